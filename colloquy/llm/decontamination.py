"""Benchmark decontamination: passages of training texts search a BM25 index of benchmark items.

The index is over pieces of items, with each posting's BM25 part divided by the piece's own full score, so that one
threshold suits pieces of every length. Postings are cut into blocks that know their largest part; block-max WAND skips
blocks that cannot reach the threshold, and returns every piece that does.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .encoding import slices

_SPLIT = r"[^\p{L}\p{N}_]+"
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case, cut the same way as whole columns are."""
    return [w for w in pc.split_pattern_regex(pc.utf8_lower(pa.array([text])), _SPLIT)[0].as_py() if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words as question and answer: the last sentence or line is the answer; the second half if there is one only."""
    parts = [p for p in (words_of(s) for s in _SENTENCE.split(text)) if p]
    if len(parts) > 1 and len(parts[-1]) >= 3:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = [w for p in parts for w in p]
    return words[: len(words) // 2], words[len(words) // 2 :]


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def overlap(part: list[str], passage: list[str], n: int = 3) -> float:
    """The share of a part's word n-grams (of all its words, if it has fewer) that a passage has; 1 for a part without words."""
    if not part:
        return 1.0
    own = grams(part, min(n, len(part)))
    return len(own & grams(passage, min(n, len(part)))) / len(own)


@dataclass
class Piece:
    item: object
    question: list[str]
    answer: list[str]
    #: question and answer of the whole item, if this is a run of it
    whole: tuple[list[str], list[str]] | None = None


@dataclass
class BlockMaxIndex:
    """Postings by term, in ascending piece number: numbers, parts, and for each block its last number and largest part."""

    pieces: list[Piece]
    terms: dict[str, int]
    numbers: list[list[int]]
    parts: list[list[float]]
    lasts: list[list[int]]
    tops: list[list[float]]
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    block: int = 2
    #: terms that are not common, each with its blocks (places in ``block_of`` and ``top_of``)
    rare: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    block_of: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    top_of: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: for each block the most that the common terms of one piece of it can add
    common_of: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def build(cls, pieces: list[Piece], df: dict[str, int], n: int, mean: float, k1: float = 1.2, b: float = 0.75, block: int = 2, common: float = 0.1) -> BlockMaxIndex:
        """``df``: pieces of the whole benchmark that hold a term; terms in more than 8 and the share ``common`` of them are common."""
        often = max(8, common * n)
        postings: dict[str, list[tuple[int, float]]] = {}
        mass = np.zeros(-(-len(pieces) // block))
        for at, p in enumerate(pieces):
            tf = Counter(p.question + p.answer)
            size = sum(tf.values())
            part = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * size / mean)) for w, f in tf.items()}
            full = sum(part.values())
            mass[at // block] = max(mass[at // block], sum(x for w, x in part.items() if df[w] > often) / full)
            for w, x in part.items():
                postings.setdefault(w, []).append((at, x / full))
        terms = {w: i for i, w in enumerate(postings)}
        lists = list(postings.values())
        cut = [[p[i : i + block] for i in range(0, len(p), block)] for p in lists]
        rare = np.array([df[w] <= often for w in terms], dtype=bool)
        tops: list[dict[int, float]] = []
        for p, keep in zip(lists, rare, strict=True):
            tops.append({})
            for at, x in p if keep else ():
                tops[-1][at // block] = max(x, tops[-1].get(at // block, 0.0))
        return cls(
            pieces, terms, [[x[0] for x in p] for p in lists], [[x[1] for x in p] for p in lists],
            [[c[-1][0] for c in cs] for cs in cut], [[max(x[1] for x in c) for c in cs] for cs in cut],
            np.array([max(x[1] for x in p) for p in lists]), block,
            rare, np.cumsum([0, *map(len, tops)]), np.array([k for t in tops for k in t], dtype=np.int64), np.array([x for t in tops for x in t.values()]), mass,
        )

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every piece whose parts at ``terms`` sum to ``threshold`` or more, by block-max WAND."""
        threshold -= 1e-9
        cursors = [[self.numbers[t][0], t, 0] for t in terms]  # current number, term, place
        found, end = [], len(self.pieces)

        def advance(c: list, to: int) -> None:
            numbers = self.numbers[c[1]]
            c[2] = bisect_left(numbers, to, c[2])
            c[0] = numbers[c[2]] if c[2] < len(numbers) else end

        while True:
            cursors.sort()
            while cursors and cursors[-1][0] == end:
                cursors.pop()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.most[c[1]]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return found
            number = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == number:
                pivot += 1
            # the largest part that each list has in its block around the pivot, and where the first block ends
            bound, reach = 0.0, end
            for c in cursors[: pivot + 1]:
                lasts = self.lasts[c[1]]
                k = bisect_left(lasts, number, c[2] // self.block)
                if k < len(lasts):
                    bound += self.tops[c[1]][k]
                    reach = min(reach, lasts[k])
            if bound < threshold:
                after = min(reach + 1, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end)
                for c in cursors[: pivot + 1]:
                    if c[0] < after:
                        advance(c, max(after, number + 1) if after <= number else after)
                continue
            if cursors[0][0] < number:
                for c in cursors[: pivot + 1]:
                    if c[0] < number:
                        advance(c, number)
                continue
            score = sum(self.parts[c[1]][c[2]] for c in cursors[: pivot + 1])
            if score >= threshold:
                found.append((number, score))
            for c in cursors[: pivot + 1]:
                advance(c, number + 1)


@dataclass(frozen=True)
class Search:
    """``passage`` words from every ``stride`` on are one query. An item is cut into pieces of at most ``stride`` words."""

    passage: int = 128
    stride: int = 64
    threshold: float = 0.6
    least_question: float = 0.5
    least_answer: float = 0.5
    in_order: int = 8  # items of fewer words must occur as they are


def items_to_pieces(item: object, text: str, most: int) -> list[Piece]:
    """A short item is one piece; of a longer one each run of ``most`` words is, and knows the item's own question and answer.

    A last run under a quarter of ``most``, which many texts could hold, is the last ``most`` words instead. The runs only serve
    the search.
    """
    question, answer = question_and_answer(text)
    words = question + answer
    if len(words) <= most:
        return [Piece(item, question, answer)] if words else []
    cut = [words[i : i + most] for i in range(0, len(words), most)]
    if 4 * len(cut[-1]) < most:
        cut[-1] = words[-most:]
    return [Piece(item, c[: len(c) // 2], c[len(c) // 2 :], (question, answer)) for c in cut]


def overlaps(p: Piece, have: list[str], how: Search) -> tuple[float, float]:
    """How much of the item's question and answer a stretch of text holds; an item of few words is there in one run or not at all."""
    question, answer = p.whole or (p.question, p.answer)
    if len(question) + len(answer) < how.in_order:
        there = overlap(question + answer, have, how.in_order)
        return there, there
    return overlap(question, have), overlap(answer, have)


def promising(index: BlockMaxIndex, window: np.ndarray, term: np.ndarray, windows: int, threshold: float) -> list[int]:
    """The windows with a block that can reach the threshold: the largest parts there of their rare terms, and the block's common mass.

    A block without a rare term of the window has the common mass alone; if that suffices somewhere, all ``windows`` count
    as promising, which is slow but exact.
    """
    if (index.common_of >= threshold - 1e-9).any():
        return list(range(windows))
    size = index.first[term + 1] - index.first[term]
    done = np.cumsum(size)
    at = np.repeat(index.first[term] - (done - size), size) + np.arange(done[-1] if len(done) else 0)
    blocks = len(index.common_of)
    key, place = np.unique(np.repeat(window, size) * blocks + index.block_of[at], return_inverse=True)
    bound = np.bincount(place, index.top_of[at], len(key)) + index.common_of[key % blocks]
    return np.unique(key[bound >= threshold - 1e-9] // blocks).tolist()


def search_texts(index: BlockMaxIndex, texts: pa.Array, how: Search) -> Iterator[tuple[int, object, float, float, float, int]]:
    """(row, item, score, question overlap, answer overlap, first word of the passage) of every verified passage.

    Words are looked up a column at a time, each distinct one once. A passage for which no block's bound reaches the threshold
    can match nothing; only the others are searched.
    """
    n = max(1, len(index.terms))
    done = 0
    for part in slices(texts):
        cut = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(part, "")), _SPLIT)
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = np.fromiter((-2 if not w else index.terms.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        term = known[np.asarray(coded.indices)]
        offsets = np.asarray(cut.offsets, dtype=np.int64) - cut.offsets[0].as_py()
        owner = np.repeat(np.arange(len(cut)), np.diff(offsets))
        real = term != -2  # the empty strings at a text's ends are no words
        flat = np.nonzero(real)[0]
        term, owner = term[real], owner[real]
        begin = np.searchsorted(owner, np.arange(len(cut) + 1))
        place = np.arange(len(term)) - begin[owner]
        # windows are numbered over the whole column: a text of m words has one for each stride, at least one
        count = np.maximum(1, -(-np.diff(begin) // how.stride))
        first = np.cumsum(count) - count
        rare = np.nonzero((term >= 0) & np.append(index.rare, False)[term])[0]
        window, term_at = first[owner[rare]] + place[rare] // how.stride, term[rare]
        keys = []
        for back in range(-(-how.passage // how.stride)):
            ok = place[rare] // how.stride >= back
            keys.append((window[ok] - back) * n + term_at[ok])
        pair = np.unique(np.concatenate(keys))
        w, t = pair // n, pair % n
        for k in promising(index, w, t, int(count.sum()), how.threshold):
            row = int(np.searchsorted(first, k, side="right")) - 1
            at = (k - int(first[row])) * how.stride
            s, e = begin[row] + at, min(begin[row] + at + how.passage, begin[row + 1])
            matches = index.search(np.unique(term[s:e][term[s:e] >= 0]).tolist(), how.threshold)
            if matches:
                for number, score in matches:
                    p = index.pieces[number]
                    # the item that a run belongs to can reach as far as its own length to both sides
                    far = sum(map(len, p.whole)) if p.whole else 0
                    have = [words[i] for i in np.asarray(coded.indices)[flat[max(begin[row], s - far) : min(begin[row + 1], e + far)]]]
                    q, a = overlaps(p, have, how)
                    if q >= how.least_question and a >= how.least_answer:
                        yield done + row, p.item, score, q, a, at
        done += len(part)


def build_indexes(bench: DataFrame, how: Search, id_col: str, text_col: str, most_bytes: int) -> Iterator[BlockMaxIndex]:
    """Indexes of the items, each over at most about ``most_bytes`` of text; document frequencies cover all items."""
    rows = bench.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    size, kind = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], bench.schema[id_col].dataType.simpleString()
    shards = -(-size // most_bytes)

    run = pa.struct([("question", pa.list_(pa.string())), ("answer", pa.list_(pa.string()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [p for p in (items_to_pieces(i, t, how.stride) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) if p]
            runs = [[{"question": p.question, "answer": p.answer} for p in ps] for ps in found]
            whole = [ps[0].whole or (None, None) for ps in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ps[0].item for ps in found], b.column(0).type), pa.array(runs, pa.list_(run)), *(pa.array([w[k] for w in whole], pa.list_(pa.string())) for k in range(2))], ["id", "runs", "question", "answer"]
            )

    items = rows.mapInArrow(cut, f"id {kind}, runs array<struct<question array<string>, answer array<string>>>, question array<string>, answer array<string>")
    pieces = items.select("id", F.explode("runs").alias("run")).select("id", "run.*")
    every = F.concat("question", "answer")
    n, total = pieces.agg(F.count("*"), F.sum(F.size(every))).first()
    if not n:
        return
    df = pieces.select(F.explode(F.array_distinct(every)).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    for k in range(shards):
        here = pieces.filter(F.pmod(F.xxhash64("id"), F.lit(shards)) == k)
        own = here.select(F.explode(every).alias("w")).distinct().join(df, "w")
        counts = {r.w: r.df for r in own.collect()}  # the terms of one shard
        held = []
        for r in items.filter(F.pmod(F.xxhash64("id"), F.lit(shards)) == k).orderBy("id", "runs").collect():
            whole = None if r.question is None else (r.question, r.answer)  # one copy for all runs
            held += [Piece(r.id, x.question, x.answer, whole) for x in r.runs]
        if held:
            yield BlockMaxIndex.build(held, counts, n, total / n)


def contaminated(docs: DataFrame, bench: DataFrame, how: Search = Search(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_bytes: int = 32 << 20) -> DataFrame:
    """One row for each pair of a document and an item that it contains: ``id_col, item_col, score, question_overlap, answer_overlap, first_word``.

    The row is of the passage of the highest score. Every passage of every whole text is a query; a pair counts if a
    passage reaches the threshold of the item's (or a run of a long item's) own BM25 score, and it (for a long item, with the
    item's length around it) holds enough of the word 3-grams of the item's question and of its answer, or all of an item
    of fewer than 8 words in one run. Items without words and null texts match nothing; null ids
    are kept as they are; repeated rows count once for each id; an empty table on either side gives an empty one.
    An index that is broadcast holds at most ``most_bytes`` of item text; more items make more indexes, each of which
    all texts are searched against.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), bench.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, score double, question_overlap double, answer_overlap double, first_word long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for built in build_indexes(bench, how, item_col, item_text_col, most_bytes):
        index = spark.sparkContext.broadcast(built)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = list(search_texts(index.value, b.column(1), how))
                cols = list(zip(*found, strict=True)) or [()] * 6
                arrays = [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1]) if cols[1] else pa.array([], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:5]), pa.array(cols[5], pa.int64())]
                if found:
                    yield pa.RecordBatch.from_arrays(arrays, ["id", "item", "score", "question_overlap", "answer_overlap", "first_word"])

        got = rows.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("first_word")).alias("back"))).alias("x")
    best = out.groupBy("id", "item").agg(best)
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "x.score", "x.question_overlap", "x.answer_overlap", (-F.col("x.back")).alias("first_word"))


def decontaminate(docs: DataFrame, bench: DataFrame, how: Search = Search(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns, whatever their names.

    A text is judged whole, however long, and by itself: rows with a null id or a repeated one are searched too, and rows with one text, named by 128 bits of
    hashes, go or stay together. Null and empty texts stay; without items all rows stay; an empty table gives an empty one.
    """
    key = fresh(docs, "_key")
    name = F.concat(F.hex(F.xxhash64(text_col)), F.lit("-"), F.hex(F.xxhash64(F.lit("text"), text_col)))
    hits = contaminated(docs.select(name.alias(key), F.col(text_col)), bench, how, key, text_col, item_col, item_text_col)
    return docs.withColumn(key, name).join(hits.select(key).distinct(), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
