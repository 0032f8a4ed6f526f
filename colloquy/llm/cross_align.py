"""Alignment of two tokenizations of the same bytes, and how often pairs of their ids are linked in a corpus.

The ends of both token sequences, united, cut a text into elementary intervals. Each interval lies in one token of either side, found by
binary search in its ends, and is the whole overlap of those two. Ends that both sides share close a group of tokens that cover the
same bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_counted, save
from .encoding import IdCoder, PieceCoder, byte_letters, coder, slices

SIDE = 20  # bits of an id in a pair of ids
CACHED = 250_000  # pieces that each of the two coders of a worker keeps at least
RUN = 1_500_000  # bytes of text that are aligned together


class SpacedCoder(IdCoder):
    """Ids of a space and the text by a byte-level vocabulary. The strings of special tokens are plain text."""

    before = " "

    def __init__(self, path: str, most: int = CACHED) -> None:
        super().__init__(path, most)
        self.library.encode_special_tokens = True
        self.special = {}
        back = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        entries = self.library.get_vocab(with_added_tokens=True)
        self.data = [b""] * (1 + max(entries.values()))
        for entry, k in entries.items():
            self.data[k] = b"".join([back.get(c, b"") for c in entry])

    def plain(self, texts: pa.Array) -> np.ndarray:
        odd = pc.or_(pc.starts_with(texts, "\n"), pc.equal(texts, ""))
        return super().plain(texts) & ~np.asarray(pc.fill_null(odd, True), dtype=bool)

    def spread(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """As in ``PieceCoder``, but the first piece has a space before it like all others."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        begins = np.asarray(cut.offsets, dtype=np.int64)
        coded = cut.flatten().dictionary_encode()
        return self.look_up(self.inner, coded.dictionary.to_pylist(), self.before), np.array(coded.indices, dtype=np.int64), (begins - begins[0])[:-1]

    def encode(self, text: str | None) -> bytes:
        return super().encode(" " + text) if text else b""


class SentenceCoder(SpacedCoder):
    """Ids by a sentencepiece model that puts a space before the text itself.

    Words are looked up one by one if the model keeps texts as they are and has no piece that goes past a space or a line end; every other
    text or model takes the library on whole texts.
    """

    before = ""

    def __init__(self, path: str, most: int = CACHED) -> None:
        import sentencepiece

        PieceCoder.__init__(self, most)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.data = [bytes([int(p[3:5], 16)]) if self.library.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        kept = self.library.normalize("a  ﬁ\n ") == "▁a▁▁ﬁ\n▁"
        within = all("\n" not in p and ("▁" not in p[1:] or not p.strip("▁")) for p in names)
        self.pattern = kept and within and self.library.encode("\n") == [self.library.piece_to_id("▁"), self.library.piece_to_id("<0x0A>")]
        self.special = {"▁": 0}

    def compute(self, texts: list[str]) -> list[bytes]:
        made = self.library.encode(texts, num_threads=1)
        return [np.asarray(ids[1:] if t[:1] == "\n" else ids, dtype="<u4").tobytes() for t, ids in zip(texts, made, strict=True)]

    def encode(self, text: str | None) -> bytes:
        return np.asarray(self.library.encode(text), dtype="<u4").tobytes() if text else b""


@dataclass
class Alignment:
    """Aligned texts of one run; places count tokens of the run, ``*_upto[k]`` is where text ``k`` ends."""

    a: np.ndarray
    b: np.ndarray
    a_upto: np.ndarray
    b_upto: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_upto: np.ndarray
    group_of_a: np.ndarray
    group_of_b: np.ndarray
    group_upto: np.ndarray


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the elementary intervals of two rising sequences with one last value, and the owner of each on both sides."""
    ends = np.union1d(ends_a, ends_b)
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def _same_bytes(ids: list[np.ndarray], data: list[bytes], want: list[bytes]) -> np.ndarray:
    each = [b"".join(map(data.__getitem__, x.tolist())) for x in ids]
    return np.fromiter((x == w for x, w in zip(each, want, strict=True)), dtype=bool, count=len(want))


def align(texts: pa.Array, a: SpacedCoder, b: SentenceCoder) -> Alignment:
    """Both encodings of each text of a run, aligned; a text that is null, empty or not given back byte for byte by both has no tokens."""
    want = [b" " + t.encode() if t else b"" for t in texts.to_pylist()]
    ids_a, ids_b = list(a.encode_all(texts)), list(b.encode_all(texts))
    good = _same_bytes(ids_a, a.data, want) & _same_bytes(ids_b, b.data, want)
    none = np.zeros(0, dtype="<u4")
    ids_a, ids_b = ([x if ok else none for x, ok in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
    flat_a, flat_b = (np.concatenate([none, *ids]).astype(np.int64) for ids in (ids_a, ids_b))
    sizes_a, sizes_b = (np.fromiter(map(len, c.data), dtype=np.int64, count=len(c.data)) for c in (a, b))
    ends_a, ends_b = np.cumsum(sizes_a[flat_a]), np.cumsum(sizes_b[flat_b])
    ends, own_a, own_b = intervals(ends_a, ends_b)
    shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
    upto = np.cumsum(np.where(good, np.fromiter(map(len, want), dtype=np.int64, count=len(want)), 0))
    return Alignment(
        flat_a, flat_b, np.searchsorted(ends_a, upto, "right"), np.searchsorted(ends_b, upto, "right"), own_a, own_b, np.searchsorted(ends, upto, "right"),
        np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b), np.searchsorted(shared, upto, "right"),
    )


class GroupWriter:
    """The text of a text's groups, ``a1,a2|b1;a3|b2,b3``, from a table of ids with what follows them."""

    def __init__(self, n_ids: int) -> None:
        self.words = np.array([f"{k}{after}" for k in range(n_ids) for after in ",|;"], dtype=object)

    def texts(self, x: Alignment) -> Iterator[str]:
        turn_a, turn_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, dtype=bool) for g in (x.group_of_a, x.group_of_b))
        words = np.empty(len(x.a) + len(x.b), dtype=object)
        words[np.arange(len(x.a)) + np.searchsorted(x.group_of_b, x.group_of_a)] = self.words[3 * x.a + turn_a]
        words[np.arange(len(x.b)) + np.searchsorted(x.group_of_a, x.group_of_b, "right")] = self.words[3 * x.b + 2 * turn_b]
        words, at = words.tolist(), 0
        for end in (x.a_upto + x.b_upto).tolist():
            yield "".join(words[at:end])[:-1]
            at = end


@lru_cache(maxsize=1)
def _writer(n_ids: int) -> GroupWriter:
    return GroupWriter(n_ids)


def _each(upto: np.ndarray) -> np.ndarray:
    return np.diff(upto, prepend=0)


def _lists(values: np.ndarray, upto: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), pa.array(values, kind))


def _digests(x: Alignment, writer: GroupWriter) -> dict[str, pa.Array]:
    """Counts, the hash of the groups, and the distinct pairs of ids that are linked with how often."""
    text = np.repeat(np.arange(len(x.link_upto)), _each(x.link_upto))
    key, times = np.unique(text << 2 * SIDE | x.a[x.link_a] << SIDE | x.b[x.link_b], return_counts=True)
    upto = np.searchsorted(key, np.arange(1, len(x.link_upto) + 1) << 2 * SIDE)
    products = np.bincount(x.group_of_a) * np.bincount(x.group_of_b)
    over = np.concatenate([[0], np.cumsum(products)])[x.group_upto]
    digest = [sha256(t.encode()).hexdigest() if t else "" for t in writer.texts(x)]
    counts = {"n_a": x.a_upto, "n_b": x.b_upto, "n_groups": x.group_upto, "n_links": x.link_upto, "n_products": over}
    out = {k: pa.array(_each(v), pa.int64()) for k, v in counts.items()} | {"groups_sha256": pa.array(digest, pa.string())}
    return out | {"pairs": _lists(key & (1 << 2 * SIDE) - 1, upto, pa.int64()), "times": _lists(times, upto, pa.int32())}


def _whole(x: Alignment) -> dict[str, pa.Array]:
    """Ids, links as places within the text, and the number of tokens of each group."""
    first_a, first_b = (np.concatenate([[0], u[:-1]]) if len(u) else u for u in (x.a_upto, x.b_upto))
    text = np.repeat(np.arange(len(x.link_upto)), _each(x.link_upto))
    of = {"a_ids": (x.a, x.a_upto), "b_ids": (x.b, x.b_upto), "link_a": (x.link_a - first_a[text], x.link_upto), "link_b": (x.link_b - first_b[text], x.link_upto)}
    of |= {"group_a": (np.bincount(x.group_of_a), x.group_upto), "group_b": (np.bincount(x.group_of_b), x.group_upto)}
    return {k: _lists(v, upto, pa.int32()) for k, (v, upto) in of.items()}


DIGESTS = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_products": "bigint", "groups_sha256": "string", "pairs": "array<bigint>", "times": "array<int>"}
WHOLE = dict.fromkeys(["a_ids", "b_ids", "link_a", "link_b", "group_a", "group_b"], "array<int>")


def _mapped(docs: DataFrame, a_path: str, b_path: str, text_col: str, types: dict[str, str], keep: list[str]) -> DataFrame:
    names = {k: fresh(docs.select(keep), k) for k in types}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coder(SpacedCoder, a_path), coder(SentenceCoder, b_path)
        for batch in batches:
            at = 0
            for part in slices(batch.column(text_col), RUN):
                rows = batch.slice(at, len(part)).select(keep)
                at += len(part)
                x = align(part, a, b)
                if types is WHOLE:
                    made = _whole(x)
                else:
                    made = _digests(x, _writer(max(len(a.data), len(b.data))))
                yield pa.RecordBatch.from_arrays([*rows.columns, *[made[k] for k in types]], names=[*keep, *names.values()])

    kept = docs.select(keep).schema
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept] + [f"`{names[k]}` {t}" for k, t in types.items()])
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the alignment of each text: ``a_ids, b_ids``, links as places in them (``link_a, link_b``), tokens of each group (``group_a, group_b``).

    ``a_path`` is a byte-level vocabulary of the tokenizers library, which takes a space and the text; ``b_path`` a sentencepiece model, which adds that space.
    Links are the pairs of tokens whose bytes overlap; they fall into groups, and all pairs of a group are ``group_a * group_b``. Texts that are null,
    empty, or that a tokenizer does not give back byte for byte have empty arrays. Texts are taken whole; repeated rows each give the same
    row; an empty table gives an empty one; a result whose name ``docs`` has already gets underscores before it.
    """
    return _mapped(docs, a_path, b_path, text_col, WHOLE, docs.columns)


def link_report(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_products``, as ``align_tokens`` aligns it.

    The count of a pair of ids is the number of rows of ``docs`` that hold it linked. ``n_best`` counts the links whose pair has the highest count of its A id, ties
    included; ``count_sum`` adds the counts of all links; ``n_products`` adds ``a * b`` over the groups. Texts are encoded once: each
    row's distinct pairs are written, and pairs that more than a thousandth of the rows' pairs are get their counts by broadcast, the others by a shuffle.
    Texts without tokens have zeros and an empty hash. Ids may be null or repeat.
    """
    row = fresh(docs, "_row")
    keep = [id_col, row]
    made, _ = save(_mapped(docs.select(id_col, text_col).withColumn(row, F.monotonically_increasing_id()), a_path, b_path, text_col, DIGESTS, keep), "links")
    each = made.select(F.col(row), F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(row, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = each.groupBy("pair").agg(F.count("*").alias("held")).withColumn("a", F.shiftright("pair", SIDE))
    top = counts.groupBy("a").agg(F.max("held").alias("most"))
    known, _ = save(counts.join(top, "a").select("pair", "held", (F.col("held") == F.col("most")).alias("best")), "pair-counts")
    joined = join_counted(each, known, ["pair"], F.col("held"))
    sums = joined.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0).cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return made.drop("pairs", "times").join(sums, row, "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", "n_products")
