"""Transcript and speaker quality: word and character errors, permutation WER, diarization errors, roll-ups, gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import E, S, regions


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column of a least-cost assignment, by shortest augmenting paths; the smaller side is assigned whole."""
    cost = np.asarray(cost, dtype=float)
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assignment(cost.T))
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        assign_row(cost, start, row_price, col_price, owner)
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)


def assign_row(cost: np.ndarray, start: int, row_price: np.ndarray, col_price: np.ndarray, owner: np.ndarray) -> None:
    """One more row of an assignment, by the shortest augmenting path; prices and the columns' ``owner`` change in place."""
    m = cost.shape[1]
    best, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
    at, row, column = 0.0, start, -1
    while True:
        reach = at + cost[row] - row_price[row] - col_price
        better = ~done & (reach < best - 1e-12)
        best[better], back[better] = reach[better], column
        column = int(np.where(done, np.inf, best).argmin())
        at, done[column] = best[column], True
        if owner[column] < 0:
            break
        row = owner[column]
    for c in np.nonzero(done)[0]:
        if c != column:
            row_price[owner[c]] += at - best[c]
        col_price[c] -= at - best[c]
    row_price[start] += at
    while column >= 0:
        previous = back[column]
        owner[column] = owner[previous] if previous >= 0 else start
        column = previous


EQUAL, SUBSTITUTED, DELETED, INSERTED = "equal", "substitute", "delete", "insert"
#: rows from one kept row of an alignment to the next
STRIDE = 128


#: up to so many items their places are bits, and up to so many bits of rows an alignment keeps all of them
SHORT, WHOLE = 4096, 1 << 24


def positions(items: list[int]) -> dict[int, int] | dict[int, list[int]]:
    """The places of each item: the bits of a whole number, or lists where there are more than ``SHORT``."""
    if len(items) > SHORT:
        lists: dict[int, list[int]] = {}
        for j, w in enumerate(items):
            lists.setdefault(w, []).append(j)
        return lists
    found: dict[int, int] = {}
    bit = 1
    for w in items:
        found[w] = found.get(w, 0) | bit
        bit <<= 1
    return found


def place_sets(places: dict[int, int] | dict[int, list[int]], full: int) -> Callable[[int], int]:
    """What gives an item's places among those of ``full`` as bits; sets of many places are kept."""
    if isinstance(next(iter(places.values()), 0), int):
        return lambda w: places.get(w, 0) & full
    kept: dict[int, int] = {}

    def find(w: int) -> int:
        same = kept.get(w)
        if same is None:
            found, same = places.get(w, ()), 0
            for j in found:
                same |= 1 << j
            same &= full
            if len(found) > 8:
                kept[w] = same
        return same

    return find


def edit_rows(reference: list[int], places: dict[int, int] | dict[int, list[int]], size: int, state: tuple[int, int] | None = None) -> Iterator[tuple[int, int, int, int]]:
    """For each reference word four sets of the first ``size`` hypothesis places, as the bits of whole numbers: where least edits rise from the row above, where they
    fall from it one place before, and where they rise and fall along the row. ``state`` is the last two of the row above.

    These are Myers' bit vectors in the form of Hyyrö: a row costs a few operations on numbers of ``size`` bits.
    """
    full = (1 << size) - 1
    rise, fall = state or (full, 0)
    find = place_sets(places, full)
    for w in reference:
        same = find(w)
        level = ((((same & rise) + rise) ^ rise) | same) & full
        met = same | fall
        drop = fall | (full ^ (level | rise))
        before = (rise & level) << 1 & full
        down = (drop << 1 | 1) & full
        rise, fall = before | (full ^ (met | down)), down & met
        yield drop, before, rise, fall


def edit_distance(reference: list[int], hypothesis: list[int]) -> int:
    """The least number of edits between two lists of numbers."""
    if len(reference) > len(hypothesis):
        reference, hypothesis = hypothesis, reference
    rise, fall = (1 << len(hypothesis)) - 1, 0
    for _, _, rise, fall in edit_rows(reference, positions(hypothesis), len(hypothesis)):
        pass
    return len(reference) + rise.bit_count() - fall.bit_count()


def common_length(reference: list[int], hypothesis: list[int]) -> int:
    """The length of a longest common subsequence of two lists of numbers."""
    full = (1 << len(hypothesis)) - 1
    find = place_sets(positions(hypothesis), full)
    left = full
    for w in reference:
        both = left & find(w)
        left = ((left + both) | (left - both)) & full
    return len(hypothesis) - left.bit_count()


def same_ends(a: list[int], b: list[int]) -> tuple[int, int]:
    """How many items two lists both begin and, past those, both end with."""
    short = min(len(a), len(b))
    head = next((i for i in range(short) if a[i] != b[i]), short)
    return head, next((i for i in range(short - head) if a[-1 - i] != b[-1 - i]), short - head)


def _bits(number: int, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(number.to_bytes((size + 7) // 8, "little"), dtype=np.uint8), count=size, bitorder="little").astype(np.int64)


def _reach(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """(row, first, last): every ``STRIDE`` rows, and at both ends, the columns between which all least-edits alignments pass."""
    n, m = len(a), len(b)

    def kept(x: list[int], y: list[int], wanted: set[int]) -> dict[int, tuple[int, int]]:
        return {i: (rise, fall) for i, (_, _, rise, fall) in enumerate(edit_rows(x, positions(y), m), 1) if i in wanted}

    rows = list(range(STRIDE, n, STRIDE))
    there, back = kept(a, b, {*rows, n}), kept(a[::-1], b[::-1], {n - i for i in rows})
    least = n + there[n][0].bit_count() - there[n][1].bit_count()
    run = lambda state, i: np.append(i, i + np.cumsum(_bits(state[0], m) - _bits(state[1], m)))
    out = [(0, 0, 0)]
    for i in rows:
        on = np.flatnonzero(run(there[i], i) + run(back[n - i], n - i)[::-1] == least)
        out.append((i, int(on[0]), int(on[-1])))
    return [*out, (n, m, m)]


def most_hits(a: list[int], b: list[int]) -> tuple[int, int]:
    """(edits, hits) of a least-edits alignment with the most hits. Only the cells that such an alignment can reach are filled."""
    n, m = len(a), len(b)
    wide = m + n + 2
    never = (wide + 1) * wide
    reach = _reach(a, b) if n > STRIDE else [(0, 0, 0), (n, m, m)]
    other = np.array(b, dtype=np.int64)
    # cost * wide - hits, so that the least value has fewest edits and then most hits
    value = np.zeros(1, dtype=np.int64)
    for (i0, first, last), (i1, first1, last1) in zip(reach, reach[1:], strict=False):
        value = np.append(value, np.full(last1 - last, never))
        steps = np.arange(last1 - first + 1, dtype=np.int64) * wide
        value = np.minimum.accumulate(value - steps) + steps
        part = other[first:last1]
        for w in a[i0:i1]:
            best = value + wide
            best[1:] = np.minimum(best[1:], value[:-1] + np.where(part == w, -1, wide))
            value = np.minimum.accumulate(best - steps) + steps
        value = value[first1 - first :]
    edits = -(-int(value[-1]) // wide)
    return edits, edits * wide - int(value[-1])


def edit_counts(reference: Sequence[str], hypothesis: Sequence[str], steps: list[tuple[str, int, int]] | None = None) -> tuple[int, int, int, int]:
    """(substitutions, deletions, insertions, hits) of a least-edits alignment; of several, one with the most hits. ``steps`` are those of ``align_words``, if they are known.

    Words that both begin or end with are hits. An alignment with as many hits as the longest common subsequence, or without substitutions, has the most; else they are searched for.
    """
    a, b = numbered(reference, hypothesis)
    head, tail = same_ends(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(a), len(b)
    ops = [op for op, _, _ in (least_edits(a, b) if steps is None else steps[head : len(steps) - tail])]
    hits, subs = ops.count(EQUAL), ops.count(SUBSTITUTED)
    if subs and hits < common_length(a, b):
        edits, hits = most_hits(a, b)
        # hits + subs + dels = n, hits + subs + ins = m, subs + dels + ins = edits
        subs = n + m - 2 * hits - edits
    return subs, n - hits - subs, m - hits - subs, hits + head + tail


def least_edits(reference: list[int], hypothesis: list[int]) -> list[tuple[str, int, int]]:
    """The steps (outcome, reference place, hypothesis place; -1 for none) of a least-edits alignment of two lists of numbers.

    Of equal costs, seen from the end, a word is dropped first, then added where that was cheaper before, then two words meet. Every ``STRIDE``-th row is kept, and the
    rows between them are made again on the way back; all rows are kept while they have at most ``WHOLE`` bits.
    """
    places, m = positions(hypothesis), len(hypothesis)
    states = [((1 << m) - 1, 0)]
    stride = max(len(reference), 1) if len(reference) * m <= WHOLE else STRIDE
    if stride == STRIDE:
        states += [(rise, fall) for i, (_, _, rise, fall) in enumerate(edit_rows(reference, places, m), 1) if i % STRIDE == 0]
    i, j, out = len(reference), m, []
    while i and j:
        top = (i - 1) // stride * stride
        within = (1 << j) - 1
        rise, fall = states[top // stride]
        rows = [(drop, before) for drop, before, _, _ in edit_rows(reference[top:i], places, j, (rise & within, fall & within))]
        while i > top and j:
            drop, before = rows[i - 1 - top]
            if drop >> (j - 1) & 1:
                i -= 1
                out.append((DELETED, i, -1))
            elif before >> (j - 1) & 1:
                j -= 1
                out.append((INSERTED, -1, j))
            else:
                i, j = i - 1, j - 1
                out.append((EQUAL if reference[i] == hypothesis[j] else SUBSTITUTED, i, j))
    return [*((INSERTED, -1, k) for k in range(j)), *((DELETED, k, -1) for k in range(i)), *out[::-1]]


def numbered(reference: Sequence[str], hypothesis: Sequence[str]) -> tuple[list[int], list[int]]:
    """Words as numbers, equal words alike."""
    ids = {w: i for i, w in enumerate(dict.fromkeys([*reference, *hypothesis]))}
    return [ids[w] for w in reference], [ids[w] for w in hypothesis]


def align_words(reference: list[str], hypothesis: list[str]) -> list[tuple[str, int, int]]:
    """``least_edits`` of two lists of words; words that both begin or end with are equal without a search."""
    a, b = numbered(reference, hypothesis)
    head, tail = same_ends(a, b)
    inner = least_edits(a[head : len(a) - tail], b[head : len(b) - tail])
    shift = lambda k: k + head if k >= 0 else k
    return [(EQUAL, k, k) for k in range(head)] + [(op, shift(i), shift(j)) for op, i, j in inner] + [(EQUAL, len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by their keys to as many tasks as a shuffle has: meetings are small to send and long to align, so tasks joined by their bytes would leave cores idle.

    By a hash of the keys: after an aggregation by the keys themselves Spark would leave the exchange out, and join its tasks.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def sides(reference: DataFrame, hypothesis: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Utterances (``side, speaker, idx, tokens`` and ``more``) of the reference, side 0, and the hypothesis, side 1."""
    one = lambda df, n: df.select(*keys, F.lit(n).alias("side"), "speaker", "idx", *more, "tokens")
    return one(reference, 0).unionByName(one(hypothesis, 1))


def for_each_meeting(rows: DataFrame, keys: list[str], solve: Callable[[list[dict]], tuple], columns: dict[str, str]) -> DataFrame:
    """(keys, ``columns``, names with their types): what ``solve`` makes of each meeting's rows, in no order, as dictionaries.

    A meeting is a row of an Arrow batch, which costs far less than a group of its own.
    """
    return rows_for_each_meeting(rows, keys, lambda meeting: [solve(meeting)], columns)


def rows_for_each_meeting(rows: DataFrame, keys: list[str], solve: Callable[[list[dict]], list[tuple]], columns: dict[str, str]) -> DataFrame:
    """``for_each_meeting`` where ``solve`` makes any number of rows of a meeting.

    Rows go to their meetings in one shuffle, by a hash of the keys (see ``spread``) that is grouped by as well.
    """
    dealt = rows.withColumn("_deal", F.xxhash64(*keys)).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_deal")
    held = dealt.groupBy("_deal", *keys).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in keys])).alias("_rows")).drop("_deal")
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solve(meeting.as_py()) for meeting in batch.column("_rows")]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            values = [pa.array([row[i] for x in found for row in x], types[kind]) for i, kind in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(owner) for k in keys], *values], names=[*keys, *columns])

    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} {kind}" for c, kind in columns.items()]
    return held.mapInArrow(run, ", ".join(kinds))


def in_order(rows: list[dict], side: int) -> list[dict]:
    return sorted((r for r in rows if r["side"] == side), key=lambda r: (r["idx"] is None, r["idx"]))


def spoken_words(meeting: list[dict], side: int) -> list[tuple[str, str]]:
    """(word, speaker) of one side, in order."""
    return [(w, row["speaker"]) for row in in_order(meeting, side) for w in row["tokens"] or ()]


def diarization_counts(meeting: list[dict], steps: list[tuple[str, int, int]] | None = None) -> tuple[int, int]:
    """(wrong, aligned) of ``word_diarization_errors``; ``steps`` are those of ``align_words``, if they are known."""
    said = [spoken_words(meeting, n) for n in (0, 1)]
    steps = align_words(*([w for w, _ in s] for s in said)) if steps is None else steps
    places = [(i, j) for op, i, j in steps if op == EQUAL]
    rows, columns = ({x: i for i, x in enumerate(dict.fromkeys(x for _, x in s))} for s in said)
    agree = np.zeros((len(rows), len(columns)))
    for i, j in places:
        agree[rows[said[0][i][1]], columns[said[1][j][1]]] += 1
    right = sum(agree[r, c] for r, c in assignment(-agree))
    return len(places) - int(right), len(places)


def word_diarization_errors(reference: DataFrame, hypothesis: DataFrame, key: str | list[str]) -> DataFrame:
    """(key, ``wrong, aligned, wder``): equal aligned words whose speakers are not paired, speakers being paired for the most equal words.

    Both sides have ``idx, speaker, tokens``; 0 of no words is 0. One meeting is one row.
    """
    keys = [key] if isinstance(key, str) else key
    found = for_each_meeting(sides(reference, hypothesis, keys), keys, diarization_counts, {"wrong": "long", "aligned": "long"})
    return found.withColumn("wder", F.when(F.col("aligned") > 0, F.col("wrong") / F.col("aligned")).otherwise(0.0))


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two token arrays, on the JVM: each distinct token becomes one code point, from U+0100 on and past the surrogates.

    There are over a million of them, more distinct tokens than the distance of a pair could be computed for.
    """
    both = F.array_distinct(F.concat(reference, hypothesis))
    point = lambda w: F.array_position(both, w) + 0xFF + F.when(F.array_position(both, w) + 0xFF >= 0xD800, 0x800).otherwise(0)
    code = lambda w: F.decode(F.unhex(F.lpad(F.hex(point(w)), 8, "0")), "UTF-32")
    text = lambda a: F.array_join(F.transform(a, code), "")
    return F.levenshtein(text(reference), text(hypothesis)).cast("long")


def rate(errors: Column, total: Column) -> Column:
    """Errors over the reference's size, which counts as one at least."""
    return errors / F.greatest(total, F.lit(1))


def error_rollup(pairs: DataFrame, dataset: str = "dataset", language: str = "language") -> DataFrame:
    """Sums of ``errors`` and ``reference_words`` by (dataset, language), by language and over all, in one aggregation."""
    d, lang = F.col(dataset), F.col(language)
    sums = [F.sum("errors").alias("errors"), F.sum("reference_words").alias("reference_words"), F.count("*").alias("n_pairs")]
    out = pairs.groupingSets([[d, lang], [lang], []], d, lang).agg(F.grouping(dataset).alias("gd"), F.grouping(language).alias("gl"), *sums)
    name = lambda g, c: F.when(F.col(g) == 1, F.lit("all")).otherwise(F.col(c))
    return out.select(name("gd", dataset).alias(dataset), name("gl", language).alias(language), "errors", "reference_words", "n_pairs", rate(F.col("errors"), F.col("reference_words")).alias("wer"))


def _pairing(seconds: list[dict]) -> list[tuple[str, str, float]]:
    """Labels paired for the most time; of equal times, the most pairs that share any."""
    known = [x for x in seconds if x["a"] is not None and x["b"] is not None]
    a, b = (sorted({x[side] for x in known}) for side in "ab")
    row, column = ({label: i for i, label in enumerate(labels)} for labels in (a, b))
    table = np.zeros((len(a), len(b)))
    for x in known:
        table[row[x["a"]], column[x["b"]]] += x["v"]
    # whole milliseconds, so that a unit for each pair decides between equal times alone
    pairs = assignment(-(table * (len(known) + 1) + (table > 0)))
    return [(a[r], b[c], float(table[r, c])) for r, c in pairs if table[r, c] > 0]


def speaker_mapping(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``a, b, shared_ms``): the pairing of reference and hypothesis labels that share the most time; of equal ones, that of the most pairs.

    The shared times are a Spark aggregation; a meeting's row holds one number for each pair of its speakers.
    """
    shared = found.select(*keys, F.explode("reference").alias("a"), "hypothesis", (F.col(E) - F.col(S)).alias("v")).select(*keys, "a", F.explode("hypothesis").alias("b"), "v")
    sums = shared.groupBy(*keys, "a", "b").agg(F.sum("v").cast("double").alias("v"))
    return rows_for_each_meeting(sums, keys, _pairing, {"a": "string", "b": "string", "shared_ms": "double"})


def diarization_errors(reference: DataFrame, hypothesis: DataFrame, keys: list[str], collar: int = 250, skip_overlap: bool = False) -> DataFrame:
    """(keys, ``missed_ms, false_alarm_ms, confusion_ms, total_ms, der``). 0 of 0 is 0, anything of 0 is 1."""
    found = regions(reference, hypothesis, keys, collar, skip_overlap)
    pairs = speaker_mapping(found, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("a", "b"))).alias("map"))
    joined = found.join(pairs, keys, "left")
    right = F.when(F.col("map").isNull(), F.lit(0)).otherwise(F.size(F.filter("reference", lambda a: F.array_contains(F.col("hypothesis"), F.col("map")[a]))))
    n, m, d = F.size("reference"), F.size("hypothesis"), F.col(E) - F.col(S)
    out = joined.groupBy(*keys).agg(
        F.sum(F.greatest(n - m, F.lit(0)) * d).alias("missed_ms"), F.sum(F.greatest(m - n, F.lit(0)) * d).alias("false_alarm_ms"),
        F.sum((F.least(n, m) - right) * d).alias("confusion_ms"), F.sum(n * d).alias("total_ms"),
    )
    errors = F.col("missed_ms") + F.col("false_alarm_ms") + F.col("confusion_ms")
    return out.withColumn("der", F.when(F.col("total_ms") > 0, errors / F.col("total_ms")).when(errors > 0, 1.0).otherwise(0.0))


def jaccard_errors(reference: DataFrame, hypothesis: DataFrame, keys: list[str], collar: int = 250) -> DataFrame:
    """(keys, ``label, jer``): for each reference speaker 1 minus the time shared with its partner over their union."""
    found = regions(reference, hypothesis, keys, collar)
    d = (F.col(E) - F.col(S)).alias("d")
    ref = found.select(*keys, F.explode("reference").alias("a"), d).groupBy(*keys, "a").agg(F.sum("d").alias("ra"))
    hyp = found.select(*keys, F.explode("hypothesis").alias("b"), d).groupBy(*keys, "b").agg(F.sum("d").alias("hb"))
    joined = ref.join(speaker_mapping(found, keys), [*keys, "a"], "left").join(hyp, [*keys, "b"], "left")
    shared = F.coalesce("shared_ms", F.lit(0.0))
    return joined.select(*keys, F.col("a").alias("label"), (1 - shared / (F.col("ra") + F.coalesce("hb", F.lit(0)) - shared)).alias("jer"))


def stream_distance(reference: Sequence[str], hypothesis: Sequence[str]) -> int:
    """``edit_distance`` of two streams of words."""
    return edit_distance(*numbered(reference, hypothesis))


def permutation_counts(meeting: list[dict], distance: Callable = stream_distance, counts: Callable = edit_counts) -> tuple:
    """(substitutions, deletions, insertions, hits, reference words, cpWER) of a meeting's rows. ``distance`` and ``counts`` of two tuples of words can be ones that remember."""
    streams = [{}, {}]
    for side in (0, 1):
        for row in in_order(meeting, side):
            streams[side].setdefault(row["speaker"], []).extend(row["tokens"] or ())
    a, b = [[tuple(x) for x in s.values()] for s in streams]
    size = max(len(a), len(b))
    a, b = a + [()] * (size - len(a)), b + [()] * (size - len(b))
    cost = np.array([[distance(x, y) for y in b] for x in a])
    best = np.array([counts(a[r], b[c]) for r, c in assignment(cost)]).sum(axis=0)
    words = sum(map(len, a))
    return *map(int, best), words, float(best[:3].sum() / max(words, 1))


def permutation_wer(reference: DataFrame, hypothesis: DataFrame, keys: list[str]) -> DataFrame:
    """cpWER, (keys, ``substitutions, deletions, insertions, hits, reference_words, cpwer``).

    Both sides have ``speaker, idx, tokens``. Each speaker's tokens are joined in order; speakers are paired for the fewest errors,
    one without a partner against an empty stream. One meeting is one row.
    """

    names = ["substitutions", "deletions", "insertions", "hits", "reference_words"]
    return for_each_meeting(sides(reference, hypothesis, keys), keys, permutation_counts, dict.fromkeys(names, "long") | {"cpwer": "double"})


def align_pairs(pairs: DataFrame, reference: str, hypothesis: str, keep: list[str]) -> DataFrame:
    """(keep, ``substitutions, deletions, insertions, hits``) of each row's two token arrays, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [edit_counts(list(r), list(h)) for r, h in zip(f[reference], f[hypothesis], strict=True)]
            yield pd.concat([f[keep].reset_index(drop=True), pd.DataFrame(got, columns=["substitutions", "deletions", "insertions", "hits"], dtype="int64")], axis=1)

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in keep)
    return pairs.select(*keep, reference, hypothesis).mapInPandas(run, f"{kinds}, substitutions long, deletions long, insertions long, hits long")


def gate_status(value: Column, op: Column, threshold: Column) -> Column:
    """passed, failed, or missing for a null value."""
    holds = F.when(op == "<=", value <= threshold).when(op == "<", value < threshold).when(op == ">=", value >= threshold).when(op == ">", value > threshold).when(op == "==", value == threshold)
    return F.when(value.isNull(), "missing").when(holds, "passed").otherwise("failed")


def evaluate_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Each gate (``metric, op, threshold``) with the metric's ``value`` and ``status``: passed, failed or missing."""
    return gates.join(metrics, "metric", "left").withColumn("status", gate_status(F.col("value"), F.col("op"), F.col("threshold")))
