"""Permutation WER under time constraints: words may only meet where their times, widened by a collar, overlap."""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import DELETED, EQUAL, INSERTED, SUBSTITUTED, assignment, for_each_meeting, numbered, positions, sides

OUTCOMES = (SUBSTITUTED, DELETED, INSERTED, EQUAL)


def timed_tokens(utterances: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``speaker, idx, nth, token, start_ms, end_ms``): the span of an utterance dealt evenly among its ``tokens``.

    An utterance without duration gives all its tokens its span.
    """
    n, long = F.size("tokens"), F.col("end_ms") - F.col("start_ms")
    each = utterances.select(*keys, "speaker", "idx", "start_ms", "end_ms", n.alias("_n"), long.alias("_long"), F.posexplode("tokens").alias("nth", "token"))
    width = F.col("_long") / F.col("_n")
    even = (F.col("_n") > 1) & (F.col("_long") > 0)
    start = F.when(even, F.col("start_ms") + F.col("nth") * width).otherwise(F.col("start_ms").cast("double"))
    end = F.when(even, F.col("start_ms") + (F.col("nth") + 1) * width).otherwise(F.col("end_ms").cast("double"))
    return each.select(*keys, "speaker", "idx", "nth", "token", start.alias("start_ms"), end.alias("end_ms"))


def windows(ref: np.ndarray, hyp: np.ndarray, collar: float) -> tuple[np.ndarray, np.ndarray]:
    """For each reference span the first and last hypothesis span it may meet; spans are sorted by start.

    The first is the first that does not end before the collar, the last the last in a row that does not start after it; the last is
    one below the first if there is none.
    """
    low = np.searchsorted(np.maximum.accumulate(hyp[:, 1]), ref[:, 0] - collar)
    high = np.searchsorted(hyp[:, 0], ref[:, 1] + collar, side="right") - 1
    return low, np.maximum(high, low - 1)


def windowed_rows(a: list[int], b: list[int], low: np.ndarray, high: np.ndarray) -> tuple[list[tuple[int, int, int, int]], int]:
    """For each item of ``a`` (places where two meet at least cost, places where it is dropped at least cost, first place, end) and the least cost of all, where item ``i`` of ``a``
    may only meet those of ``b`` from ``low[i]`` to ``high[i]``.

    As ``scoring.edit_rows``, on the places alone that this or an earlier item may meet, and this or a later one: past them costs rise by one a place, and before them every
    item of ``a`` is dropped, whatever was met there. Places outside an item's span are as items that may not even be replaced, so a rise runs on through them.
    """
    n, m = len(a), len(b)
    spans = [(max(0, x), min(m, y + 1)) for x, y in zip(low.tolist(), high.tolist(), strict=True)]
    ends, end = [], 0
    for first, last in spans:
        end = max(end, last) if last > first else end
        ends.append(end)
    begins, begin = [0] * n, m
    for i in range(n - 1, -1, -1):
        begin = min(begin, spans[i][0]) if spans[i][1] > spans[i][0] else begin
        begins[i] = min(begin, ends[i])
    places = positions(b)
    out, rise, fall, lo, hi, cost = [], 0, 0, 0, 0, 0
    for w, (first, last), begin, end in zip(a, spans, begins, ends, strict=True):
        if end > hi:
            rise |= (1 << end - lo) - (1 << hi - lo)
            hi = end
        if begin > lo:
            passed = (1 << begin - lo) - 1
            cost += (rise & passed).bit_count() - (fall & passed).bit_count()
            rise, fall, lo = rise >> begin - lo, fall >> begin - lo, begin
        full = (1 << hi - lo) - 1
        window = (1 << last - lo) - (1 << first - lo) if last > first else 0
        found = places.get(w, 0)
        if isinstance(found, int):
            same = found >> lo & window
        else:
            same, k = 0, bisect_left(found, first)
            while k < len(found) and found[k] < last:
                same |= 1 << found[k] - lo
                k += 1
        lower = ((((same & rise) + rise) ^ rise) | same) & rise
        before = lower << 1 & full
        level = same | fall | before
        begun = fall | (full ^ (rise | same | before | fall))
        closed = rise & ~window
        start = (begun << 1 | 1) & closed
        drop = begun | (((start + closed) ^ closed) | start) & closed
        after = (drop << 1 | 1) & full
        out.append((same | window & ~level, drop, lo, hi))
        rise, fall = before | (full ^ (before | after | level)) | closed & after, after & level
    return out, cost + n + rise.bit_count() - fall.bit_count() + m - hi


def windowed_counts(a: list[int], b: list[int], low: np.ndarray, high: np.ndarray) -> tuple[int, int, int, int]:
    """(substitutions, deletions, insertions, hits) of the least-edits alignment where item ``i`` of ``a`` may only meet those of ``b`` from ``low[i]`` to ``high[i]``.

    Of equal costs, seen from the end, two items meet first, then one is dropped, then one is added.
    """
    i, j = len(a), len(b)
    rows, _ = windowed_rows(a, b, low, high)
    counts = dict.fromkeys(OUTCOMES, 0)
    while i and j:
        met, drop, lo, hi = rows[i - 1]
        at = min(j, hi) - 1 - lo
        if j <= hi and at >= 0 and met >> at & 1:
            i, j = i - 1, j - 1
            counts[EQUAL if a[i] == b[j] else SUBSTITUTED] += 1
        elif at < 0 or drop >> at & 1:
            i -= 1
            counts[DELETED] += 1
        else:
            j -= 1
            counts[INSERTED] += 1
    counts[DELETED] += i
    counts[INSERTED] += j
    return tuple(counts[op] for op in OUTCOMES)


Stream = tuple[list[str], np.ndarray]


def stream_counts(ref: Stream | None, hyp: Stream | None, collar: float) -> tuple[int, int, int, int]:
    """(substitutions, deletions, insertions, hits) of two streams of words and their spans, null for a speaker who is missing."""
    if ref is None or hyp is None:
        return 0, 0 if ref is None else len(ref[0]), 0 if hyp is None else len(hyp[0]), 0
    return windowed_counts(*numbered(ref[0], hyp[0]), *windows(ref[1], hyp[1], collar))


def timed_counts(ref: pd.DataFrame | None, hyp: pd.DataFrame | None, collar: float) -> tuple[int, int, int, int]:
    """``stream_counts`` of tables of ``token, start_ms, end_ms``."""
    stream = lambda f: None if f is None else (f["token"].tolist(), f[["start_ms", "end_ms"]].to_numpy(dtype=float))
    return stream_counts(stream(ref), stream(hyp), collar)


def speaker_stream(rows: list[dict]) -> Stream:
    """A speaker's words in order of time, with the spans that ``timed_tokens`` gives them."""
    words = []
    for row in rows:
        start, end = (math.inf if row[c] is None else float(row[c]) for c in ("start_ms", "end_ms"))
        tokens, place = row["tokens"], (row["idx"] is None, row["idx"])
        even = len(tokens) > 1 and math.inf > end > start
        width = (end - start) / len(tokens) if even else 0.0
        words += [(start + k * width, start + (k + 1) * width if even else end, place, k, w) for k, w in enumerate(tokens)]
    words.sort(key=lambda w: w[:4])
    return [w[4] for w in words], np.array([w[:2] for w in words], dtype=float)


def timed_permutation(meeting: list[dict], collar_ms: float) -> tuple[int, ...]:
    """(substitutions, deletions, insertions, hits, reference words, missed, false speakers) of a meeting's rows, all with tokens."""
    streams = [{}, {}]
    for row in meeting:
        streams[row["side"]].setdefault(row["speaker"], []).append(row)
    a, b = ([speaker_stream(rows) for _, rows in sorted((k, v) for k, v in side.items() if k is not None)] for side in streams)
    size = max(len(a), len(b))
    missed, extra = size - len(b), size - len(a)
    counts = [[stream_counts(x, y, collar_ms) for y in b + [None] * missed] for x in a + [None] * extra]
    cost = np.array([[sum(c[:3]) for c in row] for row in counts])
    best = np.array([counts[r][c] for r, c in assignment(cost)], dtype=int).reshape(-1, 4).sum(axis=0)
    return *map(int, best), int(best[0] + best[1] + best[3]), missed, extra


def time_constrained_wer(reference: DataFrame, hypothesis: DataFrame, keys: list[str], collar_ms: float = 5000) -> DataFrame:
    """(keys, ``substitutions, deletions, insertions, hits, reference_words, missed_speakers, false_alarm_speakers, tcpwer``).

    Both sides have ``speaker, idx, start_ms, end_ms, tokens``. The tokens of a speaker are a stream in order of time; speakers are paired for the fewest errors, one
    without a partner against an empty stream. One meeting is one row.
    """
    names = ["substitutions", "deletions", "insertions", "hits", "reference_words", "missed_speakers", "false_alarm_speakers"]

    def solve(meeting: list[dict]) -> tuple[int, ...]:
        return timed_permutation(meeting, collar_ms)

    spoken = sides(reference, hypothesis, keys, "start_ms", "end_ms").filter(F.size("tokens") > 0)
    found = for_each_meeting(spoken, keys, solve, dict.fromkeys(names, "long"))
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return found.withColumn("tcpwer", errors / F.greatest("reference_words", F.lit(1)))
