"""Several systems' transcripts of the same meetings against one reference: scores, speakers' outcomes, gates and a report.

A meeting with all its systems is one row: its words are dealt once, whatever the number of scores.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profiles import BUCKETS, LAST_BUCKET, duration_bucket
from .scoring import align_words, assignment, diarization_counts, edit_counts, gate_status, permutation_counts, rate, rows_for_each_meeting, sides, spoken_words, stream_distance
from .timed import timed_permutation

COUNTS = ("substitutions", "deletions", "insertions", "hits")


def by_place(rows: list[dict]) -> list[dict]:
    """Rows in order of ``idx``, null first, and of their tokens where that is the same."""
    return sorted(rows, key=lambda r: (r["idx"] is not None, r["idx"] or 0, [(w is not None, w or "") for w in r["tokens"] or ()]))


def speaker_streams(rows: list[dict]) -> dict[str | None, tuple[tuple[str, ...], float]]:
    """Each speaker's tokens in order of ``idx`` and time spoken. Null speakers are one of their own."""
    tokens: dict[str | None, list[str]] = {}
    spoken: dict[str | None, float] = {}
    for row in by_place(rows):
        tokens.setdefault(row["speaker"], []).extend(row["tokens"] or ())
        known = row["start_ms"] is not None and row["end_ms"] is not None
        spoken[row["speaker"]] = spoken.get(row["speaker"], 0.0) + (max(row["end_ms"] - row["start_ms"], 0) if known else 0)
    return {x: (tuple(tokens[x]), spoken[x]) for x in tokens}


def meeting_outcomes(reference: list[dict], hypothesis: list[dict], distance: Callable = stream_distance, counts: Callable = edit_counts) -> list[tuple]:
    """(speaker, speech_ms, reference_words, matched, substitutions, deletions, insertions, hits) of every reference speaker; see ``speaker_outcomes``."""
    a = speaker_streams(reference)
    name = lambda x: (x is None, x)
    b = {x: tokens for x, (tokens, _) in speaker_streams(hypothesis).items() if tokens}
    rows, columns = sorted((x for x in a if a[x][0]), key=name), sorted(b, key=name)
    # pairing saves the words of both sides that need no edit of their own: substitutions once, hits twice
    saved = np.array([[len(a[x][0]) + len(b[y]) - distance(a[x][0], b[y]) for y in columns] for x in rows], dtype=float)
    same = np.array([[x == y for y in columns] for x in rows], dtype=float)
    pairs = {rows[r]: columns[c] for r, c in assignment(-(saved * (len(rows) + 1) + same))}
    found = {x: counts(a[x][0], b[y]) for x, y in pairs.items()}
    return [(x, float(spoken), len(tokens), pairs.get(x), *found.get(x, (0, len(tokens), 0, 0))) for x, (tokens, spoken) in a.items()]


def speaker_outcomes(reference: DataFrame, hypothesis: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``speaker, seconds, bucket, reference_words, matched, substitutions, deletions, insertions, hits, wer, word_recall``) of every reference speaker.

    Both sides have ``speaker, idx, start_ms, end_ms, tokens``. Speakers with words are paired for the fewest word errors, one to one; of equally good pairings one with the most pairs of
    equal names. A speaker without a partner has ``matched`` null and all words deleted. One meeting is one row.
    """

    def solve(meeting: list[dict]) -> list[tuple]:
        return meeting_outcomes(*([r for r in meeting if r["side"] == n] for n in (0, 1)))

    columns = {"speaker": "string", "speech_ms": "double", "reference_words": "long", "matched": "string"} | dict.fromkeys(COUNTS, "long")
    found = rows_for_each_meeting(sides(reference, hypothesis.dropna(subset=keys), keys, "start_ms", "end_ms"), keys, solve, columns)
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    recall = F.when(F.col("reference_words") > 0, F.col("hits") / F.col("reference_words")).otherwise(0.0)
    out = found.select(*keys, "speaker", (F.col("speech_ms") / 1000.0).alias("seconds"), "reference_words", "matched", *COUNTS)
    return out.withColumns({"bucket": duration_bucket(F.col("seconds")), "wer": rate(errors, F.col("reference_words")), "word_recall": recall})


def for_each_system(reference: DataFrame, hypotheses: DataFrame, key: str) -> DataFrame:
    """The reference once for each ``system`` that has the meeting."""
    return reference.join(hypotheses.select(key, "system").distinct(), key)


def system_scores(meeting: list[dict], collar_ms: float, distance: Callable, counts: Callable) -> tuple | None:
    """(reference_words, hypothesis_words, wer, cpwer, tcpwer, wder) of a system's rows of a meeting; none if neither side has a word."""
    said = [[w for row in by_place([r for r in meeting if r["side"] == n]) for w in row["tokens"] or ()] for n in (0, 1)]
    if not any(said):
        return None
    steps = align_words(*said)
    subs, dels, adds, hits = edit_counts(*said, steps)
    same_order = all([w for w, _ in spoken_words(meeting, n)] == said[n] for n in (0, 1))
    wrong, aligned = diarization_counts(meeting, steps if same_order else None)
    timed = timed_permutation([r for r in meeting if r["tokens"]], collar_ms)
    cpwer = permutation_counts(meeting, distance, counts)[-1]
    words = hits + subs + dels
    return words, hits + subs + adds, (subs + dels + adds) / max(words, 1), cpwer, sum(timed[:3]) / max(timed[4], 1), wrong / aligned if aligned else 0.0


def kept_words(outcomes: list[tuple]) -> list[float | None]:
    """The share of words kept by speakers of each range of speaking time, null without such a speaker."""
    hits, words = {}, {}
    for _, spoken, n, *_, kept in outcomes:
        name = next((name for bound, name in BUCKETS if spoken / 1000.0 < bound), LAST_BUCKET)
        hits[name], words[name] = hits.get(name, 0) + kept, words.get(name, 0) + n
    return [hits[name] / max(words[name], 1) if name in hits else None for name in RANGES]


SCORES = {"reference_words": "long", "hypothesis_words": "long"} | dict.fromkeys(("wer", "cpwer", "tcpwer", "wder"), "double")
RANGES = [n for _, n in BUCKETS] + [LAST_BUCKET]


def compare_systems(reference: DataFrame, hypotheses: DataFrame, key: str = "meeting_id", collar_ms: float = 5000, kept: bool = False) -> DataFrame:
    """(key, ``system, reference_words, hypothesis_words, wer, cpwer, tcpwer, wder, rank``): every system's scores on every meeting that it has.

    Both sides have ``speaker, idx, start_ms, end_ms, tokens``, ``hypotheses`` also ``system``. Systems rank within a meeting by WER, those with the same by name. A meeting that only
    one side has is left out, and a system where neither side has a word. With ``kept`` such a system stays, without scores and rank, and the share of words kept by speaking time
    comes in a column for each range (``RANGES``).
    """
    columns = {"system": "string"} | SCORES | {"rank": "long"} | (dict.fromkeys(RANGES, "double") if kept else {})

    def solve(meeting: list[dict]) -> list[tuple]:
        meeting.sort(key=lambda r: (r["start_ms"] is None, r["start_ms"]))  # parts of one utterance in order of time
        said = [r for r in meeting if r["side"] == 0]
        heard: dict[str, list[dict]] = {}
        for row in meeting:
            if row["side"]:
                heard.setdefault(row["system"], []).append(row)
        if not said:
            return []
        edits = cache(stream_distance), cache(edit_counts)  # scores and outcomes ask for the same streams
        scores = {name: system_scores(said + rows, collar_ms, *edits) for name, rows in heard.items()}
        ranks = {name: n for n, name in enumerate(sorted((x for x in scores if scores[x]), key=lambda x: (scores[x][2], x)), 1)}
        more = {name: kept_words(meeting_outcomes(said, rows, *edits)) if kept else [] for name, rows in heard.items()}
        return [(name, *(scores[name] or [None] * len(SCORES)), ranks.get(name), *more[name]) for name in heard if kept or scores[name]]

    rows = sides(reference.withColumn("system", F.lit(None).cast("string")), hypotheses.dropna(subset=[key, "system"]), [key], "start_ms", "end_ms", "system")
    return rows_for_each_meeting(rows, [key], solve, columns).withColumn("rank", F.col("rank").cast("int"))


def comparison_markdown(scores: DataFrame, outcomes: DataFrame | None = None, key: str = "meeting_id") -> DataFrame:
    """(key, ``document``): a table of ``compare_systems`` in order of rank and the share of words kept by speaking time, from ``outcomes`` (``speaker_outcomes`` with ``system``) or
    from the columns of ``kept``."""
    percent = lambda c: F.when(c.isNotNull(), F.format_string("%.2f %%", 100 * c.cast("double"))).otherwise("n/a")
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    gather = lambda order, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x.l), "\n")
    heads = ["System", "WER", "cpWER", "tcpWER", "WDER"]
    table = "| " + " | ".join(heads) + " |\n| --- |" + " ---: |" * (len(heads) - 1) + "\n"
    line = row([F.col("system"), *[percent(F.col(c)) for c in ("wer", "cpwer", "tcpwer", "wder")]])
    begin, end = (F.concat(F.lit("# Comparison of meeting "), F.first(F.col(key)).cast("string"), F.lit("\n\n" + table))), F.lit("\n")
    second = "\n## Words kept, by how long their speakers spoke\n\n| System | " + " | ".join(RANGES) + " |\n| --- |" + " ---: |" * len(RANGES) + "\n"
    cells = row([F.col("system"), *[percent(F.col(n)) for n in RANGES]])
    if outcomes is None and set(RANGES) <= set(scores.columns):
        ranked = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct(F.col("rank").alias("o"), line.alias("l"))))), lambda x: x.l), "\n")
        both = scores.groupBy(key).agg(F.concat(begin, ranked, end, F.lit(second), gather(F.col("system"), cells), end).alias("document"), F.count("rank").alias("_n"))
        return both.filter("_n > 0").drop("_n")
    told = scores.groupBy(key).agg(F.concat(begin, gather(F.col("rank"), line), end).alias("document"))
    if outcomes is None:
        return told
    share = outcomes.groupBy(key, "system").pivot("bucket", RANGES).agg(F.sum("hits") / F.greatest(F.sum("reference_words"), F.lit(1)))
    kept = share.groupBy(key).agg(F.concat(F.lit(second), gather(F.col("system"), cells), end).alias("_kept"))
    return told.join(kept, key, "left").select(key, F.concat("document", F.coalesce("_kept", F.lit(""))).alias("document"))


def gate_verdicts(observations: DataFrame, gates: DataFrame, fallback: str) -> DataFrame:
    """Observations (``subject, kind, language, metric, value``) against the gates (``kind, language, tier, metric, op, threshold``) that apply to them, with ``status``.

    A gate for language ``all`` applies to every observation of its kind. A language for which a kind has no gate of its own is judged by the gates of ``fallback``. Observations without a
    gate and gates without an observation give no row; a null value is ``missing``.
    """
    own = gates.filter("language <> 'all'").select("kind", F.col("language").alias("judged")).distinct()
    rows = observations.join(own, (observations["kind"] == own["kind"]) & (observations["language"] == own["judged"]), "left").drop(own["kind"])
    judged = rows.withColumn("judged", F.explode(F.array(F.coalesce("judged", F.lit(fallback)), F.lit("all"))))
    g = gates.withColumnRenamed("language", "judged")
    met = judged.join(g, ["kind", "judged", "metric"])
    return met.select("subject", "kind", "language", "tier", "metric", "value", "op", "threshold", gate_status(F.col("value"), F.col("op"), F.col("threshold")).alias("status"))
