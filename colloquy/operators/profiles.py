"""Profiles of meetings: the languages in use, how far two views of overlapping speech agree, and errors by speaking time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A language counts from this share of the words or this many seconds; speaking times in seconds and their names.
MINORITY_SHARE, MINORITY_SECONDS = 0.10, 20.0
BUCKETS = [(15.0, "under_15s"), (60.0, "15s_to_60s"), (300.0, "1m_to_5m")]
LAST_BUCKET = "over_5m"


def language_profile(spoken: DataFrame, key: str, tag: str, amount: str, ms: str) -> DataFrame:
    """(key, ``dominant, secondary, significant, tag``) of rows with a language ``tag``, an ``amount`` of it (words, say) and its ``ms``.

    Languages rank by their share of the amount, ties by name. The tag is ``mixed`` if several languages other than ``und`` are
    significant, the significant one, or else the dominant one. Null tags count as ``und``; a key without any amount has nulls.
    """
    each = spoken.groupBy(key, F.coalesce(F.col(tag), F.lit("und")).alias("lang")).agg(F.sum(amount).alias("n"), (F.sum(ms) / 1000.0).alias("seconds"))
    total = F.sum("n").over(Window.partitionBy(key))
    ranked = each.withColumn("share", F.when(total > 0, F.col("n") / total)).withColumn("counts", F.coalesce(F.col("share") > 0, F.lit(False)))
    big = F.col("counts") & (F.col("lang") != "und") & ((F.col("share") >= MINORITY_SHARE) | (F.col("seconds") >= MINORITY_SECONDS))
    item = F.struct((-F.col("share")).alias("least"), "lang", big.alias("big"))
    held = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("counts"), item))).alias("all"))  # a row for each language
    names = F.transform("all", lambda x: x.lang)
    some = F.transform(F.filter("all", lambda x: x.big), lambda x: x.lang)
    named = held.select(key, names.alias("names"), some.alias("some"))
    rest = F.array_join(F.slice("names", F.lit(2), F.greatest(F.size("names") - 1, F.lit(0))), ",")
    tagged = F.when(F.size("some") > 1, "mixed").otherwise(F.coalesce(F.get("some", F.lit(0)), F.get("names", F.lit(0))))
    return named.select(key, F.get("names", F.lit(0)).alias("dominant"), rest.alias("secondary"), F.array_join("some", ",").alias("significant"), tagged.alias("tag"))


def overlap_agreement(reference: DataFrame, predicted: DataFrame, key: str, frame_ms: int = 1000) -> DataFrame:
    """(key, ``frames, reference_overlap_percent, predicted_overlap_percent, recall_percent, precision_percent``).

    At the middle of each frame from 0 to the last end, a side overlaps if two or more of its spans (``start_ms``, ``end_ms``, the end
    left out) hold that moment. Spans become edges, summed by moment before the shuffle, and one running sum for each key reads
    them with the frames; no span is joined with a frame.
    """

    def edges(spans: DataFrame, name: str) -> DataFrame:
        starts = spans.select(key, F.col("start_ms").alias("at"), F.lit(1).alias("step"))
        both = starts.unionByName(spans.select(key, F.col("end_ms").alias("at"), F.lit(-1).alias("step")))
        steps = both.groupBy(key, "at").agg(F.sum("step").alias("step"))
        return steps.select(key, "at", *[(F.col("step") if name == c else F.lit(0)).cast("long").alias(c) for c in ("ref", "hyp")], F.lit(False).alias("frame"))

    ends = reference.select(key, "end_ms").unionByName(predicted.select(key, "end_ms")).groupBy(key).agg(F.max("end_ms").alias("end_ms"))
    last = F.ceil((F.col("end_ms") - frame_ms / 2) / frame_ms) - 1
    frames = ends.filter(last >= 0).select(key, F.explode_outer(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("k"))
    moments = frames.select(key, (F.col("k") * frame_ms + frame_ms // 2).alias("at"), F.lit(0).cast("long").alias("ref"), F.lit(0).cast("long").alias("hyp"), F.lit(True).alias("frame"))
    run = Window.partitionBy(key).orderBy("at", "frame").rowsBetween(Window.unboundedPreceding, 0)
    swept = edges(reference, "ref").unionByName(edges(predicted, "hyp")).unionByName(moments)
    seen = swept.select(key, "frame", (F.sum("ref").over(run) >= 2).alias("truth"), (F.sum("hyp").over(run) >= 2).alias("said")).filter("frame")
    sums = seen.groupBy(key).agg(F.count("*").alias("frames"), F.count_if("truth").alias("t"), F.count_if("said").alias("s"), F.count_if(F.col("truth") & F.col("said")).alias("hit"))
    percent = lambda a, b, name: F.round(100.0 * F.col(a) / b, 6).alias(name)
    one = F.lit(1)
    return sums.select(
        key, "frames", percent("t", F.col("frames"), "reference_overlap_percent"), percent("s", F.col("frames"), "predicted_overlap_percent"),
        percent("hit", F.greatest("t", one), "recall_percent"), percent("hit", F.greatest("s", one), "precision_percent"),
    )


def duration_bucket(seconds: Column) -> Column:
    """The name of the range of speaking time that holds ``seconds``."""
    out = F.lit(LAST_BUCKET)
    for bound, name in reversed(BUCKETS):
        out = F.when(seconds < bound, F.lit(name)).otherwise(out)
    return out


def errors_by_speaking_time(outcomes: DataFrame) -> DataFrame:
    """(``bucket, speakers, found, reference_words, hits, wer``) of speakers' outcomes.

    ``outcomes`` has a row for each speaker: ``seconds``, ``matched`` (null if no cluster was paired with the speaker), ``reference_words``,
    ``hits, substitutions, deletions, insertions``. A speaker is found if paired with at least one word right; the error
    rate is over all words of a bucket, 0 without words.
    """
    rows = outcomes.withColumn("bucket", duration_bucket(F.col("seconds"))).withColumn("errors", F.col("substitutions") + F.col("deletions") + F.col("insertions"))
    held = rows.groupBy("bucket").agg(
        F.count("*").alias("speakers"), F.count_if(F.col("matched").isNotNull() & (F.col("hits") > 0)).alias("found"),
        F.sum("reference_words").alias("reference_words"), F.sum("hits").alias("hits"), F.sum("errors").alias("errors"),
    )
    return held.select("bucket", "speakers", "found", "reference_words", "hits", F.round(F.when(F.col("reference_words") > 0, F.col("errors") / F.col("reference_words")).otherwise(0.0), 6).alias("wer"))
