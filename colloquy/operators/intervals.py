"""Interval operators: islands, range joins, nearest and as-of lookups, differences, sweeps.

Every operator works within ``keys`` (a meeting), so shuffles are on those; a range join also deals by time bucket, so
that one long meeting is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

S, E = "start_ms", "end_ms"


def islands(df: DataFrame, keys: list[str], max_gap: int = 0) -> DataFrame:
    """(keys, ``start_ms, end_ms, n``): spans merged while the next starts at most ``max_gap`` after all before it ended."""
    w = Window.partitionBy(*keys).orderBy(S, E)
    before = F.max(E).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(S) - before > max_gap), 1).otherwise(0)
    numbered = df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min(S).alias(S), F.max(E).alias(E), F.count("*").alias("n")).drop("__island")


def covered(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``covered_ms``): the length of the union of the spans."""
    return islands(df, keys).groupBy(*keys).agg(F.sum(F.col(E) - F.col(S)).alias("covered_ms"))


def speaker_blocks(df: DataFrame, max_gap: int = 1000) -> DataFrame:
    """Consecutive utterances of one speaker at most ``max_gap`` apart, in ``idx`` order, as one block.

    A block ends where its last utterance ends, even if an earlier one ended later.
    """
    w = Window.partitionBy("meeting_id").orderBy("idx")
    same = (F.lag("speaker").over(w) == F.col("speaker")) & (F.col(S) - F.lag(E).over(w) <= max_gap)
    numbered = df.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("block", F.sum("__new").over(w))
    return numbered.groupBy("meeting_id", "block").agg(
        F.min_by("speaker", "idx").alias("speaker"), F.min_by(S, "idx").alias(S), F.max_by(E, "idx").alias(E), F.count("*").alias("n_utterances"), F.sum("n_words").alias("n_words"), F.min("idx").alias("first_idx")
    )


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], before: int = 0, after: int = 0, bucket: int = 60_000) -> DataFrame:
    """Pairs whose spans intersect, the left one widened by ``before`` and ``after``; right columns get the prefix ``r_``.

    Both sides go to every time bucket they touch; a pair is kept in the bucket where the later of the two begins.
    """
    l_start, l_end = F.col(S) - before, F.col(E) + after
    a = left.withColumn("__b", F.explode(F.sequence(F.floor(l_start / bucket), F.floor(F.greatest(l_end - 1, l_start) / bucket))))
    r = right.select(*keys, *[F.col(c).alias("r_" + c) for c in right.columns if c not in keys])
    r = r.withColumn("__b", F.explode(F.sequence(F.floor(F.col("r_" + S) / bucket), F.floor(F.greatest(F.col("r_" + E) - 1, F.col("r_" + S)) / bucket))))
    start, end = F.greatest(l_start, F.col("r_" + S)), F.least(l_end, F.col("r_" + E))
    return a.join(r, [*keys, "__b"]).filter((end > start) & (F.floor(start / bucket) == F.col("__b"))).withColumn("overlap_ms", end - start).drop("__b")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], horizon: int, order: str, value: str, bucket: int = 60_000) -> DataFrame:
    """``left`` (which needs ``row``) with the ``value`` of the nearest right span less than ``horizon`` away.

    The first by ``order`` wins a tie; null if none is near.
    """
    near = overlap_join(left, right, keys, horizon, horizon, bucket)
    gap = F.greatest(F.col("r_" + S) - F.col(E), F.col(S) - F.col("r_" + E), F.lit(0))
    best = near.filter(gap < horizon).groupBy(*keys, "row").agg(F.min_by("r_" + value, F.struct(gap, F.col("r_" + order))).alias(value))
    return left.join(best, [*keys, "row"], "left")


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``start_ms, end_ms``): the parts of the left spans' union that no right span covers.

    One sweep over the edges of both sides, without pairs: a stretch counts while a left span and no right one is open.
    """
    edge = lambda df, l, r: [df.select(*keys, F.col(S).alias("at"), F.lit(l).alias("l"), F.lit(r).alias("r")), df.select(*keys, F.col(E).alias("at"), F.lit(-l).alias("l"), F.lit(-r).alias("r"))]  # noqa: E731, E741
    edges = None
    for e in [*edge(left, 1, 0), *edge(right, 0, 1)]:
        edges = e if edges is None else edges.unionByName(e)
    w = Window.partitionBy(*keys).orderBy("at")
    at = edges.groupBy(*keys, "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    run = at.select(*keys, F.col("at").alias(S), F.lead("at").over(w).alias(E), F.sum("l").over(w).alias("l"), F.sum("r").over(w).alias("r"))
    return islands(run.filter((F.col("l") > 0) & (F.col("r") <= 0) & (F.col(E) > F.col(S))).select(*keys, S, E), keys).drop("n")


def active_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``at_ms, active``): how many spans are open from each moment at which that changes."""
    deltas = df.select(*keys, F.col(S).alias("at_ms"), F.lit(1).alias("d")).unionByName(df.select(*keys, F.col(E).alias("at_ms"), F.lit(-1).alias("d")))
    at = deltas.groupBy(*keys, "at_ms").agg(F.sum("d").alias("d"))
    return at.withColumn("active", F.sum("d").over(Window.partitionBy(*keys).orderBy("at_ms"))).drop("d")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, order: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the last right row at or before ``at``; of several at one time the last by ``order``."""
    both = left.withColumn("__right", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__o", F.lit(None).cast(right.schema[order].dataType))
    r = right.select(*keys, at, F.lit(0).alias("__right"), F.col(value).alias("__v"), F.col(order).alias("__o"))
    w = Window.partitionBy(*keys).orderBy(at, "__right", "__o").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.unionByName(r, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(w))
    return filled.filter("__right = 1").drop("__right", "__v", "__o")


def regions(reference: DataFrame, hypothesis: DataFrame, keys: list[str], collar: int = 0, skip_overlap: bool = False) -> DataFrame:
    """(keys, ``start_ms, end_ms, reference, hypothesis``): stretches between all edges, with the labels open in each.

    Stretches within ``collar`` of a reference edge, and those without a label, are left out. Both sides need ``label``.
    """
    zone = reference.select(*keys, F.explode(F.array(S, E)).alias("at")).select(*keys, (F.col("at") - collar).alias(S), (F.col("at") + collar).alias(E), F.lit(None).cast("string").alias("label"))
    named = [(reference, "ref"), (hypothesis, "hyp"), *([(zone, "zone")] if collar else [])]
    edges = None
    for df, side in named:
        for col, d in ((S, 1), (E, -1)):
            e = df.select(*keys, F.col(col).alias("at"), F.lit(side).alias("side"), "label", F.lit(d).alias("d"))
            edges = e if edges is None else edges.unionByName(e)
    w = Window.partitionBy(*keys).orderBy("at")
    cuts = edges.select(*keys, "at").distinct().select(*keys, F.col("at").alias(S), F.lead("at").over(w).alias(E)).filter(F.col(E) > F.col(S))
    spans = None
    for df, side in named:
        x = df.filter(F.col(E) > F.col(S)).select(*keys, S, E, F.lit(side).alias("side"), "label")
        spans = x if spans is None else spans.unionByName(x)
    held = overlap_join(cuts, spans, keys)
    labels = lambda side: F.array_sort(F.collect_set(F.when(F.col("r_side") == side, F.col("r_label"))))
    out = held.groupBy(*keys, S, E).agg(labels("ref").alias("reference"), labels("hyp").alias("hypothesis"), F.max((F.col("r_side") == "zone").cast("int")).alias("zone"))
    out = out.filter((F.col("zone") == 0) & (F.size("reference") + F.size("hypothesis") > 0)).drop("zone")
    return out.filter(F.size("reference") < 2) if skip_overlap else out


def overlap_fraction(df: DataFrame, keys: list[str], row: str, label: str) -> DataFrame:
    """(keys, row, ``contested_ms``): how much of each span spans of other labels cover, together."""
    pairs = overlap_join(df, df, keys).filter(F.col("r_" + label) != F.col(label))
    cut = pairs.select(*keys, row, F.greatest(S, "r_" + S).alias(S), F.least(E, "r_" + E).alias(E))
    return covered(cut, [*keys, row]).withColumnRenamed("covered_ms", "contested_ms")


def hops(start: Column, end: Column, ceiling: int, overlap: int) -> Column:
    """Windows of ``ceiling`` that step by ``ceiling - overlap`` and cover a span; the last ends with it."""
    step = ceiling - overlap
    n = F.greatest(F.ceil((end - start - overlap) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((start + i * step).alias("start_ms"), F.least(start + i * step + ceiling, end).alias("end_ms")))
