"""Planning of recognition segments from spans of speech."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import E, S, hops


def plan_segments(speech: DataFrame, key: str = "meeting_id", total: str = "total_ms", ceiling: int = 30_000, dense_ceiling: int = 15_000, dense: float = 0.85, gap: int = 400, padding: int = 200, least: int = 1000, overlap: int = 2000) -> DataFrame:
    """(key, ``nth, start_ms, end_ms``): spans of speech grouped while near and short enough, padded, and cut where too long.

    A span joins the group before it if it starts at most ``gap`` after that ends and the group stays within the ceiling, which
    is ``dense_ceiling`` where speech fills the share ``dense`` of the recording. Groups shorter than ``least`` go. The fold
    over one meeting's sorted spans is an array expression.
    """
    held = speech.groupBy(key).agg(F.max(total).alias("total"), F.sum(F.col(E) - F.col(S)).alias("said"), F.array_sort(F.collect_list(F.struct(F.col(S).alias("s"), F.col(E).alias("e")))).alias("spans"))
    cap = F.when(F.col("said") >= dense * F.col("total"), F.lit(dense_ceiling)).otherwise(F.lit(ceiling))
    held = held.withColumn("cap", cap)

    def join(groups, x):
        last = F.element_at(groups, -1)
        fits = (F.size(groups) > 0) & (x.s - F.try_element_at(groups, F.lit(-1)).e <= gap) & (x.e - F.try_element_at(groups, F.lit(-1)).s <= F.col("cap"))
        return F.when(fits, F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(F.struct(last.s.alias("s"), x.e.alias("e"))))).otherwise(F.concat(groups, F.array(F.struct(x.s.alias("s"), x.e.alias("e")))))

    kind = "array<struct<s bigint,e bigint>>"
    groups = F.aggregate("spans", F.array().cast(kind), join)
    each = held.select(key, "total", "cap", F.posexplode(groups).alias("g", "x")).filter(F.col("x.e") - F.col("x.s") >= least)
    start, end = F.greatest(F.col("x.s") - padding, F.lit(0)), F.least(F.col("x.e") + padding, F.col("total"))
    small, large = hops(start, end, dense_ceiling, min(overlap, dense_ceiling // 3)), hops(start, end, ceiling, min(overlap, ceiling // 3))
    cut = each.select(key, "g", F.posexplode(F.when(F.col("cap") == dense_ceiling, small).otherwise(large)).alias("k", "w"))
    return cut.select(key, F.struct("g", "k").alias("nth"), F.col("w.start_ms").alias(S), F.col("w.end_ms").alias(E))
