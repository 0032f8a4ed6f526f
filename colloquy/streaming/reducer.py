"""Who spoke when, from the events of a meeting's live signals: a roster, owners of audio sources, and three signals of which the surest counts.

Events have (key, ``seq, at_ms, kind, sources, names, people``): ``roster`` brings ``people`` (``id, name, sources``), ``mapping`` owners of sources (``people`` without names), ``csrc`` and
``dominant`` speaking ``sources``, ``dom`` speaking ``names``; ``seq`` is the order in which they came.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unicode import folded

SIGNALS = ["csrc", "dominant", "dom"]  # the surest first
SPEAKING, CONTESTED, SILENT, UNKNOWN = "speaking", "contested", "silent", "unknown"
EVENT = "seq long, at_ms long, kind string, sources array<int>, names array<string>, people array<struct<id:string,name:string,sources:array<int>>>"


@dataclass(frozen=True)
class Timeline:
    lag_ms: float = 0.0
    least_ms: float = 300.0
    contest_ms: float = 0.0
    cross_check: bool = True
    ignored: tuple[str, ...] = ()


def roster(events: DataFrame, key: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(key, ``id, name, sources, fold, joined``): the last record of each participant; ``joined`` is when the first came."""
    each = events.filter("kind = 'roster'").select(key, "seq", F.posexplode("people").alias("n", "p")).select(key, "seq", "n", "p.*").withColumn("fold", folded(F.coalesce("name", F.lit(""))))
    kept = each.filter(~F.col("fold").isin([x.lower() for x in ignored])) if ignored else each
    return kept.groupBy(key, "id").agg(F.max_by(F.struct("name", "sources", "fold"), F.struct("seq", "n")).alias("r"), F.min(F.struct("seq", "n")).alias("joined")).select(key, "id", "r.*", "joined")


def source_owners(events: DataFrame, people: DataFrame, key: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(key, ``source, owner``): the last owner that a roster or a mapping gave a source, if they are in the roster, else the first participant who lists it.

    Records of names that are ignored give no owner; a mapping may name someone who comes to the roster later.
    """
    each = events.filter("kind in ('roster', 'mapping')").select(key, "seq", "kind", F.posexplode("people").alias("n", "p"))
    left_out = (F.col("kind") == "roster") & folded(F.coalesce("p.name", F.lit(""))).isin([x.lower() for x in ignored]) if ignored else F.lit(False)
    said = each.filter(~left_out).select(key, "seq", "n", "p.id", F.explode("p.sources").alias("source"))
    last = said.join(people.select(key, "id", F.lit(True).alias("known")), [key, "id"], "left")
    owner = last.groupBy(key, "source").agg(F.max_by(F.struct("id", "known"), F.struct("seq", "n")).alias("o"))
    listed = people.select(key, "id", "joined", F.explode("sources").alias("source")).groupBy(key, "source").agg(F.min_by("id", "joined").alias("lister"))
    both = owner.join(listed, [key, "source"], "full")
    return both.select(key, "source", F.when(F.col("o.known"), F.col("o.id")).otherwise(F.col("lister")).alias("owner")).filter("owner is not null")


def transitions(events: DataFrame, key: str) -> DataFrame:
    """The events of the three signals that differ from the one before them of the same signal, in the order in which they came."""
    w = Window.partitionBy(key, "kind").orderBy("seq")
    told = F.struct(F.coalesce("sources", F.array().cast("array<int>")).alias("s"), F.coalesce("names", F.array().cast("array<string>")).alias("n"))
    rows = events.filter(F.col("kind").isin(SIGNALS)).withColumn("_told", told)
    return rows.withColumn("_before", F.lag("_told").over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("_told"))).select(key, "seq", "at_ms", "kind", F.col("_told.s").alias("sources"), F.col("_told.n").alias("names"))


def assertions(events: DataFrame, people: DataFrame, key: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(key, ``seq, at_ms, kind, resolved, unresolved``): who each change of a signal says is speaking.

    A name is that of a participant, or begins it, or begins with it; the earliest participant of several.
    """
    raw = transitions(events, key)
    by_source = raw.select(key, "seq", F.explode("sources").alias("source")).join(source_owners(events, people, key, ignored), [key, "source"], "left").select(key, "seq", F.col("owner").alias("who"))
    said = raw.select(key, "seq", F.explode("names").alias("said")).withColumn("_f", folded(F.col("said")))
    said = said.filter(~F.col("_f").isin([x.lower() for x in ignored])) if ignored else said
    near = (F.col("fold") == F.col("_f")) | F.startswith("fold", F.col("_f")) | F.startswith(F.col("_f"), F.col("fold"))
    rank = F.struct((F.col("fold") != F.col("_f")).alias("part"), "joined")
    names = said.select(key, "_f").distinct().join(people.select(key, "id", "fold", "joined"), key).filter(near).groupBy(key, "_f").agg(F.min_by("id", rank).alias("who"))
    by_name = said.join(names, [key, "_f"], "left").select(key, "seq", "who")
    told = by_source.unionByName(by_name).groupBy(key, "seq").agg(F.array_sort(F.collect_set("who")).alias("resolved"), F.count_if(F.col("who").isNull()).alias("unresolved"))
    none = F.array().cast("array<string>")
    return raw.select(key, "seq", "at_ms", "kind").join(told, [key, "seq"], "left").select(key, "seq", "at_ms", "kind", F.coalesce("resolved", none).alias("resolved"), F.coalesce("unresolved", F.lit(0).cast("long")).alias("unresolved"))


def _merged(slices: DataFrame, key: str) -> DataFrame:
    """Touching slices with one state, speaker and candidates as one, with the first one's signal."""
    w = Window.partitionBy(key).orderBy("start_ms")
    same = F.col("state").eqNullSafe(F.lag("state").over(w)) & F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) & F.col("candidates").eqNullSafe(F.lag("candidates").over(w)) & (F.lag("end_ms").over(w) >= F.col("start_ms") - 1e-6)
    run = slices.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    first = lambda c: F.min_by(c, "start_ms").alias(c)
    return run.groupBy(key, "_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), first("state"), first("speaker"), first("candidates"), first("signal")).drop("_run")


def _contested(slices: DataFrame, key: str, window_ms: float) -> DataFrame:
    """Where one speaker follows another at once, half the window on either side, at most half of what a slice has, is contested between them."""
    w, half = Window.partitionBy(key).orderBy("start_ms"), window_ms / 2
    long = F.col("end_ms") - F.col("start_ms")
    swap = lambda at: (F.col("state") == SPEAKING) & (at("state") == SPEAKING) & (at("speaker") != F.col("speaker"))
    before, after = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    cut = slices.withColumn("_in", F.when(F.coalesce(swap(before), F.lit(False)), F.least(F.lit(half), long / 2)).otherwise(0.0))
    cut = cut.withColumn("_out", F.when(F.coalesce(swap(after), F.lit(False)), F.least(F.lit(half), (long - F.col("_in")) / 2)).otherwise(0.0))
    bridge = F.struct((F.col("start_ms") - before("_out")).alias("start_ms"), (F.col("start_ms") + F.col("_in")).alias("end_ms"), F.lit(CONTESTED).alias("state"), F.lit(None).cast("string").alias("speaker"), F.array_sort(F.array(before("speaker"), F.col("speaker"))).alias("candidates"), before("signal").alias("signal"))
    own = F.struct((F.col("start_ms") + F.col("_in")).alias("start_ms"), (F.col("end_ms") - F.col("_out")).alias("end_ms"), "state", "speaker", "candidates", "signal")
    parts = cut.select(key, F.array_compact(F.array(own, F.when(F.coalesce(swap(before), F.lit(False)), bridge))).alias("p"))
    return parts.select(key, F.explode("p").alias("p")).select(key, "p.*").filter(F.col("end_ms") - F.col("start_ms") > 1e-6)


def speaker_timeline(events: DataFrame, meetings: DataFrame, key: str = "meeting_id", how: Timeline = Timeline()) -> DataFrame:
    """(key, ``start_ms, end_ms, state, speaker, candidates, signal``) of each meeting (key, ``origin_ms, finish_ms``), times counted from its origin.

    At any time the surest signal that has said anything counts. It says silence, one speaker, or several, which are contested; one whom another signal contradicts is
    contested too, and someone not in the roster is unknown. Short speech counts as silence. Names and owners are resolved with the whole roster, so late rosters
    help earlier signals. Every step is a join or a window by meeting; events may come in any order of rows.
    """
    people = roster(events, key, how.ignored)
    bounds = meetings.filter("finish_ms > origin_ms").select(key, "origin_ms", (F.col("finish_ms") - F.col("origin_ms")).cast("double").alias("horizon"))
    told = assertions(events, people, key, how.ignored).join(bounds, key)
    at = F.least(F.greatest(F.col("at_ms") - how.lag_ms - F.col("origin_ms"), F.lit(0.0)), F.col("horizon"))
    says = F.struct("resolved", "unresolved")
    placed = told.select(key, at.alias("t"), F.col("at_ms").alias("o"), "seq", "kind", says.alias("says"))
    edges = bounds.select(key, F.explode(F.array(F.lit(0.0), F.col("horizon"))).alias("t"), F.lit(None).cast("long").alias("o"), F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("struct<resolved:array<string>,unresolved:bigint>").alias("says"))
    rows = placed.unionByName(edges)
    w = Window.partitionBy(key).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.select(key, "t", "seq", *[F.last(F.when(F.col("kind") == s, F.col("says")), ignorenulls=True).over(w).alias(s) for s in SIGNALS])
    last = held.groupBy(key, "t").agg(F.max_by(F.struct(*SIGNALS), "seq").alias("x")).select(key, "t", "x.*")
    spans = last.withColumn("end_ms", F.lead("t").over(Window.partitionBy(key).orderBy("t"))).filter(F.col("end_ms").isNotNull()).withColumnRenamed("t", "start_ms")

    signal = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in SIGNALS])
    now = F.coalesce(*[F.col(s) for s in SIGNALS])
    total = F.size(now.resolved) + now.unresolved
    winner = F.get(now.resolved, F.lit(0))

    def against(s: str) -> Column:
        other = F.col(s)
        return F.coalesce((F.lit(s) != signal) & (other.unresolved == 0) & (F.size(other.resolved) == 1) & ~F.array_contains(other.resolved, winner), F.lit(False))

    disputed = against(SIGNALS[0]) | against(SIGNALS[1]) | against(SIGNALS[2]) if how.cross_check else F.lit(False)
    state = F.when(signal.isNull(), UNKNOWN).when(total == 0, SILENT).when(total > 1, CONTESTED).when(F.size(now.resolved) == 0, UNKNOWN).when(disputed, CONTESTED).otherwise(SPEAKING)
    none = F.array().cast("array<string>")
    named = spans.select(key, "start_ms", "end_ms", state.alias("state"), F.when(state == SPEAKING, winner).alias("speaker"), F.when(state.isin(SPEAKING, CONTESTED), now.resolved).otherwise(none).alias("candidates"), signal.alias("signal"))
    merged = _merged(named, key)
    short = (F.col("state") == SPEAKING) & (F.col("end_ms") - F.col("start_ms") < how.least_ms)
    gated = merged.withColumn("speaker", F.when(~short, F.col("speaker"))).withColumn("state", F.when(short, SILENT).otherwise(F.col("state")))
    return _merged(_contested(gated, key, how.contest_ms) if how.contest_ms > 0 else gated, key)


def signal_health(events: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, ``roster, csrc, dominant, dom, last_ms``): how often each signal changed, rosters as they came, and the time of the last event."""
    changed = transitions(events, key).groupBy(key).agg(*[F.count_if(F.col("kind") == s).alias(s) for s in SIGNALS])
    told = events.groupBy(key).agg(F.count_if(F.col("kind") == "roster").alias("roster"), F.max("at_ms").alias("last_ms"))
    return told.join(changed, key, "left").select(key, "roster", *[F.coalesce(s, F.lit(0).cast("long")).alias(s) for s in SIGNALS], "last_ms")
