"""Items of minutes that say the same: merged in order, each into the first leader that it is most like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phonetics import sound_key
from ..functions.text import edit_similarity, jaccard
from .minutes import terms
from .scoring import spread

CITATIONS = 4
SOUND = 0.85  # from here on, how alike two texts sound counts as well as their terms


def merge_similar(items: DataFrame, keys: list[str], threshold: float = 0.6, citations: int = CITATIONS, french: bool = False) -> DataFrame:
    """(keys, ``leader, n_merged, text, owner, due, units``) of items (keys, ``pos, text, owner, due, unit``), merged one after the other in order of ``pos``.

    An item goes to the leader most like it, the earliest of equals, if that reaches ``threshold``; else it becomes a leader. Two texts are as alike as their terms (Jaccard) or, if
    that is more and at least ``SOUND``, as their sound keys, French or English ones. A
    leader keeps the longer text, on a tie its own, and takes an owner or a due date that it lacks; its next comparisons are by the text that it has then. ``units`` are
    the first ``citations`` cited units. Items of one group of ``keys`` (a meeting and a kind of item) are folded in one expression; null texts count as empty.
    """
    sounded = items.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_sound", sound_key(F.col("text"), french))
    one = F.struct("pos", "text", "owner", "due", "unit", terms(F.col("text")).alias("terms"), F.col("_sound").alias("sound"))
    held = sounded.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("items"))
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    none = F.array().cast(f"array<struct<leader:{kinds['pos']},n:int,text:string,owner:{kinds['owner']},due:{kinds['due']},terms:array<string>,sound:string,units:array<{kinds['unit']}>>>")

    def led(x: Column) -> Column:
        return F.struct(x.pos.alias("leader"), F.lit(1).alias("n"), x.text.alias("text"), x.owner.alias("owner"), x.due.alias("due"), x.terms.alias("terms"), x.sound.alias("sound"), F.array(x.unit).alias("units"))

    def joined(a: Column, x: Column) -> Column:
        longer = F.length(x.text) > F.length(a.text)
        units = F.array_distinct(F.array_append(a.units, x.unit))
        pick = lambda n: F.when(longer, x[n]).otherwise(a[n]).alias(n)
        return F.struct(a.leader.alias("leader"), (a.n + 1).alias("n"), pick("text"), F.coalesce(a.owner, x.owner).alias("owner"), F.coalesce(a.due, x.due).alias("due"), pick("terms"), pick("sound"), units.alias("units"))

    def alike(a: Column, x: Column) -> Column:
        heard = F.when((a.sound == "") | (x.sound == ""), (a.sound == x.sound).cast("double")).otherwise(edit_similarity(a.sound, x.sound))
        return F.greatest(jaccard(a.terms, x.terms), F.when(heard >= SOUND, heard).otherwise(0.0))

    def put(leaders: Column, x: Column) -> Column:
        scored = F.transform(leaders, lambda a, i: F.struct(alike(a, x).alias("s"), (-i).alias("back")))
        best = F.array_max(F.filter(scored, lambda s: s.s >= threshold))
        return F.when(best.isNull(), F.array_append(leaders, led(x))).otherwise(F.transform(leaders, lambda a, i: F.when(i == -best.back, joined(a, x)).otherwise(a)))

    merged = spread(held, keys).select(*keys, F.explode(F.aggregate("items", none, put)).alias("m"))
    return merged.select(*keys, "m.leader", F.col("m.n").alias("n_merged"), "m.text", "m.owner", "m.due", F.slice(F.array_sort("m.units"), 1, citations).alias("units"))
