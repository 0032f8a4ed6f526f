"""Who owns an action: named, addressed, committed or answering; and requests paired with their acceptances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, words
from .minutes import ANSWER, content, matches

#: Cues over folded text, English and French, of our own: taking a task on, giving one, and what follows a name that takes one.
SELF = [r"\b(?:i|we) (?:will|shall|can|am going to)\b", r"\b(?:i|we)'ll\b", r"\blet me\b", r"\bje (?:vais|m'occupe|prends)\b", r"\bje m'en (?:occupe|charge)\b"]
DIRECTED = [r"\b(?:could|can|would|will) you\b", r"\bplease\b", r"\byou (?:should|must|need to)\b", r"\b(?:peux-tu|pouvez-vous|merci de|tu dois|vous devez)\b"]
THIRD_PERSON = ["will", "shall", "should", "must", "has to", "is going to", "va", "doit", "prend", "s'occupe"]
_NAME = r"\p{Lu}[\p{L}'’.-]+"
HEAD, TAIL = rf"^({_NAME}(?:\s+{_NAME})?)\s*[,:]", rf",\s*({_NAME}(?:\s+{_NAME})?)\s*[.?!]?$"
UNKNOWN = ""


def directory(names: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, ``people, aliases``) from (key, ``pos, name``): a meeting's names in order, and what each may be called, folded: in full, by parts of three letters or more, with dots or without blanks.

    An alias that two people share is the first one's.
    """
    first = names.filter(F.trim("name") != UNKNOWN).groupBy(key, "name").agg(F.min("pos").alias("pos"))
    full = fold(F.col("name"))
    every = F.array_distinct(F.concat(F.array(full), F.filter(words(full), lambda p: F.length(p) >= 3), F.array(F.replace(full, F.lit(" "), F.lit(".")), F.replace(full, F.lit(" "), F.lit("")))))
    each = first.select(key, "pos", "name", F.posexplode(every).alias("n", "alias"))
    owned = each.groupBy(key, "alias").agg(F.min(F.struct("pos", "n", "name")).alias("x"))
    aliases = owned.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("x.pos", "x.n", "alias", "x.name"))).alias("aliases"))
    people = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda p: p["name"]).alias("people"))
    return people.join(aliases, key)


def attribute_owner(units: DataFrame, names: DataFrame, key: str = "meeting_id", window: int = 2, window_ms: int = 45_000) -> DataFrame:
    """``units`` (key, ``unit, speaker, start_ms, end_ms, text``) with ``owner`` and ``owner_source``, the first rule that gives one.

    mention: ``@name``; first_person: the speaker takes it on; vocative: a name before or after a comma; third_person: a name before a verb of duty; then, if the sentence
    asks somebody: named, the longest alias in it of another person; sole_counterpart: the only other person; reply: who answers or takes it on within
    ``window`` units and ``window_ms``; commitment: who takes it on there, the same speaker too; else unassigned.
    """
    w = Window.partitionBy(key).orderBy("unit")
    rows = units.join(directory(names, key), key, "left").withColumn("_f", fold(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("_self", matches(F.col("_f"), SELF)).withColumn("_asks", matches(F.col("_f"), DIRECTED)).withColumn("_answers", matches(F.col("_f"), ANSWER))
    aliases = F.coalesce("aliases", F.filter(F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("n"), F.lit("").alias("alias"), F.lit("").alias("name"))), lambda a: F.lit(False)))
    named = lambda said: F.get(F.filter("_aliases", lambda a: a["alias"] == F.trim(F.regexp_replace(fold(said), r"^[ .,:;!?]+|[ .,:;!?]+$", ""))), F.lit(0))["name"]
    kept = rows.withColumn("_aliases", aliases)
    safe = lambda a: F.replace(a, F.lit("."), F.lit(r"\."))
    mention = F.get(F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"@([\w.-]+)"), 1), named), lambda n: n.isNotNull()), F.lit(0))
    others = lambda n: F.when(n != F.col("speaker"), n)
    vocative = F.coalesce(others(named(F.regexp_extract("text", HEAD, 1))), others(named(F.regexp_extract("text", TAIL, 1))))
    third = F.get(F.filter("_aliases", lambda a: (F.length(a["alias"]) >= 3) & F.regexp(F.col("_f"), F.concat(F.lit(r"\b"), safe(a["alias"]), F.lit(rf"\s+(?:{'|'.join(THIRD_PERSON)})\b")))), F.lit(0))["name"]
    inside = F.filter("_aliases", lambda a: (a["name"] != F.col("speaker")) & (F.length(a["alias"]) >= 3) & F.regexp(F.col("_f"), F.concat(F.lit(r"\b"), safe(a["alias"]), F.lit(r"\b"))))
    longest = F.array_min(F.transform(inside, lambda a: F.struct((-F.length(a["alias"])).alias("l"), a.pos.alias("pos"), a.n.alias("n"), a["name"].alias("name"))))["name"]
    rest = F.filter(F.coalesce("people", F.array().cast("array<string>")), lambda p: p != F.col("speaker"))
    sole = F.when(F.size(rest) == 1, F.get(rest, F.lit(0)))

    def follows(test: Column, skip_own: bool) -> Column:
        """The speaker of the first unit ahead that passes; a unit past the time ends the search."""
        found = F.lit(None).cast("string")
        for k in range(window, 0, -1):
            other = (F.lead("speaker", k).over(w) != F.col("speaker")) if skip_own else F.lit(True)
            late = F.lead("start_ms", k).over(w) - F.col("end_ms") > window_ms
            hit = F.lead(test, k).over(w)
            here = F.when(F.lead("unit", k).over(w).isNull(), None).when(~other, found).when(late, None).when(hit, F.nullif(F.lead("speaker", k).over(w), F.lit(UNKNOWN))).otherwise(found)
            found = here
        return found

    reply, commitment = follows(F.col("_self") | F.col("_answers"), True), follows(F.col("_self"), False)
    asks = F.col("_asks")
    rules = {"mention": mention, "first_person": F.when(F.col("_self"), F.nullif("speaker", F.lit(UNKNOWN))), "vocative": vocative, "third_person": third, "named": F.when(asks, longest), "sole_counterpart": F.when(asks, sole), "reply": F.when(asks, reply), "commitment": commitment}
    tried = kept.withColumns({f"_r_{n}": c for n, c in rules.items()})
    source = F.when(F.col("_r_mention").isNull() & F.col("_self"), "first_person")  # also where the speaker is unknown
    for n in rules:
        source = source.when(F.col(f"_r_{n}").isNotNull(), n)
    tried = tried.withColumn("owner_source", source.otherwise("unassigned"))
    owner = F.coalesce(*[F.when(F.col("owner_source") == n, F.col(f"_r_{n}")) for n in rules])
    return tried.withColumn("owner", owner).select(*units.columns, "owner", "owner_source")


def pair_acceptances(actions: DataFrame, key: str = "meeting_id", window: int = 4, window_ms: int = 150_000, short: int = 4) -> DataFrame:
    """(key, ``unit, owner, owner_source, support``): actions (key, ``unit, owner, owner_source, start_ms, end_ms, text``) after acceptances went to the requests that they answer.

    An action that its owner takes on themselves answers the last request before it that is theirs, if that is at most ``window`` units and ``window_ms`` away, and if
    the acceptance has at most ``short`` terms or shares one with it. The two become one action, by the text with more content words, on a tie the request; the other's unit is support. A
    meeting's actions are folded in one expression.
    """
    item = F.struct("unit", "owner", "owner_source", F.col("start_ms").cast("long").alias("start"), F.col("end_ms").cast("long").alias("end"), content(F.coalesce("text", F.lit(""))).alias("terms"))
    held = actions.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("a"))
    unit = actions.schema["unit"].dataType.simpleString()
    none = F.array().cast(f"array<struct<unit:{unit},owner:string,owner_source:string,start:bigint,end:bigint,terms:array<string>,support:array<{unit}>>>")
    fields = ("unit", "owner", "owner_source", "start", "end", "terms")

    def open_item(x: Column) -> Column:
        return F.struct(*[x[f].alias(f) for f in fields], F.array().cast(f"array<{unit}>").alias("support"))

    def merged(r: Column, x: Column) -> Column:
        rich = F.size(r.terms) >= F.size(x.terms)
        support = F.when(rich, F.array_append(r.support, x.unit)).otherwise(F.concat(F.array(r.unit), r.support))
        return F.struct(*[F.when(rich, r[f]).otherwise(x[f]).alias(f) for f in fields], support.alias("support"))

    def put(state: Column, x: Column) -> Column:
        at = F.array_max(F.filter(F.transform(state, lambda r, i: F.when((r.owner_source != "first_person") & (r.owner == x.owner), i)), lambda i: i.isNotNull()))
        request = F.get(state, at)
        near = (x.unit - request.unit <= window) & (x.start - request.end <= window_ms)
        accepts = (F.size(F.array_distinct(x.terms)) <= short) | F.arrays_overlap(x.terms, request.terms)
        good = (x.owner_source == "first_person") & x.owner.isNotNull() & at.isNotNull() & near & accepts
        return F.when(F.coalesce(good, F.lit(False)), F.transform(state, lambda r, i: F.when(i == at, merged(r, x)).otherwise(r))).otherwise(F.array_append(state, open_item(x)))

    return held.select(key, F.explode(F.aggregate("a", none, put)).alias("p")).select(key, "p.unit", "p.owner", "p.owner_source", "p.support")
