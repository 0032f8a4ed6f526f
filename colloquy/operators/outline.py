"""Topic segments of meetings, and the sentences that sum them up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard
from .minutes import content
from .topics import block_similarity, topic_gaps

#: Endings that are taken off words, in the order in which they are tried, with the least length of what is left.
ENGLISH_SUFFIXES = {"sses": 2, "ies": 1, "ing": 4, "edly": 4, "ed": 4, "ly": 4, "s": 3}
FRENCH_SUFFIXES = {"aient": 4, "erait": 4, "erons": 4, "eront": 4, "ement": 5, "ions": 4, "iez": 4, "ons": 4, "ez": 4, "er": 4, "ait": 4, "ais": 4, "ees": 3, "es": 3, "s": 3, "x": 3}
LEAST_KEYWORD = 4  # letters


@dataclass(frozen=True)
class Topics:
    """How topics are found; pseudo-sentences, blocks and the least duration shrink in short meetings unless ``adaptive`` is off."""

    width: int = 20
    block: int = 6
    least_ms: int = 90_000
    least_utterances: int = 3
    most_topics: int = 12
    keywords: int = 4
    snap: int = 2
    adaptive: bool = True


def lexical_stem(token: Column, language: str = "en") -> Column:
    """A word without its first ending that leaves enough of it; numbers stay. ``mixed`` tries the endings of both languages, longest first."""
    both = {s: max(d[s] for d in (ENGLISH_SUFFIXES, FRENCH_SUFFIXES) if s in d) for s in {**ENGLISH_SUFFIXES, **FRENCH_SUFFIXES}}
    suffixes = {"fr": FRENCH_SUFFIXES, "mixed": dict(sorted(both.items(), key=lambda x: (-len(x[0]), x[0])))}.get(language, ENGLISH_SUFFIXES)
    cut = [F.when(F.endswith(token, F.lit(s)) & (F.length(token) - len(s) >= least), F.left(token, F.length(token) - len(s))) for s, least in suffixes.items()]
    return F.when(token.rlike("^[0-9]+$"), token).otherwise(F.coalesce(*cut, token))


def token_stream(utterances: DataFrame, key: str = "meeting_id", language: str = "en") -> DataFrame:
    """(key, ``pos, idx, surface, term``): the content words of a meeting in order and their stems."""
    each = utterances.select(key, "idx", F.posexplode(content(F.col("text"))).alias("nth", "surface"))
    pos = F.row_number().over(Window.partitionBy(key).orderBy("idx", "nth")) - 1
    return each.select(key, pos.alias("pos"), "idx", "surface", lexical_stem(F.col("surface"), language).alias("term"))


def _sizes(tokens: DataFrame, spans: DataFrame, key: str, how: Topics) -> DataFrame:
    """(spans, ``n_tokens, width, block, least_ms``) of each meeting."""
    n, d = F.coalesce("n_tokens", F.lit(0)), F.col("meeting_end") - F.col("meeting_start")
    sized = spans.join(tokens.groupBy(key).agg(F.count("*").alias("n_tokens")), key, "left").withColumn("n_tokens", n)
    if not how.adaptive:
        return sized.withColumns({"width": F.lit(how.width), "block": F.lit(how.block), "least_ms": F.lit(float(how.least_ms))})
    within = lambda x, lo, hi: F.least(F.greatest(F.bround(x).cast("int"), F.lit(lo)), F.lit(hi))
    sized = sized.withColumn("width", within(F.col("n_tokens") / 60, 6, how.width))
    sized = sized.withColumn("block", within(F.col("n_tokens") / (F.col("width") * 6), 3, how.block))
    return sized.withColumn("least_ms", F.when(d > 0, F.least(F.lit(float(how.least_ms)), d / 4)).otherwise(F.lit(float(how.least_ms))))


def boundaries(utterances: DataFrame, tokens: DataFrame, key: str, how: Topics) -> DataFrame:
    """(key, ``gap, depth, i, start_ms, before_ms``): candidate gaps, each moved to the utterance near it that follows the longest pause, a change of speaker counting a second."""
    order = Window.partitionBy(key).orderBy("idx")
    placed = utterances.withColumn("i", F.row_number().over(order) - 1).withColumn("before_ms", F.lag("end_ms").over(order))
    change = F.when(F.lag("speaker").over(order) != F.col("speaker"), 1000).otherwise(0)
    placed = placed.withColumn("pull", F.greatest(F.col("start_ms") - F.col("before_ms"), F.lit(0)) + change)
    spans = placed.groupBy(key).agg(F.count("*").alias("n"), F.min_by("start_ms", "i").alias("meeting_start"), F.max_by("end_ms", "i").alias("meeting_end"))
    sizes = _sizes(tokens, spans, key, how)
    long = sizes.filter(F.col("n_tokens") >= F.col("width") * (F.col("block") + 1))
    gaps = topic_gaps(block_similarity(tokens, key, sizes=long), key).filter("candidate").select(key, "gap", "depth")
    at = gaps.join(long.select(key, "width", "n_tokens", "n"), key).withColumn("pos", F.least((F.col("gap") + 1) * F.col("width"), F.col("n_tokens") - 1))
    target = at.join(tokens.select(key, "pos", "idx"), [key, "pos"]).join(placed.select(key, "idx", F.col("i").alias("t")), [key, "idx"])
    lo, hi = F.greatest(F.col("t") - how.snap, F.lit(1)), F.least(F.col("t") + how.snap, F.col("n") - 1)
    near = target.filter(lo <= hi).select(key, "gap", "depth", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("i"))
    near = near.join(placed.select(key, "i", "pull", "start_ms", "before_ms"), [key, "i"])
    best = F.max(F.struct("pull", (-F.col("i")).alias("back"), "start_ms", "before_ms")).alias("x")
    found = near.groupBy(key, "gap", "depth").agg(best).select(key, "gap", "depth", (-F.col("x.back")).alias("i"), "x.start_ms", "x.before_ms")
    ranked = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("down"), "gap", "i", "start_ms", "before_ms"))).alias("candidates"))
    return sizes.join(ranked, key, "left")


def segment_topics(utterances: DataFrame, tokens: DataFrame, key: str = "meeting_id", how: Topics = Topics()) -> DataFrame:
    """(key, ``segment, first, last, start_ms, end_ms``): a meeting's topics, by places of utterances from 0.

    Candidate boundaries are taken from the deepest on, if both parts keep the least duration and number of utterances, until there are enough topics.
    A meeting of few tokens is one topic. ``tokens`` is a ``token_stream``. The candidates of a meeting are folded in one expression, without a Python group.
    """
    edge = "struct<i:bigint,start:bigint,before:bigint>"
    found = boundaries(utterances, tokens, key, how)
    new = lambda i, start, before: F.struct(i.cast("bigint").alias("i"), start.cast("bigint").alias("start"), before.cast("bigint").alias("before"))
    none = F.lit(None).cast("bigint")
    whole = F.array(new(F.lit(0), F.col("meeting_start"), none), new(F.col("n"), none, F.col("meeting_end"))).cast(f"array<{edge}>")

    def viable(left: Column, right: Column) -> Column:
        return (right.i - left.i >= how.least_utterances) & (right.before - left.start >= F.col("least_ms"))

    def taken(edges: Column, c: Column) -> Column:
        here = new(c.i, c.start_ms, c.before_ms)
        left, right = F.array_max(F.filter(edges, lambda e: e.i < c.i)), F.array_min(F.filter(edges, lambda e: e.i > c.i))
        free = (F.size(edges) - 1 < how.most_topics) & ~F.exists(edges, lambda e: e.i == c.i)
        return F.when(free & viable(left, here) & viable(here, right), F.array_append(edges, here)).otherwise(edges)

    candidates = F.coalesce("candidates", F.filter(F.array(F.struct(F.lit(0.0).alias("down"), F.lit(0).cast("bigint").alias("gap"), F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("start_ms"), F.lit(0).cast("bigint").alias("before_ms"))), lambda x: F.lit(False)))
    edges = found.select(key, F.array_sort(F.aggregate(candidates, whole, taken)).alias("e"))
    parts = F.transform(F.sequence(F.lit(0), F.size("e") - 2), lambda k: F.struct(k.alias("segment"), F.get("e", k).i.alias("first"), (F.get("e", k + 1).i - 1).alias("last"), F.get("e", k).start.alias("start_ms"), F.get("e", k + 1).before.alias("end_ms")))
    return edges.select(key, F.explode(parts).alias("p")).select(key, "p.*")


def segment_keywords(segments: DataFrame, utterances: DataFrame, tokens: DataFrame, key: str = "meeting_id", limit: int = 4) -> DataFrame:
    """(segments, ``keywords, title``): stems of most count times log(1 + utterances over those that have it), each in its most frequent form."""
    i = F.row_number().over(Window.partitionBy(key).orderBy("idx")) - 1
    owned = tokens.join(utterances.select(key, "idx", i.alias("i")), [key, "idx"])
    total = owned.groupBy(key).agg(F.count_distinct("i").alias("total"))
    df = owned.groupBy(key, "term").agg(F.count_distinct("i").alias("df"))
    forms = owned.groupBy(key, "term", "surface").agg(F.count("*").alias("c")).groupBy(key, "term").agg(F.min_by("surface", F.struct(-F.col("c"), F.length("surface"), "surface")).alias("form"))
    long = owned.filter((F.length("term") >= LEAST_KEYWORD) & ~F.col("term").rlike("^[0-9]+$"))
    tf = long.join(segments.select(key, "segment", "first", "last"), key).filter(F.col("i").between(F.col("first"), F.col("last"))).groupBy(key, "segment", "term").agg(F.count("*").alias("tf"))
    scored = tf.join(df, [key, "term"]).join(total, key).withColumn("score", F.round(F.col("tf") * F.log(1 + F.col("total") / F.col("df")), 9))
    rank = F.row_number().over(Window.partitionBy(key, "segment").orderBy(F.desc("score"), "term"))
    top = scored.withColumn("rank", rank).filter(F.col("rank") <= limit).join(forms, [key, "term"])
    words = top.groupBy(key, "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "form"))), lambda x: x.form).alias("keywords"))
    named = segments.join(words, [key, "segment"], "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    joined = F.array_join(F.slice("keywords", 1, 3), ", ")
    title = F.when(F.size("keywords") == 0, F.concat(F.lit("Topic "), (F.col("segment") + 1).cast("string"))).otherwise(F.concat(F.upper(F.left(joined, F.lit(1))), F.substring(joined, 2, 1_000_000)))
    return named.withColumn("title", title)


def summary_sentences(sentences: DataFrame, segments: DataFrame, limit: int, key: str = "meeting_id", least_words: int = 6, alike: float = 0.6) -> DataFrame:
    """(key, ``unit, score``): at most ``limit`` sentences of a meeting: the best of each segment in turn, then the best of all, none ``alike`` another.

    ``sentences`` has (key, ``unit, i, score, terms, n_words, is_question, is_boilerplate``), ``i`` the place of its utterance; ``terms`` are distinct. Questions, boilerplate and short sentences
    stand back unless a meeting has no others. Two sentences are alike if their terms have that Jaccard similarity. A meeting's candidates are folded in one
    expression.
    """
    fine = (F.col("n_words") >= least_words) & (F.size("terms") >= 2) & ~F.col("is_question") & ~F.col("is_boilerplate")
    whole = Window.partitionBy(key)
    marked = sentences.withColumn("_fine", fine).withColumn("_any", F.max("_fine").over(whole))
    usable = marked.filter(F.col("_fine") | (~F.col("_any") & (F.size("terms") > 0)))
    spans = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("segment", "first", "last"))).alias("spans"))
    item = F.struct((-F.col("score")).alias("down"), F.col("unit").cast("bigint").alias("unit"), F.col("i").cast("bigint").alias("i"), "terms")
    held = usable.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("ordered")).join(spans, key, "left")
    novel = lambda c, chosen: F.forall(chosen, lambda o: jaccard(c.terms, o.terms) < alike)
    room = lambda chosen: F.size(chosen) < limit

    def from_segment(chosen: Column, s: Column) -> Column:
        first = F.get(F.filter("ordered", lambda c: c.i.between(s["first"], s["last"]) & novel(c, chosen)), F.lit(0))
        return F.when(room(chosen) & first.isNotNull(), F.array_append(chosen, first)).otherwise(chosen)

    def from_all(chosen: Column, c: Column) -> Column:
        return F.when(room(chosen) & novel(c, chosen) & ~F.exists(chosen, lambda o: o.unit == c.unit), F.array_append(chosen, c)).otherwise(chosen)

    nothing = F.filter("ordered", lambda c: F.lit(False))
    spans_or_none = F.coalesce("spans", F.filter(F.array(F.struct(F.lit(0).alias("segment"), F.lit(0).cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("last"))), lambda s: F.lit(False)))
    chosen = held.select(key, "ordered", F.aggregate(spans_or_none, nothing, from_segment).alias("some")).select(key, F.aggregate("ordered", F.col("some"), from_all).alias("chosen"))
    return chosen.select(key, F.explode("chosen").alias("c")).select(key, "c.unit", (-F.col("c.down")).alias("score"))
