"""Claims of minutes checked against what was said: in the whole meeting, and in the time that they cite."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phonetics import sound_keys
from ..functions.text import edit_similarity, folded_tokens
from .minutes import content
from .outline import lexical_stem

SUPPORTED, WEAK, UNSUPPORTED = "supported", "weak", "unsupported"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
CAPITALISED = r"[A-ZÀ-ÖØ-Þ][\p{L}\p{N}_’'-]*(?:\s+[A-ZÀ-ÖØ-Þ][\p{L}\p{N}_’'-]*)*"


@dataclass(frozen=True)
class Support:
    """``cited`` and ``overall`` shares of a claim's terms, the padding of a citation, how alike the sound keys of two terms are, and how few terms are too few to judge."""

    cited: float = 0.6
    overall: float = 0.5
    padding_ms: int = 20_000
    alike: float = 0.86
    least_terms: int = 2


def stems(text: Column, language: str) -> Column:
    return F.transform(content(F.coalesce(text, F.lit(""))), lambda w: lexical_stem(w, language))


def plain_number(number: Column) -> Column:
    """Without points, commas and leading zeros."""
    bare = F.ltrim(F.translate(number, ".,", ""), F.lit("0"))
    return F.when(bare == "", "0").otherwise(bare)


def spoken_terms(utterances: DataFrame, key: str, language: str) -> DataFrame:
    """The inverted index: (key, ``said, start_ms, end_ms``), a row for each term of each utterance."""
    return utterances.select(key, "start_ms", "end_ms", F.explode(F.array_distinct(stems(F.col("text"), language))).alias("said"))


def like_terms(wanted: DataFrame, index: DataFrame, key: str, alike: float, language: str) -> DataFrame:
    """(key, ``term, said``): terms of claims and terms of the meeting that are equal or sound alike. Only terms whose sound keys are of near lengths meet."""
    sounds = lambda df, name, as_: df.select(key, name).distinct().select(key, name, F.explode(sound_keys(F.col(name), F.lit(language))).alias(as_))
    a = sounds(wanted, "term", "_a").withColumn("_n", F.length("_a"))
    reach = F.floor(F.col("_n") / F.lit(alike) - F.col("_n") + 1e-9).cast("int")
    shorter = (F.col("_n") - F.ceil(F.col("_n") * F.lit(alike) - 1e-9)).cast("int")
    spread = a.select(key, "term", "_a", F.explode(F.sequence(F.col("_n") - shorter, F.col("_n") + reach)).alias("_m"))
    b = sounds(index, "said", "_b").withColumn("_m", F.length("_b"))
    near = spread.join(b, [key, "_m"]).filter(edit_similarity(F.col("_a"), F.col("_b")) >= alike - 1e-9).select(key, "term", "said")
    same = wanted.select(key, "term").distinct().join(index.select(key, F.col("said").alias("term")).distinct(), [key, "term"]).select(key, "term", F.col("term").alias("said"))
    return near.unionByName(same).distinct()


def verify_claims(claims: DataFrame, utterances: DataFrame, key: str = "meeting_id", language: str = "en", vocabulary: DataFrame | None = None, how: Support = Support()) -> DataFrame:
    """``claims`` (key, ``claim, text, cited_from, cited_to``) with ``verdict, kept, cited_support, overall_support, missing, bad_numbers, bad_names``.

    The terms of a claim, repeats counted, are looked up in the meeting and in the utterances that its citation, padded, touches; a claim without a citation is judged by
    the meeting. Few terms: supported if the meeting has them, else weak. Too little in the meeting: unsupported. Too little where it is cited, or a number that nobody
    said: weak. ``missing`` are the terms that the cited part lacks; ``bad_names`` capitalised runs with a word that neither the meeting, its speakers nor ``vocabulary`` (key, ``entry``)
    has. Claims and utterances meet by term, number and word, never in pairs.
    """
    numbered = claims.select(key, "claim", "cited_from", "cited_to", F.posexplode_outer(stems(F.col("text"), language)).alias("nth", "term"))
    index = spoken_terms(utterances, key, language)
    like = like_terms(numbered.filter(F.col("term").isNotNull()), index, key, how.alike, language)
    wide_from, wide_to = F.greatest(F.col("cited_from") - how.padding_ms, F.lit(0)), F.col("cited_to") + how.padding_ms
    touches = ((F.col("start_ms") < wide_to) & (F.col("end_ms") > wide_from)) | ((F.col("start_ms") >= wide_from) & (F.col("start_ms") < wide_to))
    hits = numbered.join(like, [key, "term"]).join(index, [key, "said"]).groupBy(key, "claim", "nth").agg(F.lit(1).alias("known"), F.max(F.when(F.col("cited_from").isNull() | touches, 1)).alias("near"))
    each = numbered.join(hits, [key, "claim", "nth"], "left")
    n, share = F.count("term"), lambda c: F.when(F.count("term") > 0, F.count(c) / F.count("term")).otherwise(1.0)
    missing = F.transform(F.array_sort(F.collect_list(F.when(F.col("term").isNotNull() & F.col("near").isNull(), F.struct("nth", "term")))), lambda x: x.term)
    scored = each.groupBy(key, "claim").agg(n.alias("_n"), share("near").alias("cited_support"), share("known").alias("overall_support"), missing.alias("missing"))

    number = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(NUMBER), 0))
    said = utterances.select(key, number.alias("_x")).select(key, plain_number(F.col("_x")).alias("_number")).distinct()
    claimed = claims.select(key, "claim", "text").select(key, "claim", number.alias("_x")).withColumn("_number", plain_number(F.col("_x")))
    bad_numbers = claimed.join(said, [key, "_number"], "left_anti").groupBy(key, "claim").agg(F.array_sort(F.collect_list("_x")).alias("bad_numbers"))

    word = lambda c: F.explode(folded_tokens(c))
    known = utterances.select(key, word(F.concat_ws(" ", "text", "speaker")).alias("_word"))
    if vocabulary is not None:
        known = known.unionByName(vocabulary.select(key, word(F.col("entry")).alias("_word")))
    runs = F.regexp_extract_all("text", F.lit(CAPITALISED), 0)
    alone = F.col("text").rlike("^[A-ZÀ-ÖØ-Þ]") & ~F.contains(F.get(runs, F.lit(0)), F.lit(" "))
    named = claims.select(key, "claim", F.posexplode(F.when(alone, F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1)))).otherwise(runs)).alias("_k", "_run"))
    parts = named.select(key, "claim", "_k", "_run", word(F.col("_run")).alias("_word")).join(known.distinct(), [key, "_word"], "left_anti")
    bad_names = parts.select(key, "claim", "_k", "_run").distinct().groupBy(key, "claim").agg(F.array_sort(F.collect_list("_run")).alias("bad_names"))

    none = F.array().cast("array<string>")
    out = claims.join(scored, [key, "claim"]).join(bad_numbers, [key, "claim"], "left").join(bad_names, [key, "claim"], "left")
    out = out.withColumns({"bad_numbers": F.coalesce("bad_numbers", none), "bad_names": F.coalesce("bad_names", none)})
    enough, cited = F.col("overall_support") >= how.overall - 1e-9, F.col("cited_support") >= how.cited - 1e-9
    few = F.when(enough, SUPPORTED).otherwise(WEAK)
    many = F.when(~enough, UNSUPPORTED).when(~cited | (F.size("bad_numbers") > 0), WEAK).otherwise(SUPPORTED)
    verdict = F.when(F.col("_n") < how.least_terms, few).otherwise(many)
    return out.withColumn("verdict", verdict).withColumn("kept", F.col("verdict") != UNSUPPORTED).drop("_n")


def grounding_report(checked: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, ``n_claims, supported, weak, dropped, supported_ratio, is_clean``) of ``verify_claims``."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    clean = F.min((F.col("verdict") == SUPPORTED) & (F.size("bad_numbers") == 0) & (F.size("bad_names") == 0))
    return checked.groupBy(key).agg(F.count("*").alias("n_claims"), count(SUPPORTED).alias("supported"), count(WEAK).alias("weak"), count(UNSUPPORTED).alias("dropped"), (count(SUPPORTED) / F.count("*")).alias("supported_ratio"), clean.alias("is_clean"))
