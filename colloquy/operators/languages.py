"""Language evidence, fills and profiles of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded_tokens

#: Frequent function words, folded, by language.
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "is", "that", "with", "for", "was", "this"],
    "fr": ["le", "la", "les", "des", "et", "que", "pour", "dans", "est", "une"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "von", "mit", "ein", "auf"],
    "es": ["el", "los", "las", "que", "y", "por", "con", "una", "para", "del"],
}


def among(tokens: str, words: list[str]) -> Column:
    """How many tokens are among ``words``."""
    return F.size(F.filter(tokens, lambda w: w.isin(words))).cast("long")


def function_word_scores(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ``n_tokens``, a count of function words for each language, ``best``): ties and no evidence give ``und``."""
    counted = docs.select(key, folded_tokens(F.col(text)).alias("t")).select(
        key, F.size("t").cast("long").alias("n_tokens"), *[among("t", ws).alias(f"n_{lang}") for lang, ws in FUNCTION_WORDS.items()]
    )
    most = F.greatest(*[F.col(f"n_{lang}") for lang in FUNCTION_WORDS])
    leaders = F.array_compact(F.array(*[F.when(F.col(f"n_{lang}") == most, F.lit(lang)) for lang in FUNCTION_WORDS]))
    return counted.withColumn("best", F.when((most > 0) & (F.size(leaders) == 1), leaders[0]).otherwise("und"))


def profile(rows: DataFrame, keys: list[str], tag: str, weight: str, seconds: str, floor: float = 0.10, floor_seconds: float = 20.0) -> DataFrame:
    """(keys, tag, ``words, seconds, share, significant``): a language counts from a tenth of the words or 20 s on."""
    sums = rows.groupBy(*keys, tag).agg(F.sum(weight).alias("words"), F.sum(seconds).alias("seconds"))
    share = F.col("words") / F.greatest(F.sum("words").over(Window.partitionBy(*keys)), F.lit(1))
    return sums.withColumn("share", F.round(share, 6)).withColumn("significant", (F.col(tag) != "und") & ((share >= floor) | (F.col("seconds") >= floor_seconds)))


def fill_tags(rows: DataFrame, key: str, fallback: str) -> DataFrame:
    """(rows, ``filled``): null tags take the nearest tag of the same speaker, later first on a tie; else the nearest of
    anyone, earlier first; else ``fallback``. ``idx`` orders a meeting's rows without gaps."""

    def side(keys: list[str], ahead: bool) -> Column:
        w = Window.partitionBy(*keys).orderBy("idx")
        at = F.when(F.col("tag").isNotNull(), F.struct("idx", "tag"))
        return F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if ahead else F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    def nearer(keys: list[str], later_first: bool) -> Column:
        later, earlier = side(keys, True), side(keys, False)
        to_later, to_earlier = later["idx"] - F.col("idx"), F.col("idx") - earlier["idx"]
        take = (to_later <= to_earlier) if later_first else (to_later < to_earlier)
        return F.when(earlier.isNull() | take, later["tag"]).otherwise(earlier["tag"])

    own, anyone = nearer([key, "speaker"], True), nearer([key], False)
    return rows.withColumn("__own", own).withColumn("__any", anyone).withColumn("filled", F.coalesce("tag", "__own", "__any", F.lit(fallback))).drop("__own", "__any")


def confusion(rows: DataFrame, expected: str, observed: str, weight: str) -> DataFrame:
    """(expected, observed, ``words, rank``) in descending order of words."""
    sums = rows.groupBy(expected, observed).agg(F.sum(weight).alias("words"))
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("words"), expected, observed)))  # a row for each pair of languages
