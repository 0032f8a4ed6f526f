"""French and English in one meeting: evidence in a text, tags of utterances, and texts normalised piece by piece in their language."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..functions.unicode import without_accents
from ..functions.words import ENGLISH_ONLY_WORDS, FRENCH_ONLY_WORDS
from .languages import fill_tags

#: What shows a language besides its words: pattern, weight of a hit, and how many hits count at most.
FRENCH_SIGNS = [(r"\b(?:l|d|j|n|m|t|s|c|qu)['’](?=[a-zà-öø-ÿ])", 0.9, None), (r"[àâäçéèêëîïôöùûüÿœæ]", 0.7, 4)]
ENGLISH_SIGNS = [(r"\b(?:can|don|won|isn|aren|wasn|weren|didn|doesn|couldn|shouldn|wouldn|haven|hasn|hadn)['’]t\b|\b\w+['’](?:ll|re|ve|s|d|m)\b", 0.9, None), (r"\bth\w", 0.25, 6)]
#: Endings of words of more than four letters, and their weight.
FRENCH_ENDINGS, ENGLISH_ENDINGS, ENDING_WEIGHT = ["ement", "aient", "eront", "erons", "ite"], ["ing", "ness"], 0.4
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
#: where a piece of a text ends
PIECE = r"(?<=[.!?…])\s+"


@dataclass(frozen=True)
class Evidence:
    """When a text's language is decided: enough evidence and a clear margin; texts of few words need less if nothing speaks against."""

    least: float = 1.5
    margin: float = 0.6
    relative: float = 0.18
    unopposed: float = 0.9
    few_words: int = 3


def _score(text: Column, tokens: Column, words: list[str], signs: list[tuple[str, float, int | None]], endings: list[str]) -> Column:
    listed = F.array(*map(F.lit, words))
    score = F.size(F.filter(tokens, lambda w: F.array_contains(listed, w))).cast("double")
    for pattern, weight, most in signs:
        hits = F.regexp_count(text, F.lit("(?iU)" + pattern))
        score = score + weight * (F.least(hits, F.lit(most)) if most else hits)
    long = F.filter(tokens, lambda w: (F.length(w) > 4) & w.rlike(f"(?:{'|'.join(endings)})$"))
    return score + ENDING_WEIGHT * F.size(long)


def identify(text: Column, how: Evidence = Evidence()) -> Column:
    """A struct of ``language`` (``fr``, ``en``, null if undecided), ``confidence``, ``french`` and ``english`` evidence; null and blank texts have none."""
    x = F.trim(F.coalesce(text, F.lit("")))
    tokens = F.regexp_extract_all(F.lower(without_accents(x)), F.lit(LETTERS), 0)
    fr, en = _score(x, tokens, FRENCH_ONLY_WORDS, FRENCH_SIGNS, FRENCH_ENDINGS), _score(x, tokens, ENGLISH_ONLY_WORDS, ENGLISH_SIGNS, ENGLISH_ENDINGS)
    scored = F.struct(F.round(fr, 9).alias("f"), F.round(en, 9).alias("e"), F.size(tokens).alias("n"))

    def judged(s: Column) -> Column:
        total, gap = s.f + s.e, F.abs(s.f - s.e)
        alone = (s.n <= how.few_words) & (((s.f >= how.unopposed) & (s.e == 0)) | ((s.e >= how.unopposed) & (s.f == 0)))
        clear = (gap >= how.margin) & (gap / F.greatest(total, F.lit(1e-9)) >= how.relative)
        decided = ((total >= how.least) | alone) & clear
        language = F.when(decided, F.when(s.f > s.e, "fr").otherwise("en"))
        return F.struct(language.alias("language"), F.when(decided, gap / total).otherwise(0.0).alias("confidence"), s.f.alias("french"), s.e.alias("english"))

    return F.get(F.transform(F.array(scored), judged), F.lit(0))  # so that the evidence is gathered once


def tag_utterances(utterances: DataFrame, key: str = "meeting_id", default: str | None = None, engine_tags: bool = False, revise: bool = False, how: Evidence = Evidence()) -> DataFrame:
    """``utterances`` with ``verdict`` (see ``identify``) and ``tag``.

    An undecided utterance takes its engine's ``language`` if ``engine_tags``, else the nearest tag of its speaker, later first on a tie, else of anyone, else ``default``, else
    the meeting's most frequent verdict. With ``revise``, a weak verdict gives way to the strong ones of its speaker before and after if they agree against it.
    """
    rows = utterances.withColumn("verdict", identify(F.col("text"), how))
    seed = F.col("verdict.language")
    seed = F.coalesce(seed, F.nullif(F.lower(F.trim("language")), F.lit(""))) if engine_tags else seed
    if revise:
        weak = (F.col("verdict.confidence") < 0.55) | (F.col("verdict.french") + F.col("verdict.english") < 3.0)
        strong = F.when(F.col("verdict.language").isNotNull() & ~weak, F.struct("verdict.language", "verdict.confidence"))
        own = Window.partitionBy(key, "speaker").orderBy("idx")
        near = [F.last(strong, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.first(strong, ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing))]
        agreed = F.when((near[0].language == near[1].language) & (near[0].confidence >= 0.7) & (near[1].confidence >= 0.7), near[0].language)
        seed = F.when(F.col("verdict.language").isNotNull() & weak, F.coalesce(agreed, seed)).otherwise(seed)
    seeded = rows.withColumn("tag", seed)
    votes = rows.filter("verdict.language is not null").groupBy(key, "verdict.language").agg(F.count("*").alias("_c"))
    most = votes.groupBy(key).agg(F.min_by("language", F.struct(-F.col("_c"), "language")).alias("_most"))
    filled = fill_tags(seeded, key, None).join(most, key, "left")
    return filled.withColumn("tag", F.coalesce("filled", F.lit(default), "_most")).drop("filled", "_most")


def normalise_mixed(rows: DataFrame, keys: list[str], text: str = "text", default: str = "en", how: Evidence = Evidence()) -> DataFrame:
    """(keys, ``normalized``): each text cut into sentences, each sentence normalised in its language, for rows that ``keys`` name.

    An undecided sentence goes with the one before it, the first ones with the first decided one, and a text without any with ``default``. Sentences of one
    language in a row are normalised together. A null text gives null, a blank one an empty one.
    """
    pieces = F.filter(F.split(F.col(text), PIECE), lambda p: F.trim(p) != "")
    each = rows.select(*keys, F.posexplode(pieces).alias("_nth", "_piece")).withColumn("_tag", identify(F.col("_piece"), how).language)
    w = Window.partitionBy(*keys).orderBy("_nth")
    first = F.first("_tag", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tagged = each.withColumn("_lang", F.coalesce(F.last("_tag", ignorenulls=True).over(w), first, F.lit(default)))
    run = F.sum(F.when(F.lag("_lang").over(w) == F.col("_lang"), 0).otherwise(1)).over(w)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", F.col(c).alias("t")))), lambda x: x.t), " ")
    runs = tagged.withColumn("_run", run).groupBy(*keys, "_run", "_lang").agg(F.min("_nth").alias("_first"), joined("_piece").alias("_text"))
    is_french = F.col("_lang") == "fr"
    said = F.when(is_french, normal.french(F.when(is_french, F.col("_text")))).otherwise(normal.english(F.when(~is_french, F.col("_text"))))
    out = runs.select(*keys, F.col("_first").alias("_nth"), said.alias("_said")).filter(F.col("_said") != "").groupBy(*keys).agg(joined("_said").alias("normalized"))
    back = rows.select(*keys, F.when(F.col(text).isNotNull(), F.lit("")).alias("_blank")).join(out, keys, "left")
    return back.select(*keys, F.when(F.col("_blank").isNotNull(), F.coalesce("normalized", "_blank")).alias("normalized"))
