"""Decisions, actions and open questions of a meeting, with their evidence, and how well minutes are supported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, folded_tokens, jaccard, sentences

_WE, _WHO = r"(?:we|the team|everyone|the group)", r"(?:i|we|you|he|she|they|[a-z]+)"
#: Cues over folded text, English and French, by what they show: an explicit decision, a likely one, a task, a reply.
STRONG_DECISION = [rf"\b{_WE} (?:all )?(?:just )?(?:agreed|decided|settled|chose|voted)\b", r"\b(?:final )?decision\b.{0,12}(?: is| was|:)", r"\bso it is (?:agreed|decided|settled)\b", r"\b(?:nous avons|on a|l'equipe a) (?:bien )?(?:decide|choisi|tranche|convenu|valide)\b", r"\bc'est (?:decide|acte|valide|tranche)\b"]
WEAK_DECISION = [rf"\b{_WE} (?:go|goes|will go|move|moves) (?:for|with|ahead)\b", r"\b(?:agreed|settled|adopted|accepted)\b", r"\b(?:adopte|accepte|convenu)e?s?\b"]
ACTION = [rf"\b{_WHO} (?:will|shall|must|should|has to|have to) [a-z]", r"\b(?:could|would|can) (?:you|someone|anyone) [a-z]", r"\b(?:action|todo|task)\b *:", r"\b(?:tu|vous|nous|on) (?:dois|devez|devons|doit) [a-z]", r"\b(?:merci de|charge de|a faire)\b"]
ANSWER = [r"^(?:yes|yep|no|nope|ok|okay|of course|exactly|oui|non|bien sur|exactement)\b"]
#: Words that carry no topic, folded: a short list of our own, which callers can replace.
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "by", "for", "with", "from", "as", "is", "are", "was", "were", "be", "it", "this", "that", "we", "you", "they", "he", "she", "not", "le", "la", "les", "un", "une", "des", "et", "ou", "de", "du", "en", "que", "qui", "est", "ce"]


def content(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Folded tokens of three letters or more, or with a digit, that are no stop words; repeats are kept."""
    return F.filter(folded_tokens(text), lambda w: ~w.isin(stop_words) & ((F.length(w) >= 3) | w.rlike("[0-9]")))


def terms(text: Column) -> Column:
    """Distinct words of ``content``."""
    return F.array_distinct(content(text))


def sentence_rows(utterances: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, ``unit, idx, nth, speaker, start_ms, end_ms, text``): sentences, numbered through the meeting, with shares of the
    utterance's time by their numbers of characters."""
    each = utterances.select(key, "idx", "speaker", "start_ms", "end_ms", sentences(F.col("text")).alias("s")).filter(F.size("s") > 0)
    lengths = F.transform("s", lambda x: F.length(x))
    upto = lambda n: F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0), lambda a, b: a + b)
    rows = each.select("*", F.posexplode("s").alias("nth", "text"), upto(F.size("s")).alias("whole")).withColumn("before", upto(F.col("nth")))
    span = F.col("end_ms") - F.col("start_ms")
    at = lambda chars: (F.col("start_ms") + F.floor(span * chars / F.col("whole"))).cast("long")
    unit = F.row_number().over(Window.partitionBy(key).orderBy("idx", "nth")) - 1
    return rows.select(key, unit.alias("unit"), "idx", "nth", "speaker", at(F.col("before")).alias("start_ms"), at(F.col("before") + F.length("text")).alias("end_ms"), "text")


def matches(folded: Column, patterns: list[str]) -> Column:
    return folded.rlike("|".join(f"(?:{p})" for p in patterns))


def candidates(units: DataFrame, key: str = "meeting_id", decisions: int = 20, actions: int = 30, questions: int = 12, answer_ms: int = 150_000, answer_units: int = 4) -> DataFrame:
    """(key, ``unit, kind, strong, answered``): sentences that decide, assign or ask, at most so many of a kind for each meeting.

    A decision is no question and has two terms; what decides assigns nothing. A question is open unless another speaker
    within ``answer_units`` sentences and ``answer_ms`` begins with an answer (in the first two) or shares its terms.
    """
    w = Window.partitionBy(key).orderBy("unit")
    rows = units.withColumn("f", fold(F.col("text"))).withColumn("t", terms(F.col("text")))
    asks = F.trim("text").endswith("?")
    strong, weak = matches(F.col("f"), STRONG_DECISION), matches(F.col("f"), WEAK_DECISION)
    decides = ~asks & (F.size("t") >= 2) & (strong | weak)
    answered = F.lit(False)
    for k in range(1, answer_units + 1):
        other = (F.lead("speaker", k).over(w) != F.col("speaker")) & (F.lead("start_ms", k).over(w) - F.col("end_ms") <= answer_ms)
        says = jaccard(F.col("t"), F.lead("t", k).over(w)) >= 0.22
        if k <= 2:
            says = says | matches(F.lead("f", k).over(w), ANSWER)
        answered = answered | F.coalesce(other & says, F.lit(False))
    kinds = F.array_compact(F.array(F.when(decides, "decision"), F.when(~decides & ~asks & matches(F.col("f"), ACTION), "action"), F.when(asks & (F.size(folded_tokens(F.col("text"))) >= 4) & (F.size("t") >= 2), "question")))
    found = rows.withColumn("answered", answered).withColumn("strong", strong).withColumn("kind", F.explode(kinds))
    most = F.when(F.col("kind") == "decision", decisions).when(F.col("kind") == "action", actions).otherwise(questions)
    nth = F.row_number().over(Window.partitionBy(key, "kind").orderBy("unit"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= most).select(key, "unit", "kind", "strong", F.when(F.col("kind") == "question", F.col("answered")).alias("answered"))


def grounding(claims: DataFrame, utterances: DataFrame, key: str = "meeting_id", support: float = 0.7, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(key, ``n_claims, supported, score``): claims (key, ``claim``) of which ``support`` of the content words, repeats counted, occur in the meeting.

    Claims without content words are not scored; a meeting whose claims have none scores 1. Words of claims meet the meeting's words in a join.
    """
    numbered = claims.select(key, F.monotonically_increasing_id().alias("_claim"), content(F.col("claim"), stop_words).alias("_words"))
    named = numbered.select(key, "_claim", F.explode_outer("_words").alias("_word"))
    said = utterances.select(key, F.explode(F.array_distinct(folded_tokens(F.col("text")))).alias("_word")).distinct().withColumn("_said", F.lit(1))
    each = named.join(said, [key, "_word"], "left").groupBy(key, "_claim").agg(F.count("_word").alias("_n"), F.count(F.when(F.col("_word").isNotNull(), F.col("_said"))).alias("_m"))
    scored = F.col("_n") > 0
    held = each.groupBy(key).agg(F.count_if(scored).alias("n_claims"), F.count_if(scored & (F.col("_m") >= support * F.col("_n") - 1e-9)).alias("supported"))
    return held.withColumn("score", F.when(F.col("n_claims") > 0, F.col("supported") / F.col("n_claims")).otherwise(1.0))
