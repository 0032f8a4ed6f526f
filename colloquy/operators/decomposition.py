"""Word errors by kind of word: the alignment itself as rows, joined with the class of each reference word."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.unicode import folded
from ..functions.words import ENGLISH_FUNCTION_WORDS, ENGLISH_ONLY_WORDS, FILLERS, FRENCH_FUNCTION_WORDS, FRENCH_ONLY_WORDS, NUMBER_WORDS
from .scoring import DELETED, EQUAL, INSERTED, SUBSTITUTED, align_words

PROPER_NOUN, NUMBER, CODE_SWITCHED, FILLER, FUNCTION_WORD, CONTENT_WORD = "proper_noun", "number", "code_switched", "filler", "function_word", "content_word"

LETTER = r"[\p{L}\p{Nl}\p{No}]"
TOKEN = rf"\x01?(?:{LETTER}+(?:['’-]{LETTER}+)*|\p{{Nd}}+(?:[.,]\p{{Nd}}+)*)"
#: where a sentence starts: at the beginning, after a closing sign and white space, or on a new line
STARTS = r"([.!?…:;]\s+|\n\s*|^\s*)"


def proper_nouns(texts: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """(keys, ``name``): folded words of ``raw`` that are capitalised inside a sentence, never written small in the same text, and no common word.

    A text counts by its keys. Null and empty texts have no names.
    """
    tokens = F.regexp_extract_all(F.regexp_replace(raw, "(?U)" + STARTS, "$1\u0001"), F.lit("(?U)" + TOKEN), 0)
    each = texts.select(*keys, F.explode(tokens).alias("_t")).select(*keys, F.ltrim("_t", F.lit("\u0001")).alias("_w"), F.startswith("_t", F.lit("\u0001")).alias("_first"))
    seen = each.select(*keys, folded(F.col("_w")).alias("name"), F.col("_w").rlike(r"^\p{Lu}").alias("_up"), "_first")
    found = seen.groupBy(*keys, "name").agg(F.max(F.col("_up") & ~F.col("_first")).alias("_inside"), F.min("_up").alias("_always"))
    common = sorted({*FILLERS, *ENGLISH_FUNCTION_WORDS, *FRENCH_FUNCTION_WORDS})
    named = (F.length("name") >= 2) & (F.substring_index("name", "'", 1) != "i") & ~F.col("name").isin(common)
    return found.filter(F.col("_inside") & F.col("_always") & named).select(*keys, "name")


def word_class(word: Column, fold: Column, named: Column, language: Column) -> Column:
    """The class of a reference word: names first, then numbers, fillers, words of the other language, function words, and the rest."""
    french = language == "fr"
    other = F.when(french, fold.isin(ENGLISH_ONLY_WORDS)).otherwise(fold.isin(FRENCH_ONLY_WORDS))
    own = F.when(french, fold.isin(FRENCH_FUNCTION_WORDS)).otherwise(fold.isin(ENGLISH_FUNCTION_WORDS))
    number = word.rlike(r"\p{Nd}") | fold.isin(NUMBER_WORDS)
    return F.when(named, PROPER_NOUN).when(number, NUMBER).when(fold.isin(FILLERS), FILLER).when(other, CODE_SWITCHED).when(own, FUNCTION_WORD).otherwise(CONTENT_WORD)


def alignment_rows(pairs: DataFrame, keep: list[str], reference: str, hypothesis: str) -> DataFrame:
    """(keep, ``outcome, ref_place, hyp_place, word, heard``): a row for each step of a least-edits alignment of two token arrays.

    Places are null where a side has no word. A null side has no words.
    """
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, outcome, ref_place, hyp_place, word, heard = ([] for _ in range(6))
            for row, (ref, hyp) in enumerate(zip(batch.column(reference).to_pylist(), batch.column(hypothesis).to_pylist(), strict=True)):
                ref, hyp = ref or [], hyp or []
                for op, i, j in align_words(ref, hyp):
                    owner.append(row)
                    outcome.append(op)
                    ref_place.append(i if i >= 0 else None)
                    hyp_place.append(j if j >= 0 else None)
                    word.append(ref[i] if i >= 0 else None)
                    heard.append(hyp[j] if j >= 0 else None)
            held = [batch.column(c).take(pa.array(owner, pa.int64())) for c in keep]
            steps = [pa.array(x, t) for x, t in ((outcome, pa.string()), (ref_place, pa.int32()), (hyp_place, pa.int32()), (word, pa.string()), (heard, pa.string()))]
            yield pa.RecordBatch.from_arrays([*held, *steps], names=[*keep, "outcome", "ref_place", "hyp_place", "word", "heard"])

    return pairs.select(*keep, reference, hypothesis).mapInArrow(run, f"{kinds}, outcome string, ref_place int, hyp_place int, word string, heard string")


def decompose(pairs: DataFrame, keys: list[str], reference: str, hypothesis: str, raw: str, language: str, glossary: DataFrame | None = None) -> DataFrame:
    """``alignment_rows`` with the ``language`` and the ``category`` of each reference word (null for insertions).

    ``keys`` name a pair. Names come from the pair's ``raw`` text, and from ``glossary`` (``term``) for all pairs. Sums over pairs, corpora or languages are
    ``category_counts`` and ``totals`` by those columns.
    """
    steps = alignment_rows(pairs, [*keys, language], reference, hypothesis).withColumn("_fold", folded(F.col("word")))
    names = proper_nouns(pairs, keys, raw).withColumn("_named", F.lit(True)).withColumnRenamed("name", "_fold")
    labelled = steps.join(names, [*keys, "_fold"], "left")
    named = F.coalesce("_named", F.lit(False))
    if glossary is not None:
        terms = glossary.select(folded(F.col("term")).alias("_fold")).distinct().withColumn("_term", F.lit(True))
        labelled = labelled.join(terms, "_fold", "left")
        named = named | F.coalesce("_term", F.lit(False))
    category = F.when(F.col("word").isNotNull(), word_class(F.col("word"), F.col("_fold"), named, F.col(language)))
    return labelled.withColumn("category", category).select(*keys, language, "outcome", "ref_place", "hyp_place", "word", "heard", "category")


def _count(outcome: str) -> Column:
    return F.count_if(F.col("outcome") == outcome)


def category_counts(steps: DataFrame, by: list[str]) -> DataFrame:
    """(by, ``category, reference_words, hits, substitutions, deletions, error_rate, recall``) of the reference words of ``decompose``."""
    n, wrong = F.count("*"), _count(SUBSTITUTED) + _count(DELETED)
    counts = {"reference_words": n, "hits": _count(EQUAL), "substitutions": _count(SUBSTITUTED), "deletions": _count(DELETED), "error_rate": wrong / n, "recall": _count(EQUAL) / n}
    return steps.filter(F.col("category").isNotNull()).groupBy(*by, "category").agg(*[c.alias(k) for k, c in counts.items()])


def totals(steps: DataFrame, by: list[str]) -> DataFrame:
    """(by, ``reference_words, substitutions, deletions, insertions, error_rate``) of all steps; the rate of no reference words is 0."""
    n, wrong = F.count("category"), _count(SUBSTITUTED) + _count(DELETED) + _count(INSERTED)
    counts = {"reference_words": n, "substitutions": _count(SUBSTITUTED), "deletions": _count(DELETED), "insertions": _count(INSERTED), "error_rate": F.when(n > 0, wrong / n).otherwise(0.0)}
    return steps.groupBy(*by).agg(*[c.alias(k) for k, c in counts.items()])


def proper_noun_recall(steps: DataFrame, by: list[str]) -> DataFrame:
    """(by, ``hits, reference_words, recall``) of names."""
    return category_counts(steps, by).filter(F.col("category") == PROPER_NOUN).select(*by, "hits", "reference_words", "recall")
