"""How good minutes are: action items and decisions found, owners right, and names and numbers that nobody said."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import basic
from ..functions.text import fold
from .scoring import assign_row, for_each_meeting

NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
CAPITALISED = r"[A-ZÀ-ÖØ-Þ][\p{L}\p{N}_’'-]*(?:\s+[A-ZÀ-ÖØ-Þ][\p{L}\p{N}_’'-]*)*"


def set_similarity(a: str, b: str) -> float:
    """The best ratio of matching characters between the shared words, and those with either side's own; 1 if one text's words are among
    the other's."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return float(x == y)
    both = sorted(x & y)
    forms = [" ".join(both), " ".join(both + sorted(x - y)), " ".join(both + sorted(y - x))]
    return max(SequenceMatcher(None, forms[i], forms[j]).ratio() for i, j in ((0, 1), (0, 2), (1, 2)))


def most_similarity(a: list[str], b: list[str]) -> np.ndarray:
    """For each two texts at least their ``set_similarity``: from the lengths of what they share, and from how often each has a character."""
    sets = [[sorted(set(t.split())) for t in side] for side in (a, b)]
    words, signs = ({x: i for i, x in enumerate(sorted(found))} for found in ({w for side in sets for s in side for w in s}, {c for side in sets for s in side for w in s for c in w} | {" "}))
    has, counts = ([np.zeros((len(side), len(of))) for side in sets] for of in (words, signs))
    for n, side in enumerate(sets):
        for i, s in enumerate(side):
            has[n][i, [words[w] for w in s]] = 1
            for c in " ".join(s):
                counts[n][i, signs[c]] += 1
    length = [c.sum(axis=1) for c in counts]
    shared = has[0] @ has[1].T
    both = (has[0] * [len(w) + 1 for w in words]) @ has[1].T - (shared > 0)
    alike = np.zeros((len(a), len(b)))
    for i, own in enumerate(counts[0]):
        alike[i] = np.minimum(own, counts[1]).sum(axis=1)
    ratio = lambda same, whole: 2 * same / np.maximum(whole, 1)
    out = np.maximum(ratio(alike, length[0][:, None] + length[1]), ratio(both, both + np.minimum.outer(length[0], length[1])))
    return np.where((length[0][:, None] == 0) & (length[1] == 0), 1.0, out)


def best_pairs(a: list[str], b: list[str]) -> list[tuple[int, int, float]]:
    """(place in ``a``, place in ``b``, similarity) of the pairing of most ``set_similarity``.

    Pairs are assigned by bounds; what that pairs is then compared, and a text whose bound was too high is assigned anew, each time after twice as
    many comparisons, until all that is paired has been compared. As bounds are never too low, no other pairing has more. The shorter side is filled up, so that no place stays free.
    """
    size = max(len(a), len(b))
    cost, known = np.zeros((size, size)), np.ones((size, size), dtype=bool)
    cost[: len(a), : len(b)], known[: len(a), : len(b)] = -most_similarity(a, b), False
    row_price, col_price, owner = np.zeros(size), np.zeros(size), np.full(size, -1)
    waiting, tries = list(range(size)), [0] * size

    def compare(r: int, h: int) -> None:
        cost[r, h], known[r, h] = -set_similarity(a[r], b[h]), True

    while waiting:
        for row in waiting:
            assign_row(cost, row, row_price, col_price, owner)
        waiting = []
        for h, r in enumerate(owner.tolist()):
            if not known[r, h]:
                bound = cost[r, h]
                compare(r, h)
                if cost[r, h] > bound + 1e-12:
                    owner[h] = -1
                    waiting.append(r)
                    tries[r] += 1
                    left = np.flatnonzero(~known[r])
                    for c in left[np.argsort((cost[r] - col_price)[left], kind="stable")[: 1 << tries[r]]].tolist():
                        compare(r, c)
    return sorted((r, h, float(-cost[r, h])) for h, r in enumerate(owner.tolist()) if r < len(a) and h < len(b))


def token_set_similarity(a: Column, b: Column) -> Column:
    """``set_similarity`` of two normalised texts, in Arrow batches; null if either is."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series([None if x is None or y is None else set_similarity(x, y) for x, y in zip(xs, ys, strict=True)], dtype="float64")

    return run(a, b)


def item_matches(reference: DataFrame, hypothesis: DataFrame, key: str = "meeting_id", threshold: float = 0.7) -> DataFrame:
    """(key, ``matched, reference_count, hypothesis_count, precision, recall, f1, owner_accuracy``) of items (key, ``text, owner``).

    Items of a meeting are paired for the most token-set similarity of their normalised texts; pairs below ``threshold`` do not count.
    Owners agree without case and accents, null as an empty name. A side without items scores 1 against none, else 0. A meeting's items,
    of both sides, are one row: there are as many as its minutes list.
    """
    side = lambda df, n: df.select(key, F.lit(n).alias("side"), basic(F.coalesce("text", F.lit(""))).alias("text"), F.trim(fold(F.coalesce("owner", F.lit("")))).alias("owner"))

    def solve(meeting: list[dict]) -> tuple[int, int, int, int]:
        refs, hyps = (sorted((r["text"], r["owner"]) for r in meeting if r["side"] == n) for n in (0, 1))
        pairs = [(r, h) for r, h, like in best_pairs([t for t, _ in refs], [t for t, _ in hyps]) if like >= threshold]
        return len(pairs), len(refs), len(hyps), sum(refs[r][1] == hyps[h][1] for r, h in pairs)

    found = for_each_meeting(side(reference, 0).unionByName(side(hypothesis, 1)), [key], solve, dict.fromkeys(["matched", "reference_count", "hypothesis_count", "right"], "long"))
    m, r, h = F.col("matched"), F.col("reference_count"), F.col("hypothesis_count")
    share = lambda n, other: F.when(n > 0, m / n).otherwise(F.when(other == 0, 1.0).otherwise(0.0))
    scored = found.withColumn("precision", share(h, r)).withColumn("recall", share(r, h))
    p, q = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0)).withColumn("owner_accuracy", F.when(m > 0, F.col("right") / m).otherwise(0.0)).drop("right")


def decision_recall(reference: DataFrame, hypothesis: DataFrame, key: str = "meeting_id", threshold: float = 0.7) -> DataFrame:
    """(key, ``recall``): the share of expected decisions (key, ``text``) that were found; 1 where none was expected."""
    named = lambda df: df.select(key, "text", F.lit(None).cast("string").alias("owner"))
    found = item_matches(named(reference), named(hypothesis), key, threshold)
    return found.select(key, F.when(F.col("reference_count") > 0, F.col("matched") / F.col("reference_count")).otherwise(1.0).alias("recall"))


def mentions(sentence: Column) -> Column:
    """Numbers and capitalised runs of a sentence; a single capitalised word at its start is none."""
    runs = F.regexp_extract_all(sentence, F.lit(f"({CAPITALISED})"), 1)
    first = sentence.rlike("^[A-ZÀ-ÖØ-Þ]") & ~F.coalesce(F.get(runs, F.lit(0)), F.lit("")).contains(" ")
    return F.concat(F.regexp_extract_all(sentence, F.lit(f"({NUMBER})"), 1), F.when(first, F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1)))).otherwise(runs))


def surface_terms(text: Column) -> Column:
    """Folded words, and numbers without their points and commas: what a mention or an utterance says."""
    words = F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), lambda n: F.regexp_replace(n, "[.,]", ""))
    return F.array_distinct(F.concat(words, numbers))


def hallucination_rate(claims: DataFrame, utterances: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, ``mentions, unsupported, rate``): mentions of the sentences ``claim`` with a term that no utterance of the meeting has; 0 of none.

    A number counts by its digits alone, a name by each of its words. Null texts say nothing. Mentions meet what was said in a join on
    terms, so no vocabulary is gathered.
    """
    named = claims.select(key, F.explode(mentions(F.coalesce("claim", F.lit("")))).alias("m"))
    number = F.col("m").rlike(f"^{NUMBER}$")
    terms = F.when(number, F.array(F.regexp_replace("m", "[.,]", ""))).otherwise(F.regexp_extract_all(fold(F.col("m")), F.lit(r"([\p{L}\p{N}]+)"), 1))
    counted = named.groupBy(key, "m").agg(F.count("*").alias("n")).withColumn("term", F.explode_outer(terms))
    said = utterances.select(key, F.explode(surface_terms(F.col("text"))).alias("term")).distinct().withColumn("said", F.lit(1))
    each = counted.join(said, [key, "term"], "left").groupBy(key, "m", "n").agg(F.max((F.col("said").isNull() & F.col("term").isNotNull()).cast("int")).alias("bad"))
    sums = each.groupBy(key).agg(F.sum("n").alias("mentions"), F.sum(F.col("n") * F.col("bad")).alias("unsupported"))
    out = claims.select(key).distinct().join(sums, key, "left").select(key, F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("unsupported", F.lit(0)).alias("unsupported"))
    return out.withColumn("rate", F.when(F.col("mentions") > 0, F.col("unsupported") / F.col("mentions")).otherwise(0.0))
