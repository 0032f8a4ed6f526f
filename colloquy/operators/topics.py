"""Topics, ranking and clustering of transcripts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keywords(terms: DataFrame, group: str, limit: int = 5) -> DataFrame:
    """(group, ``term, tf, df, score, rank``): the terms of most TF x ln(1 + N / df) of each group; ties go by term."""
    tf = terms.groupBy(group, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = terms.select(group).distinct().agg(F.count("*").alias("n"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * F.log(1 + F.col("n") / F.col("df")), 6))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit).select(group, "term", "tf", "df", "score", "rank")


def text_rank(sentences: DataFrame, key: str, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(key, ``idx, score``) of sentences (key, ``idx, terms``): power iteration over shared terms, one meeting a group.

    Two sentences of two terms or more are linked by their shared terms over the sum of the logarithms of their numbers of terms.
    """

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        sets = [frozenset(t) for t in group["terms"]]
        n = len(sets)
        vocabulary = {w: i for i, w in enumerate({w for s in sets for w in s})}
        has = np.zeros((n, max(1, len(vocabulary))))
        for i, s in enumerate(sets):
            has[i, [vocabulary[w] for w in s]] = 1
        many = np.array([len(s) >= 2 for s in sets])
        size = np.log(np.maximum([len(s) for s in sets], 1))
        weight = np.divide(has @ has.T, size[:, None] + size[None, :], out=np.zeros((n, n)), where=many[:, None] & many[None, :])
        np.fill_diagonal(weight, 0)
        out = weight.sum(axis=1, keepdims=True)
        step = np.divide(weight, out, out=np.full((n, n), 1 / n), where=out > 0)
        score = np.full(n, 1 / n)
        for _ in range(rounds):
            new = (1 - damping) / n + damping * (score @ step)
            if np.abs(new - score).sum() < tolerance:
                score = new
                break
            score = new
        return pd.DataFrame({key: group[key], "idx": group["idx"], "score": score})

    kind, idx = sentences.schema[key].dataType.simpleString(), sentences.schema["idx"].dataType.simpleString()
    return sentences.select(key, "idx", "terms").groupBy(key).applyInPandas(solve, f"{key} {kind}, idx {idx}, score double")


def block_counts(tokens: list[str], width: int, block: int) -> list[tuple[int, int, int, int]]:
    """(gap, products of the counts on both sides, squares left, squares right) of each gap between runs of ``width`` tokens, by sums that slide on with the gap."""
    rows = [tokens[i : i + width] for i in range(0, len(tokens) - width + 1, width)]
    left, right = defaultdict(int), defaultdict(int)
    both = ll = rr = 0
    out = []
    for gap in range(-1, len(rows) - 1):
        if gap >= 0:
            for t in rows[gap]:
                n, m = left[t], right[t]
                rr, ll, both = rr - 2 * m + 1, ll + 2 * n + 1, both - n + m - 1
                left[t], right[t] = n + 1, m - 1
        if gap >= block:
            for t in rows[gap - block]:
                n = left[t]
                ll, both = ll - 2 * n + 1, both - right[t]
                left[t] = n - 1
        for row in rows[1 : block + 1] if gap == 0 else rows[gap + block : gap + block + 1] if gap > 0 else rows[:1]:
            for t in row:
                m = right[t]
                rr, both = rr + 2 * m + 1, both + left[t]
                right[t] = m + 1
        if gap >= 0:
            out.append((gap, both, ll, rr))
    return out


def similarity_of_tokens(texts: DataFrame, key: str) -> DataFrame:
    """``block_similarity`` of (key, ``tokens, width, block``), an array of a key's tokens in order. A row is worked on where it lies, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("tokens", "width", "block")]
            for i in range(batch.num_rows):
                tokens, width, block = (c[i].as_py() for c in columns)
                found = block_counts(tokens or [], width, block)
                if found:
                    keys = batch.column(key).take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, pa.int64()) for c in zip(*found, strict=True)]], names=[key, "gap", "lr", "ll", "rr"])

    kind = texts.schema[key].dataType.simpleString()
    dots = texts.select(key, "tokens", "width", "block").mapInArrow(run, f"{key} {kind}, gap long, lr long, ll long, rr long")
    norm = F.sqrt(F.col("ll") * F.col("rr"))
    return dots.select(key, "gap", F.round(F.when(norm > 0, F.col("lr") / norm).otherwise(0.0), 6).alias("similarity"))


def block_similarity(tokens: DataFrame, key: str, width: int = 20, block: int = 6, sizes: DataFrame | None = None) -> DataFrame:
    """TextTiling's (key, ``gap, similarity``): the cosine of term counts in the ``block`` pseudo-sentences on either side of a gap.

    ``tokens`` has (key, ``pos, term``), which come together once, as an array of a key; a remainder shorter than ``width`` at the end is left out. With ``sizes``
    (key, ``width, block``) each key has its own, and keys without a row have no gaps.
    """
    held = tokens.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x.term).alias("tokens"))
    sized = held.withColumns({"width": F.lit(width), "block": F.lit(block)}) if sizes is None else held.join(sizes.select(key, "width", "block"), key)
    return similarity_of_tokens(sized, key)


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, label, ``dim, value``): the mean of the vectors of a label, scaled to length one, a row for each dimension."""
    each = vectors.select(*keys, label, F.posexplode(vector).alias("dim", "v"))
    mean = each.groupBy(*keys, label, "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(*keys, label)))
    return mean.select(*keys, label, "dim", F.when(norm > 0, F.col("m") / norm).otherwise(0.0).alias("value"))


def centroid_cosines(found: DataFrame, label: str = "label") -> DataFrame:
    """(``a, b, cosine``), a < b, of centroids as rows. The pairs are of labels, met through their dimensions."""
    a, b = found.select(F.col(label).alias("a"), "dim", F.col("value").alias("x")), found.select(F.col(label).alias("b"), "dim", F.col("value").alias("y"))
    return a.join(b, "dim").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))


def chunk_plan(units: DataFrame, key: str, budget: int, overlap: int = 0) -> DataFrame:
    """(key, ``chunk, first_idx, last_idx, n_tokens``): units packed in order up to ``budget`` tokens each.

    A chunk starts with the last units of the one before that fit in ``overlap`` tokens. One meeting is one group.
    """

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        ids, sizes = group["idx"].tolist(), group["n_tokens"].tolist()
        out, start = [], 0
        while start < len(ids):
            end, total = start, 0
            while end < len(ids) and (end == start or total + sizes[end] <= budget):
                total += sizes[end]
                end += 1
            out.append([group[key].iloc[0], len(out), ids[start], ids[end - 1], total])
            if end == len(ids):
                break
            back, held = end, 0
            while back - 1 > start and held + sizes[back - 1] <= overlap:
                back -= 1
                held += sizes[back]
            start = back
        return pd.DataFrame(out, columns=[key, "chunk", "first_idx", "last_idx", "n_tokens"])

    kind, idx = units.schema[key].dataType.simpleString(), units.schema["idx"].dataType.simpleString()
    return units.select(key, "idx", F.col("n_tokens").cast("long").alias("n_tokens")).groupBy(key).applyInPandas(solve, f"{key} {kind}, chunk int, first_idx {idx}, last_idx {idx}, n_tokens long")


def topic_gaps(similarity: DataFrame, key: str, width: int = 2, passes: int = 1, cutoff: float = 0.5) -> DataFrame:
    """(key, ``gap, smoothed, depth, candidate``) of TextTiling's (key, ``gap, similarity``), gaps numbered from 0.

    Each pass averages ``2 width + 1`` values, the first and last standing in beyond the ends. A gap's depth is how far it lies below
    the peaks reached by going up on either side, level stretches included. Candidates are deeper than 0 and than the mean less ``cutoff``
    standard deviations of their ``key``.
    """
    w = Window.partitionBy(key).orderBy("gap")
    whole, edge = Window.partitionBy(key), F.count("*").over(Window.partitionBy(key)) - 1
    x = similarity.select(key, "gap", F.col("similarity").alias("smoothed"))
    for _ in range(passes):
        inside = F.sum("smoothed").over(w.rowsBetween(-width, width))
        before, after = F.greatest(width - F.col("gap"), F.lit(0)), F.greatest(F.col("gap") + width - edge, F.lit(0))
        ends = before * F.first("smoothed").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + after * F.last("smoothed").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        x = x.select(key, "gap", F.round((inside + ends) / (2 * width + 1), 9).alias("smoothed"))
    # a stretch that falls to the right begins at its left peak, one that rises ends at its right peak
    rises, falls = F.lag("smoothed").over(w) < F.col("smoothed"), F.lag("smoothed").over(w) > F.col("smoothed")
    x = x.withColumn("r", F.when(rises, 1).otherwise(0)).withColumn("f", F.when(falls, 1).otherwise(0))
    x = x.withColumn("down", F.sum("r").over(w)).withColumn("up", F.sum("f").over(w))
    left, right = F.max("smoothed").over(Window.partitionBy(key, "down")), F.max("smoothed").over(Window.partitionBy(key, "up"))
    x = x.withColumn("depth", F.round(left + right - 2 * F.col("smoothed"), 9)).select(key, "gap", "smoothed", "depth")
    least = F.greatest(F.avg("depth").over(whole) - cutoff * F.stddev_pop("depth").over(whole), F.lit(0.0))
    return x.withColumn("candidate", F.col("depth") > least + 1e-9)
