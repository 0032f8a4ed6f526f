"""Toxicity by a classifier chain of linear models over words and word beginnings.

The categories are predicted one after the other. A later category's model also sees the earlier categories'
probabilities; in training these come from models that did not see the document (out of fold), so that the later
model learns how far to trust them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, remove, save
from .encoding import forget_coders, slices

_SPLIT = r"[^\p{L}\p{N}_]+"
PREFIXES = range(4, 9)


def word_features(word: str) -> list[str]:
    """The word and its beginnings of 4 to 8 letters, marked as such."""
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def words_of(texts: pa.Array) -> pa.ListArray:
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), _SPLIT)


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float

    def logit(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, extra: np.ndarray) -> np.ndarray:
        w = self.weights
        k = extra.shape[1]
        return np.bincount(rows, w[cols] * values, n) + self.bias + extra @ w[len(w) - k :]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, extra: np.ndarray, y: np.ndarray, features: int, ridge: float = 0.02, steps: int = 150) -> Linear:
    """Logistic regression with a ridge penalty on the weights, by limited-memory BFGS steps.

    The features of document ``rows[i]`` are ``values[i]`` at ``cols[i]``, all others are 0, and the columns of ``extra`` (earlier
    probabilities) come after the ``features`` sparse ones. It ends when the gradient is small, or after ``steps``.
    """
    n, k = extra.shape

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, values * w[cols], n) + extra @ w[features : features + k] + w[-1]
        error = sigmoid(z) - y
        slope = np.concatenate((np.bincount(cols, values * error[rows], features), extra.T @ error, [error.sum()]))
        slope[:-1] += ridge * w[:-1]
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * (w[:-1] @ w[:-1])), slope

    w = np.zeros(features + k + 1)
    w[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(slope).max() < 1e-3 * max(1.0, n / 1000):
            break
        way, alphas = -slope, []
        for s, d, r in reversed(past):
            alphas.append(r * (s @ way))
            way = way - alphas[-1] * d
        if past:
            s, d, r = past[-1]
            way = way / (r * (d @ d))
        for (s, d, r), alpha in zip(past, reversed(alphas), strict=True):
            way = way + s * (alpha - r * (d @ way))
        down, size = slope @ way, 1.0 if past else 1 / max(1.0, np.abs(slope).sum())
        while True:
            new, new_slope = loss(w + size * way)
            if new <= value + 1e-4 * size * down or size < 1e-10:
                break
            size /= 2
        moved, turned = size * way, new_slope - slope
        if moved @ turned > 1e-12:
            past = [*past[-9:], (moved, turned, 1 / (moved @ turned))]
        w, value, slope = w + moved, new, new_slope
    return Linear(w[:-1], float(w[-1]))


@dataclass(frozen=True)
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    models: list[Linear]

    def probabilities(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for m in self.models:
            out = np.column_stack((out, sigmoid(m.logit(rows, cols, values, n, out))))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        """The probability of each category, for each text."""
        found = [np.zeros((0, len(self.categories)))]
        for part in slices(texts):
            found.append(self.probabilities(*sparse(part, self.vocabulary), len(part)))
        return np.concatenate(found)


def sparse(texts: pa.Array, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of each text's features: 1 + log(count). Each distinct word is looked up once."""
    cut = words_of(texts)
    coded = cut.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(cut)), np.diff(np.asarray(cut.offsets)))
    known, columns = [], []
    for i, w in enumerate(coded.dictionary.to_pylist()):
        if got := [vocabulary[f] for f in word_features(w) if f in vocabulary]:
            known.append(i)
            columns.append(got)
    first = np.full(len(coded.dictionary), -1)
    first[known] = np.arange(len(known))
    kind = first[np.asarray(coded.indices)]
    owner, kind = owner[kind >= 0], kind[kind >= 0]
    size = np.array([len(c) for c in columns], dtype=np.int64)
    flat = np.array([x for c in columns for x in c], dtype=np.int64)
    n = size[kind] if len(kind) else np.zeros(0, dtype=np.int64)
    start = (np.cumsum(size) - size)[kind] if len(kind) else n
    cols = flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(kind) else np.zeros(0, dtype=np.int64)
    pair, count = np.unique(np.repeat(owner, n) * max(1, len(vocabulary)) + cols, return_counts=True)
    return pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary)), 1 + np.log(count)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", most_rows: int = 10_000, least_z: float = 5.0, folds: int = 5) -> Chain:
    """Fit on at most about ``most_rows`` labelled documents, chosen by a hash of the id.

    ``categories`` names each category, in the chain's order, and the SQL condition on ``labels`` that makes it
    true. Features are all words and word beginnings that at least 5 sampled documents hold and whose share differs
    between some category and the rest by ``least_z`` standard errors. Rows whose id or condition is null are left out; of
    several labels of one id a category is true if one says so; of several rows of ``docs`` with one id the least text counts, so
    no id weighs more than once; a label without a document is not used; a null text has no features. The
    folds go by a hash of the text, so exact copies share one. Without labels, or without documents for
    them, every probability is about 0.

    Spark counts the features and fits the models: one task for each category and fold, on at most the sample's rows,
    and one for the category itself. The driver gets the chosen features and the chain's weights, a number for each.
    """
    spark = docs.sparkSession
    names = list(categories)
    conditions = [f"c{i}" for i in range(len(names))]
    given = labels.select(F.col(id_col).alias("id"), *[F.expr(c).cast("int").alias(f"c{i}") for i, c in enumerate(categories.values())]).dropna()
    given = given.groupBy("id").agg(*[F.max(c).alias(c) for c in conditions])
    total = given.count()
    nothing = Chain(names, {}, [Linear(np.zeros(i), -40.0) for i in range(len(names))])
    if not total:
        return nothing
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), F.col("id")), 11) / F.lit(float(1 << 53))
    chosen = F.broadcast(given.filter(draw < min(1.0, most_rows / total)))  # about ``most_rows`` rows of numbers
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(chosen, "id")
    sample, sample_path = save(rows.groupBy("id").agg(F.min("text").alias("text"), *[F.max(c).alias(c) for c in conditions]), "toxicity-sample")
    kinds = ", ".join(f"{c} int" for c in conditions)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_coders()
        for b in batches:
            found = [sorted({f for w in ws for f in word_features(w) if w}) for ws in words_of(b.column(0)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), *b.columns[1:]], ["features", *b.schema.names[1:]])

    n, *positive = sample.agg(F.count("*"), *[F.sum(c) for c in conditions]).first()
    if not n:
        remove(spark, sample_path)
        return nothing
    each = sample.select("text", *conditions).mapInArrow(features, f"features array<string>, {kinds}").select(F.explode("features").alias("f"), *conditions)
    counted = each.groupBy("f").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"p{i}") for i, c in enumerate(conditions)]).filter("n >= 5")
    telling = F.lit(False)
    for i, p in enumerate(positive):
        if p and p < n:
            rate = F.col("n") / n
            z = (F.col(f"p{i}") / p - (F.col("n") - F.col(f"p{i}")) / (n - p)) / F.sqrt(rate * (1 - rate) * (1 / p + 1 / (n - p)) + 1e-12)
            telling = telling | (F.abs(z) >= least_z)
    vocabulary = {f: i for i, f in enumerate(sorted(r.f for r in counted.filter(telling).select("f").collect()))}
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, col, value = sparse(b.column(0), vocabulary)
            at = np.searchsorted(row, np.arange(len(b) + 1)).tolist()
            packed = [pa.array([x[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x in (col.astype("<i4"), value.astype("<f4"))]
            yield pa.RecordBatch.from_arrays([*packed, *b.columns[1:]], ["cols", "vals", *b.schema.names[1:]])

    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("text")), F.lit(folds)).cast("int").alias("fold")
    coded = sample.select("text", "id", fold, *conditions).mapInArrow(rows_of, f"cols binary, vals binary, id {id_type}, fold int, {kinds}")
    coded, coded_path = save(coded, "toxicity-rows")
    models, paths = [], [sample_path, coded_path]
    for i in range(len(names)):
        fits, fits_path = save(fitted(coded, i, folds, len(vocabulary), id_type, apart=i + 1 < len(names)), "toxicity-fits")
        paths.append(fits_path)
        r = fits.filter("weights is not null").select("weights", "bias").first()
        models.append(Linear(np.frombuffer(r.weights, dtype="<f8"), r.bias))
        if i + 1 < len(names):
            coded = coded.join(fits.filter("weights is null").select("id", F.col("p").alias(f"e{i}")), "id")
    remove(spark, *paths)
    return Chain(names, vocabulary, models)


def fitted(coded: DataFrame, category: int, folds: int, features: int, id_type: str, apart: bool) -> DataFrame:
    """The model of one category (``weights, bias``, one row) and, if ``apart``, each row's probability by a model that did not see its fold.

    Each model is a group of at most the sample's rows, so the models are fitted side by side.
    """

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        sizes = rows["cols"].map(len).to_numpy(dtype=np.int64) // 4
        owner = np.repeat(np.arange(len(rows)), sizes)
        col, value = np.frombuffer(b"".join(rows["cols"]), dtype="<i4").astype(np.int64), np.frombuffer(b"".join(rows["vals"]), dtype="<f4").astype(np.float64)
        extra = rows[[f"e{i}" for i in range(category)]].to_numpy(dtype=float)
        seen = (rows["fold"] != key[0]).to_numpy()
        place = np.cumsum(seen) - 1
        inside = seen[owner]
        model = fit_linear(place[owner[inside]], col[inside], value[inside], extra[seen], rows[f"c{category}"].to_numpy(dtype=float)[seen], features)
        if key[0] == folds:
            return pd.DataFrame({"id": [None], "p": [None], "weights": [model.weights.astype("<f8").tobytes()], "bias": [model.bias]}).astype({"p": float})
        p = sigmoid(model.logit(owner, col, value, len(rows), extra))
        return pd.DataFrame({"id": rows["id"][~seen], "p": p[~seen], "weights": None, "bias": None}).astype({"bias": float})

    model = F.explode(F.sequence(F.lit(0 if apart else folds), F.lit(folds)))
    return coded.withColumn("model", model).groupBy("model").applyInPandas(fit, f"id {id_type}, p double, weights binary, bias double")


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, and ``p_<category>`` for each category, for every row.

    A null text has no features, as an empty one; null ids and repeated rows are scored like any other; an empty
    table gives an empty one. No shuffle: a text is scored where it is read.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(chain)
    rows = docs.select(F.col(text_col).alias(fresh(docs, "_text")), F.col(id_col), *[c for c in keep if c != id_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_coders()
        for b in batches:
            p = model.value.score(b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(p[:, i]) for i in range(p.shape[1]))], [*b.schema.names[1:], *(f"p_{c}" for c in chain.categories)])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, kinds + "".join(f", p_{c} double" for c in chain.categories))
