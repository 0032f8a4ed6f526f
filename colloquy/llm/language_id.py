"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LETTER = None
ORDERS = (1, 2, 3)


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; everything but letters is 0, in runs of one."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(_LETTER[codes], codes, 0)
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    return codes[keep]


def ngram_buckets(codes: np.ndarray, buckets: int) -> np.ndarray:
    """The hash bucket of every n-gram of each order; a word's border counts as a character."""
    padded = np.concatenate(([0], codes, [0])).astype(np.uint64)
    out, h = [], np.zeros(len(padded), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(padded) < n:
            break
        h = h[: len(padded) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + padded[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(out)


@dataclass(frozen=True)
class LanguageModel:
    """``log_prob[bucket, language]`` and ``log_prior[language]``."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray

    def predict(self, text: str | None, block: int = 200_000) -> tuple[str, float]:
        """The most probable language and its posterior; ``und`` and 0 for a text without letters."""
        codes = letter_codes(text or "")
        if not self.languages or not codes.any():
            return "und", 0.0
        score = self.log_prior.copy()
        ids = ngram_buckets(codes, len(self.log_prob))
        for at in range(0, len(ids), block):
            score += self.log_prob[ids[at : at + block]].sum(axis=0, dtype=np.float64)
        best = int(score.argmax())
        return self.languages[best], float(1 / np.exp(score - score[best]).sum())


def train(docs: DataFrame, text_col: str, lang_col: str, key_col: str, buckets: int = 1 << 15, most_docs: int = 3000, smoothing: float = 0.5) -> LanguageModel:
    """Fit on at most about ``most_docs`` documents of each language, chosen by a hash of ``key_col``.

    Priors come from all rows. Counts are combined in Spark; the driver gets one number for each language and
    bucket, whose product is checked against 256 MB of log-probabilities.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    totals = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(totals)
    if 8 * buckets * len(languages) > 256 << 20:
        raise ValueError("too many languages for this number of buckets")
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((buckets, 0)))
    share = F.element_at(F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, most_docs / totals[lang]))]), F.col(lang_col))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("language"), F.col(key_col)), 11) / F.lit(float(1 << 53))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), buckets), dtype=np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[place[lang]] += np.bincount(ngram_buckets(letter_codes(text.as_py()), buckets), minlength=buckets)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    sample = rows.filter(draw < share).select(lang_col, text_col)
    got = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((buckets, len(languages)))
    n[got["bucket"], got["lang"]] = got["n"]
    prior = np.array([totals[x] for x in languages], dtype=float)
    return LanguageModel(languages, np.log(prior / prior.sum()), np.log((n + smoothing) / (n.sum(axis=0) + smoothing * buckets)))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 15, most_docs: int = 3000) -> DataFrame:
    """One row for each document: ``id_col, held_out, lang_pred, score``.

    A document is held out if the CRC-32 of its id as text is a multiple of 5; the others with a language train the
    model, which sees n-grams alone. A null id is neither held out nor trained on. A null text or one without a letter gets
    ``und`` and 0, and so does every text if nothing can be learned; repeated rows each give a row; an empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held.alias("held"))
    model = spark.sparkContext.broadcast(train(rows.filter(~F.col("held")), "text", "lang", "id", buckets, most_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.value.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.select("id", F.coalesce("held", F.lit(False)).alias("held_out"), "text").mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
