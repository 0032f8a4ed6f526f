"""Speakers of single words: overlaps with turns, a most likely path of labels, and utterances cut where the speaker changes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import nearest, overlap_join
from .scoring import spread

FLOOR = 1e-6  # least share of a word that a label can have


def likely_path(gain: np.ndarray, switch: float) -> np.ndarray:
    """The column of each row on the path of most gain, in which another column than the last costs the logarithm of ``switch`` shared among the others."""
    n, m = gain.shape
    stay, change = math.log(1 - switch), math.log(switch / max(m - 1, 1))
    step = np.full((m, m), change)
    np.fill_diagonal(step, stay)
    total, back = gain[0], np.zeros((n, m), dtype=np.int32)
    for k in range(1, n):
        reach = total[:, None] + step
        back[k] = reach.argmax(axis=0)
        total = reach.max(axis=0) + gain[k]
    path = np.zeros(n, dtype=np.int32)
    path[-1] = total.argmax()
    for k in range(n - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


def word_labels(words: DataFrame, turns: DataFrame, key: str = "meeting_id", dilation: int = 200, margin: float = 1.5, switch: float = 0.05, horizon: int = 2000) -> DataFrame:
    """``words`` (key, ``idx, nth, start_ms, end_ms``) with ``label``, from turns (key, ``pos, label, start_ms, end_ms``, and ``confidence`` if they have it).

    A word's labels score their overlap with the word widened by ``dilation``; without any, the nearest turn within ``horizon`` counts, else all labels alike. A label of ``margin``
    times the next one's score is the word's; other words take the most likely path's. Words of meetings without turns have no label. The path of one meeting is one row, of a number for
    each word and label.
    """
    weight = F.col("overlap_ms") * (F.col("r_confidence") if "confidence" in turns.columns else F.lit(1.0))
    numbered = words.withColumn("row", F.row_number().over(Window.partitionBy(key).orderBy("start_ms", "idx", "nth")))
    pairs = overlap_join(numbered.select(key, "row", "start_ms", "end_ms"), turns, [key], dilation, dilation)
    scores = pairs.groupBy(key, "row", F.col("r_label").alias("label")).agg(F.sum(weight).cast("double").alias("score"))
    bare = numbered.select(key, "row", "start_ms", "end_ms").join(scores.select(key, "row").distinct(), [key, "row"], "left_anti")
    near = nearest(bare, turns, [key], horizon, "pos", "label").filter(F.col("label").isNotNull()).select(key, "row", "label", F.lit(1.0).alias("score"))
    labels = turns.groupBy(key, "label").agg(F.min(F.struct("start_ms", "pos")).alias("seen"))
    ordered = labels.withColumn("column", F.row_number().over(Window.partitionBy(key).orderBy("seen")) - 1).select(key, "label", "column")
    # a meeting's row: how many words, its labels in order, and a number for each word and label that have to do with each other
    found = scores.withColumn("own", F.lit(True)).unionByName(near.withColumn("own", F.lit(False))).filter("label is not null").withColumn("score", F.coalesce("score", F.lit(0.0)))
    cells = found.groupBy(key).agg(F.collect_list("row").alias("_at"), F.collect_list("label").alias("_named"), F.collect_list("score").alias("_score"), F.collect_list("own").alias("_own"))
    names = ordered.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "label"))), lambda x: x.label).alias("_labels"))
    sizes = numbered.groupBy(key).agg(F.max("row").alias("_n"))
    held = sizes.join(names, key).join(cells, key, "left").select(key, "_n", "_labels", "_at", "_named", "_score", "_own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [meeting_path(*(batch.column(i)[k] for i in range(1, 7)), switch, margin) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.list_(batch.column(2).type.value_type))], names=[key, "path"])

    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    paths = spread(held, [key]).mapInArrow(run, f"{key} {kinds[key]}, path array<{kinds['label']}>")
    found = paths.select(key, F.posexplode("path").alias("row", "label")).withColumn("row", F.col("row") + 1)
    return numbered.join(found, [key, "row"], "left").drop("row")


def meeting_path(size: pa.Scalar, labels: pa.Scalar, at: pa.Scalar, named: pa.Scalar, scores: pa.Scalar, owns: pa.Scalar, switch: float, margin: float) -> list:
    """The label of each of a meeting's words, from its cells (``at`` counts words from one); all labels alike for a word without any."""
    names = labels.as_py()
    column = {x: i for i, x in enumerate(names)}
    score, own = np.zeros((size.as_py(), len(names))), np.zeros((size.as_py(), len(names)))
    if at.is_valid:
        place = at.values.to_numpy(zero_copy_only=False) - 1, np.array([column[x] for x in named.as_py()], dtype=np.int64)
        value = scores.values.to_numpy(zero_copy_only=False)
        score[place] = value
        own[place] = np.where(owns.values.to_numpy(zero_copy_only=False), value, 0)
    none = score.sum(axis=1) == 0
    score[none] = 1
    path = likely_path(np.log(np.maximum(score / score.sum(axis=1, keepdims=True), FLOOR)), switch)
    if len(names) > 1:
        ranked = np.sort(own, axis=1)[:, ::-1]
        clear = (ranked[:, 0] > 0) & ((ranked[:, 1] <= 0) | (ranked[:, 0] >= margin * ranked[:, 1]))
        path = np.where(clear, own.argmax(axis=1), path)
    return [names[c] for c in path]


def rebuilt_utterances(labelled: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, ``idx, part, speaker, start_ms, end_ms, text, n_words``): the utterances of labelled words (``idx, nth, token, label, speaker``), cut where the label changes.

    A word without a label keeps its utterance's ``speaker``.
    """
    w = Window.partitionBy(key, "idx").orderBy("nth")
    said = labelled.withColumn("_who", F.coalesce("label", "speaker"))
    words = F.array_sort(F.collect_list(F.struct("nth", "token")))
    marked = said.withColumn("_change", F.when((F.row_number().over(w) == 1) | F.lag("_who").over(w).eqNullSafe(F.col("_who")), 0).otherwise(1))
    parts = marked.withColumn("part", F.sum("_change").over(w)).groupBy(key, "idx", "part")
    return parts.agg(F.min_by("_who", "nth").alias("speaker"), F.min_by("start_ms", "nth").alias("start_ms"), F.max_by("end_ms", "nth").alias("end_ms"), F.array_join(F.transform(words, lambda x: x.token), " ").alias("text"), F.count("*").alias("n_words"))
