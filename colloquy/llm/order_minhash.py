"""Order MinHash fingerprints of texts, and how alike two of them are.

A text's k-mers are numbered by occurrence. Each of the sketches hashes (k-mer, occurrence) its own way, takes the
``picks`` least, puts them back in text order and hashes that tuple. Two texts agree in a sketch only if they share
those k-mers in the same order, so agreement falls with edit distance and not only with set overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH, save, setting, shuffle_parts

COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class OrderMinHash:
    """``sketches`` tuples of ``picks`` k-mers of ``k`` characters; a fingerprint has 4 hex digits for each sketch."""

    k: int = 8
    picks: int = 2
    sketches: int = 64
    block: int = 8192

    def items(self, text: str) -> np.ndarray:
        """A 64-bit hash of each (k-mer, occurrence number), in text order. A shorter text is one k-mer."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        k = min(self.k, len(codes))
        n = len(codes) - k + 1
        h = np.full(n, k, dtype=np.uint64)
        for t in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[t : t + n] + np.uint64(1)
        h = mix(h)
        low = np.uint64(n.bit_length())  # k-mers sort by their hash, then by place in the low bits
        place = np.sort((h >> low << low) | np.arange(n, dtype=np.uint64))
        head = place >> low
        at = np.arange(n)
        since = np.maximum.accumulate(np.where(np.concatenate(([True], head[1:] != head[:-1])), at, 0))
        nth = np.empty(n, dtype=np.uint64)
        nth[(place & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)] = (at - since).astype(np.uint64)
        return np.where(nth > 0, mix(h + nth * np.uint64(0xD1B54A32D192ED03)), h)

    def fingerprint(self, text: str | None) -> np.ndarray:
        """One 16-bit number for each sketch; zeros for a text without characters."""
        if not text:
            return np.zeros(self.sketches, dtype=np.uint16)
        x = self.items(text)
        short = (x >> np.uint64(32)).astype(np.uint32)
        seed = mix(np.arange(1, 2 * self.sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
        factor, shift = (seed[: self.sketches] | np.uint32(1))[:, None], seed[self.sketches :][:, None]
        row = np.arange(self.sketches)
        value = np.zeros((self.sketches, 0), dtype=np.uint32)
        where = np.zeros((self.sketches, 0), dtype=np.int64)
        for at in range(0, len(x), self.block):
            h = (short[None, at : at + self.block] ^ shift) * factor
            for _ in range(min(self.picks, h.shape[1])):
                least = h.argmin(axis=1)
                value = np.column_stack((value, h[row, least]))
                where = np.column_stack((where, least + at))
                h[row, least] = np.uint32(0xFFFFFFFF)
            if value.shape[1] > self.picks:
                best = np.argsort(value, axis=1, kind="stable")[:, : self.picks]
                value, where = np.take_along_axis(value, best, 1), np.take_along_axis(where, best, 1)
        where.sort(axis=1)
        out = np.zeros(self.sketches, dtype=np.uint64)
        for i in range(where.shape[1]):
            out = mix(out * np.uint64(31) + x[where[:, i]] + np.uint64(1))
        return (out >> np.uint64(48)).astype(np.uint16) | np.uint16(1)

    @staticmethod
    def likeness(a: np.ndarray, b: np.ndarray) -> float:
        """The share of sketches in which two fingerprints agree."""
        return float(np.mean(a == b))

    @staticmethod
    def text_of(fingerprint: np.ndarray) -> str:
        return fingerprint.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _row(sketch: OrderMinHash, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    new = edited(text, following)
    changed = sketch.fingerprint(new)
    return (len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), sketch.text_of(own), sketch.text_of(changed), sketch.likeness(own, changed), sketch.likeness(own, other))


def _batch(names: list, rows: list[tuple], id_type: pa.DataType, more: list[pa.Array], more_names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    heads = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(names, id_type), *cols, *more], ["id", *heads, *more_names])


def edit_fingerprints(docs: DataFrame, sketch: OrderMinHash = OrderMinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike it is to that and to the next document.

    The next document is the one after it by descending id; the first follows the last. A null text is empty; two
    empty texts are alike (1.0), an empty and another one are not (0.0); null ids come last; rows with one id are ordered
    by text; an only row follows itself; an empty table gives an empty one. Rows are dealt by ranges of the id,
    one shuffle, and each task reads its rows in turn; the one row that each task leaves open waits for
    the first row of the next task that has any, in a second pass over as many rows as there were tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, id_type = None, None, None
        for b in batches:
            id_type, names, rows = b.column(0).type, [], []
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                own = sketch.fingerprint(text)
                if held is None:
                    first = text
                else:
                    names.append(held[0])
                    rows.append(_row(sketch, held[1], held[2], text, own))
                held = (name, text, own)
            nothing = [pa.nulls(len(names), t) for t in (pa.int32(), pa.string(), pa.string())]
            yield _batch(names, rows, id_type, nothing, ["part", "last_text", "first_text"])
        if held is not None:
            open_row = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([held[1]]), pa.array([first])]
            yield _batch([held[0]], [(None,) * 6], id_type, open_row, ["part", "last_text", "first_text"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_row(sketch, a, sketch.fingerprint(a), n, sketch.fingerprint(n)) for a, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield _batch(b.column(0).to_pylist(), rows, b.column(0).type, [], [])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(shuffle_parts(docs.sparkSession), F.desc_nulls_last("id")).sortWithinPartitions(F.desc_nulls_last("id"), F.desc("text"))
    with setting(docs.sparkSession, BATCH, "500"):  # a task's texts need not stand in memory beside their sorted rows
        found, _ = save(dealt.mapInArrow(run, f"id {kind}, {COLUMNS}, part int, last_text string, first_text string"), "order-minhash")
    ends = found.filter("part is not null")
    order = Window.orderBy("part")  # over part numbers alone, as many as there were tasks
    after = ends.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("after"))
    pairs = ends.select("id", "part", "last_text").join(after, "part").join(ends.select(F.col("part").alias("after"), "first_text"), "after")
    closed = pairs.select("id", "last_text", "first_text").mapInArrow(close, f"id {kind}, {COLUMNS}")
    return found.filter("part is null").select(closed.columns).unionByName(closed).withColumnRenamed("id", id_col)
