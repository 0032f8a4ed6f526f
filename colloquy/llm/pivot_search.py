"""Exact search for the largest inner products by an index of distances to pivots.

Vectors get one more coordinate that brings all of them to the norm of the longest, so that the largest inner product belongs to the nearest
vector. Each is keyed by its nearest pivot and its distance from it; sorted by that key and cut into blocks, a pivot's vectors are rings
around it. A query's k-th best score so far is a radius around the query; by the triangle inequality a ring whose distances from the pivot
all differ from the query's by more than the radius holds nothing better. The search begins with the rings next to a query and widens
until no ring is left within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH, remove, save, setting, shuffle_parts

RING = 4096  # vectors of a block of the index at most
QUERIES = 256  # queries of a block at most
UNKNOWN = np.iinfo(np.int64).min  # k-th best score of a query that has fewer than k results


def usable(vec: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor values that are not finite."""
    x = vec.cast("array<double>")
    return vec.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def whole_numbers(vec: Column, scale: float) -> Column:
    """``floor(scale * x)`` of each component as long."""
    return F.transform(vec.cast("array<double>"), lambda v: F.floor(F.lit(float(scale)) * v))


@dataclass(frozen=True)
class Space:
    """What all tasks know of the vectors: dimension, type, longest norm, and the pivots with the added coordinate."""

    dim: int
    dtype: str
    floats: bool  # whether sums of products are exact in doubles
    longest: float  # squared norm
    pivots: np.ndarray
    k: int

    def pack(self, vecs: pa.Array) -> np.ndarray:
        """A row for each vector, shorter ones padded with zeros."""
        size = np.diff(np.asarray(vecs.offsets, dtype=np.int64))
        out = np.zeros((len(vecs), self.dim), dtype=self.dtype)
        out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(vecs.flatten())
        return out

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, dtype=self.dtype).reshape(-1, self.dim)

    def from_pivots(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Distances of vectors or queries from all pivots; a query's added coordinate is zero."""
        x = x.astype(np.float64)
        norm = np.einsum("ij,ij->i", x, x)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.longest - norm))
        p = self.pivots
        square = (norm + more**2)[:, None] + np.einsum("ij,ij->i", p, p) - 2 * (x @ p[:, :-1].T + more[:, None] * p[:, -1])
        return np.sqrt(np.maximum(0, square))

    def radius(self, x: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """How far from each query a vector can be that reaches the k-th best score, with room for rounding."""
        x = x.astype(np.float64)
        square = np.einsum("ij,ij->i", x, x) + self.longest - 2 * kth.astype(np.float64)
        return np.where(kth == UNKNOWN, np.inf, np.sqrt(np.maximum(0, square)) + self.room())

    def room(self) -> float:
        return 1e-6 * (1 + self.longest**0.5)

    def scores(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        if self.floats:
            return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
        return q.astype(np.int64) @ v.astype(np.int64).T


def centres(sample: np.ndarray, most: int, rounds: int = 10) -> np.ndarray:
    """At most ``most`` centres of a sample: farthest points first, then means."""
    at = [0]
    far = np.full(len(sample), np.inf)
    while len(at) < min(most, len(sample)):
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
        if far.max() == 0:
            break
        at.append(int(far.argmax()))
    c = sample[at]
    for _ in range(rounds):
        own = ((sample**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * sample @ c.T).argmin(axis=1)
        size = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c = np.where(size[:, None] > 0, sums / np.maximum(1, size)[:, None], c)
    return c


def fit_space(rows: DataFrame, k: int, pivots: int, sample: int) -> Space | None:
    """Counts over all of ``rows`` (``id``, ``v``), and pivots from the ``sample`` rows with the least hashes of their ids; none without rows."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    top = rows.agg(F.max(F.size("v")).alias("dim"), F.max(largest).alias("most"), F.max(square).alias("longest")).first()
    if top["dim"] is None:
        return None
    if top["longest"] >= 2.0**63:
        raise ValueError("inner products of these vectors do not fit in a long")
    dtype = "int16" if top["most"] < 2**15 else "int32" if top["most"] < 2**31 else "int64"
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    plain = Space(max(1, top["dim"]), dtype, top["longest"] < 2.0**52, top["longest"], np.zeros((1, max(1, top["dim"]) + 1)), k)
    x = plain.pack(drawn).astype(np.float64)
    more = np.sqrt(np.maximum(0, top["longest"] - (x**2).sum(axis=1)))
    return Space(plain.dim, dtype, plain.floats, plain.longest, centres(np.hstack([x, more[:, None]]), pivots), k)


def first_copies(packed: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows with the ``most`` least distinct ids of each distinct vector."""
    _, own = np.unique(np.ascontiguousarray(packed).view(np.dtype((np.void, packed.shape[1] * packed.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((ids, own))
    o, i = own[order], ids[order]
    new = np.append(True, (o[1:] != o[:-1]) | (i[1:] != i[:-1]))
    order, o = order[new], o[new]
    return order[np.arange(len(o)) - np.searchsorted(o, o) < most]


def _keyed(rows: DataFrame, space: Space, query: bool) -> DataFrame:
    """``id``, packed vector ``x``, nearest pivot and distance; a query's are those of the same vector in the index. Of copies within a batch only those with the k + 1 least ids can be results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = np.asarray(batch.column("id")), space.pack(batch.column("v"))
            if not query and len(ids):
                at = first_copies(x, ids, space.k + 1)
                ids, x = ids[at], x[at]
            d = space.from_pivots(x, False)
            own = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(x)), own])], names=["id", "x", "pivot", "d"])

    return rows.mapInArrow(run, "id long, x binary, pivot int, d double")


def _blocks(keyed: DataFrame, most: int) -> DataFrame:
    """Rows in order of (pivot, distance), cut into blocks of one pivot and at most ``most`` rows: ``block, pivot, lo, hi, ids, xs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made, base = 0, TaskContext.get().partitionId() << 32

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal made
            made += 1
            d = np.asarray(t["d"])
            cols = {"block": [base + made], "pivot": [t["pivot"][0].as_py()], "lo": [d.min()], "hi": [d.max()], "ids": [np.asarray(t["id"], dtype="<i8").tobytes()], "xs": [b"".join(t["x"].to_pylist())]}
            types = {"block": pa.int64(), "pivot": pa.int32(), "lo": pa.float64(), "hi": pa.float64(), "ids": pa.binary(), "xs": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(v, types[c]) for c, v in cols.items()], names=list(cols))

        def cut(t: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            out, at = [], 0
            p = np.asarray(t["pivot"])
            while at < len(t):
                end = min(at + most, int(np.searchsorted(p, p[at], "right")))
                if end == len(t) and end - at < most and not last:
                    break
                out.append(block(t.slice(at, end - at)))
                at = end
            return out, t.slice(at)

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= most:
                out, rest = cut(pa.Table.from_batches(held), False)
                held = rest.to_batches()
                yield from out
        if sum(map(len, held)):
            yield from cut(pa.Table.from_batches(held), True)[0]

    parts = shuffle_parts(keyed.sparkSession)
    dealt = keyed.repartitionByRange(parts, "pivot", "d", "id").sortWithinPartitions("pivot", "d", "id")
    return dealt.mapInArrow(run, "block long, pivot int, lo double, hi double, ids binary, xs binary")


def _reaches(state: DataFrame, space: Space, share: float) -> DataFrame:
    """For each block of queries and each pivot, between which distances from it the queries look, at ``share`` of their radii."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, xs, kth in zip(batch.column("q").to_pylist(), batch.column("xs").to_pylist(), batch.column("kth").to_pylist(), strict=True):
                x = space.unpack(xs)
                d, r = space.from_pivots(x, True), space.radius(x, np.frombuffer(kth, dtype="<i8"))[:, None] * share
                near, far = (d - r).min(axis=0) - space.room(), (d + r).max(axis=0) + space.room()
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(near), pa.int64()), pa.array(np.arange(len(near), dtype=np.int32)), pa.array(near), pa.array(far)], names=["q", "pivot", "near", "far"])

    return state.select("q", "xs", "kth").mapInArrow(run, "q long, pivot int, near double, far double")


def best_of(score: np.ndarray, ids: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, score) of each query's k best, its own id aside; ids rise and are distinct. Scores under ``kth`` cannot be results."""
    at = np.searchsorted(ids, own)
    hit = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == own)
    score[np.flatnonzero(hit), at[hit]] = UNKNOWN
    least = np.maximum(kth, UNKNOWN + 1)
    if score.shape[1] > k:
        least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
    i, j = np.nonzero(score >= least[:, None])
    order = np.lexsort((j, -score[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    i, j = i[keep], j[keep]
    return i, ids[j], score[i, j]


def _search(work: DataFrame, space: Space) -> DataFrame:
    """``query_id, vec_id, score`` of each pair of blocks: the queries that the ring can matter to, times the ring's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in batch.to_pylist():
                x, own, kth = space.unpack(w["qxs"]), np.frombuffer(w["qids"], dtype="<i8"), np.frombuffer(w["kth"], dtype="<i8")
                d, r = space.from_pivots(x, True)[:, w["pivot"]], space.radius(x, kth)
                near = (d - r <= w["hi"] + space.room()) & (d + r >= w["lo"] - space.room())
                if not near.any():
                    continue
                x, own, kth = x[near], own[near], kth[near]
                ids, v = np.frombuffer(w["ids"], dtype="<i8"), space.unpack(w["xs"])
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], v[order]
                score = space.scores(x, v)
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                if len(first) < len(ids):  # an id that several vectors hold counts with the best
                    score, ids = np.maximum.reduceat(score, first, axis=1), ids[first]
                i, vec, s = best_of(score, ids, own, kth, space.k)
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(vec), pa.array(s)], names=["query_id", "vec_id", "score"])

    return work.mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_kth(blocks: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
    """Blocks of queries with the k-th best score of each, in the order of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kth = []
            for ids, known in zip(batch.column("ids").to_pylist(), batch.column("known").to_pylist(), strict=True):
                of = {r["query_id"]: r["score"] for r in known or []}
                kth.append(np.array([of.get(i, UNKNOWN) for i in np.frombuffer(ids, dtype="<i8").tolist()], dtype="<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("ids"), batch.column("xs"), pa.array(kth, pa.binary())], names=["q", "ids", "xs", "kth"])

    rows = blocks.select(F.col("block").alias("q"), "ids", "xs")
    if best is None:
        known = rows.withColumn("known", F.lit(None).cast("array<struct<query_id:bigint,score:bigint>>"))
    else:
        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for q, ids in zip(batch.column("q").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    of = np.unique(np.frombuffer(ids, dtype="<i8"))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), q)), pa.array(of)], names=["q", "query_id"])

        held = rows.select("q", "ids").mapInArrow(members, "q long, query_id long")
        scored = held.join(best.filter(F.col("rank") == k).select("query_id", "score"), "query_id")
        known = rows.join(scored.groupBy("q").agg(F.collect_list(F.struct("query_id", "score")).alias("known")), "q", "left")  # at most QUERIES
    return known.select("q", "ids", "xs", "known").mapInArrow(run, "q long, ids binary, xs binary, kth binary")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = 32, sample: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` takes, the ``k`` other ids with the largest inner products of ``floor(scale * x)``.

    Ties go to the smaller id; a query with fewer than ``k`` others has them all. Rows without an id, and vectors that are null or hold nulls or values that
    are not finite, take no part; an empty vector is all zeros, as are the components that shorter vectors lack. An id that several rows hold, as
    query or as candidate, counts once, with its best score; copies under other ids all count. Products past 64 bits stop the job with an
    error. An empty table gives an empty one; other columns are not looked at. Only the pivots come from a sample, of ``sample`` rows; every row is indexed.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vec_col), scale).alias("v"), is_query.alias("asks"))
    space = fit_space(rows.select("id", "v"), k, pivots, sample)
    if space is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    with setting(spark, BATCH, "10000"):
        index, _ = save(_blocks(_keyed(rows.select("id", "v"), space, False), RING), "rings")
        asked, _ = save(_blocks(_keyed(rows.filter("asks").select("id", "v"), space, True), QUERIES), "queries")
    best = done = None
    for share in (0.0, 0.5, 1.0):
        best, done = _round(spark, index, asked, best, done, space, share)
    return best.select("query_id", "rank", "vec_id", "score")


def _round(spark: SparkSession, index: DataFrame, asked: DataFrame, best: DataFrame | None, done: DataFrame | None, space: Space, share: float) -> tuple[DataFrame, DataFrame]:
    """Search the rings that come within ``share`` of the queries' radii and were not searched before; best results so far, and pairs of blocks done.

    The first round, before any radius is known, takes the rings around a query's own pivot that lie at its distance.
    """
    with setting(spark, BATCH, "16"):  # a row holds a ring and a block of queries
        state, state_path = save(_with_kth(asked, best, space.k), "state")
        salts = 1 + shuffle_parts(spark) // len(space.pivots)
        if best is None:
            reach = asked.select(F.col("block").alias("q"), "pivot", F.col("lo").alias("near"), F.col("hi").alias("far"))
        else:
            reach = _reaches(state, space, share)
        rings = index.select("block", "pivot", "lo", "hi", F.pmod("block", F.lit(salts)).alias("salt"))
        spread = reach.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        pairs = spread.join(rings, ["pivot", "salt"]).filter((F.col("hi") >= F.col("near")) & (F.col("lo") <= F.col("far"))).select("q", "block")
        if done is not None:
            pairs = pairs.join(done, ["q", "block"], "left_anti")
        pairs, _ = save(pairs, "pairs")
        asks = pairs.join(state.select("q", F.col("ids").alias("qids"), F.col("xs").alias("qxs"), "kth"), "q")
        found = _search(asks.join(index, "block").select("qids", "qxs", "kth", "pivot", "lo", "hi", "ids", "xs"), space)
        new, _ = save(_ranked(found if best is None else found.unionByName(best.select("query_id", "vec_id", "score")), space.k), "best")
    remove(spark, state_path)
    return new, pairs if done is None else done.unionByName(pairs)
