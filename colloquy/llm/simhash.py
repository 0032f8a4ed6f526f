"""SimHash near-duplicates: fingerprints joined on a grid of per-segment bit counts, and their components.

Two fingerprints that differ in d bits have segment counts whose Manhattan distance is at most d, and so agree in all but d
groups of segments. The grid's range join therefore meets fingerprints that agree in some choice of groups, keeps the
pairs whose counts are near enough, and verifies those on the fingerprints themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_counted, remove, save
from .encoding import forget_coders

GROUPS = 6  # groups of segments in the grid's keys
CROWD = 64  # more distinct fingerprints than that in a cell are linked by their one-bit neighbours
_PLANES = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; all words if there are fewer; none without words.

    Words are runs of bytes other than ASCII white space, A-Z in lower case.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], seed) for a, b in zip(begins[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: a bit is set if over half of the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.ascontiguousarray(hashes[at : at + 65536]).astype("<u8", copy=False)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << _PLANES).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id``, ``fp``): every row's fingerprint as a signed long. A null text is empty and has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([majority(shingle_hashes(t.as_py(), words)) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def long(x: int) -> Column:
    """64 bits as a signed literal."""
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def segment_counts(fp: Column) -> Column:
    """The bit counts of the 32 segments of two bits, each in unary: 00, 01 or 11.

    Two such embeddings differ in as many bits as the Manhattan distance of their counts.
    """
    odd, high = long(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(odd), 1))


def grid_keys(counts: Column, apart: int = 2) -> Column:
    """A key for each choice of ``apart`` of the groups of segments: the counts of all other groups, and which those are.

    Counts at a Manhattan distance of ``apart`` or less differ in at most so many groups, so they share a key.
    """
    bounds = [2 * (32 * g // GROUPS) for g in range(GROUPS + 1)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    keys = []
    for k, out in enumerate(combinations(range(GROUPS), apart)):
        keys.append(F.xxhash64(F.lit(k), counts.bitwiseAND(long(sum(m for g, m in enumerate(masks) if g not in out)))))
    return F.array(*keys)


def links(fps: DataFrame, apart: int = 2) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints with the same components as all pairs at ``apart`` bits or less.

    ``fps`` has one row for each fingerprint. Fingerprints that share a cell of the grid are a pair if the Manhattan distance of
    their segment counts allows it and their own bits, which decide, differ in ``apart`` or less. Of a cell with over
    ``CROWD`` fingerprints (copies with small changes) no pairs are made: there a fingerprint stands for itself and its 64 one-bit
    neighbours, and all that share one, which are those at 2 bits or less, are linked to the least. So a group of any
    size makes links in proportion to its members; both ways are exact.
    """
    if apart != 2:
        raise ValueError("crowded cells are linked at 2 bits")
    spark = fps.sparkSession
    placed = fps.select("fp", F.explode(grid_keys(segment_counts(F.col("fp")), apart)).alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    shared, path = save(placed.join(sizes, "cell"), "cells")
    few = shared.filter(F.col("n") <= CROWD)
    a, b = few.select("cell", F.col("fp").alias("a")), few.select("cell", F.col("fp").alias("b"))
    near = F.bit_count(segment_counts(F.col("a")).bitwiseXOR(segment_counts(F.col("b")))) <= apart
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= apart
    pairs = a.join(b, "cell").filter((F.col("a") < F.col("b")) & near & exact).select("a", "b")
    crowd = shared.filter(F.col("n") > CROWD).select("fp").distinct()
    around, around_path = save(crowd.select("fp", F.explode(F.array("fp", *[F.col("fp").bitwiseXOR(long(1 << k)) for k in range(64)])).alias("mid")), "neighbours")
    heads = around.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("hi")).filter("a < hi").select("mid", "a")
    starred = around.join(heads, "mid").filter("a < fp").select("a", F.col("fp").alias("b"))
    out, _ = save(pairs.unionByName(starred).distinct(), "links")
    remove(spark, path, around_path)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``root``): the least node of the component, for every node of ``edges``.

    Alternates large-star and small-star steps until the links no longer change; each step is two aggregations and
    two joins over the links, and its result is written to the shared folder, so that nothing is computed again.
    A hub's row is joined, never collected; the number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    links, path = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "star")
    state = None
    while True:
        # large star: every larger neighbour of a node links to the least of the node and its neighbours
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # small star: a node's smaller neighbours, and itself, link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = save(small, "star")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, path)
        links, path = new, new_path
        if now == state:
            break
        state = now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_groups(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id``, ``n_copies``.

    Documents link when their fingerprints differ in 2 bits or less; ``component_id`` is the least id that can be
    reached by links, itself included; ``n_copies`` counts the rows with the same fingerprint. Null texts and texts without
    words have fingerprint zero and link like any other; a null id is reached but never names a component unless
    all its members are null; repeated rows stay; an empty table gives an empty one. Rows with one fingerprint are
    combined before any join, and no step makes pairs within a group.
    """
    spark = docs.sparkSession
    found, _ = save(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes, classes_path = save(found.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n_copies")), "classes")
    edges = links(classes.select("fp"))
    roots = components(edges)
    rooted, rooted_path = save(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", "n_copies", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fingerprints"))
    named, _ = save(join_counted(rooted, least, ["root"], F.col("fingerprints")).select("fp", "n_copies", "component_id"), "named")
    remove(spark, classes_path, rooted_path)
    out = join_counted(found, named, ["fp"], F.col("n_copies"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")


SKETCH = 1 << 18  # hash buckets in which shingles are counted
MARKS = 1536  # bits of a text's parity fingerprint
LONGS = MARKS // 64
CELLS = 12  # segments of the parity fingerprint whose bits are counted


def shingle_rarity(docs: DataFrame, words: int, text_col: str) -> np.ndarray:
    """A frequency class for each of ``SKETCH`` hash buckets of shingles, 4 steps for each doubling, from all texts.

    Any fixed order of shingles gives an exact search; counts only serve to place widely shared shingles last. So a batch of texts
    counts the shingles that two of them share, and those that one text has alone, by far the most, do not fill the buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.int64)
        for b in batches:
            each = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column(0)]
            shingle, n = np.unique(np.concatenate(each), return_counts=True)
            total += np.bincount((shingle[n > 1] % np.uint64(SKETCH)).astype(np.int64), n[n > 1], SKETCH).astype(np.int64)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["b", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "b int, n long").groupBy("b").agg(F.round(4 * F.log2(F.sum("n") + 1)).cast("tinyint").alias("c")).toArrow()
    out = np.zeros(SKETCH, dtype=np.uint8)
    out[counts["b"].to_numpy()] = counts["c"].to_numpy()
    return out


def shingle_prefixes(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(``id``, ``x``, ``fp``, ``n``, ``cells``, ``sig``, ``prefix``): a hash that names the text, its SimHash, its number of distinct shingles, parity
    fingerprint with the bit counts of its segments, and rarest shingles.

    Two sets of Jaccard similarity s or more share one of the first ``n - ceil(s n) + 1`` shingles of each, in an order
    that all sets follow. A bit of the fingerprint says whether an odd number of shingles fall on it, so two fingerprints differ in at
    most as many bits as the sets in members, and the bit counts of their segments in at most as much again. Texts without
    words share the prefix 0.
    """
    rarity = docs.sparkSession.sparkContext.broadcast(shingle_rarity(docs, words, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = rarity.value
        forget_coders()
        for b in batches:
            fps, sizes, cells, sigs, firsts = [], [], [], [], []
            for t in b.column(2):
                h = shingle_hashes(t.as_py(), words)
                fps.append(majority(h))
                h = np.unique(h)
                n = len(h)
                order = np.argsort(classes[(h % np.uint64(SKETCH)).astype(np.int64)], kind="stable")  # h ascends, so ties go by hash
                sizes.append(n)
                odd = (np.bincount((h % np.uint64(MARKS)).astype(np.int64), minlength=MARKS) & 1).astype(np.uint8)
                cells.append(odd.reshape(CELLS, -1).sum(axis=1, dtype=np.int32))
                sigs.append(np.packbits(odd).view(np.int64))
                firsts.append(h[order[: n - math.ceil(similarity * n - 1e-9) + 1]].view(np.int64) if n else np.zeros(1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(sigs, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))], ["id", "x", "fp", "n", "cells", "sig", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_name(text_col).alias("x"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, x long, fp long, n int, cells array<int>, sig array<long>, prefix array<long>")


def text_name(text_col: str) -> Column:
    """A 64-bit hash that names a text; null counts as empty."""
    return F.xxhash64(F.lit("text"), F.coalesce(F.col(text_col), F.lit("")))


def cell_distance(a: Column, b: Column) -> Column:
    """The Manhattan distance of two texts' segment counts: a lower bound of ``differing_bits``."""
    return sum((F.abs(F.get(a, F.lit(k)) - F.get(b, F.lit(k))) for k in range(CELLS)), F.lit(0))


def differing_bits(a: Column, b: Column) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(LONGS)), F.lit(0))


def can_be_near(similarity: float) -> Column:
    """Whether texts ``a`` and ``b`` (structs of ``n``, ``cells``, ``sig``) can be similar: sizes, segment counts and parity fingerprints."""
    # sets of n and m shingles with similarity s have s / (1 + s) of n + m in common, and differ in what is left
    both_n = F.col("a.n") + F.col("b.n")
    apart_by = both_n - 2 * F.ceil(both_n * (similarity / (1 + similarity)) - 1e-9)
    sizes_fit = F.least("a.n", "b.n") >= F.lit(similarity) * F.greatest("a.n", "b.n") - 1e-9
    return sizes_fit & (cell_distance(F.col("a.cells"), F.col("b.cells")) <= apart_by) & (differing_bits(F.col("a.sig"), F.col("b.sig")) <= apart_by)


def pairs_apart(mixed: DataFrame, similarity: float) -> DataFrame:
    """(``x``, ``y``), x > y: texts of one cell that lie in different components and can be similar, one of them outside the cell's ``main`` component.

    ``mixed`` has ``cell, x, root, main`` and ``a``, the text's size and fingerprint: they are compared in the join, so that only pairs that can be
    similar are made, however many texts share the cell. The comparisons themselves still grow with the square of a cell whose texts do not link.
    """
    other = mixed.filter("root <> main").select("cell", F.col("x").alias("y"), F.col("root").alias("y_root"), F.col("a").alias("b"))
    met = mixed.join(other, (mixed.cell == other.cell) & (F.col("root") != F.col("y_root")) & can_be_near(similarity))
    return met.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def near_text_links(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts with their least document, and links between texts whose shingle sets have a Jaccard similarity of ``similarity``, with the same
    components as all such pairs.

    SimHash fingerprints that ``links`` joins on its grid, and texts of one fingerprint, are looked at first. As 2 of 64 bits reach only very near
    texts, those that share one of their rarest shingles (an exact prefix filter, which loses no pair) meet as well: all with the least of them,
    and then those outside the largest component of the group with all of another component. A group of near copies that hang together makes pairs
    in proportion to its members; texts that share a rare shingle and link to none are compared with all such, in number with the square of the
    group. Of any pair the sizes, the segment counts of the parity fingerprints
    under the Manhattan distance and these fingerprints' own distance rule out most, and shingle sets decide.
    """
    spark = docs.sparkSession
    found, found_path = save(shingle_prefixes(docs, words, similarity, id_col, text_col), "prefixes")
    texts, _ = save(found.groupBy("x").agg(F.min("id").alias("least"), F.count("*").alias("rows"), F.any_value(F.struct("fp", "n", "cells", "sig", "prefix")).alias("own")).select("x", "least", "rows", "own.*"), "texts")
    remove(spark, found_path)
    placed = texts.select("x", F.explode("prefix").alias("cell"))
    heads = placed.groupBy("cell").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("cell", "lo", "n")
    members, members_path = save(placed.join(heads, "cell").select("cell", "x", "lo", "n"), "members")

    sigs = texts.select("x", F.struct("n", "cells", "sig").alias("a"))

    def verify(pairs: DataFrame, compared: bool = False) -> tuple[DataFrame, str]:
        near = pairs if compared else pairs.join(sigs, "x").join(sigs.withColumnsRenamed({"x": "y", "a": "b"}), "y").filter(can_be_near(similarity))
        near, near_path = save(near.select("x", "y"), "near")
        ends = near.select("x").unionByName(near.select(F.col("y").alias("x"))).distinct()
        named = docs.select(text_name(text_col).alias("x"), F.col(text_col).alias("text")).join(ends, "x", "left_semi")

        def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["x", "set"])

        sets, sets_path = save(named.mapInArrow(shingles, "x long, set array<long>").groupBy("x").agg(F.any_value("set").alias("set")), "shingles")
        both = near.join(sets.withColumnRenamed("set", "a"), "x").join(sets.select(F.col("x").alias("y"), F.col("set").alias("b")), "y")
        common = F.size(F.array_intersect("a", "b"))
        union = F.size("a") + F.size("b") - common
        out, path = save(both.filter((common >= F.lit(similarity) * union - 1e-9)).select("x", "y"), "near-texts")
        remove(spark, near_path, sets_path)
        return out, path

    classes, classes_path = save(texts.groupBy("fp").agg(F.min("x").alias("head")), "classes")
    near_fps = links(classes.select("fp")).join(classes.withColumnsRenamed({"fp": "a", "head": "x"}), "a").join(classes.withColumnsRenamed({"fp": "b", "head": "y"}), "b").select("x", "y")
    alike = near_fps.unionByName(texts.join(classes, "fp").filter("x > head").select("x", F.col("head").alias("y")))
    pair = F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")
    first, _ = verify(alike.unionByName(members.filter("x > lo").select("x", F.col("lo").alias("y"))).select(*pair).distinct())
    remove(spark, classes_path)

    def unsettled(found: DataFrame) -> tuple[DataFrame, str]:
        """Members of cells that lie in several components of ``found``, with their component and the cell's most frequent one."""
        placed = members.filter("n > 2").select("cell", "x").join(components(found, "x", "y"), F.col("x") == F.col("node"), "left").select("cell", "x", F.coalesce("root", "x").alias("root"))
        placed, placed_path = save(placed, "placed")
        most = placed.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.mode("root", True).alias("main")).filter("lo < hi").select("cell", "main")
        out, path = save(placed.join(most, "cell").join(sigs, "x"), "unsettled")
        remove(spark, placed_path)
        return out, path

    mixed, mixed_path = unsettled(first)
    second, _ = verify(pairs_apart(mixed, similarity), compared=True)
    remove(spark, mixed_path, members_path)
    return texts.select("x", "least", "rows"), first.unionByName(second).distinct()


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first by id of their group of near copies.

    Groups are components of texts that are equal or whose sets of ``words``-word shingles have a Jaccard similarity of
    ``similarity`` or more. Null and empty texts, and texts without words, are alike; null ids come last; of rows with
    one id and text one stays; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    texts, linked = near_text_links(docs, words, similarity, id_col, text_col)
    roots = components(linked, "x", "y")
    grouped, *paths = save(texts.join(roots, texts.x == roots.node, "left").select("x", "least", F.coalesce("root", "x").alias("root")), "grouped")
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("null_id"), "least", "x")).alias("best")).select("best.least", "best.x")
    x, at = fresh(docs, "_x"), fresh(docs, "_least")
    named = docs.withColumn(x, text_name(text_col))
    kept = named.join(best.withColumnsRenamed({"least": at, "x": x}), x).filter(F.col(id_col).eqNullSafe(F.col(at)))
    kept, _ = save(kept.select(*docs.columns, x), "kept")
    remove(spark, *paths)
    many = kept.groupBy(x).agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(x)
    single = kept.join(many, x, "left_anti")
    return single.unionByName(kept.join(many, x, "left_semi").dropDuplicates([x])).select(docs.columns)
