"""Token ids in fixed-width bit-packed shards that numpy unpacks and that give any document by itself.

A shard is one byte string: a header, the number of ids of every document, and the ids, each in the fewest
bits that hold the vocabulary's largest. Ids are packed in blocks of ``BLOCK``; the header's block offsets let
a reader unpack only the blocks that hold what it wants. Shards lie in a Parquet table, a row for each, because a
Spark task can write that to any store that Spark knows; its other columns say which documents a shard holds.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, save, shuffle_parts
from .encoding import IdCoder, coder

MAGIC = b"CQID0001"
BLOCK = 8192
_HEAD = struct.Struct("<8sIIQQ")  # magic, bits, ids in a block, documents, ids


def bits_for(n_ids: int) -> int:
    """The fewest bits that hold the ids 0 to ``n_ids - 1``."""
    return max(1, int(n_ids - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, lowest bit first, without gaps; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def write_shard(docs: list[np.ndarray], bits: int) -> bytes:
    sizes = np.array([len(d) for d in docs], dtype="<u8")
    ids = np.concatenate(docs) if docs else np.zeros(0, dtype="<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join([_HEAD.pack(MAGIC, bits, BLOCK, len(docs), len(ids)), sizes.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Reads documents from a shard's bytes."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, self.block, docs, self.n = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        at = _HEAD.size
        sizes = np.frombuffer(data, dtype="<u8", count=docs, offset=at).astype(np.int64)
        at += 8 * docs
        self.offsets = np.frombuffer(data, dtype="<u8", count=-(-self.n // self.block) + 1, offset=at)
        self.base, self.data = at + 8 * len(self.offsets), data
        self.starts = np.concatenate(([0], np.cumsum(sizes)))

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from place ``first`` up to ``last`` of the shard, out of the blocks that hold them."""
        if last <= first:
            return np.zeros(0, dtype="<u4")
        a, b = first // self.block, -(-last // self.block)
        parts = [unpack(self.data[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])], self.bits, min(self.block, self.n - k * self.block)) for k in range(a, b)]
        return np.concatenate(parts)[first - a * self.block : last - a * self.block]

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """(``id``, ``ids``): every text's ids with the end id, as little-endian integers of two bytes, or four if the vocabulary needs them."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: IdCoder = coder(IdCoder, tokenizer)
        whole = "<u2" if bits_for(max(c.n_ids, (end_id or 0) + 1)) <= 16 else "<u4"
        tail = np.array([] if end_id is None else [end_id], dtype=whole)
        for b in batches:
            ids = [np.concatenate((x.astype(whole), tail)).tobytes() for x in c.encode_all(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary")


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 250_000) -> None:
    """Encode every text, append ``end_id``, and write packed shards of about ``shard_ids`` ids in ascending id order.

    The table at ``path`` has a row for each shard: ``part, shard`` (its place: parts ascend by id, shards within a part), ``before``
    (ids of the part before it), ``n_docs, n_ids, doc_ids`` and ``data``. A null or empty text has the end id alone; null ids come
    first; rows with one id are ordered by their ids' bytes, so that repeats have a defined place; other columns are not read; an
    empty table gives no shard. Texts are encoded where they are read, whole, and only their ids, under half the bytes, are dealt out by
    ranges of the document id, one shuffle. A task holds the ids of one shard, or of one very long document, at a time.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows, rows_path = save(encoded(docs, tokenizer, end_id, id_col, text_col), "encoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        bits = bits_for(max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), (end_id or 0) + 1))
        whole = "<u2" if bits <= 16 else "<u4"
        part, shard, before, held, names, n = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def full(id_type: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([n], pa.int64()), pa.array([names], pa.list_(id_type)), pa.array([write_shard(held, bits)], pa.binary())],
                ["part", "shard", "before", "n_docs", "n_ids", "doc_ids", "data"],
            )

        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for name, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append(np.frombuffer(ids.as_py(), dtype=whole))
                names.append(name)
                n += len(held[-1])
                if n >= shard_ids:
                    yield full(id_type)
                    shard, before, held, names, n = shard + 1, before + n, [], [], 0
        if held:
            yield full(id_type)

    dealt = rows.repartitionByRange(shuffle_parts(spark), F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"), "ids")
    shards = dealt.mapInArrow(run, f"part int, shard int, before long, n_docs long, n_ids long, doc_ids array<{kind}>, data binary")
    # rows are large: the writer must look at its size more often than every hundred rows, and small row groups do
    small = {"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "16"}
    shards.write.options(**small).parquet(path)
    remove(spark, rows_path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """``first``, the number of ids before each part: as many rows as the writing job had tasks."""
    parts = spark.read.parquet(path).groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("n"))
    return parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))


def read_packed(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of a packed table: its id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Null and repeated ids give a row each, as they were written; a table without shards gives no row.
    """
    kind = spark.read.parquet(path).schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, names, data in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                shard = Shard(data.as_py())
                ids, starts = shard.ids(0, shard.n), shard.starts
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names.values, pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    # a part is a task of the writing job, so the broadcast side has at most as many rows as that job had partitions
    shards = spark.read.parquet(path).join(F.broadcast(part_starts(spark, path)), "part")
    return shards.select((F.col("first") + F.col("before")).alias("base"), "doc_ids", "data").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
