"""Columns named like the operators' own survive."""

import public_tokenizers
from pyspark.sql import functions as F

from colloquy.llm.decontamination import decontaminate
from colloquy.llm.packing import pack, token_pieces

OWN = {"bucket": "b", "nth": 7, "before": 1.5, "n": "n", "sequence_id": "s", "offset": "o"}


def test_pack_keeps_columns(spark, docs, empty):
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, 1024).withColumns({k: F.lit(v) for k, v in OWN.items()})
    out = pack(pieces, 1024)
    assert out.columns == [*pieces.columns, "_sequence_id", "_offset"] and out.count() == pieces.count()
    assert out.select(*OWN).distinct().collect() == [tuple(OWN.values())]
    most = out.groupBy("_sequence_id").agg(F.sum("length").alias("t"), F.max(F.col("_offset") + F.col("length")).alias("e")).collect()
    assert all(r.t == r.e <= 1024 for r in most)
    assert pack(pieces.limit(0), 1024).count() == 0


def test_decontaminate_keeps_columns_and_odd_rows(spark, edges, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    wide = edges.withColumnsRenamed({"x": "_key", "row": "__key", "n": "item"})
    bad = wide.limit(1).select(*[F.lit(99).alias("doc_id") if c == "doc_id" else F.lit("before " * 200 + item + " after").alias("text") if c == "text" else F.col(c) for c in wide.columns])
    got = decontaminate(wide.unionByName(bad), bench)
    assert got.columns == wide.columns and sorted(map(str, got.collect())) == sorted(map(str, wide.collect()))
    assert decontaminate(wide.limit(0), bench).count() == 0 and decontaminate(wide, bench.limit(0)).count() == wide.count()
