import os

import duckdb
import pytest

import corpus_pipeline
from colloquy.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_keep_the_columns_and_their_decisions_hold(spark, docs):
    ids, columns = {r.doc_id for r in docs.collect()}, docs.columns
    rows, df = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        df, _ = corpus_pipeline.save(stage(spark, df, SF), name)
        rows[name] = df.count()
        if name != "best_fit_packing":
            assert df.columns == columns and [f.dataType for f in df.schema] == [f.dataType for f in docs.schema]
            assert {r.doc_id for r in df.collect()} <= ids
    assert rows["line_dedup"] == rows["toxicity"] < len(ids)
    assert rows["toxicity"] > rows["simhash_near_dedup"] >= rows["decontamination"] > 0.5 * len(ids)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(SQL[name])
    assert sorted(map(repr, QUERIES[name](spark, SF).select(want.columns).toPandas().astype(object).fillna("null").values.tolist())) == sorted(map(repr, want.df().astype(object).fillna("null").values.tolist()))


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_bear_odd_rows_and_an_empty_table(spark, docs, edges):
    odd = edges.select(docs.columns)
    df = docs.filter("doc_id >= 20").unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[1:]:  # toxicity judges by labels of clean ids; its edges are in test_models
        df, _ = corpus_pipeline.save(stage(spark, df, SF), name)
        if name == "line_dedup":
            assert df.count() == docs.filter("doc_id >= 20").count() + odd.count() and df.filter("text is null").count() == 1
        if name == "simhash_near_dedup":
            assert df.filter("doc_id = 4").count() == 1 and df.filter("doc_id in (8, 9)").count() <= 1  # repeated rows and equal texts stay once
    assert df.filter("doc_id is null or doc_id = 7").count() >= 2  # a null id and a text of one long word are packed
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[1:]:
        none, _ = corpus_pipeline.save(stage(spark, none, SF), name)
        assert none.count() == 0
