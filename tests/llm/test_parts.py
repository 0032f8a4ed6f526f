"""Keys of line parts: similar lines share one, lines that merely share words have none in common, and plans stay small."""

import random

from pyspark.sql import functions as F

from colloquy.llm import line_dedup, simhash


def test_similar_lines_share_a_key_and_others_do_not(spark):
    rng = random.Random(11)
    rows = []
    for k in range(120):
        for n in (3, 9, 10, 11, 18, 19, 36, 37, 38, 75, 150):
            words = [f"w{rng.randrange(400)}" for _ in range(n)]
            rows += [(k * 1000 + n, 0, words), (k * 1000 + n, 1, words + [f"x{i}" for i in range(n // 9)]), (k * 1000 + n, 2, [f"y{k}" if i < n // 19 else w for i, w in enumerate(words)])]
    df = spark.createDataFrame([(g, j, " ".join(w)) for g, j, w in rows], "pair long, j int, line string")
    keyed = {(r["pair"], r["j"]): set(r["keys"]) for r in line_dedup.part_keys(df, 0.9).collect()}
    sets = {(g, j): set(w) for g, j, w in rows}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b]) - 1e-9
    pairs = [((g, 0), (g, j)) for g, _, _ in rows[::3] for j in (1, 2)]
    alike = [p for p in pairs if near(*p)]
    assert len(alike) > 1000 and all(keyed[a] & keyed[b] for a, b in alike)
    firsts = [(g, 0) for g, _, _ in rows[::3] if g % 1000 > 18]
    assert not any(keyed[a] & keyed[b] for a, b in zip(firsts, firsts[1:], strict=False) if not near(a, b))


def test_line_dedup_plans_hold_no_large_literal(spark, docs):
    plan = line_dedup.line_report(docs)._jdf.queryExecution().toString()
    assert len(plan) < 100_000
    keyed = line_dedup.part_keys(docs.select(F.col("text").alias("line")), 0.9)
    assert len(keyed._jdf.queryExecution().toString()) < 100_000


def test_parts_of_few_tokens_lose_no_match(spark):
    """Lines all of whose tokens but few fall into one part meet by the small part with parts of the others."""
    hashes = dict(spark.range(4000).select(F.concat(F.lit("t"), "id").alias("w"), F.xxhash64(F.concat(F.lit("t"), "id")).alias("h")).collect())
    high = [w for w, h in hashes.items() if h >= 0][:40]
    low = next(w for w, h in hashes.items() if h < 0)
    lines = [" ".join([low, *high[:12]]), " ".join([low, *high[:13]]), " ".join([low, *high[20:32]])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [r.removed for r in line_dedup.line_report(docs).orderBy("doc_id").collect()] == ["", "0", ""]
    keyed = [set(r["keys"]) for r in line_dedup.part_keys(docs.withColumnRenamed("text", "line"), 0.9).orderBy("doc_id").collect()]
    assert keyed[0] & keyed[1] and not keyed[0] & keyed[2]


def test_texts_that_share_a_rare_shingle_are_paired_only_if_they_can_be_near(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [" ".join([passage, *(f"r{rng.random()}" for _ in range(90))]) for _ in range(60)]
    rows.append(rows[0].replace("p0 ", "q0 "))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = simhash.shingle_prefixes(docs, 5, 0.8, "doc_id", "text")
    mixed = found.select(F.lit(1).alias("cell"), "x", F.col("x").alias("root"), F.lit(0).alias("main"), F.struct("n", "cells", "sig").alias("a"))
    ids = {r["x"]: r["id"] for r in found.collect()}
    assert [sorted((ids[r["x"]], ids[r["y"]])) for r in simhash.pairs_apart(mixed, 0.8).collect()] == [[0, 60]]
