import hashlib
import os
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontamination as dc
from colloquy.llm import secrets
from colloquy.llm.language_id import identify_languages
from colloquy.llm.queries import TOXIC_CHAIN
from colloquy.llm.toxicity import fit_chain, score_toxicity

MID = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(MID), reason="needs the driver's tables")


def spans(text):
    out = []
    for m in re.finditer(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_equal_the_rules(docs_frame):
    rng = random.Random(3)
    bits = ["password", "PassWd", "Token", "api_key", "apikey", "secret", '"', "'", " ", ":", "=", "abc", "hunter2", "AKIA", "AKIAQ", "Z9" * 9, "deadbeef", "0123", "ſecret", "toKen", "\n", ".", "é🙂"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + docs_frame.text.tolist()
    for t in texts:
        assert [x[:3] for x in secrets.base_spans(t)] == spans(t), t


def test_secrets_by_owner(spark):
    shared, own = "token: examplevalue1", "token: livevalue99"
    odd = "Zx9Kq2Lm7Pw4Rt8Vb3Nc6Yd1"
    rows = [(i, f"é {shared} and {odd if i < 1 else ''}", f"s{i}") for i in range(6)] + [(10, own, "s1"), (11, own, "s1"), (12, None, None)]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3].n_example == 1 and got[3].n_live == 0 and got[10].n_live == 1
    assert got[0].n_live == 1 and "opaque" in got[0].spans and got[0].n_assign == 1
    assert (got[10].secrets[0].owners, got[10].secrets[0].repos) == (1, 2)
    assert got[12].spans == "" and got[12].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].base_sha256 == hashlib.sha256(b"assign:2:22").hexdigest()


def test_secrets_of_one_owner_with_many_copies_stay_live(spark):
    odd, key = "Zx9Kq2Lm7Pw4Rt8Vb3Nc6Yd1", "token: livevalue99"
    rows = [(i, f"{key} and {odd}", "s1", f"r{i}") for i in range(8)] + [(20 + i, "token: bothvalue11", f"s{i % 2}", f"r{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    for repo_col, both in ((None, (1, 0)), ("repo", (0, 1))):
        got = {r.doc_id: r for r in secrets.scan_secrets(df, repo_col=repo_col).collect()}
        assert all((got[i].n_live, got[i].n_example) == (2, 0) and "opaque" in got[i].spans for i in range(8))
        assert (got[0].secrets[0].owners, got[0].secrets[0].repos) == (1, 8) and (got[20].n_live, got[20].n_example) == both


def test_secrets_of_edges(edges, empty, edge_frame):
    got = secrets.scan_secrets(edges).collect()
    assert len(got) == len(edge_frame) and sum(r.n_assign for r in got) == 2 and secrets.scan_secrets(empty).count() == 0


@needs_tables
def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = got[got.held_out & (got.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_languages_of_edges(edges, empty):
    got = {(r.doc_id, r.lang_pred == "und") for r in identify_languages(edges).collect()}
    assert {(1, True), (2, True), (3, True), (5, False)} <= got
    assert identify_languages(empty).count() == 0
    assert {r.lang_pred for r in identify_languages(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@needs_tables
def test_toxicity_on_documents_it_did_not_see(spark):
    docs, labels = spark.read.parquet(f"{MID.replace('0.01', '0.1')}/documents.parquet"), spark.read.parquet(f"{MID.replace('0.01', '0.1')}/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0
    chain = fit_chain(docs, labels.filter(seen), TOXIC_CHAIN)
    got = score_toxicity(docs, chain).join(labels.filter(~seen), "doc_id").toPandas()
    said = got.p_toxic >= 0.5
    assert (said & (got.toxic == 1)).sum() / (got.toxic == 1).sum() > 0.85
    assert (said & (got.toxic == 0)).sum() / (got.toxic == 0).sum() < 0.02


def test_toxicity_of_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 0, 0), (5, None, 1), (6, 1, 1), (None, 0, 1), (6, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    got = score_toxicity(edges, fit_chain(edges, labels, TOXIC_CHAIN), keep=("text", "n", "row"))
    assert got.count() == edges.count() and {"p_low_quality", "p_toxic", "n", "row"} <= set(got.columns)
    chain = fit_chain(empty, labels.limit(0), TOXIC_CHAIN)
    assert score_toxicity(edges, chain).filter("p_toxic > 0.5").count() == 0 and score_toxicity(empty, chain).count() == 0


def test_block_max_wand_equals_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        words = [f"w{i}" for i in range(30)]
        pieces = [dc.Piece(i, rng.choices(words, k=rng.randint(1, 8)), rng.choices(words, k=rng.randint(1, 4))) for i in range(rng.randint(1, 60))]
        df = {}
        for p in pieces:
            for w in set(p.question + p.answer):
                df[w] = df.get(w, 0) + 1
        index = dc.BlockMaxIndex.build(pieces, df, len(pieces), 6.0, block=3)
        for _ in range(20):
            terms = [index.terms[w] for w in set(rng.choices(words, k=rng.randint(1, 15))) if w in index.terms]
            threshold = rng.choice([0.2, 0.4, 0.6, 0.9])
            scores = {}
            for t in terms:
                for number, part in zip(index.numbers[t], index.parts[t]):
                    scores[number] = scores.get(number, 0) + part
            want = {k: round(v, 9) for k, v in scores.items() if v >= threshold - 1e-9}
            assert {k: round(v, 9) for k, v in index.search(terms, threshold)} == want


def test_search_finds_what_every_window_scored_alone_finds():
    rng = random.Random(5)
    words = [f"q{i}" for i in range(400)]
    items = [dc.Piece(i, rng.choices(words, k=12), rng.choices(words, k=6)) for i in range(25)]
    df = {}
    for p in items:
        for w in set(p.question + p.answer):
            df[w] = df.get(w, 0) + 1
    index, how = dc.BlockMaxIndex.build(items, df, len(items), 18.0), dc.Search(passage=32, stride=16)
    texts = [None, "", "..."]
    for k in range(40):
        w = rng.choices(words, k=rng.randint(0, 150))
        p = items[k % 25]
        w[len(w) // 2 : len(w) // 2] = p.question + p.answer if k % 2 else []
        texts.append(" ".join(w).upper() + ".")
    got = {(r, i) for r, i, *_ in dc.search_texts(index, pa.array(texts, pa.string()), how)}
    want = set()
    for r, t in enumerate(texts):
        w = dc.words_of(t or "")
        for at in range(0, max(1, len(w)), how.stride):
            part = w[at : at + how.passage]
            have = part
            for number, p in enumerate(items):
                score = sum(x for t_, x in ((t_, dict(zip(index.numbers[t_], index.parts[t_])).get(number, 0)) for t_ in {index.terms[x] for x in part if x in index.terms}))
                if score >= how.threshold - 1e-9 and dc.overlap(p.question, have) >= 0.5 and dc.overlap(p.answer, have) >= 0.5:
                    want.add((r, p.item))
    assert got == want and len(got) >= 18


@needs_tables
def test_leaks_are_found_and_clean_documents_left(spark):
    docs, bench = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()}
    flat = {r.doc_id: " ".join(dc.words_of(r.text)) for r in docs.collect()}
    want = {(d, r.item_id) for r in bench.collect() for d, t in flat.items() if " ".join(dc.words_of(r.text)) in t}
    assert want <= got and len(got - want) <= 0.05 * len(want)
    kept = {r.doc_id for r in dc.decontaminate(docs, bench).collect()}
    assert kept == set(flat) - {d for d, _ in got}


def test_decontamination_of_edges(spark, edges, empty):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog"), (2, None), (3, ""), (None, "nothing like it anywhere at all"), (1, "the cat sat on the mat and looked at the dog")], "item_id long, text string")
    got = dc.contaminated(edges, bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(None, 1)]
    assert dc.decontaminate(edges, bench).count() == edges.count() - 1 and dc.decontaminate(edges, bench).columns == edges.columns
    assert dc.contaminated(empty, bench).count() == 0 and dc.contaminated(edges, bench.limit(0)).count() == 0
    sharded = dc.contaminated(edges, bench, most_bytes=40).collect()
    assert [(r.doc_id, r.item_id) for r in sharded] == [(None, 1)]


def test_long_and_tiny_items_need_their_own_question_and_answer(spark):
    context, answer = [f"c{i}" for i in range(190)], [f"a{i}" for i in range(10)]
    long_one = " ".join(context) + ". " + " ".join(answer) + "."
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(64)) + " house"), (2, long_one), (3, "red fox"), (4, "small blue boats sail. they never return")], "item_id long, text string")
    pad = " ".join(f"p{i}" for i in range(150))
    rows = [
        (10, "a house by the sea"), (11, " ".join(context[:70])), (12, " ".join(context)), (13, f"{pad} {long_one} {pad}"), (14, " ".join(f"w{i}" for i in range(64)) + " house"),
        (15, "fox and hound in red"), (16, "the red fox runs"), (17, "they never return but small blue boats sail"), (18, "Small blue boats sail; they never return."),
        (19, " ".join(context[60:]) + " " + " ".join(answer)),
    ]
    got = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(13, 2), (14, 1), (16, 3), (18, 4), (19, 2)]
    assert [(r.question_overlap, r.answer_overlap) for r in got if r.doc_id == 13] == [(1.0, 1.0)]


def test_long_items_are_cut():
    p = dc.items_to_pieces(1, " ".join(f"w{i}" for i in range(150)), 64)
    assert [len(x.question + x.answer) for x in p] == [64, 64, 22]
    assert dc.question_and_answer("What is it? It is a cat.") == (["what", "is", "it"], ["it", "is", "a", "cat"])
    assert dc.overlap(["a"], ["b", "a"]) == 1.0 and dc.overlap(["a", "b"], ["b", "a"]) == 0.0
