import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import packed_ids
from colloquy.llm.encoding import IdCoder, pieces
from colloquy.llm.packing import best_fit, configurations, pack_documents, packed_sequences, places, plan_runs
from colloquy.llm.token_counts import CountCoder, RankMerger, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b ", "\n\n x", "a \n b", "don't  <|endoftext|> x<|endoftext|>", "<|endoftext|>", "ÀÉ́ é", "a\xa0b\x85c　d", "日本語 テスト 🙂", "a\tb \t c\r\nd", "'s 't x's", "İstanbul ΣΑΣ", "x" * 3000, "a" * 777 + " aaaa", "12 345", "a  ", "\x1c a", "a\n\n\nb", "a\n\n", "\n\n\n", "a b\n\nc d\n", "\n\nab\n\n\n\nc"]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def odd_texts(docs_frame):
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab c'sé\n\t.1  ́Σ<|>") for _ in range(rng.randint(0, 60))) for _ in range(300)] + docs_frame.text.tolist()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_library(odd_texts, path):
    lib, c = library(path), IdCoder(path, most=500)
    want = [e.ids for e in lib.encode_batch(odd_texts, add_special_tokens=False)]
    assert [x.tolist() for x in c.encode_all(pa.array(odd_texts))] == want
    assert [np.frombuffer(c.encode(t), "<u4").tolist() for t in odd_texts] == want
    assert [len(x) for x in c.encode_all(pa.array([None, "a"], pa.string()))] == [0, 1]


def test_counts_equal_the_library(odd_texts):
    lib, c = library(BYTE), CountCoder(BYTE, most=500)
    want = [len(e.ids) for e in lib.encode_batch(odd_texts, add_special_tokens=False)]
    assert c.count_all(pa.array(odd_texts)).tolist() == want
    assert [c.count(t) for t in odd_texts] == want


def test_merges_by_rank_with_overlaps():
    vocab = {chr(97 + i): i for i in range(3)}
    letters = {c: i + 3 for i, c in enumerate(__import__("colloquy.llm.encoding", fromlist=["x"]).byte_letters())}
    vocab = letters | {"aa": 300, "aab": 301}
    m = RankMerger(vocab, [["a", "a"], ["aa", "b"]])
    assert m.counts([b"aaaab", b"aaab", b"", b"a", b"xyz"]).tolist() == [2, 3, 0, 1, 3]


def test_pieces_join_to_the_text(odd_texts):
    assert all(" ".join(pieces(t)) == t for t in odd_texts)


def test_token_counts_of_edges(edges, empty, edge_frame):
    lib = library(BYTE)
    want = sorted((str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in zip(edge_frame.doc_id.astype("Int64").astype(object).where(edge_frame.doc_id.notna(), None), edge_frame.text))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(edges, BYTE).collect())
    assert got == want
    assert token_counts(empty, BYTE).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 20_001, dtype=np.uint64).astype("<u4")
    assert (packed_ids.unpack(packed_ids.pack(ids, bits), bits, len(ids)) == ids).all()
    assert len(packed_ids.pack(ids, bits)) == -(-len(ids) * bits // 8)
    docs = np.split(ids, [0, 5, 5, 9000, 16_384])
    shard = packed_ids.Shard(packed_ids.write_shard(docs, bits))
    assert all((shard.doc(k) == d).all() for k, d in enumerate(docs))
    assert (shard.ids(8190, 8200) == ids[8190:8200]).all()


def packed_by_hand(frame, path, end):
    lib, start, out = library(path), 0, []
    keyed = sorted(((i is not None and i == i, i if i == i and i is not None else 0, t is not None, t or "") for i, t in zip(frame.doc_id, frame.text)))
    for has, i, _, t in keyed:
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [end], dtype="<u4")
        out.append((int(i) if has else None, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


@pytest.mark.parametrize("which", ["docs", "edges"])
def test_packed_table_round_trip(spark, tmp_path, request, which):
    df, frame = request.getfixturevalue(which), request.getfixturevalue("docs_frame" if which == "docs" else "edge_frame")
    path = f"file://{tmp_path}/packed"
    packed_ids.write_packed(df, path, WORD, end_id=1, shard_ids=5000)
    got = sorted((tuple(r) for r in packed_ids.read_packed(spark, path).collect()), key=lambda r: r[1])
    assert got == packed_by_hand(frame, WORD, 1)


def test_packed_table_of_nothing(spark, tmp_path, empty):
    path = f"file://{tmp_path}/packed"
    packed_ids.write_packed(empty, path, WORD, end_id=1)
    assert packed_ids.read_packed(spark, path).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_documents(docs, docs_frame):
    rows = pack_documents(docs, BYTE, end_id=2, capacity=1024).collect()
    used = check_packing(rows, 1024)
    total = sum(r.length for r in rows)
    assert used <= -(-total // 1024) * 1.05 + 2
    lib = library(BYTE)
    want = []
    for i, t in zip(docs_frame.doc_id, docs_frame.text):
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            e = first if k == 0 else s + 1024
            want.append((i, k, s, min(e, len(ids)) - s, zlib.crc32(ids[s:e])))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)


def test_pack_edges_and_sequences(edges, empty):
    rows = pack_documents(edges, BYTE, end_id=2, capacity=1024).collect()
    check_packing(rows, 1024)
    assert {r.doc_id for r in rows} == {None, *range(1, 10)}
    assert pack_documents(empty, BYTE, end_id=2).count() == 0
    got = packed_sequences(edges, BYTE, end_id=2).collect()
    assert sum(len(r.ids) for r in got) == sum(r.length for r in rows) and all(len(r.ids) <= 1024 for r in got)


def test_plans_hold_every_item_and_stay_near_the_bound():
    rng = np.random.default_rng(0)
    for n, capacity in ((1, 10), (50, 64), (5000, 1024), (20_000, 1024)):
        lengths = np.concatenate([rng.integers(1, capacity + 1, n), np.minimum(capacity, rng.lognormal(4, 1, n).astype(int) + 1)])
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        runs = plan_runs(counts, capacity)
        held = {}
        for r in runs:
            assert sum(a * b for a, b in r.content) + r.room == capacity
            for length, each in r.content:
                held[length] = held.get(length, 0) + each * r.bins
        assert held == counts
        assert sum(r.bins for r in runs) <= lengths.sum() / capacity * 1.02 + 3
        table = places(runs, capacity)
        assert all((t[:, 0] == np.sort(t[:, 0])).all() for t in table.values())


def test_best_fit_takes_the_tightest_room():
    from colloquy.llm.packing import Run

    runs = best_fit([Run(1, 5, [(5, 1)]), Run(1, 3, [(7, 1)])], {3: 1}, 10)
    assert sorted((r.room, tuple(r.content)) for r in runs) == [(0, ((7, 1), (3, 1))), (5, ((5, 1),))]


def test_configurations_cover_the_need():
    sizes, need = np.array([700, 400, 300]), np.array([10.0, 20.0, 30.0])
    found = configurations(sizes, need, 1000)
    assert all((p * sizes).sum() <= 1000 for p, _ in found)
    assert np.allclose(sum(p * u for p, u in found), need) and abs(sum(u for _, u in found) - 25) < 1e-6


def test_over_limit(docs):
    r = token_counts(docs, BYTE, limit=100).agg(F.sum((F.col("n_tokens") > 100).cast("int")), F.sum(F.col("over_limit").cast("int"))).first()
    assert r[0] == r[1]


def test_a_batch_is_encoded_in_one_run(monkeypatch):
    c, runs = IdCoder(WORD), []
    spread = c.spread
    monkeypatch.setattr(c, "spread", lambda texts: runs.append(len(texts)) or spread(texts))
    texts = [f"some words of text {k % 7} " * 300 + "end" for k in range(900)]  # about 6 MB
    ids = list(c.encode_all(pa.array(texts)))
    assert runs == [900] and [x.tolist() for x in ids[:7]] == [c.library.encode(t, add_special_tokens=False).ids for t in texts[:7]]
