import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from colloquy.llm.cross_align import SentenceCoder, SpacedCoder, align_tokens, link_report
from colloquy.llm.encoding import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "\n", "\n\n\n", "\nab", " ab", "ab ", "a  b\n\n c", "a\n\n\nb", "é́🙂 日本語", "<|endoftext|> x", "<s> </s> <unk> <0x41>", "a▁b", "▁", "x\x00y", "tab\tend\r\n", "ﬁ Ａ", "x" * 5000, "can't won't 12345 __init__", "the " * 3000]


class Plain:
    """The definition, token by token."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        back = {c: bytes([k]) for k, c in enumerate(byte_letters())}
        self.a_bytes = {k: b"".join(back.get(c, b"") for c in t) for t, k in self.a.get_vocab().items()}

    def b_bytes(self, k):
        p = self.b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        ta, tb = [(k, self.a_bytes[k]) for k in ids_a], [(k, self.b_bytes(k)) for k in ids_b]
        same = all(b"".join(x for _, x in t) == b" " + text.encode() for t in (ta, tb))
        return (ta, tb) if same else ([], [])

    def aligned(self, text):
        def spans(ts):
            at = 0
            for k, x in ts:
                yield k, at, at + len(x)
                at += len(x)

        ta, tb = (list(spans(t)) for t in self.tokens(text))
        links = [(i, j) for i, (_, s, e) in enumerate(ta) for j, (_, u, v) in enumerate(tb) if s < v and u < e] if len(ta) < 2000 else self.swept(ta, tb)
        shared = sorted({e for *_, e in ta} & {e for *_, e in tb})
        groups, lo = [], 0
        for e in shared if len(ta) < 2000 else shared[:0]:
            groups.append(([k for k, _, x in ta if lo < x <= e], [k for k, _, x in tb if lo < x <= e]))
            lo = e
        return ta, tb, links, groups

    @staticmethod
    def swept(ta, tb):
        i = j = 0
        out = []
        while i < len(ta) and j < len(tb):
            out.append((i, j))
            x, y = ta[i][2], tb[j][2]
            i, j = i + (x <= y), j + (y <= x)
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def texts(docs_frame):
    rng = random.Random(5)
    return ODD + ["".join(rng.choice("ab cé\n\n.1 <|▁🙂d") for _ in range(rng.randint(0, 40))) for _ in range(200)] + docs_frame.text.tolist()[:60] + ["a b\nthe cat", "a b\nthe cat"]


def test_coders_equal_the_libraries(plain, texts):
    for c, want in ((SpacedCoder(A, 300), lambda t: plain.a.encode(" " + t, add_special_tokens=False).ids), (SentenceCoder(B, 300), plain.b.encode)):
        assert c.pattern
        assert [x.tolist() for x in c.encode_all(pa.array(texts))] == [want(t) if t else [] for t in texts]


def test_alignment_equals_the_definition(spark, plain, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r for r in align_tokens(df, A, B).collect()}
    for k, t in enumerate(texts):
        ta, tb, links, groups = plain.aligned(t)
        r = got[k]
        assert (r.a_ids, r.b_ids, list(zip(r.link_a, r.link_b))) == ([x for x, *_ in ta], [x for x, *_ in tb], sorted(links))
        if len(ta) < 2000:
            assert list(zip(r.group_a, r.group_b)) == [(len(x), len(y)) for x, y in groups]


def test_report_equals_brute_force(spark, plain, texts):
    texts = [t for t in texts if len(t or "") < 4000]
    held, most, every = Counter(), defaultdict(int), {}
    for k, t in enumerate(texts):
        every[k] = ta, tb, links, _ = plain.aligned(t)
        held.update({(ta[i][0], tb[j][0]) for i, j in links})
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    want = []
    for k, (ta, tb, links, groups) in every.items():
        counts = [held[ta[i][0], tb[j][0]] for i, j in links]
        best = sum(n == most[ta[i][0]] for n, (i, _) in zip(counts, links))
        line = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        want.append((k, len(ta), len(tb), len(groups), len(links), best, sum(counts), hashlib.sha256(line.encode()).hexdigest() if ta else "", sum(len(x) * len(y) for x, y in groups)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, link_report(df, A, B).collect())) == want


def test_edges_and_clashing_columns(edges, empty):
    wide = edges.withColumnsRenamed({"id": "a_ids", "x": "pairs", "row": "_row"})
    out = align_tokens(wide, A, B)
    assert out.columns == [*wide.columns, "_a_ids", "b_ids", "link_a", "link_b", "group_a", "group_b"] and out.count() == edges.count()
    rows = link_report(wide, A, B).collect()
    assert len(rows) == edges.count() and sorted((r.n_a, r.n_b, r.groups_sha256) for r in rows if not r.n_links) == [(0, 0, "")] * 2
    assert align_tokens(empty, A, B).count() == link_report(empty, A, B).count() == 0
