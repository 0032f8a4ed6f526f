"""Alignments against a plain dynamic program, classes of words, and time-constrained errors."""

import random

import numpy as np
import pandas as pd
import pytest

from colloquy.operators.decomposition import alignment_rows, category_counts, decompose, proper_noun_recall, proper_nouns, totals
from colloquy.operators.scoring import align_words
from colloquy.operators.timed import time_constrained_wer, timed_counts, windowed_rows, windows


def plain_counts(ref, hyp, allowed=lambda i, j: True):
    """(cost, substitutions, deletions, insertions, hits); of equal costs meeting comes first, then dropping, then adding."""
    prev = [(j, 0, 0, j, 0) for j in range(len(hyp) + 1)]
    for i, r in enumerate(ref):
        cur = [(i + 1, 0, i + 1, 0, 0)]
        for j, h in enumerate(hyp):
            c, s, d, n, k = prev[j + 1]
            best = (c + 1, s, d + 1, n, k)
            c, s, d, n, k = cur[j]
            if c + 1 < best[0]:
                best = (c + 1, s, d, n + 1, k)
            c, s, d, n, k = prev[j]
            if allowed(i, j) and c + (r != h) <= best[0]:
                best = (c + (r != h), s + (r != h), d, n, k + (r == h))
            cur.append(best)
        prev = cur
    return prev[-1]


def test_alignment_is_least_and_covers_both_sides():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        steps = align_words(a, b)
        assert [i for _, i, _ in steps if i >= 0] == list(range(len(a))) and [j for *_, j in steps if j >= 0] == list(range(len(b)))
        assert all((op == "equal") == (i >= 0 <= j and a[i] == b[j]) for op, i, j in steps)
        assert sum(op != "equal" for op, *_ in steps) == plain_counts(a, b)[0]


@pytest.mark.parametrize("collar", [0.0, 300.0, 5000.0])
def test_timed_counts_equal_a_plain_program(collar):
    rng = random.Random(int(collar))
    for _ in range(150):
        sides = []
        for _ in range(2):
            rows = sorted((s := rng.randint(0, 30) * 100, s + rng.randint(0, 6) * 100, rng.choice("ab")) for _ in range(rng.randint(1, 10)))
            sides.append(pd.DataFrame(rows, columns=["start_ms", "end_ms", "token"]))
        spans = [x[["start_ms", "end_ms"]].to_numpy(dtype=float) for x in sides]
        low, high = windows(*spans, collar)
        for i, (s, e) in enumerate(spans[0]):
            k = next((j for j, (_, x) in enumerate(spans[1]) if x >= s - collar), len(spans[1]))
            last = k - 1
            while last + 1 < len(spans[1]) and spans[1][last + 1][0] <= e + collar:
                last += 1
            assert (low[i], high[i]) == (k, last)
        want = plain_counts(sides[0].token.tolist(), sides[1].token.tolist(), lambda i, j: low[i] <= j <= high[i])
        assert timed_counts(*sides, collar) == want[1:]


UTTERANCE = "m string, speaker string, idx int, start_ms long, end_ms long, tokens array<string>"


def test_time_constrained_wer(spark):
    ref = [("x", "A", 0, 0, 2000, ["a", "b"]), ("x", "B", 1, 2000, 3000, ["c"]), ("y", "A", 0, 0, 0, ["a", "a"]), ("z", "A", 0, 0, 10, ["q"]), ("w", "A", 0, 0, 10, [])]
    hyp = [("x", "1", 0, 2000, 3000, ["c"]), ("x", "2", 1, 60_000, 62_000, ["a", "b"]), ("y", "A", 0, 0, 0, ["a"]), ("y", "B", 1, 9, 10, ["a"])]
    got = {r.m: r for r in time_constrained_wer(spark.createDataFrame(ref, UTTERANCE), spark.createDataFrame(hyp, UTTERANCE), ["m"]).collect()}
    tell = lambda r: (r.substitutions, r.deletions, r.insertions, r.hits, r.reference_words, r.missed_speakers, r.false_alarm_speakers)
    assert tell(got["x"]) == (0, 2, 2, 1, 3, 0, 0)  # the right words a minute late do not meet
    assert tell(got["y"]) == (0, 1, 1, 1, 2, 0, 1) and tell(got["z"]) == (0, 1, 0, 0, 1, 1, 0)
    assert set(got) == {"x", "y", "z"}


def test_long_streams_are_aligned_whole():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50, 3000).astype(str).tolist()
    b = [w for k, w in enumerate(a) if k % 10]
    steps = align_words(a, b)
    assert sum(op == "delete" for op, *_ in steps) == len(a) - len(b) and all(op in ("equal", "delete") for op, *_ in steps)


TEXTS = [
    (0, "We met Marie Curie. Paris is big, says Élodie; Paris!", "marie curie elodie"),
    (1, "Then I said so. Zoë said: Hello\nBerlin and berlin, and Berlin", "zoe"),
    (2, None, ""), (3, "", ""), (4, "the Monday and the Um, O'Neil Jean-Luc X", "jean-luc o'neil"), (5, "… Ångström. (Rome) saw Rome", "rome"),
]


def test_proper_nouns(spark):
    df = spark.createDataFrame([t[:2] for t in TEXTS], "k int, raw string")
    got = {}
    for r in proper_nouns(df, ["k"], "raw").collect():
        got.setdefault(r.k, set()).add(r.name)
    # Paris begins each of its sentences; Zoë and Hello follow a full stop and a colon; (Rome) follows a bracket
    want = {0: {"curie", "marie", "elodie"}, 4: {"jean-luc", "o'neil"}, 5: {"rome"}}
    assert got == want


def test_decomposition_by_class(spark):
    rows = [("d1", 0, "en", "we saw marie in 12 euh voila les gens", "we saw mary in 12 euh les gens now", "We saw Marie in 12 euh, voila les gens"), ("d1", 1, "fr", "bonjour the chat", "", "bonjour the chat"), ("d2", 2, "fr", "", "oui non", None)]
    df = spark.createDataFrame([(a, b, c, r.split(), h.split(), raw) for a, b, c, r, h, raw in rows], "corpus string, k int, language string, ref array<string>, hyp array<string>, raw string")
    steps = decompose(df, ["corpus", "k"], "ref", "hyp", "raw", "language", spark.createDataFrame([("Chat",), (None,)], "term string"))
    got = {(r.k, r.category): (r.reference_words, r.hits, r.substitutions, r.deletions) for r in category_counts(steps, ["k"]).collect()}
    assert got == {
        (0, "function_word"): (2, 2, 0, 0), (0, "content_word"): (2, 2, 0, 0), (0, "proper_noun"): (1, 0, 1, 0), (0, "number"): (1, 1, 0, 0), (0, "filler"): (2, 1, 0, 1), (0, "code_switched"): (1, 1, 0, 0),
        (1, "function_word"): (1, 0, 0, 1), (1, "code_switched"): (1, 0, 0, 1), (1, "proper_noun"): (1, 0, 0, 1),
    }
    assert {r.corpus: tuple(r)[1:] for r in totals(steps, ["corpus"]).collect()} == {"d1": (12, 1, 4, 1, 0.5), "d2": (0, 0, 0, 2, 0.0)}
    assert [tuple(r) for r in proper_noun_recall(steps, []).collect()] == [(0, 2, 0.0)]
    assert alignment_rows(df.limit(0), ["k"], "ref", "hyp").count() == 0


def test_alignment_rows_come_in_arrow_batches(spark):
    pairs = spark.createDataFrame([(1, ["a", "b"], ["a"]), (2, None, ["x"]), (3, [], None), (4, [None], ["y"])], "k int, ref array<string>, hyp array<string>")
    steps = alignment_rows(pairs, ["k"], "ref", "hyp")
    assert "MapInArrow" in steps._jdf.queryExecution().toString()
    got = sorted((r.k, r.outcome, r.ref_place, r.hyp_place, r.word, r.heard) for r in steps.collect())
    assert got == [(1, "delete", 1, None, "b", None), (1, "equal", 0, 0, "a", "a"), (2, "insert", None, 0, None, "x"), (4, "substitute", 0, 0, None, "y")]


def test_timed_alignments_of_long_streams_look_at_the_words_within_reach_alone():
    rng = random.Random(4)
    starts = [300 * k for k in range(5000)]
    spans = [[(a + s, a + s + 300) for a in starts] for s in (0, 150)]
    ids = [rng.randrange(400) for _ in starts]
    low, high = windows(*(np.array(s, dtype=float) for s in spans), 5000)
    rows, cost = windowed_rows(ids, [x if k % 9 != 8 else -1 for k, x in enumerate(ids)], low, high)
    assert cost == 555 and max(hi - lo for _, _, lo, hi in rows) < 50
