"""Minutes metrics, word diarization and clustering on small hand-made cases."""

import itertools
import random

import numpy as np
import pytest

from colloquy.operators import attribution, quality, scoring, topics
from colloquy.operators.scoring import assignment

ITEM = "meeting_id int, text string, owner string"


@pytest.mark.parametrize(("a", "b", "like"), [("", "", 1.0), ("", "x", 0.0), ("send the report", "report the send", 1.0), ("send report", "send report now", 1.0)])
def test_set_similarity(a, b, like):
    assert quality.set_similarity(a, b) == like


def test_unlike_texts_are_below_the_threshold():
    assert quality.set_similarity("send the report", "book a room") < 0.7


def test_item_matches(spark):
    refs = [(1, "Send the report!", "Élise"), (1, "Book a room", None), (2, "Call Bob", "Al"), (3, None, "x")]
    hyps = [(1, "the report: send", "elise "), (1, "paint it", "zed"), (4, "nothing asked", "q")]
    got = {r.meeting_id: r for r in quality.item_matches(spark.createDataFrame(refs, ITEM), spark.createDataFrame(hyps, ITEM)).collect()}
    assert (got[1].matched, got[1].precision, got[1].recall, got[1].f1, got[1].owner_accuracy) == (1, 0.5, 0.5, 0.5, 1.0)
    assert (got[2].precision, got[2].recall, got[2].f1) == (0.0, 0.0, 0.0)
    assert (got[4].hypothesis_count, got[4].recall) == (1, 0.0) and got[3].reference_count == 1


def test_hallucination_rate(spark):
    claims = spark.createDataFrame([(1, "Then Anna Berg paid 1,200 in Oslo"), (1, "Nothing here"), (2, None), (3, "We met Zed")], "meeting_id int, claim string")
    said = spark.createDataFrame([(1, "anna berg said 1200"), (1, None), (3, "")], "meeting_id int, text string")
    got = {r.meeting_id: (r.mentions, r.unsupported) for r in quality.hallucination_rate(claims, said).collect()}
    # "Then Anna Berg" is one run, as its first word is capitalised as well
    assert got == {1: (3, 2), 2: (0, 0), 3: (1, 1)}
    assert quality.hallucination_rate(claims.limit(0), said).count() == 0



def test_word_diarization_errors(spark):
    kind = "m int, idx int, speaker string, tokens array<string>"
    ref = spark.createDataFrame([(1, 0, "A", ["a", "b", "c"]), (1, 1, "B", ["d", "e"]), (2, 0, "A", [])], kind)
    hyp = spark.createDataFrame([(1, 0, "x", ["a", "b"]), (1, 1, "y", ["c", "d", "f"])], kind)
    got = {r.m: (r.wrong, r.aligned) for r in scoring.word_diarization_errors(ref, hyp, "m").collect()}
    assert got == {1: (1, 4), 2: (0, 0)}


def test_labels_merge_within_their_meeting(spark):
    rows = [(m, label, dim, value) for m, label, v in [(1, 0, (1, 0)), (1, 1, (0.9, 0.1)), (1, 2, (0, 1)), (2, 0, (0, 1)), (2, 1, (1, 0))] for dim, value in enumerate(map(float, v))]
    got = attribution.merge_like_labels(spark.createDataFrame(rows, "meeting_id int, label int, dim int, value double")).collect()
    assert {(r.meeting_id, r.label): r.cluster for r in got} == {(1, 0): 0, (1, 1): 0, (1, 2): 2, (2, 0): 0, (2, 1): 1}


def test_topic_gaps_find_the_valley(spark):
    rows = [(1, i, v) for i, v in enumerate([0.8, 0.8, 0.2, 0.7, 0.9])] + [(2, 0, 0.5)]
    got = {(r.k, r.gap): r for r in topics.topic_gaps(spark.createDataFrame(rows, "k int, gap int, similarity double"), "k", passes=0).collect()}
    assert [got[1, i].depth for i in range(5)] == [0.0, 0.0, pytest.approx(1.3), pytest.approx(0.2), 0.0]
    # mean 0.3 less half of the deviation 0.506 is 0.047, which 0.2 passes
    assert [i for i in range(5) if got[1, i].candidate] == [2, 3] and not got[2, 0].candidate


def test_bounds_pair_items_as_all_pairs_would(monkeypatch):
    rng = random.Random(4)
    texts = lambda n: [" ".join(rng.choice(["alpha", "beta", "budget", "plan", "of", "a", "0123", "tion"]) + rng.choice(["", "s"]) for _ in range(rng.choice([0, 3, 12, 60]))) for _ in range(n)]
    for _ in range(40):
        a, b = texts(rng.randint(0, 7)), texts(rng.randint(0, 7))
        true = np.array([[quality.set_similarity(x, y) for y in b] for x in a]).reshape(len(a), len(b))
        assert (quality.most_similarity(a, b).reshape(true.shape) >= true - 1e-12).all()
        assert abs(sum(v for _, _, v in quality.best_pairs(a, b)) - sum(true[r, c] for r, c in assignment(-true))) < 1e-9
    calls, plain = [], quality.set_similarity
    monkeypatch.setattr(quality, "set_similarity", lambda x, y: calls.append(1) or plain(x, y))
    items = [f"item{i} " + " ".join(rng.sample(["red", "blue", "green", "black", "white", "grey", "pink"], 4)) for i in range(40)]
    assert [(r, h) for r, h, _ in quality.best_pairs(items, items[::-1])] == [(i, 39 - i) for i in range(40)] and len(calls) < 400
