import itertools
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import attribution, intervals, languages, minutes, topics

U = "meeting_id long, idx int, speaker string, start_ms long, end_ms long, text string"


def test_islands_and_difference_equal_brute_force(spark):
    rng = random.Random(2)
    spans = lambda n: [(1, s, s + rng.randint(0, 15)) for s in (rng.randint(0, 120) for _ in range(n))]
    a, b = spans(30), spans(12)
    kind = "k long, start_ms long, end_ms long"
    left, right = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    inside = lambda rows: {t for _, s, e in rows for t in range(s, e)}
    got = {t for r in intervals.difference(left, right, ["k"]).collect() for t in range(r.start_ms, r.end_ms)}
    assert got == inside(a) - inside(b)
    assert intervals.covered(left, ["k"]).first().covered_ms == len(inside(a))
    pairs = intervals.overlap_join(left, right, ["k"], bucket=7)
    want = sorted((s, e, x, y, min(e, y) - max(s, x)) for (_, s, e), (_, x, y) in itertools.product(a, b) if min(e, y) > max(s, x))
    assert sorted((r.start_ms, r.end_ms, r.r_start_ms, r.r_end_ms, r.overlap_ms) for r in pairs.collect()) == want


def test_nearest_prefers_the_first_on_a_tie_and_keeps_to_the_horizon(spark):
    gaps = spark.createDataFrame([(1, 1, 100, 110), (1, 2, 500, 510)], "k long, row int, start_ms long, end_ms long")
    turns = spark.createDataFrame([(1, 0, 80, 90, "a"), (1, 1, 120, 130, "b")], "k long, pos int, start_ms long, end_ms long, label string")
    got = {r.row: r.label for r in intervals.nearest(gaps, turns, ["k"], 50, "pos", "label", bucket=64).collect()}
    assert got == {1: "a", 2: None}


def test_blocks_end_with_their_last_utterance(spark):
    rows = spark.createDataFrame([(1, 0, "a", 0, 9000, "x"), (1, 1, "a", 500, 1000, "y"), (1, 2, "a", 1900, 2500, "z"), (1, 3, "b", 2500, 3000, "w")], U).withColumn("n_words", F.lit(1))
    got = sorted((r.start_ms, r.end_ms, r.n_utterances) for r in intervals.speaker_blocks(rows).collect())
    assert got == [(0, 2500, 3), (2500, 3000, 1)]


def test_tag_fill_ties(spark):
    rows = [(1, 1, "a", "en"), (1, 2, "a", None), (1, 3, "a", "fr"), (1, 4, "b", None), (1, 5, "c", "de")]
    got = {r.idx: r.filled for r in languages.fill_tags(spark.createDataFrame(rows, "m long, idx int, speaker string, tag string"), "m", "und").collect()}
    assert got[2] == "fr" and got[4] == "fr"


def test_names_need_coverage_and_margin(spark):
    turns = spark.createDataFrame([(1, 0, 0, 1000, "x"), (1, 1, 1000, 2000, "y"), (1, 2, 2000, 3000, "z")], "meeting_id long, pos int, start_ms long, end_ms long, label string")
    seen = spark.createDataFrame([(1, 0, 900, "Ann"), (1, 1000, 1300, "Bob"), (1, 2000, 2500, "Cat"), (1, 2500, 3000, "Dan")], "meeting_id long, start_ms long, end_ms long, name string")
    got = {r.label: r.name for r in attribution.name_speakers(turns, seen).collect()}
    assert got == {"x": "Ann", "y": "Speaker 2", "z": "Speaker 3"}


def test_repeats_at_seams(spark):
    rows = spark.createDataFrame([(1, 0, 0, 10, ["a", "b", "c"]), (1, 1, 20, 30, ["b", "c", "d"]), (1, 2, 5000, 5010, ["d"])], "meeting_id long, idx int, start_ms long, end_ms long, tokens array<string>")
    assert [r.repeated for r in attribution.seam_repeats(rows).orderBy("idx").collect()] == [2, 0, 0]


def test_merging_of_like_labels(spark):
    rows = [(k, i, v) for k, vec in {1: (1.0, 0.0), 2: (0.9, 0.1), 3: (0.0, 1.0)}.items() for i, v in enumerate(vec)]
    got = {r.label: r.cluster for r in attribution.merge_like_labels(spark.createDataFrame([(1, *r) for r in rows], "meeting_id int, label int, dim int, value double")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_paths_resist_small_gains(spark):
    rows = [(1, i, x, v) for i, (a, b) in enumerate([(1.0, 0.0), (0.5, 0.52), (1.0, 0.0), (0.0, 1.0)]) for x, v in (("a", a), ("b", b))]
    got = attribution.viterbi_labels(spark.createDataFrame(rows, "meeting_id long, idx int, label string, score double"))
    assert [r.label for r in got.orderBy("idx").collect()] == ["a", "a", "a", "b"]


def test_candidates_of_a_small_meeting(spark):
    rows = [
        (1, 0, "Ann", 0, 4000, "We have agreed to ship the release on Friday."), (1, 1, "Bob", 4000, 8000, "I will write the release notes. What about the load test environment?"),
        (1, 2, "Ann", 8000, 9000, "Yes, it is ready."), (1, 3, "Bob", 9000, 12000, "Who owns the billing migration project?"), (1, 4, "Bob", 12000, 13000, "Hm."),
    ]
    got = [(r.unit, r.kind, r.answered) for r in minutes.candidates(minutes.sentence_rows(spark.createDataFrame(rows, U))).orderBy("unit").collect()]
    assert got == [(0, "decision", None), (1, "action", None), (2, "question", True), (4, "question", False)]


def test_sentence_spans_share_the_time_by_characters(spark):
    got = minutes.sentence_rows(spark.createDataFrame([(1, 0, "a", 0, 1000, "abcd. efgh.")], U)).orderBy("unit").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 500), (500, 1000)]


def test_grounding(spark):
    said = spark.createDataFrame([(1, 0, "a", 0, 1, "the release ships friday")], U)
    claims = spark.createDataFrame([(1, "Release ships Friday"), (1, "Budget doubled")], "meeting_id long, claim string")
    assert minutes.grounding(claims, said).first().score == 0.5


def test_chunks_overlap(spark):
    rows = spark.createDataFrame([(1, i, 10) for i in range(7)] + [(2, 0, 500)], "m long, idx int, n_tokens int")
    got = sorted((r.m, r.chunk, r.first_idx, r.last_idx, r.n_tokens) for r in topics.chunk_plan(rows, "m", 30, 10).collect())
    assert got == [(1, 0, 0, 2, 30), (1, 1, 2, 4, 30), (1, 2, 4, 6, 30), (2, 0, 0, 0, 500)]


def test_block_similarity_equals_numpy(spark):
    import numpy as np

    rng = random.Random(4)
    tokens = [rng.choice("abcde") for _ in range(97)]
    got = {r.gap: r.similarity for r in topics.block_similarity(spark.createDataFrame([(1, i, t) for i, t in enumerate(tokens)], "k long, pos int, term string"), "k", 5, 3).collect()}
    count = np.array([[tokens[5 * r : 5 * r + 5].count(c) for c in "abcde"] for r in range(len(tokens) // 5)])
    for g in range(len(count) - 1):
        a, b = count[max(0, g - 2) : g + 1].sum(0), count[g + 1 : g + 4].sum(0)
        assert got[g] == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=2e-6)
