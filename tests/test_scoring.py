import itertools
import random

import numpy as np

from pyspark.sql import functions as F

from colloquy.operators import scoring


def test_assignment_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        cost = np.array([[rng.randint(0, 20) for _ in range(m)] for _ in range(n)])
        got = scoring.assignment(cost)
        small, wide = (cost, range(m)) if n <= m else (cost.T, range(n))
        best = min(sum(small[i, c] for i, c in enumerate(p)) for p in itertools.permutations(wide, len(small)))
        assert len(got) == min(n, m) and len({c for _, c in got}) == len(got)
        assert sum(cost[r, c] for r, c in got) == best


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_counts_sum_to_the_distance(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for _ in range(120)]
    for a, b in pairs:
        s, d, i, h = scoring.edit_counts(a, b)
        assert min(s, d, i, h) >= 0 and s + d + i == plain_edits(a, b)
        assert s + d + h == len(a) and s + i + h == len(b)
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a array<string>, b array<string>")
    got = {r.k: r.e for r in df.select("k", scoring.word_edits(df.a, df.b).alias("e")).collect()}
    assert all(got[k] == plain_edits(a, b) for k, (a, b) in enumerate(pairs))


def test_permutation_wer_ignores_names_and_counts_missing_speakers(spark):
    kind = "meeting_id long, idx int, speaker string, tokens array<string>"
    ref = spark.createDataFrame([(1, 0, "a", ["x", "y"]), (1, 1, "b", ["z"]), (2, 0, "a", ["x"]), (2, 1, "b", ["y", "y"])], kind)
    hyp = spark.createDataFrame([(1, 0, "q", ["x", "y"]), (1, 1, "p", ["z"]), (2, 0, "q", ["x"])], kind)
    got = {r.meeting_id: r for r in scoring.permutation_wer(ref, hyp, ["meeting_id"]).collect()}
    assert got[1].cpwer == 0 and got[1].hits == 3
    assert got[2].deletions == 2 and got[2].cpwer == 2 / 3


def test_diarization_error(spark):
    kind = "meeting_id long, start_ms long, end_ms long, label string"
    ref = spark.createDataFrame([(1, 0, 1000, "a"), (1, 1000, 2000, "b"), (2, 0, 1000, "a")], kind)
    hyp = spark.createDataFrame([(1, 0, 1500, "x"), (1, 1500, 2000, "y"), (2, 500, 1500, "z")], kind)
    got = {r.meeting_id: r for r in scoring.diarization_errors(ref, hyp, ["meeting_id"], collar=0).collect()}
    assert (got[1].missed_ms, got[1].false_alarm_ms, got[1].confusion_ms, got[1].der) == (0, 0, 500, 0.25)
    assert (got[2].missed_ms, got[2].false_alarm_ms, got[2].der) == (500, 500, 1.0)


def test_gates(spark):
    metrics = spark.createDataFrame([("wer", 0.1), ("der", 0.3)], "metric string, value double")
    gates = spark.createDataFrame([("wer", "<=", 0.1), ("der", "<", 0.3), ("jer", ">", 0.0)], "metric string, op string, threshold double")
    assert {r.metric: r.status for r in scoring.evaluate_gates(metrics, gates).collect()} == {"wer": "passed", "der": "failed", "jer": "missing"}


def test_word_edits_past_the_surrogates(spark):
    many = [f"w{k}" for k in range(60_000)]
    df = spark.createDataFrame([(many[:500], many[:499] + ["x"]), ([], ["a"]), (["a", "b"], ["b"])], "r array<string>, h array<string>")
    assert [r.e for r in df.select(scoring.word_edits(F.col("r"), F.col("h")).alias("e")).collect()] == [1, 1, 1]
    wide = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda k: k.cast("string")).alias("r"))
    point = wide.select(scoring.word_edits(F.slice("r", 1, 10), F.slice("r", 1, 9)).alias("e"), F.length(F.array_join(F.transform("r", lambda w: F.decode(F.unhex(F.lpad(F.hex(w.cast("int") + 0xFF + F.when(w.cast("int") + 0xFF >= 0xD800, 0x800).otherwise(0)), 8, "0")), "UTF-32")), "")).alias("n")).first()
    assert (point.e, point.n) == (1, 60_000)


def test_single_linkage_with_a_ceiling(spark):
    from colloquy.operators.attribution import merge_like_labels

    at = {"a": (1.0, 0.0), "b": (0.9, 0.1), "c": (0.7, 0.7), "d": (-1.0, 0.2), "z": (0.0, 0.0)}
    rows = [(1, label, dim, v) for label, xs in at.items() for dim, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "meeting_id int, label string, dim int, value double")
    clusters = lambda **how: {r.label: r.cluster for r in merge_like_labels(df, **how).collect()}
    assert clusters(threshold=0.9) == {"a": "a", "b": "a", "c": "c", "d": "d", "z": "z"}
    assert clusters(threshold=0.75) == {"a": "a", "b": "a", "c": "a", "d": "d", "z": "z"}  # c is like b alone
    assert clusters(threshold=0.99, ceiling=2) == {"a": "a", "b": "a", "c": "a", "d": "a", "z": "z"}


def test_alignments_of_long_streams_take_few_operations_a_word():
    """Bit vectors against a plain table, over several kept rows, and a pair of 20,000 words."""
    rng = random.Random(3)
    for k in range(60):
        a = [rng.choice("abcdefgh"[: 2 + k % 7]) for _ in range(rng.randrange(0, 330))]
        b = [rng.choice("abcdefgh") if rng.random() < 0.3 else w for w in a if rng.random() < 0.8]
        best = [[(j, 0) for j in range(len(b) + 1)]]
        for i, x in enumerate(a, 1):
            row = [(i, 0)]
            for j, y in enumerate(b, 1):
                (u, p), (v, q), (w, r) = best[-1][j], row[-1], best[-1][j - 1]
                row.append(min((u + 1, p), (v + 1, q), (w + (x != y), r - (x == y))))
            best.append(row)
        s, d, i, h = scoring.edit_counts(a, b)
        assert (s + d + i, -h) == best[-1][-1] and (s + d + h, s + i + h) == (len(a), len(b))
        assert scoring.edit_distance(*scoring.numbered(a, b)) == s + d + i
    words = [f"w{int(rng.paretovariate(0.5)) % 5000}" for _ in range(20_000)]
    heard = [w if k % 9 != 8 else "zzq" for k, w in enumerate(words)]
    assert scoring.edit_counts(words, heard) == (2222, 0, 0, 17_778)


def test_equal_shared_times_pair_the_most_speakers(spark):
    shared = [("assistant", "assistant", 9850), ("assistant", "user", 56700), ("user", "user", 46850), ("system", "system", 22300)]
    rows = [(m, [a], [b], 0, v) for m in (1, 2) for a, b, v in shared] + [(3, ["a"], [], 0, 50)]
    found = spark.createDataFrame(rows, "m long, reference array<string>, hypothesis array<string>, start_ms long, end_ms long")
    got = sorted((r.m, r.a, r.b, r.shared_ms) for r in scoring.speaker_mapping(found, ["m"]).collect())
    assert got == [(m, x, x, v) for m in (1, 2) for x, v in (("assistant", 9850.0), ("system", 22300.0), ("user", 46850.0))]


def test_alignments_are_the_same_whatever_is_kept(monkeypatch):
    rng = random.Random(6)
    pairs = [tuple([rng.choice("abcde") for _ in range(rng.randrange(300))] for _ in "rh") for _ in range(20)]
    found = []
    for short, whole in ((4096, 1 << 24), (0, 0), (4096, 0)):
        monkeypatch.setattr(scoring, "SHORT", short)
        monkeypatch.setattr(scoring, "WHOLE", whole)
        found.append([(scoring.stream_distance(r, h), scoring.align_words(r, h), scoring.edit_counts(r, h), scoring.edit_counts(r, h, scoring.align_words(r, h))) for r, h in pairs])
    assert found[0] == found[1] == found[2] and all(a == b for _, _, a, b in found[0])
