"""Systems compared: speakers' outcomes against a search over all pairings, scores against the operators by themselves, reports and gates."""

import itertools
import random

from colloquy.operators.comparison import compare_systems, comparison_markdown, for_each_system, gate_verdicts, speaker_outcomes
from colloquy.operators.scoring import edit_counts, permutation_wer
from colloquy.operators.timed import time_constrained_wer

SAID = "meeting_id int, idx int, speaker string, start_ms long, end_ms long, tokens array<string>"


def made(rng, speakers, meeting, n=12):
    return [(meeting, i, rng.choice(speakers), 2000 * i, 2000 * i + rng.randrange(100, 40_000), [rng.choice("abcdefgh") for _ in range(rng.randrange(7))]) for i in range(n)]


def streams(rows):
    out = {}
    for _, _, s, _, _, tokens in sorted(rows, key=lambda r: r[1]):
        out.setdefault(s, []).extend(tokens or [])
    return out


def test_outcomes(spark):
    rng = random.Random(3)
    ref = [r for m in range(12) for r in made(rng, ["ana", "bo", "kim", None][: 2 + m % 3], m)]
    hyp = [(m, i, rng.choice([s, s, "x", "y"]), a, b, [w for w in t if rng.random() < 0.8]) for m, i, s, a, b, t in ref if m != 5]
    ref += [(20, 0, "mute", 0, 5000, []), (20, 1, "alone", 0, 61_000, ["a", "b"]), (20, 2, "alone", 5, 1, None)]
    got = speaker_outcomes(spark.createDataFrame(ref, SAID), spark.createDataFrame(hyp, SAID), ["meeting_id"]).collect()
    assert len(got) == len({(r[0], r[2]) for r in ref})
    for m in sorted({r[0] for r in ref}):
        a, b = streams(r for r in ref if r[0] == m), {s: t for s, t in streams(r for r in hyp if r[0] == m).items() if t}
        mine = {r.speaker: r for r in got if r.meeting_id == m}
        pairs = {s: r.matched for s, r in mine.items() if r.hits + r.substitutions + r.insertions}
        assert len(set(pairs.values())) == len(pairs) and set(pairs.values()) <= set(b)
        spoken = [s for s in a if a[s]]
        total = lambda p: sum(sum(edit_counts(a.get(x, []), b.get(y, []))[:3]) for x, y in p)
        size = max(len(spoken), len(b))
        left, right = spoken + [("none", i) for i in range(size - len(spoken))], list(b) + [("none", i) for i in range(size - len(b))]
        unheard = sum(len(t) for s, t in b.items() if s not in pairs.values())
        assert sum(r.substitutions + r.deletions + r.insertions for r in mine.values()) + unheard == min(total(zip(left, p, strict=True)) for p in itertools.permutations(right))
        for s, r in mine.items():
            want = edit_counts(a[s], b[pairs[s]] if s in pairs else [])
            assert (r.substitutions, r.deletions, r.insertions, r.hits) == want and r.reference_words == len(a[s])
    lone = {r.speaker: (r.matched, r.deletions, r.seconds, r.bucket, r.wer, r.word_recall) for r in got if r.meeting_id == 20}
    assert lone == {"mute": (None, 0, 5.0, "under_15s", 0.0, 0.0), "alone": (None, 2, 61.0, "1m_to_5m", 1.0, 0.0)}


def test_scores_and_report(spark):
    rng = random.Random(5)
    ref = [r for m in (1, 2, 3) for r in made(rng, ["ana", "bo"], m)]
    heard = {"near": [(m, i, s, a, b, t[:-1]) for m, i, s, a, b, t in ref], "far": [(m, i, "x", a + 90_000, b + 90_000, t[::-1]) for m, i, s, a, b, t in ref if m < 3], "exact": [r for r in ref if r[0] == 1]}
    side = lambda rows: spark.createDataFrame(rows, SAID)
    systems = spark.createDataFrame([(*r, name) for name, rows in heard.items() for r in rows] + [(9, 0, "z", 0, 1, ["a"], "near")], SAID + ", system string")
    scores = compare_systems(side(ref), systems)
    got = {(r.meeting_id, r.system): r for r in scores.collect()}
    assert set(got) == {(m, s) for s, rows in heard.items() for m in {r[0] for r in rows}}
    for name, rows in heard.items():
        kept = side([r for r in ref if r[0] in {x[0] for x in rows}])
        cp = {r.meeting_id: r.cpwer for r in permutation_wer(kept, side(rows), ["meeting_id"]).collect()}
        tcp = {r.meeting_id: r.tcpwer for r in time_constrained_wer(kept, side(rows), ["meeting_id"]).collect()}
        for m in cp:
            a, b = ([w for r in sorted(x, key=lambda r: r[1]) if r[0] == m for w in r[5]] for x in (ref, rows))
            row = got[m, name]
            assert (row.cpwer, row.tcpwer, row.wer) == (cp[m], tcp[m], sum(edit_counts(a, b)[:3]) / len(a)) and (row.reference_words, row.hypothesis_words) == (len(a), len(b))
    assert [got[1, s]["rank"] for s in ("exact", "near", "far")] == [1, 2, 3] and got[1, "exact"].wder == 0
    truth = side([r for r in ref if r[0] == 1])
    exact = speaker_outcomes(truth, side(heard["exact"]), ["meeting_id"]).selectExpr("*", "'exact' as system")
    text = {r.meeting_id: r.document for r in comparison_markdown(scores, exact).collect()}
    lines = text[1].split("\n")
    assert lines[0] == "# Comparison of meeting 1" and lines[4].startswith("| exact | 0.00 % | 0.00 % | 0.00 % | 0.00 % |") and len(lines) == 14 and lines[12].count("100.00 %") + lines[12].count("n/a") == 4 and "n/a" in lines[12]
    assert "##" not in text[2]


def test_gates(spark):
    seen = [("a", "read", "en", "wer", 0.1), ("b", "read", "de", "wer", 0.1), ("c", "meeting", "en", "wer", None), ("c", "meeting", "en", "rtf", 1.0), ("d", "meeting", "en", "other", 1.0)]
    gates = [("read", "en", "must", "wer", "<=", 0.1), ("read", "fr", "must", "wer", "<", 0.1), ("meeting", "fr", "must", "wer", "<", 0.1), ("meeting", "all", "goal", "rtf", ">", 0.5)]
    got = gate_verdicts(spark.createDataFrame(seen, "subject string, kind string, language string, metric string, value double"), spark.createDataFrame(gates, "kind string, language string, tier string, metric string, op string, threshold double"), "fr")
    assert sorted((r.subject, r.tier, r.metric, r.status) for r in got.collect()) == [("a", "must", "wer", "passed"), ("b", "must", "wer", "failed"), ("c", "goal", "rtf", "passed"), ("c", "must", "wer", "missing")]


def test_report_of_one_pass_equals_the_one_of_scores_and_outcomes(spark):
    rng = random.Random(8)
    ref = [r for m in (1, 2, 3) for r in made(rng, ["ana", "bo", None], m)] + [(4, 0, "ana", 0, 70_000, [])]
    hyp = [(m, i, rng.choice([s, "x"]), a, b, [w for w in t if rng.random() < 0.7], name) for m, i, s, a, b, t in ref for name in ("near", "far")]
    said, heard = spark.createDataFrame(ref, SAID), spark.createDataFrame(hyp + [(3, 99, "y", None, None, None, "mute"), (9, 0, "z", 0, 1, ["a"], "near")], SAID + ", system string")
    outcomes = speaker_outcomes(for_each_system(said, heard, "meeting_id"), heard, ["meeting_id", "system"])
    want = {r.meeting_id: r.document for r in comparison_markdown(compare_systems(said, heard), outcomes).collect()}
    one = comparison_markdown(compare_systems(said, heard, kept=True))
    assert {r.meeting_id: r.document for r in one.collect()} == want and set(want) == {1, 2, 3}
    # words are dealt to their meetings once, and scored once
    plan = one._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and plan.count("REPARTITION_BY_NUM") == 1
