"""Owners, acceptances, merged items and speakers of words against plain loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from colloquy.functions.phonetics import sound_key
from colloquy.operators.merging import merge_similar
from colloquy.operators.owners import attribute_owner, pair_acceptances
from colloquy.operators.wordlevel import likely_path, rebuilt_utterances, word_labels

from .test_biasing import edits

UNIT = "meeting_id int, unit int, speaker string, start_ms long, end_ms long, text string"


def test_owners_by_rule(spark):
    said = [
        ("Ana Lima", "@joao.reis check the plan"), ("Ana Lima", "I will check the plan"), ("Ana Lima", "João, look at the plan"), ("Ana Lima", "Look at the plan, Kim."), ("Kim", "Ana will look at the plan"), ("Kim", "Could you ask João Reis about it?"),
        ("Ana Lima", "Can you look at it?"), ("Ana Lima", "Hm"), ("Kim", "Yes, sure"), ("Kim", "The plan is open"), ("Kim", "Let me do that"), ("", "I will do it"), ("Ana Lima", "Kim, Kim must do it"), ("Kim", "Kim, the plan"), (None, None),
    ]
    rows = [(1, k, s, k * 1000, k * 1000 + 900, t) for k, (s, t) in enumerate(said)]
    names = spark.createDataFrame([(1, 0, "Ana Lima"), (1, 1, "João Reis"), (1, 2, "Kim"), (1, 3, "")], "meeting_id int, pos int, name string")
    got = {r.unit: (r.owner, r.owner_source) for r in attribute_owner(spark.createDataFrame(rows, UNIT), names).collect()}
    assert got == {
        0: ("João Reis", "mention"), 1: ("Ana Lima", "first_person"), 2: ("João Reis", "vocative"), 3: ("Kim", "vocative"), 4: ("Ana Lima", "third_person"), 5: ("João Reis", "named"), 6: ("Kim", "reply"), 7: (None, "unassigned"),
        8: ("Kim", "commitment"), 9: ("Kim", "commitment"), 10: ("Kim", "first_person"), 11: (None, "first_person"), 12: ("Kim", "vocative"), 13: (None, "unassigned"), 14: (None, "unassigned"),
    }
    two = names.filter("pos in (0, 2)")
    assert {r.unit: r.owner_source for r in attribute_owner(spark.createDataFrame(rows[6:7], UNIT), two).collect()} == {6: "sole_counterpart"}
    alone = attribute_owner(spark.createDataFrame(rows[6:7], UNIT), names.limit(0)).first()
    assert (alone.owner, alone.owner_source) == (None, "unassigned")


def paired(actions):
    state = []
    for a in actions:
        if a["source"] == "first_person" and a["owner"] is not None:
            at = next((i for i in range(len(state) - 1, -1, -1) if state[i]["source"] != "first_person" and state[i]["owner"] == a["owner"]), None)
            r = state[at] if at is not None else None
            if r and a["unit"] - r["unit"] <= 4 and a["start"] - r["end"] <= 150_000 and (len(set(a["terms"])) <= 4 or set(a["terms"]) & set(r["terms"])):
                one, other = (r, a) if len(r["terms"]) >= len(a["terms"]) else (a, r)
                state[at] = {**one, "support": one["support"] + [other["unit"]] + other["support"]}
                continue
        state.append(a)
    return [(x["unit"], x["owner"], x["source"], x["support"]) for x in state]


def test_acceptances(spark):
    rng = random.Random(8)
    words = "alpha bravo delta echos foxes golfs hotel india julie".split()
    rows, want = [], {}
    for m in range(40):
        acts, t = [], 0
        for k in sorted(rng.sample(range(20), rng.randint(1, 8))):
            t += rng.choice([1000, 60_000, 100_000])
            acts.append({"unit": k, "owner": rng.choice(["A", "B", None]), "source": rng.choice(["first_person", "named", "reply"]), "start": t, "end": t + 500, "terms": rng.choices(words, k=rng.randint(1, 7)), "support": []})
        rows += [(m, a["unit"], a["owner"], a["source"], a["start"], a["end"], " ".join(a["terms"])) for a in acts]
        want[m] = sorted(paired(acts))
    df = spark.createDataFrame(rows, "meeting_id int, unit int, owner string, owner_source string, start_ms long, end_ms long, text string")
    got = {}
    for r in pair_acceptances(df).collect():
        got.setdefault(r.meeting_id, []).append((r.unit, r.owner, r.owner_source, r.support))
    assert {m: sorted(v) for m, v in got.items()} == want and any(s for v in want.values() for *_, s in v)


def test_merging_depends_on_the_order_alone(spark):
    rng = random.Random(9)
    words = "alpha alfa bravo delta echos ekoss foxes golfs".split()
    rows, want = [], {}
    texts = {(g, pos): " ".join(rng.sample(words, rng.randint(0, 5))) for g in range(40) for pos in range(rng.randint(1, 9))}
    keys = {r.t: r.k for r in spark.createDataFrame([(t,) for t in set(texts.values())], "t string").select("t", sound_key(F.col("t")).alias("k")).collect()}
    by_sound = 0
    for g in range(40):
        leaders = []
        for pos in [p for m, p in texts if m == g]:
            text, owner = texts[g, pos], rng.choice(["A", None])
            rows.append((g, pos, text, owner, None, pos))
            best = None
            for k, a in enumerate(leaders):
                x, y = set(a["text"].split()), set(text.split())
                s = len(x & y) / len(x | y) if x and y else 0.0
                a_key, key = keys[a["text"]], keys[text]
                heard = 1 - edits(a_key, key) / max(len(a_key), len(key), 1)
                by_sound += s < 0.5 and heard >= 0.85
                s = max(s, heard if heard >= 0.85 else 0.0)
                if s >= 0.5 and (best is None or s > best[0]):
                    best = (s, k)
            if best is None:
                leaders.append({"leader": pos, "n": 1, "text": text, "owner": owner, "units": [pos]})
            else:
                a = leaders[best[1]]
                a.update(n=a["n"] + 1, text=a["text"] if len(a["text"]) >= len(text) else text, owner=a["owner"] or owner, units=a["units"] + [pos])
        want[g] = sorted((a["leader"], a["n"], a["text"], a["owner"], a["units"][:4]) for a in leaders)
    assert by_sound > 5
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, pos int, text string, owner string, due string, unit int").repartition(5)
    got = {}
    for r in merge_similar(df, ["g"], 0.5).collect():
        got.setdefault(r.g, []).append((r.leader, r.n_merged, r.text, r.owner, r.units))
    assert {g: sorted(v, key=lambda x: x[0]) for g, v in got.items()} == {g: sorted(v, key=lambda x: x[0]) for g, v in want.items()}


def test_likely_path_is_the_best():
    import itertools

    rng = np.random.default_rng(2)
    for m in (1, 2, 3):
        gain = np.log(rng.dirichlet(np.ones(m), size=6))
        cost = lambda p: sum(gain[k, c] for k, c in enumerate(p)) + sum(math.log(0.95) if a == b else math.log(0.05 / max(m - 1, 1)) for a, b in itertools.pairwise(p))  # noqa: E731, B023
        assert tuple(likely_path(gain, 0.05)) == max(itertools.product(range(m), repeat=6), key=cost)


def test_words_find_their_speakers(spark):
    words = [(1, 0, k, "A", w, k * 500, k * 500 + 400) for k, w in enumerate("one two three four five six".split())] + [(1, 1, 0, "B", "late", 60_000, 60_400), (2, 0, 0, "Z", "alone", 0, 400)]
    df = spark.createDataFrame(words, "meeting_id int, idx int, nth int, speaker string, token string, start_ms long, end_ms long")
    turns = spark.createDataFrame([(1, 0, "x", 0, 1400), (1, 1, "y", 1300, 3500)], "meeting_id int, pos int, label string, start_ms long, end_ms long")
    labelled = word_labels(df, turns)
    got = {(r.idx, r.nth): r.label for r in labelled.collect() if r.meeting_id == 1}
    assert [got[0, k] for k in range(6)] == ["x", "x", "x", "y", "y", "y"] and got[1, 0] == "y"  # no turn near: the path stays
    rows = sorted(tuple(r) for r in rebuilt_utterances(labelled).collect())
    assert rows == [(1, 0, 0, "x", 0, 1400, "one two three", 3), (1, 0, 1, "y", 1500, 2900, "four five six", 3), (1, 1, 0, "y", 60_000, 60_400, "late", 1), (2, 0, 0, "Z", 0, 400, "alone", 1)]
    one = word_labels(df, turns.filter("pos = 0"))
    assert {r.label for r in one.filter("meeting_id = 1").collect()} == {"x"}
    sure = turns.withColumn("confidence", F.when(F.col("label") == "x", 0.01).otherwise(1.0))
    assert [r.label for r in word_labels(df, sure).filter("meeting_id = 1 and idx = 0 and nth = 2").collect()] == ["y"]


def test_word_labels_make_no_row_for_each_word_and_label(spark):
    words = spark.createDataFrame([(1, 0, k, k * 500, k * 500 + 400) for k in range(4)], "meeting_id int, idx int, nth int, start_ms long, end_ms long")
    turns = spark.createDataFrame([(1, 0, "x", 0, 900), (1, 1, None, 0, 2000), (1, 2, "y", 900, 2000)], "meeting_id int, pos int, label string, start_ms long, end_ms long")
    labelled = word_labels(words, turns)
    assert [r.label for r in labelled.orderBy("nth").collect()] == ["x", "x", "y", "y"]
    assert "FlatMapGroupsInPandas" not in labelled._jdf.queryExecution().toString()


def test_merging_deals_meetings_to_all_tasks(spark):
    rows = [(m, p, t, None, None, p) for m in range(40) for p, t in enumerate(["send the report", "send report the", "book a room"])]
    items = spark.createDataFrame(rows, "g int, pos int, text string, owner string, due date, unit int")
    merged = merge_similar(items, ["g"])
    assert merged.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.g, r.leader, r.n_merged) for r in merged.collect()) == sorted((m, p, n) for m in range(40) for p, n in ((0, 2), (2, 1)))
