"""The timeline of live signals against a plain loop over the same events."""

import random

import pytest

from colloquy.streaming.reducer import EVENT, SIGNALS, Timeline, signal_health, speaker_timeline


def plainly(events, origin, finish, how):
    people, owners, history = {}, {}, {s: [] for s in SIGNALS}
    for _, at, kind, sources, names, who in sorted(events):
        if kind == "roster":
            for i, name, listed in who:
                if name.lower() not in how.ignored:
                    people[i] = (name, listed)
                    owners.update(dict.fromkeys(listed, i))
        elif kind == "mapping":
            owners.update({s: i for i, _, listed in who for s in listed})
        elif not history[kind] or history[kind][-1][1:] != (sources, names):
            history[kind].append((at, sources, names))

    def of_source(s):
        return owners[s] if owners.get(s) in people else next((i for i, (_, listed) in people.items() if s in listed), None)

    def of_name(n):
        n = n.lower()
        exact = [i for i, (x, _) in people.items() if x.lower() == n]
        return (exact or [i for i, (x, _) in people.items() if x.lower().startswith(n) or n.startswith(x.lower())] or [None])[0]

    told = {}
    for s in SIGNALS:
        told[s] = []
        for at, sources, names in history[s]:
            who = [of_source(x) for x in sources] + [of_name(x) for x in names if x.lower() not in how.ignored]
            told[s].append((min(max(at - how.lag_ms - origin, 0), finish - origin), {w for w in who if w}, who.count(None)))
        told[s].sort(key=lambda x: x[0])
    at = lambda s, t: ([x for x in told[s] if x[0] <= t] or [None])[-1]
    cuts = sorted({0, finish - origin} | {x[0] for s in SIGNALS for x in told[s]})
    out = []
    for a, b in zip(cuts, cuts[1:]):
        now = [(s, at(s, a)) for s in SIGNALS if at(s, a)]
        state, speaker, candidates = "unknown", None, []
        if now:
            s, (_, found, missing) = now[0]
            if not found and not missing:
                state = "silent"
            elif len(found) + missing > 1:
                state, candidates = "contested", sorted(found)
            elif found:
                speaker, candidates, state = min(found), sorted(found), "speaking"
                if how.cross_check and any(not m and len(f) == 1 and speaker not in f for _, (_, f, m) in now[1:]):
                    state, speaker = "contested", None
        out.append([a, b, state, speaker, candidates])

    def merge(slices):
        kept = []
        for x in slices:
            if kept and kept[-1][2:] == x[2:]:
                kept[-1][1] = x[1]
            else:
                kept.append(list(x))
        return kept

    out = merge(out)
    out = [[a, b, "silent", None, c] if s == "speaking" and b - a < how.least_ms else [a, b, s, w, c] for a, b, s, w, c in out]
    if how.contest_ms > 0:
        done = [out[0]]
        for x in out[1:]:
            p = done[-1]
            if p[2] == x[2] == "speaking" and p[3] != x[3]:
                left, right = min(how.contest_ms / 2, (p[1] - p[0]) / 2), min(how.contest_ms / 2, (x[1] - x[0]) / 2)
                edge = x[0]
                done[-1] = [p[0], edge - left, *p[2:]]
                done += [[edge - left, edge + right, "contested", None, sorted({p[3], x[3]})], [edge + right, *x[1:]]]
            else:
                done.append(x)
        out = [x for x in done if x[1] - x[0] > 1e-9]
    return [tuple(x[:4]) + (tuple(x[4]),) for x in merge(out)]


def made(rng):
    names = ["Ana", "Bo", "Bo Li", "Cy", "Bot"]
    events, t = [], 0
    for seq in range(rng.randint(0, 25)):
        t += rng.choice([0, 50, 200, 1000, 4000])
        kind = rng.choice(["roster", "mapping", "csrc", "csrc", "dominant", "dom", "dom"])
        ids = rng.sample(range(5), rng.randint(1, 3))
        who = [(f"p{i}", names[i] if kind == "roster" else None, rng.sample(range(1, 7), rng.randint(0, 2))) for i in ids] if kind in ("roster", "mapping") else []
        sources = rng.sample(range(1, 7), rng.choice([0, 1, 1, 2])) if kind == "csrc" else rng.sample(range(1, 7), rng.randint(0, 1)) if kind == "dominant" else []
        events.append((seq, 1000 + t, kind, sources, rng.sample(["ana", "Bo", "Cy X", "Zed", "BOT"], rng.randint(0, 2)) if kind == "dom" else [], who))
    return events


@pytest.mark.parametrize("how", [Timeline(), Timeline(lag_ms=150.0, least_ms=0.0, contest_ms=800.0, ignored=("bot",)), Timeline(cross_check=False, contest_ms=300.0)])
def test_timeline_equals_the_loop(spark, how):
    rng = random.Random(4)
    meetings = {m: made(rng) for m in range(60)}
    rows = [(m, *e) for m, events in meetings.items() for e in events]
    rng.shuffle(rows)  # events reach the table in any order
    df = spark.createDataFrame(rows, "meeting_id int, " + EVENT).repartition(5)
    ends = {m: 1500 + 25_000 * (m % 7 > 0) for m in meetings}
    spans = spark.createDataFrame([(m, 1200, e) for m, e in ends.items()] + [(99, 5, 5)], "meeting_id int, origin_ms long, finish_ms long")
    got = {}
    for r in speaker_timeline(df, spans, how=how).collect():
        got.setdefault(r.meeting_id, []).append((r.start_ms, r.end_ms, r.state, r.speaker, tuple(r.candidates)))
    states = set()
    for m, events in meetings.items():
        want = plainly(events, 1200, ends[m], how)
        assert sorted(got[m]) == want, m
        states |= {x[2] for x in want}
    assert states == {"speaking", "contested", "silent", "unknown"} and 99 not in got


def test_health(spark):
    rows = [(1, 0, 5, "roster", [], [], []), (1, 1, 9, "csrc", [1], [], []), (1, 2, 12, "csrc", [1], [], []), (1, 3, 11, "dom", [], ["x"], []), (2, 0, 1, "roster", None, None, None)]
    got = {r.meeting_id: tuple(r)[1:] for r in signal_health(spark.createDataFrame(rows, "meeting_id int, " + EVENT)).collect()}
    assert got == {1: (1, 1, 0, 1, 12), 2: (1, 0, 0, 0, 1)}
