import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import line_dedup, order_minhash, simhash


def fingerprint(text, words=3):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints_equal_the_definition(docs_frame):
    for t in [*docs_frame.text[:40], "", None, " \n", "A", "A b", "É É a\x0bB\xa0c d"]:
        assert simhash.majority(simhash.shingle_hashes(t, 3)) == fingerprint(t)


def test_links_have_the_components_of_all_pairs(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base) | {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    for f in base[:12]:
        for _ in range(12):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 1, 2, 2, 3])))
            fps.add(f)
    for _ in range(60):  # a dense group around one
        fps.add(base[0] ^ sum(1 << b for b in rng.sample(range(10), 3)))
    fps = sorted(fps)
    want = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got_edges = [(r.a, r.b) for r in edges.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in got_edges)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    got = defaultdict(set)
    for i, f in enumerate(signed):
        got[root.get(f, f)].add(i)
    expected = defaultdict(set)
    for i, r in enumerate(want):
        expected[r].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_path(spark):
    n = 200
    order = list(range(n))
    random.Random(2).shuffle(order)
    df = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("which", ["docs", "edges"])
def test_simhash_groups(request, which):
    df, frame = request.getfixturevalue(which), request.getfixturevalue("docs_frame" if which == "docs" else "edge_frame")
    got = simhash.simhash_groups(df).collect()
    fps = [fingerprint(t) for t in frame.text]
    root = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    ids = [None if i != i or i is None else int(i) for i in frame.doc_id]
    least = defaultdict(list)
    for i, r in zip(ids, root):
        if i is not None:
            least[r].append(i)
    want = sorted((str(i), f"{f:016x}", str(min(least[r]) if least[r] else None)) for i, f, r in zip(ids, fps, root))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_simhash_groups_of_nothing(empty):
    assert simhash.simhash_groups(empty).count() == 0


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def test_near_dedup_finds_copies_and_keeps_the_rest(spark, docs_frame):
    rng = random.Random(4)
    rows, nth = [], 10_000
    long_ones = [t for t in docs_frame.text if len(t.split()) > 150][:12]
    for k, t in enumerate(long_ones):
        rows.append((k, t))
        for _ in range(6):
            w = t.split(" ")
            for _ in range(max(1, len(w) // 150)):
                w[rng.randrange(len(w))] = "changed" + str(rng.random())
            rows.append((nth, " ".join(w)))
            nth += 1
        rows.append((nth, t))
        nth += 1
    rows += [(500, ""), (501, None), (502, "  "), (None, "alone in the world here"), (700, "some words"), (700, "some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit("mine"))
    got = simhash.near_dedup(df)
    assert got.columns == ["doc_id", "text", "x"]
    sets = [shingles(t) for _, t in rows]
    same = lambda a, b: a == b or (a | b and len(a & b) >= 0.8 * len(a | b))
    root = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if same(sets[i], sets[j])])
    best = {}
    for (i, _), r in zip(rows, root):
        key = (i is None, i or 0)
        best[r] = min(best.get(r, key), key)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(best.values())
    assert simhash.near_dedup(df.limit(0)).count() == 0


def tokens(line):
    return frozenset(x for x in re.split("[\t\r\f\v\n ]", line.lower()) if x)


def later_lines(rows, t=0.9):
    first, order = {}, []
    for key, text in rows:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            if line not in first:
                first[line] = (key, k)
                order.append(line)
    sets, late = [tokens(x) for x in order], {}
    df = Counter(w for s in sets for w in s)
    inverted = defaultdict(list)
    for j, s in enumerate(sets):
        found = set()
        for w in sorted(s, key=lambda w: (df[w], w))[: len(s) - math.ceil(t * len(s) - 1e-9) + 1] if s else ():
            found.update(inverted[w])
            inverted[w].append(j)
        late[order[j]] = any(len(s & sets[x]) >= t * len(s | sets[x]) - 1e-9 for x in found)
    return {key: [k for k, line in enumerate((text or "").split("\n")) if text is not None and tokens(line) and (late[line] or first[line] != (key, k))] for key, text in rows}


def test_line_dedup_equals_brute_force(spark, docs_frame):
    rng = random.Random(9)
    w = [f"w{i}" for i in range(60)]
    base = [rng.choice(w) + str(i) for i in range(40)]
    rows = list(zip(docs_frame.doc_id.tolist(), docs_frame.text.tolist()))
    for k in range(40):  # a line with many variants, and its variants' variants
        line = list(base)
        for _ in range(rng.randint(0, 3)):
            line[rng.randrange(40)] = f"v{rng.randint(0, 9)}"
        rng.shuffle(line)
        rows.append((5000 + k, "\n".join([" ".join(line), "", "short one", f"only {k}"])))
    want = later_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_report(df).collect()}
    assert {k: ",".join(map(str, v)) for k, v in want.items()} == {k: r.removed for k, r in got.items()}
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert texts == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(want[k])) for k, t in rows}


def test_line_dedup_of_edges(edges, empty):
    got = line_dedup.dedup_lines(edges)
    assert got.columns == edges.columns and got.count() == edges.count()
    by = {(r.doc_id, r.text) for r in got.collect()}
    assert (1, None) in by and (8, "one") in by and (9, "") in by and (3, " \n\t ") in by
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.line_report(empty).count() == 0


def test_line_dedup_is_native(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def omh(sketch, text):
    return order_minhash.OrderMinHash.text_of(sketch.fingerprint(text))


@pytest.mark.parametrize("which", ["docs", "edges"])
def test_edit_fingerprints(request, which):
    df, frame = request.getfixturevalue(which), request.getfixturevalue("docs_frame" if which == "docs" else "edge_frame")
    sketch = order_minhash.OrderMinHash(sketches=16)
    rows = sorted(((i is None or i != i, -(i if i == i and i is not None else 0), t) for i, t in zip(frame.doc_id, frame.text)), key=lambda r: (r[0], r[1], r[2] is None))
    texts = [t or "" for *_, t in rows]
    want = []
    for k, t in enumerate(texts):
        n, following = len(t) // 3, texts[(k + 1) % len(texts)]
        new = t[: len(t) - n] + following[:n]
        want.append((len(t), __import__("hashlib").sha256(new.encode()).hexdigest(), omh(sketch, t), omh(sketch, new)))
    got = order_minhash.edit_fingerprints(df, sketch).collect()
    assert sorted((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_likeness_falls_with_edits_and_with_order(docs_frame):
    sketch = order_minhash.OrderMinHash(sketches=256)
    text = max(docs_frame.text, key=len)[:4000]
    half = len(text) // 2
    a = sketch.fingerprint(text)
    few = sketch.likeness(a, sketch.fingerprint(text[:1000] + "#" + text[1001:]))
    many = sketch.likeness(a, sketch.fingerprint("".join("#" if i % 40 == 0 else c for i, c in enumerate(text))))
    swapped = sketch.likeness(a, sketch.fingerprint(text[half:] + text[:half]))
    assert few > 0.9 and many < few - 0.2 and swapped < 0.7
    assert (sketch.fingerprint(text) == a).all() and sketch.likeness(sketch.fingerprint(""), sketch.fingerprint(None)) == 1
    assert (order_minhash.OrderMinHash(block=100).fingerprint(text) == order_minhash.OrderMinHash().fingerprint(text)).all()


def test_edit_fingerprints_of_nothing_and_of_one(spark, empty):
    assert order_minhash.edit_fingerprints(empty).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert order_minhash.edit_fingerprints(one).first().near_next == 1.0


def test_near_dedup_of_unlike_repeats(spark):
    base, phrase = " ".join(f"w{i}" for i in range(100)), " ".join(["again and", "again"] * 3)
    texts = [" ".join([base, *["over and over"] * n]) for n in (3, 30, 300)] + [" ".join([phrase] * n) for n in (2, 20)]
    got = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [0, 3]


def test_near_text_links_find_all_short_pairs(spark):
    rng = random.Random(7)
    rows = []
    for n in [8] * 40 + [10] * 40 + [16] * 40 + [60] * 40 + [200] * 20:
        w = [f"v{rng.randrange(3000)}" for _ in range(n)]
        rows += [" ".join(w), " ".join([*w, *(f"t{rng.random()}" for _ in range(max(1, (n - 4) // 4)))])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    texts, linked = simhash.near_text_links(docs)
    ids = {r.x: r.least for r in texts.collect()}
    sets = [shingles(t) for t in rows]
    want = {(i, j) for j in range(len(rows)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {tuple(sorted((ids[r.x], ids[r.y]))) for r in linked.collect()}
    assert len(want) >= 180 and got == want


def test_near_texts_of_a_large_group_make_pairs_in_proportion(spark, monkeypatch):
    """Variants of one text, of which half are alike: the pairs looked at do not grow with the square of their number."""
    rng, seen = random.Random(3), []
    real = simhash.save

    def count(df, label):
        out = real(df, label)
        if label == "near":
            seen.append(out[0].count())
        return out

    monkeypatch.setattr(simhash, "save", count)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(160):
        w = list(base)
        for i in rng.sample(range(200), 4):
            w[i] = f"c{k}x{i}"
        rows.append(" ".join(w))
    sets = [shingles(t) for t in rows]
    alike = [(i, j) for i in range(160) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    kept = simhash.near_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert 0 < len(alike) < 160 * 159 / 2 and sorted(r.doc_id for r in kept.collect()) == sorted(set(groups(160, alike)))
    assert sum(seen) < 160 * 20


def test_near_texts_meet_on_the_simhash_grid(spark, monkeypatch):
    met = []
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps: met.append(fps.count()) or real(fps))
    texts = [" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(301)), "another text"]
    _, linked = simhash.near_text_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert linked.count() == 1 and met == [len({fingerprint(t, 5) for t in texts})]
