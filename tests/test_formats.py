import datetime

from pyspark.sql import functions as F

from colloquy.functions import clock, text
from colloquy.sources import formats


def test_rttm_round_trip(spark):
    turns = spark.createDataFrame([("m", 1500, 2750, "a"), ("m", 0, 1000, "b")], "file string, start_ms long, end_ms long, label string")
    lines = formats.rttm_lines(turns, "file", "label")
    assert [r.line for r in lines.orderBy("pos").collect()][0] == "SPEAKER m 1 0.000 1.000 <NA> <NA> b <NA> <NA>"
    back = formats.rttm_turns(lines.select(F.col("line").alias("value")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, turns.collect()))
    short = spark.createDataFrame([("LEXEME a b",), ("SPEAKER m 1 x y z",)], "value string")
    assert formats.rttm_turns(short).count() == 0


VTT = "﻿WEBVTT\n\nNOTE none\n\n1\n00:01.000 --> 00:02.500\n<v Ann Lee>Hello &amp; bye\n\n00:00:00,000 --> 00:00:01,000\nBob: first\nline\n\nno timing\n"


def test_cues(spark):
    df = spark.createDataFrame([("f", VTT)], "file string, value string")
    got = [tuple(r) for r in formats.cues(df).orderBy("idx").collect()]
    assert got == [("f", 0, 0, 1000, "Bob", "first line"), ("f", 1, 1000, 2500, "Ann Lee", "Hello &amp; bye")]


def test_subtitles_round_trip(spark):
    u = spark.createDataFrame([(1, 0, "Ann", 0, 1200, "one"), (1, 1, "Ann", 1300, 2000, "two"), (1, 2, "Bob", 2000, 3000, "three")], "k long, idx int, speaker string, start_ms long, end_ms long, text string")
    for style in ("vtt", "srt"):
        docs = formats.subtitles(u, "k", style).select(F.col("k").cast("string").alias("file"), F.col("document").alias("value"))
        got = [(r.start_ms, r.end_ms, r.text) for r in formats.cues(docs).orderBy("idx").collect()]
        assert got == [(0, 1200, "one"), (1300, 2000, "two"), (2000, 3000, "three")]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"audio":"/d/a.wav","text":"HI","seconds":2.5,"language":"fr"}\n{"id":"x","segments":[{"start":1,"end":0.5,"text":"a"}]}\n')
    got = {r.id: r for r in formats.read_manifest(spark, str(tmp_path / "m.jsonl"), "src").collect()}
    assert (got["a"].end, got["a"].language, got["a"].speaker) == (2.5, "fr", "unknown")
    assert (got["x"].start, got["x"].end, got["x"].language) == (1.0, 1.0, "en")


def test_clock(spark):
    df = spark.range(1).select(
        clock.timecode(F.lit(90_061_500)).alias("a"), clock.timecode(F.lit(1499), "vtt").alias("b"), clock.parse_timecode(F.lit("01:02,5")).alias("c"), clock.parse_timecode(F.lit("junk")).alias("d"),
        clock.iso_duration(F.lit(3_723_000)).alias("e"), clock.weekday_after(F.lit(datetime.date(2026, 6, 5)), 4).alias("f"), clock.end_of_week(F.lit(datetime.date(2026, 6, 6))).alias("g"),
        clock.calendar_date(F.lit(30), F.lit(2), F.lit(datetime.date(2026, 6, 6))).alias("h"), clock.calendar_date(F.lit(1), F.lit(2), F.lit(datetime.date(2026, 6, 6))).alias("i"),
    )
    r = df.first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("25:01:02", "00:00:01.499", 62_500, None, "PT1H2M3S")
    assert (str(r.f), str(r.g), r.h, str(r.i)) == ("2026-06-12", "2026-06-12", None, "2027-02-01")


def test_text(spark):
    r = spark.range(1).select(
        text.fold(F.lit("Œuvre Éte")).alias("a"), text.word_count(F.lit("  ")).alias("b"), text.sentences(F.lit("A b. C!\nd")).alias("c"),
        text.initials(F.lit("jean-luc picard")).alias("d"), text.initials(F.lit("")).alias("e"), text.file_name(F.lit("a/b: c.")).alias("f"), text.file_name(F.lit("con.txt")).alias("g"),
        text.coverage(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("a"))).alias("h"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("oeuvre ete", 0, ["A b.", "C!", "d"], "JL", "?", "a_b_ c", "_con.txt")
    assert abs(r.h - 2 / 3) < 1e-12
