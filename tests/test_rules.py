import datetime as dt

from pyspark.sql import functions as F

from colloquy.functions.due import due_date
from colloquy.functions.tags import agree, languages_of, merged_tag, normal_tag
from colloquy.operators.segments import plan_segments

DAY = dt.date(2026, 6, 3)  # a Wednesday


def test_due_dates(spark):
    want = {
        "by Friday please": "2026-06-05", "next monday": "2026-06-08", "on wednesday": "2026-06-10", "pour vendredi": "2026-06-05", "lundi prochain": "2026-06-08",
        "end of the week": "2026-06-05", "fin du mois": "2026-06-30", "end of next month": "2026-07-31", "in 10 days": "2026-06-13", "dans 2 semaines": "2026-06-17",
        "in 1 month": "2026-07-31", "demain": "2026-06-04", "today": "2026-06-03", "2026-12-24, not friday": "2026-12-24", "15th of March": "2027-03-15", "le 14 août": "2026-08-14", "May 40": None, "soon": None,
        "Tomorrow, at the latest by March 3": "2026-06-04", "by March 3rd, not tomorrow": "2027-03-03", "the day after tomorrow": "2026-06-05", "d'ici après-demain": "2026-06-05", "March 3, 2028": "2028-03-03",
        "le 3 mars 2028": "2028-03-03", "15/02": "2027-02-15", "by the 15th": "2026-06-15", "before the 2nd": "2026-07-02", "next month": "2026-07-31", "le mois prochain": "2026-07-31", "by end of day": "2026-06-03", "EOM": "2026-06-30",
        "avant le 2": "2026-07-02", "le 14 h": None, "en fin de journée": "2026-06-03", "3rd of Sept": "2026-09-03", "2026-02-31": None, "1/2/27": "2027-02-01", "3 March": None,
    }
    df = spark.createDataFrame([(k, DAY) for k in want], "t string, d date")
    assert {r.t: r.x and str(r.x) for r in df.select("t", due_date(F.col("t"), F.col("d")).alias("x")).collect()} == want


def test_tags(spark):
    df = spark.createDataFrame([(" FR_ca ", ["en", "EN-us", None]), ("Multi", ["en", "fr"]), ("auto", []), (None, ["mixed"])], "t string, a array<string>")
    got = df.select(normal_tag(F.col("t")).alias("n"), languages_of(F.col("t")).alias("l"), merged_tag(F.col("a")).alias("m"), agree(F.col("t"), F.lit("x")).alias("g")).collect()
    df2 = spark.createDataFrame([("bilingual",), ("Mixte",), ("automatic",), ("mul",), (" ",)], "t string")
    assert [r.n for r in df2.select(normal_tag(F.col("t")).alias("n")).collect()] == ["mixed", "mixed", None, "mul", None]
    assert [tuple(r) for r in got] == [("fr", ["fr"], "en", False), ("mixed", ["en", "fr"], "mixed", False), (None, ["en", "fr"], None, False), (None, ["en", "fr"], "mixed", True)]


def test_segment_plan(spark):
    rows = [(1, 0, 1000), (1, 1300, 2000), (1, 5000, 5500), (1, 10_000, 50_000)]
    df = spark.createDataFrame([(*r, 100_000) for r in rows], "meeting_id long, start_ms long, end_ms long, total_ms long")
    got = sorted((r.start_ms, r.end_ms) for r in plan_segments(df).collect())
    assert got == [(0, 2200), (9800, 39_800), (37_800, 50_200)]
