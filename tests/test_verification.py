"""Verdicts on claims, worked out by hand."""

from pyspark.sql import functions as F

from colloquy.operators.verification import grounding_report, plain_number, verify_claims

SAID = [(1, 0, "Ana Lima", "The budget report counts 1,200 invoices", 0, 5000), (1, 1, "Kim", "Servers are slow in Nantes", 60_000, 65_000)]
CLAIMS = [
    (0, "Budget reports count 1200 invoices", 0, 5000, "supported", ["1200"], [], []),
    (1, "Budget reports count 1300 invoices", 0, 5000, "weak", ["1300"], ["1300"], []),
    (2, "The servers are slow", 0, 5000, "weak", ["server", "slow"], [], []),
    (3, "The servers are slow", None, None, "supported", [], [], []),
    (4, "The zebras of Paris eat servers", 60_000, 65_000, "unsupported", ["zebra", "pari", "eat"], [], ["Paris"]),
    (5, "budgett for Kim and Ana", 0, 1000, "supported", [], [], []),
    (6, "", None, None, "supported", [], [], []), (7, None, None, None, "supported", [], [], []), (8, "zebra", None, None, "weak", ["zebra"], [], []),
]


def test_verdicts(spark):
    said = spark.createDataFrame(SAID, "meeting_id int, idx int, speaker string, text string, start_ms long, end_ms long")
    claims = spark.createDataFrame([(1, *c[:4]) for c in CLAIMS] + [(2, 0, "nobody spoke here", 0, 1)], "meeting_id int, claim int, text string, cited_from long, cited_to long")
    got = {(r.meeting_id, r.claim): r for r in verify_claims(claims, said).collect()}
    assert len(got) == len(CLAIMS) + 1
    for k, *_, verdict, missing, numbers, names in CLAIMS:
        r = got[1, k]
        if k != 5:
            assert (r.verdict, r.missing, r.bad_numbers, r.bad_names) == (verdict, missing, numbers, names), k
    assert got[2, 0].verdict == "unsupported" and not got[2, 0].kept
    assert got[1, 5].overall_support < 1  # names of speakers are words, but no terms of what was said
    vocabulary = spark.createDataFrame([(1, "Paris")], "meeting_id int, entry string")
    assert {r.claim: r.bad_names for r in verify_claims(claims, said, vocabulary=vocabulary).collect() if r.meeting_id == 1}[4] == []
    report = {r.meeting_id: r for r in grounding_report(verify_claims(claims, said)).collect()}
    assert (report[2].n_claims, report[2].dropped, report[2].supported_ratio) == (1, 1, 0.0) and report[1].n_claims == len(CLAIMS)


def test_numbers(spark):
    assert [spark.range(1).select(plain_number(F.lit(x)).alias("n")).first().n for x in ("1,200", "007", "0.0", "3.5")] == ["1200", "7", "0", "35"]
