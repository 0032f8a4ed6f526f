"""The inbox as a stream of files, and job records: a second run, a repeated batch and a broken sidecar change nothing."""

import datetime as dt

from colloquy.streaming.inbox import pending_recordings, processed, read_sidecars, watch_inbox
from colloquy.streaming.jobs import RECORD, append_records, latest_records, read_records, recovered

CUE = "WEBVTT\n\n00:00.000 --> 00:01.500\n<v Ana>Hello there\n\n00:02.000 --> 00:03.000\nBo: Yes\n"


def test_inbox(spark, tmp_path):
    inbox, outbox, state = (tmp_path / n for n in ("in", "out", "state"))
    inbox.mkdir()
    (inbox / "weekly call.vtt").write_text(CUE)
    (inbox / "weekly call.json").write_text('{"title": "Weekly", "language": "fr", "speakers": "2", "vocabulary": ["Bordeaux", 7, null]}')
    (inbox / "b.SRT").write_text("1\n00:00:01,000 --> 00:00:02,000\nHi\n")
    (inbox / "b.json").write_text('{"title": ')
    (inbox / "empty.vtt").write_text("WEBVTT\n")
    (inbox / "empty.json").write_text('["title"]')
    (inbox / "notes.txt").write_text("x")
    run = lambda: watch_inbox(spark, str(inbox), str(outbox), str(state)).awaitTermination()
    shown = lambda: {r.title: (r.state, r.n_utterances, r.language, list(r.vocabulary), r.speakers, r.note, r.error) for r in spark.read.parquet(str(outbox / "requests")).collect()}
    run()
    want = {"Weekly": ("completed", 2, "fr", ["Bordeaux", "7"], 2, None, None), "b": ("completed", 1, None, [], None, "malformed sidecar", None), "empty": ("failed", 0, None, [], None, None, "no timed text")}
    assert shown() == want
    said = sorted((r.idx, r.start_ms, r.speaker, r.text, r.language) for r in spark.read.parquet(str(outbox / "utterances")).collect())
    assert said == [(0, 0, "Ana", "Hello there", "fr"), (0, 1000, "unknown", "Hi", None), (1, 2000, "Bo", "Yes", "fr")]
    run()
    assert shown() == want and spark.read.parquet(str(outbox / "requests")).count() == 3
    (inbox / "late.vtt").write_text(CUE)
    (inbox / "late.json").write_text('{"speakers": true, "title": "", "vocabulary": "Bordeaux"}')
    run()
    assert shown() == want | {"late": ("completed", 2, None, [], None, None, None)} and spark.read.parquet(str(outbox / "utterances")).count() == 5
    files = spark.read.text(str(inbox / "late.vtt"), wholetext=True).selectExpr("_metadata.file_path as path", "value")
    assert [r.identifier for r in processed(files, read_sidecars(spark, str(inbox)))[0].collect()] == [r.identifier for r in spark.read.parquet(str(outbox / "requests")).filter("title = 'late'").collect()]


def test_recordings(spark, tmp_path):
    for name, text in {"b.WAV": "12345", "a.mp3": "1", "none.mp3": "", "a.json": '{"speakers": 3}', "c.txt": "x"}.items():
        (tmp_path / name).write_text(text)
    got = [(r.title, r.bytes, r.speakers, r.state) for r in pending_recordings(spark, str(tmp_path)).collect()]
    assert got == [("a", 1, 3, "pending"), ("b", 5, None, "pending")]


def test_jobs(spark, tmp_path):
    at = lambda k: dt.datetime(2026, 1, 1, 0, k)
    row = lambda name, state, k, url=None: (name, state, at(0), at(k), None, url, None, "t", None, ["x"], [])
    store = str(tmp_path / "jobs")
    append_records(spark.createDataFrame([row("a", "pending", 1), row("b", "capturing", 1, "u"), row("c", "capturing", 1, "u"), row("d", "pending", 1, "u"), row("e", "pending", 1)], RECORD), store)
    append_records(spark.createDataFrame([row("a", "summarizing", 2), row("e", "completed", 2), row("f", "transcribing", 2, "u")], RECORD), store)
    (tmp_path / "jobs" / "broken.json").write_text('{"identifier": \n{"state": "pending"}\n')
    last = latest_records(read_records(spark, store))
    assert {r.identifier: r.state for r in last.collect()} == {"a": "summarizing", "b": "capturing", "c": "capturing", "d": "pending", "e": "completed", "f": "transcribing"}
    recordings = spark.createDataFrame([("b", "b1", 2000), ("b", "b2", 3000), ("c", "c1", 1024), ("f", "f1", 5000), ("e", "e1", 5000), ("a", "a1", 5000)], "identifier string, path string, bytes long")
    found = recovered(last, recordings, "timestamp'2026-01-02'")
    got = {r.identifier: (r.outcome, r.state, r.join_url, r.audio_path, r.error is not None) for r in found.collect()}
    assert got == {
        "a": ("resumed", "pending", None, None, False), "b": ("resumed", "pending", None, "b2", False), "c": ("abandoned", "failed", "u", None, True), "d": ("resumed", "pending", "u", None, False), "f": ("resumed", "pending", None, "f1", False),
    }
    append_records(found.drop("outcome"), store)
    again = recovered(latest_records(read_records(spark, store)), recordings, "timestamp'2026-01-03'").collect()
    assert sorted((r.identifier, r.outcome) for r in again) == [(n, "resumed") for n in "abdf"]
