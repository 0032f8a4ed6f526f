import hashlib
import hmac
import json

from pyspark.sql import functions as F

from colloquy.sources import corpora, formats


def test_transcript_json_round_trip(spark, tmp_path):
    u = spark.createDataFrame([(1, 0, "Ann", 0, 1250, "one"), (1, 1, "Bob", 1250, 3000, "two")], "k long, idx long, speaker string, start_ms long, end_ms long, text string")
    docs = formats.transcript_json(u, "k")
    body = json.loads(docs.first().document)
    assert body["transcript"]["speakers"] == ["Ann", "Bob"] and body["transcript"]["word_count"] == 2
    docs.select("document").write.text(str(tmp_path / "out"))
    back = corpora.read_transcript_json(spark, str(tmp_path / "out"))
    assert sorted(tuple(r)[1:] for r in back.collect()) == sorted(tuple(r)[1:] for r in u.collect())


def test_tracks(spark, tmp_path):
    for name, rows in (("ann", [{"start": 1.0, "end": 2.0, "text": "+ hello_there"}, {"start": 3, "end": 4, "text": " * "}]), ("bob", [{"start": 0.5, "end": 0.1, "text": "hi"}])):
        (tmp_path / "m1").mkdir(exist_ok=True)
        (tmp_path / "m1" / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    got = [(r.meeting, r.idx, r.speaker, r.start, r.end, r.text) for r in corpora.read_tracks(spark, str(tmp_path)).orderBy("idx").collect()]
    assert got == [("m1", 0, "bob", 0.5, 0.5, "hi"), ("m1", 1, "ann", 1.0, 2.0, "hello there")]


def test_word_xml(spark, tmp_path):
    (tmp_path / "a.words.xml").write_text('<n><w starttime="0.0" endtime="0.4">So</w><w starttime="0.4" endtime="0.4" punc="true">,</w><w starttime="0.5" endtime="1.0">yes</w><w starttime="3.0" endtime="3.5">ok</w><w>lost</w></n>')
    got = [(r.idx, r.start, r.end, r.text) for r in corpora.read_word_xml(spark, str(tmp_path)).orderBy("idx").collect()]
    assert got == [(0, 0.0, 1.0, "So yes"), (1, 3.0, 3.5, "ok")]


def test_sink_helpers(spark):
    df = spark.createDataFrame([("d", "a.txt"), ("d", "A.txt"), ("e", "a.txt")], "f string, n string")
    assert sorted(r.unique_name for r in corpora.unique_names(df, "f", "n").collect()) == ["A.txt", "a-1.txt", "a.txt"]
    keys = spark.createDataFrame([("a/b.txt",), ("/a",), ("a/../b",), ("",), (None,), ("a//b",)], "k string")
    assert [r.v for r in keys.select(corpora.valid_key(F.col("k")).alias("v")).collect()] == [True, False, False, False, False, False]
    r = spark.range(1).select(corpora.recipients(F.lit("a@b.co; bad, c@d.org,a@b.co")).alias("r"), corpora.plain_of_html(F.lit("<p>a &amp; <b>b</b></p><script>x</script>")).alias("h")).first()
    assert r.r == ["a@b.co", "c@d.org"] and r.h == "a & b"
    one = corpora.signed(spark.createDataFrame([(5, "{}")], "timestamp int, body string"), "key").first()
    assert one.signature == "sha256=" + hmac.new(b"key", b"5.{}", hashlib.sha256).hexdigest()
    newest = corpora.latest(spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "id string, updated_at int"))
    assert sorted(map(tuple, newest.collect())) == [("x", 2), ("y", 1)]
    page = corpora.html(spark.createDataFrame([(1, 0, "A<b", "x & y", "T")], "k int, block int, speaker string, text string, title string"), "k", "title").first().document
    assert "<strong>A&lt;b</strong> x &amp; y</p>" in page and "<title>T</title>" in page


def test_no_name_is_handed_out_twice(spark):
    from colloquy.sources.corpora import unique_names

    names = ["a-1.txt", "a.txt", "A.txt", "a.txt", "b", "b", "b-1", ".env", ".env", None]
    df = spark.createDataFrame([("f", n) for n in names] + [("g", "a.txt")], "folder string, name string")
    got = [(r.folder, r.name, r.unique_name) for r in unique_names(df, "folder", "name").collect()]
    assert len(got) == 11
    for folder in ("f", "g"):
        given = [u.lower() for f, n, u in got if f == folder and n]
        assert len(set(given)) == len(given)
    assert ("g", "a.txt", "a.txt") in got and ("f", None, None) in got and ("f", "a-1.txt", "a-1.txt") in got
