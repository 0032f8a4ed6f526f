"""Readers and writers of transcript formats: RTTM, WebVTT, SubRip, manifests, JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import parse_timecode, timecode
from ..functions.text import word_count

UNKNOWN = "unknown"


def rttm_turns(lines: DataFrame, column: str = "value") -> DataFrame:
    """(``file, start_ms, end_ms, label``) of the SPEAKER records of RTTM lines; other and short records are left out."""
    f = F.split(F.trim(F.col(column)), r"\s+")
    ms = lambda x: F.floor(x.try_cast("double") * 1000 + 0.5).cast("long")
    good = lines.select(f.alias("f")).filter((F.size("f") >= 8) & (F.get("f", F.lit(0)) == "SPEAKER"))
    rows = good.select(F.get("f", F.lit(1)).alias("file"), ms(F.get("f", F.lit(3))).alias("start_ms"), ms(F.get("f", F.lit(4))).alias("length"), F.get("f", F.lit(7)).alias("label"))
    return rows.filter("start_ms is not null and length is not null").select("file", "start_ms", (F.col("start_ms") + F.col("length")).alias("end_ms"), "label")


def rttm_lines(turns: DataFrame, file: str, label: str, channel: int = 1) -> DataFrame:
    """(file, ``pos, line``): RTTM records, in seconds with three places, ordered by start, end and label."""
    pos = F.row_number().over(Window.partitionBy(file).orderBy("start_ms", "end_ms", label))
    seconds = lambda ms: F.format_string("%d.%03d", F.floor(ms / 1000).cast("long"), F.pmod(ms, F.lit(1000)).cast("long"))
    line = F.concat_ws(" ", F.lit("SPEAKER"), F.col(file).cast("string"), F.lit(str(channel)), seconds(F.col("start_ms")), seconds(F.col("end_ms") - F.col("start_ms")), F.lit("<NA>"), F.lit("<NA>"), F.col(label), F.lit("<NA>"), F.lit("<NA>"))
    return turns.select(file, pos.alias("pos"), line.alias("line"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    return rttm_turns(spark.read.text(path))


def speaker_of(payload: Column) -> tuple[Column, Column]:
    """(speaker, text) of a cue: a ``<v Name>`` tag, else a capitalised ``Name:`` of at most four words, else unknown."""
    voice = F.regexp_extract(payload, r"^<v(?:\.[^ >]*)?\s+([^>]+)>", 1)
    prefix = F.regexp_extract(payload, r"^(\p{Lu}[^:\s]*(?:\s+[^:\s]+){0,3}):\s+", 1)
    speaker = F.when(voice != "", F.trim(voice)).when(prefix != "", prefix).otherwise(F.lit(UNKNOWN))
    plain = F.when(voice != "", payload).when(prefix != "", F.substr(payload, F.length(prefix) + 2)).otherwise(payload)
    return speaker, F.trim(F.regexp_replace(plain, "<[^>]*>", ""))


def cues(documents: DataFrame, file: str = "file", content: str = "value") -> DataFrame:
    """(file, ``idx, start_ms, end_ms, speaker, text``) of WebVTT or SubRip documents, a row for each.

    Blocks are cut at blank lines; the first line with ``-->`` times a block, the lines after it are its text.
    """
    body = F.regexp_replace(F.regexp_replace(F.col(content), "^﻿", ""), "\r\n?", "\n")
    blocks = documents.select(file, F.posexplode(F.split(body, r"\n[ \t]*\n+")).alias("n", "block"))
    timing = F.regexp_extract("block", r"(?m)^\s*(\S+)\s+-->\s+(\S+)", 1), F.regexp_extract("block", r"(?m)^\s*(\S+)\s+-->\s+(\S+)", 2)
    payload = F.trim(F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1), r"\s*\n\s*", " "))
    timed = blocks.select(file, "n", parse_timecode(timing[0]).alias("start_ms"), parse_timecode(timing[1]).alias("end_ms"), payload.alias("p")).filter("start_ms is not null and end_ms is not null and p <> ''")
    speaker, text = speaker_of(F.col("p"))
    idx = F.row_number().over(Window.partitionBy(file).orderBy("start_ms", "end_ms", "n")) - 1
    return timed.select(file, idx.alias("idx"), "start_ms", F.greatest("start_ms", "end_ms").alias("end_ms"), speaker.alias("speaker"), text.alias("text"))


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    return cues(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def subtitles(utterances: DataFrame, key: str, style: str = "vtt") -> DataFrame:
    """(key, ``document``): WebVTT with voice tags, or SubRip that names a speaker where it changes."""
    w = Window.partitionBy(key).orderBy("idx")
    n = F.row_number().over(w)
    times = F.concat(timecode(F.col("start_ms"), style), F.lit(" --> "), timecode(F.col("end_ms"), style))
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    changed = F.coalesce(F.lag("speaker").over(w) != F.col("speaker"), F.lit(True))
    text = F.concat(F.lit("<v "), F.col("speaker"), F.lit(">"), safe) if style == "vtt" else F.when(changed, F.concat(F.col("speaker"), F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    cue = utterances.select(key, "idx", F.concat_ws("\n", n.cast("string"), times, text).alias("cue"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "cue"))), lambda c: c.cue), "\n\n")
    head = F.lit("WEBVTT\n\n") if style == "vtt" else F.lit("")
    return cue.groupBy(key).agg(F.concat(head, joined, F.lit("\n")).alias("document"))


def read_manifest(spark: SparkSession, path: str, source: str) -> DataFrame:
    """JSON-lines manifests as utterances: (``id, idx, start, end, speaker, text, language``), an item's own list or one utterance."""
    item = "array<struct<start double, end double, speaker string, text string, language string>>"
    rows = spark.read.schema(f"id string, audio string, language string, text string, speaker string, seconds double, duration double, utterances {item}, segments {item}").option("mode", "FAILFAST").json(path)
    listed = F.coalesce(F.when(F.size("utterances") > 0, F.col("utterances")), F.when(F.size("segments") > 0, F.col("segments")))
    whole = F.array(F.struct(F.lit(0.0).alias("start"), F.coalesce("seconds", "duration", F.lit(0.0)).alias("end"), F.col("speaker"), F.coalesce("text", F.lit("")).alias("text"), F.col("language")))
    stem = F.regexp_extract("audio", r"([^/]+?)(?:\.[^./]*)?$", 1)
    each = rows.select(F.coalesce("id", F.when(stem != "", stem), F.lit(source)).alias("id"), F.coalesce("language", F.lit("en")).alias("lang"), F.posexplode(F.coalesce(listed, whole)).alias("idx", "u"))
    return each.select("id", "idx", F.col("u.start").alias("start"), F.greatest("u.start", "u.end").alias("end"), F.coalesce("u.speaker", F.lit(UNKNOWN)).alias("speaker"), F.col("u.text").alias("text"), F.coalesce("u.language", "lang").alias("language"))


def transcript_json(utterances: DataFrame, key: str) -> DataFrame:
    """(key, ``document``): a transcript as JSON: its duration, words, speakers in order of appearance and utterances."""
    u = F.struct("idx", "speaker", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), timecode(F.col("start_ms")).alias("timecode"), "text")
    held = utterances.groupBy(key).agg(F.max("end_ms").alias("e"), F.sum(word_count(F.col("text"))).alias("n"), F.array_sort(F.collect_list(u)).alias("u"))
    speakers = F.array_distinct(F.transform("u", lambda x: x.speaker))
    body = F.struct((F.col("e") / 1000).alias("audio_duration_seconds"), F.col("n").alias("word_count"), speakers.alias("speakers"), F.col("u").alias("utterances"))
    return held.select(key, F.to_json(F.struct(F.lit("1.1").alias("schema_version"), F.lit("transcript").alias("kind"), body.alias("transcript"))).alias("document"))


def markdown(blocks: DataFrame, key: str) -> DataFrame:
    """(key, ``document``): a heading for each block (``block, speaker, start_ms, text``) and its text."""
    line = F.concat(F.lit("### "), F.col("speaker"), F.lit(" — "), timecode(F.col("start_ms")), F.lit("\n\n"), F.col("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", line.alias("l")))), lambda x: x.l), "\n\n")
    return blocks.groupBy(key).agg(joined.alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One line-delimited text table of documents; a task writes what it holds, through Spark's committer."""
    documents.select("document").write.mode("error").text(path, lineSep="\x1e\n")
