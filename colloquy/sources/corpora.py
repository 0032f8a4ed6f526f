"""Readers of meeting corpora: transcript exports, speaker tracks, word-level XML; and helpers of document sinks."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .formats import UNKNOWN

EXPORT = "schema_version string, kind string, transcript struct<audio_duration_seconds double, word_count long, speakers array<string>, utterances array<struct<idx bigint, speaker string, start double, end double, text string>>>"


def read_transcript_json(spark: SparkSession, path: str) -> DataFrame:
    """(``file, idx, speaker, start_ms, end_ms, text``) of transcript exports, one JSON document a line."""
    rows = spark.read.schema(EXPORT).json(path).filter("kind = 'transcript'")
    each = rows.select(F.col("_metadata.file_path").alias("file"), F.explode("transcript.utterances").alias("u"))
    ms = lambda x: F.floor(x * 1000 + 0.5).cast("long")
    return each.select("file", F.col("u.idx").alias("idx"), F.coalesce("u.speaker", F.lit(UNKNOWN)).alias("speaker"), ms(F.col("u.start")).alias("start_ms"), ms(F.greatest("u.start", "u.end")).alias("end_ms"), F.col("u.text").alias("text"))


def clean_annotation(text: Column) -> Column:
    """A transcriber's marks taken out: lone ``+ @ *``; ``#`` and ``_`` become blanks."""
    lone = F.regexp_replace(F.translate(text, "#_", "  "), r"(?<=^|\s)[+@*]+(?=\s|$)", " ")
    return F.trim(F.regexp_replace(lone, r"\s+", " "))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(``meeting, idx, speaker, start, end, text``) of a folder of meetings with a JSON-lines file for each speaker.

    The meeting is the folder's name and the speaker the file's; blank texts are left out; rows are ordered by start, end and speaker.
    """
    rows = spark.read.schema("start double, end double, text string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(path)
    named = rows.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("meeting"), F.regexp_extract("_metadata.file_path", r"([^/]+?)\.jsonl?$", 1).alias("speaker"), "start", F.greatest("start", "end").alias("end"), clean_annotation(F.col("text")).alias("text"))
    kept = named.filter("text <> '' and start is not null")
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy("meeting").orderBy("start", "end", "speaker")) - 1)


def read_word_xml(spark: SparkSession, path: str, gap: float = 1.0) -> DataFrame:
    """(``file, idx, start, end, text``): utterances of word-level XML (``<w starttime endtime punc>``).

    Punctuation and words without times are left out; words at most ``gap`` seconds after the one before make an utterance.
    """
    rows = spark.read.format("xml").option("rowTag", "w").schema("_starttime double, _endtime double, _punc string, _VALUE string").load(path)
    words = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_starttime").alias("start"), F.col("_endtime").alias("end"), F.trim("_VALUE").alias("word")).filter("start is not null and end is not null and word <> '' and coalesce(_punc, 'false') <> 'true'")
    w = Window.partitionBy("file").orderBy("start", "end")
    run = words.withColumn("new", F.when(F.col("start") - F.lag("end").over(w) <= gap, 0).otherwise(1)).withColumn("idx", F.sum("new").over(w) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "word"))), lambda x: x.word), " ")
    return run.groupBy("file", "idx").agg(F.min("start").alias("start"), F.max("end").alias("end"), text.alias("text"))


def latest(records: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """The newest record of each key: an upsert of appended records."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return records.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def unique_names(files: DataFrame, folder: str, name: str) -> DataFrame:
    """``files`` with ``unique_name``: in order of ``name``, a name that its folder has already, in any case, gets the first of ``-1``, ``-2`` and so on that is free.

    Names that differ in more than such numbers and case cannot meet, so a group is what shares folder, stem and suffix without them.
    """
    parts = r"(?s)^(.*?)((?:-\d+)*)(\.[^.]*)?$"
    root = F.struct(F.lower(F.regexp_extract(name, parts, 1)), F.lower(F.regexp_extract(name, parts, 3)))
    row, group = "_row", "_root"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        made, tried = {}, {}
        for at, wanted in rows.sort_values([name, row])[name].items():
            base, dot, tail = wanted.rpartition(".")
            base, tail = (base, dot + tail) if dot else (wanted, "")
            free, k = wanted, tried.get(wanted.lower(), 1)
            while free.lower() in taken:
                free, k = f"{base}-{k}{tail}", k + 1
            tried[wanted.lower()] = k
            taken.add(free.lower())
            made[at] = free
        return pd.DataFrame({row: rows[row], "unique_name": pd.Series(made)})

    numbered = files.withColumn(row, F.monotonically_increasing_id()).withColumn(group, root)
    named = numbered.filter(F.col(name).isNotNull()).select(row, folder, name, F.to_json(group).alias(group)).groupBy(folder, group).applyInPandas(solve, f"{row} long, unique_name string")
    return numbered.drop(group).join(named, row, "left").drop(row)


def recipients(address: Column) -> Column:
    """The valid mail addresses of a list parted by commas or semicolons."""
    return F.array_distinct(F.filter(F.transform(F.split(address, "[,;]"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")))


def valid_key(key: Column) -> Column:
    """Whether a store's key has 1 to 512 characters, is relative, and has no control characters and no ``..`` part."""
    return F.coalesce((F.length(key).between(1, 512)) & ~key.rlike(r"[\x00-\x1f\\]") & ~key.startswith("/") & ~F.exists(F.split(key, "/"), lambda p: p.isin("", ".", "..")), F.lit(False))


def signed(payloads: DataFrame, secret: str, body: str = "body", stamp: str = "timestamp") -> DataFrame:
    """``payloads`` with ``signature``: the HMAC-SHA-256 of ``<timestamp>.<body>``, which Spark has no function for."""

    def sign(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda x: "sha256=" + hmac.new(secret.encode(), x.encode(), hashlib.sha256).hexdigest())

    return payloads.withColumn("signature", F.pandas_udf(sign, "string")(F.concat_ws(".", F.col(stamp).cast("string"), body)))


def html(blocks: DataFrame, key: str, title: str) -> DataFrame:
    """(key, ``document``): a page with a paragraph for each block (``block, speaker, text``), escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("<p><strong>"), safe(F.col("speaker")), F.lit("</strong> "), safe(F.col("text")), F.lit("</p>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", line.alias("l")))), lambda x: x.l), "\n")
    head = F.concat(F.lit('<!doctype html>\n<html><head><meta charset="utf-8"><title>'), safe(F.first(title)), F.lit("</title></head><body>\n"))
    return blocks.groupBy(key).agg(F.concat(head, body, F.lit("\n</body></html>\n")).alias("document"))


def plain_of_html(markup: Column) -> Column:
    """The text of a page without its tags."""
    bare = F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " ")
    plain = F.replace(F.replace(F.replace(bare, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))
