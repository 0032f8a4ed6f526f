"""A folder in which transcripts arrive, each with an optional JSON sidecar of options, read as a stream of files into tables of requests and utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.formats import cues

#: Endings of recordings.
RECORDINGS = "wav flac ogg opus mp3 m4a mp4 mkv webm aac wma".split()
TRANSCRIPTS = ["vtt", "srt"]
COMPLETED, FAILED, PENDING = "completed", "failed", "pending"
OPTIONS = "title string, language string, speakers string, vocabulary string"


def endings(names: list[str]) -> str:
    """A pattern for files with one of these endings, in small letters or capitals."""
    return "*.{" + ",".join([*names, *(n.upper() for n in names)]) + "}"


def stem(path: Column) -> Column:
    """The path without the ending of its file."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def read_sidecars(spark: SparkSession, inbox: str) -> DataFrame:
    """(``stem, sidecar``) of the JSON files of a folder."""
    files = spark.read.option("pathGlobFilter", "*.json").text(inbox, wholetext=True)
    return files.select(stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("sidecar"))


def with_options(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``files`` (``path``, any columns) as requests: ``identifier, title, language, vocabulary, speakers, note``.

    The title is the sidecar's or the file's name without ending; the vocabulary a list or empty; the number of speakers one of digits alone, as number or text. What is not JSON is
    noted and counts as no sidecar, as does JSON that is no object.
    """
    joined = files.withColumn("stem", stem(F.col("path"))).join(sidecars, "stem", "left")
    text = F.trim("sidecar")
    valid = F.call_function("try_parse_json", text).isNotNull()
    o = F.when(valid & F.startswith(text, F.lit("{")), F.from_json("sidecar", OPTIONS))
    filled = lambda c: F.when(c != "", c)
    name = F.regexp_extract("stem", r"([^/]*)$", 1)
    listed = F.when(F.startswith(o.vocabulary, F.lit("[")), F.from_json(o.vocabulary, "array<string>"))
    return joined.select(
        *files.columns, F.left(F.sha2("path", 256), F.lit(32)).alias("identifier"), F.coalesce(filled(o.title), F.call_function("url_decode", F.replace(name, F.lit("+"), F.lit("%2B")))).alias("title"),
        filled(o.language).alias("language"), F.coalesce(F.filter(listed, lambda v: v.isNotNull()), F.array().cast("array<string>")).alias("vocabulary"),
        F.when(o.speakers.rlike("^[0-9]{1,9}$"), o.speakers.cast("int")).alias("speakers"), F.when(F.col("sidecar").isNotNull() & ~valid, "malformed sidecar").alias("note"),
    )


def pending_recordings(spark: SparkSession, inbox: str) -> DataFrame:
    """The recordings of a folder as requests, in order of their paths, with ``bytes``; their content is not read.

    Files without a byte are not seen here or in ``watch_inbox``: Spark's readers pass over them, as over uploads that have only begun.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", endings(RECORDINGS)).load(inbox)
    return with_options(found.select("path", F.col("length").alias("bytes")), read_sidecars(spark, inbox)).withColumn("state", F.lit(PENDING)).orderBy("path")


def processed(files: DataFrame, sidecars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their ``state``, ``n_utterances`` and ``error``, and the utterances of those that have any, from ``files`` (``path, value``)."""
    asked = with_options(files.select("path"), sidecars)
    spoken = cues(files, "path")
    counts = spoken.groupBy("path").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    requests = asked.join(counts, "path", "left").withColumns({"n_utterances": n, "state": F.when(n > 0, COMPLETED).otherwise(FAILED), "error": F.when(n == 0, "no timed text")}).drop("n")
    utterances = spoken.join(asked.select("path", "identifier", "language"), "path").drop("path")
    return requests, utterances


def watch_inbox(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """A query that brings new transcripts of ``inbox`` into ``outbox/requests`` and ``outbox/utterances``; with no ``interval`` it ends once all are in.

    Each file is taken once, with the sidecar that is there by then. A micro-batch writes its own folder of either table whole, so one that is run again after a lost driver leaves the same rows.
    ``checkpoint`` is a folder that all executors share.
    """
    files = spark.readStream.option("pathGlobFilter", endings(TRANSCRIPTS)).format("text").option("wholetext", "true").load(inbox)
    named = files.select(F.col("_metadata.file_path").alias("path"), "value")

    def write(batch: DataFrame, number: int) -> None:
        requests, utterances = processed(batch, read_sidecars(batch.sparkSession, inbox))
        utterances.write.mode("overwrite").parquet(f"{outbox}/utterances/batch={number}")
        requests.write.mode("overwrite").parquet(f"{outbox}/requests/batch={number}")

    stream = named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=interval) if interval else stream.trigger(availableNow=True)).start()
