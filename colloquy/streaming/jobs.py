"""Records of meeting jobs as a table to which states are appended: the latest of each job, and what a restart takes up again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States of a job, before and after the recording is there, and the least bytes of a recording.
CAPTURING = "pending joining capturing".split()
PROCESSING = "transcribing summarizing delivering".split()
LEAST_BYTES = 1024
ABANDONED = "the worker stopped during the meeting and left no recording"
RECORD = "identifier string, state string, created_at timestamp, updated_at timestamp, error string, join_url string, audio_path string, title string, language string, vocabulary array<string>, artifacts array<string>"


def append_records(records: DataFrame, path: str) -> None:
    """Add records as lines of JSON; Spark's committer shows a task's file whole or not at all."""
    records.write.mode("append").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a folder of JSON lines; lines that are no JSON, or lack an identifier or a state, are left out."""
    rows = spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path)
    return rows.filter("identifier is not null and state is not null")


def latest_records(records: DataFrame) -> DataFrame:
    """One record for each ``identifier``: the one updated last, on a tie that of the greater state; combined before the shuffle."""
    others = [c for c in records.columns if c != "identifier"]
    when = F.coalesce("updated_at", "created_at")
    last = records.groupBy("identifier").agg(F.max_by(F.struct(*others), F.struct(when, "state")).alias("_r"))
    return last.select("identifier", "_r.*").select(records.columns)


def recovered(jobs: DataFrame, recordings: DataFrame, at: str = "current_timestamp()") -> DataFrame:
    """The jobs that were under way (latest records), with ``outcome``, ``resumed`` or ``abandoned``, and what becomes of them, updated ``at`` (an SQL expression).

    A job without a meeting to join starts again. One that joined a meeting goes on with its recording (``identifier, path, bytes``; of several the largest over ``LEAST_BYTES``) instead of joining; without one
    it starts again if it had not joined yet, and fails if it had, as the meeting has moved on.
    """
    active = jobs.filter(F.col("state").isin(CAPTURING + PROCESSING))
    best = recordings.filter(F.col("bytes") > LEAST_BYTES).groupBy("identifier").agg(F.max_by("path", F.struct("bytes", "path")).alias("_kept"))
    joined = active.join(best, "identifier", "left")
    by_file = F.col("join_url").isNotNull() & F.col("_kept").isNotNull()
    again = F.col("join_url").isNull() | by_file | (F.col("state") == "pending")
    new = {
        "outcome": F.when(again, "resumed").otherwise("abandoned"), "state": F.when(again, "pending").otherwise("failed"), "error": F.when(~again, ABANDONED), "updated_at": F.expr(at).cast("timestamp"),
        "audio_path": F.when(by_file, F.col("_kept")).otherwise(F.col("audio_path")), "join_url": F.when(~by_file, F.col("join_url")),
    }
    return joined.withColumns(new).drop("_kept")
