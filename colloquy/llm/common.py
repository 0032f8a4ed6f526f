"""Helpers shared by the corpus operators: scratch tables in the shared folder, joins with frequent keys, fresh names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: scratch tables that are still there, by application
_saved: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only on a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="colloquy-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that run inside."""
    kept = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, kept) if kept is not None else spark.conf.unset(key)


def save(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet below the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    # nothing reads the shuffles of a written table again, so their files can go at once
    with setting(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    _saved.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    left = _saved.get(spark.sparkContext.applicationId, [])
    left[:] = [p for p in left if p not in paths]


def scratch_tables(spark: SparkSession) -> tuple[str, ...]:
    """Paths of the scratch tables of this application that are still there."""
    return tuple(_saved.get(spark.sparkContext.applicationId, []))


def sweep(spark: SparkSession, *keep: str) -> None:
    """Delete the scratch tables of this application but ``keep``: for callers that have written the results which read them."""
    remove(spark, *[p for p in _saved.get(spark.sparkContext.applicationId, []) if p not in keep])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it, so that ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_counted(rows: DataFrame, named: DataFrame, on: list[str], count: Column, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``named``, which has a row for each key and says in ``count`` how many rows hold the key.

    Keys that more than 1 of ``share`` rows hold are at most ``share``, so those are broadcast and their rows stay where they are; the
    others are joined by a shuffle in which no key is large.
    """
    total = named.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    often = F.broadcast(named.filter(count * share > total))
    seldom = named.filter(~(count * share > total))
    return rows.join(often, on).unionByName(rows.join(often.select(*on), on, "left_anti").join(seldom, on))


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
