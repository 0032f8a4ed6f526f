"""Meeting inputs derived from the driver's tables, in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as timed utterances: 400 ms a word, a pause of 500 ms times (turn mod 4) after each."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), "text", word_count(F.col("text")).alias("n_words")
    )
    earlier = Window.partitionBy("meeting_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(400 * F.col("n_words") + 500 * (F.col("idx") % 4)).over(earlier), F.lit(0))
    return rows.withColumn("start_ms", start.cast("long")).withColumn("end_ms", F.col("start_ms") + 400 * F.col("n_words"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second opinion on who spoke: shifted by 150 ms times (turn mod 3), every fifth turn with the other label."""
    other = F.when(F.col("speaker") == "user", "assistant").when(F.col("speaker") == "assistant", "user").otherwise(F.col("speaker"))
    shift = 150 * (F.col("idx") % 3)
    return utterances(spark, sf_dir).select(
        "meeting_id", F.col("idx").alias("pos"), (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"),
        F.when(F.col("idx") % 5 == 4, other).otherwise(F.col("speaker")).alias("label"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who a live roster showed as speaking: 1.5 s late, names in capitals."""
    return utterances(spark, sf_dir).select("meeting_id", (F.col("start_ms") + 1500).alias("start_ms"), (F.col("end_ms") + 1500).alias("end_ms"), F.upper("speaker").alias("name"))


#: The same inputs as DuckDB common table expressions.
UTTERANCES_SQL = r"""
utt_words AS (
  SELECT conv_id AS meeting_id, turn AS idx, role AS speaker, text,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words
  FROM conversations),
utterances AS (
  SELECT *, start_ms + 400 * n_words AS end_ms FROM (
    SELECT *, CAST(coalesce(sum(400 * n_words + 500 * (idx % 4)) OVER (PARTITION BY meeting_id ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM utt_words))"""
TURNS_SQL = (
    UTTERANCES_SQL
    + """,
turns AS (
  SELECT meeting_id, idx AS pos, start_ms + 150 * (idx % 3) AS start_ms, end_ms + 150 * (idx % 3) AS end_ms,
         CASE WHEN idx % 5 = 4 THEN CASE speaker WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE speaker END ELSE speaker END AS label
  FROM utterances)"""
)
