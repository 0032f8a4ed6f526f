"""The queries of the corpus operators, each over its whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's. Texts go to Python in batches of 2,000, some megabytes, which bounds the memory of both sides."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"), words=3)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from .common import scratch_root
    from .packed_ids import read_packed, write_packed

    path = f"{scratch_root(spark)}/packed-{uuid.uuid4().hex}"
    write_packed(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return read_packed(spark, path)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import edit_fingerprints

    return edit_fingerprints(table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


#: The chain's categories in order: a label's condition makes each true.
TOXIC_CHAIN = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_chain, score_toxicity

    docs = table(spark, sf_dir, "documents")
    chain = fit_chain(docs, table(spark, sf_dir, "labels"), TOXIC_CHAIN)
    return score_toxicity(docs, chain).withColumn("rejected", F.col("p_toxic") >= 0.5)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cross_align import link_report

    return link_report(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle_digests

    return fill_in_middle_digests(table(spark, sf_dir, "documents"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivot_search import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash_groups": op2_simhash_groups,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_packed_ids": op6_packed_ids,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_order_minhash": op10_order_minhash,
    "op11_token_alignment": op11_token_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_exact_top_k": op13_exact_top_k,
}

#: the contract of op12 reorders all texts (h3 % 100 < 100), so its SQL has no draw for that
SQL: dict[str, str] = {
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM d),
f AS (SELECT line, doc_id, no, row_number() OVER (PARTITION BY line ORDER BY doc_id, no) AS nth FROM l),
u AS (SELECT line, row_number() OVER (ORDER BY doc_id, no) AS id, list_distinct(list_filter(string_split_regex(lower(line), '[\t\r\f\v ]'), lambda w: w <> '')) AS t FROM f WHERE nth = 1),
e AS (SELECT id, len(t) AS n, unnest(t) AS w FROM u WHERE len(t) > 0),
c AS (SELECT w, count(*) AS df FROM e GROUP BY w),
r AS (SELECT e.id, n, w, row_number() OVER (PARTITION BY e.id ORDER BY df, w) AS k FROM e JOIN c USING (w)),
p AS (SELECT id, n, w FROM r WHERE k <= n - ceil(0.9 * n - 1e-9) + 1),
q AS (SELECT DISTINCT a.id, b.id AS early FROM p a JOIN p b ON a.w = b.w AND b.id < a.id AND a.n >= 0.9 * b.n - 1e-9 AND b.n >= 0.9 * a.n - 1e-9),
v AS (SELECT DISTINCT q.id FROM q JOIN u a ON a.id = q.id JOIN u b ON b.id = q.early WHERE len(list_intersect(a.t, b.t)) >= 0.9 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) - 1e-9),
g AS (SELECT f.doc_id, f.no FROM f JOIN u USING (line) LEFT JOIN v ON v.id = u.id WHERE len(u.t) > 0 AND (f.nth > 1 OR v.id IS NOT NULL)),
x AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS removed FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM d LEFT JOIN x USING (doc_id)""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS c, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, list_filter(list_transform(range(1, len(c) + 1), lambda i: c[i] || CASE WHEN i < len(c) THEN chr(10) ELSE '' END), lambda x: x <> '') AS ls FROM d),
p AS (SELECT *, len(ls) AS k, list_sort([CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(ls) + 1), CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(ls) + 1)]) AS ab, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS o FROM u),
q AS (SELECT *, CAST(coalesce(list_sum(list_transform(ls[:ab[1]], lambda x: length(x))), 0) AS BIGINT) AS np, CAST(coalesce(list_sum(list_transform(ls[:ab[2]], lambda x: length(x))), 0) AS BIGINT) AS nm, t = '' OR regexp_matches(t, '<[PSM]>') AS whole FROM p)
SELECT doc_id, CAST(k AS BIGINT) AS n, CASE WHEN whole THEN 'plain' WHEN o < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT whole THEN np END AS prefix_chars, CASE WHEN NOT whole THEN nm - np END AS middle_chars,
  sha256(CASE WHEN whole THEN t WHEN o < 50 THEN '<S>' || substr(t, nm + 1) || '<P>' || substr(t, 1, np) || '<M>' || substr(t, np + 1, nm - np)
    ELSE '<P>' || substr(t, 1, np) || '<S>' || substr(t, nm + 1) || '<M>' || substr(t, np + 1, nm - np) END) AS output_sha256, sha256(t) AS restored_sha256
FROM q""",
    "op13_exact_top_k": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
