"""Fill-in-the-middle training texts: cut at line ends, reordered behind sentinels, and the way back.

The work on texts is DuckDB SQL inside ``mapInArrow``: each run of a few megabytes of a batch is registered as a table and the
result comes back as Arrow. No row passes through Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .encoding import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: The cut and the order of the parts, from a table ``batch`` (``name``, ``text``).
CUT = r"""
WITH units AS (
  SELECT coalesce(text, '') AS whole, sha256('{seed}:' || coalesce(name, '')) AS draw, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines FROM batch),
drawn AS (
  SELECT whole, lines, len(lines) AS n, CAST('0x' || draw[1:8] AS UBIGINT) AS h1, CAST('0x' || draw[9:16] AS UBIGINT) AS h2,
    CAST('0x' || draw[17:24] AS UBIGINT) AS h3, CAST('0x' || draw[25:32] AS UBIGINT) AS h4 FROM units),
cut AS (
  SELECT whole, lines, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN whole = '' OR contains(whole, '{P}') OR contains(whole, '{S}') OR contains(whole, '{M}') OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT whole, n, form, array_to_string(list_slice(lines, 1, a), '') AS p, array_to_string(list_slice(lines, a + 1, b), '') AS m, array_to_string(list_slice(lines, b + 1, n), '') AS s FROM cut),
made AS (
  SELECT CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    CASE form WHEN 'plain' THEN whole WHEN 'psm' THEN concat('{P}', p, '{S}', s, '{M}', m) ELSE concat('{S}', s, '{P}', p, '{M}', m) END AS output FROM parts)"""

#: The text that an output was made from, by its form alone. Sentinels begin with "<" and end with ">", so none arises where two parts meet.
RESTORED = """CASE form WHEN 'psm' THEN concat(split_part(split_part(output, '{S}', 1), '{P}', 2), split_part(output, '{M}', 2), split_part(split_part(output, '{S}', 2), '{M}', 1))
  WHEN 'spm' THEN concat(split_part(split_part(output, '{P}', 2), '{M}', 1), split_part(output, '{M}', 2), split_part(split_part(output, '{P}', 1), '{S}', 2)) ELSE output END"""

_SENTINELS = {"P": PREFIX, "S": SUFFIX, "M": MIDDLE}


def _connection():
    """One in-memory database for each worker process, on one thread, as Spark runs a task for each core."""
    import duckdb

    if not hasattr(_connection, "held"):
        _connection.held = duckdb.connect(":memory:", config={"threads": 1, "preserve_insertion_order": True})
    return _connection.held


def in_duckdb(sql: str, by: str, reads: dict[str, str], adds: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow``: each batch with the columns of ``sql`` appended, one row for each of ``batch``, in order.

    ``batch`` has the columns that ``reads`` names (its own name to the batch's). A batch is taken in runs of about 4 MB of the column ``by``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for batch in batches:
            at = 0
            for part in slices(batch.column(by)):
                rows = batch.slice(at, len(part))
                at += len(part)
                con.register("batch", pa.table({k: rows.column(v) for k, v in reads.items()}))
                made = con.sql(sql).to_arrow_table().combine_chunks()
                con.unregister("batch")
                yield pa.RecordBatch.from_arrays([*rows.columns, *[made.column(k).chunk(0) for k in range(len(adds))]], names=[*batch.schema.names, *adds])

    return run


def _apply(docs: DataFrame, sql: str, reads: dict[str, str], by: str, types: dict[str, str]) -> DataFrame:
    names = dict.fromkeys(types)
    for k in types:
        names[k] = fresh(docs, k)
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{names[k]}` {t}" for k, t in types.items()])
    return docs.mapInArrow(in_duckdb(sql, by, reads, list(names.values())), schema)


def _named(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    name = fresh(docs, "_name")
    return docs.withColumn(name, F.col(id_col).cast("string")), name


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``docs`` with ``n`` (lines), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    ``rate`` of 100 texts are reordered, ``spm`` of 100 of those with the suffix first. The draw depends on ``seed`` and the id alone, so rows with
    equal ids are cut alike and a lost task makes the same rows again. A null text counts as empty, a null id as an empty name; empty
    texts and texts that hold a sentinel stay plain; texts are taken whole, however long; an empty table gives an empty one.
    A result whose name ``docs`` has already gets underscores before it.
    """
    rows, name = _named(docs, id_col)
    sql = CUT.format(seed=int(seed), rate=int(rate), spm=int(spm), **_SENTINELS) + " SELECT n, form, prefix_chars, middle_chars, output FROM made"
    types = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}
    return _apply(rows, sql, {"name": name, "text": text_col}, text_col, types).drop(name)


def restore(made: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``made`` with ``restored``, the text before reordering, from ``output_col`` and ``form_col`` alone. A null output stays null; an unknown form is plain."""
    sql = f"SELECT {RESTORED.format(**_SENTINELS)} AS restored FROM batch"
    return _apply(made, sql, {"output": output_col, "form": form_col}, output_col, {"restored": "string"})


def fill_in_middle_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``id_col``, the numbers of ``fill_in_middle`` and SHA-256 of its output and of the text restored from it, without sending texts back to Spark."""
    rows, name = _named(docs.select(id_col, text_col), id_col)
    sql = CUT.format(seed=int(seed), rate=int(rate), spm=int(spm), **_SENTINELS)
    sql += f" SELECT n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({RESTORED.format(**_SENTINELS)}) AS restored_sha256 FROM made"
    adds = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    types = ["bigint", "string", "bigint", "bigint", "string", "string"]
    run = in_duckdb(sql, text_col, {"name": name, "text": text_col}, adds)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.select([id_col, *adds]) for b in run(batches))

    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(digests, ", ".join([f"`{id_col}` {id_type}", *[f"{a} {t}" for a, t in zip(adds, types, strict=True)]]))
