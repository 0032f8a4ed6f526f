"""Secret scan: candidate strings in texts, judged by how many owners of the corpus share each of them."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Kinds of the base rules, in the order that breaks ties at one start.
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Long runs of key-like characters that no base rule names; kept if random-looking and owned by few.
_OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in BASE, end, secret) of the base rules' matches, ordered."""
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def entropy(s: str) -> float:
    """Bits for each character, by the characters' own counts."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def opaque_spans(text: str, taken: list[tuple[int, int, int, str]], least_bits: float) -> list[tuple[int, int, int, str]]:
    """Key-like runs that overlap no base span, hold a digit, a capital and a small letter, and look random."""
    out = []
    for m in _OPAQUE.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and s.lower() != s and s.upper() != s and entropy(s) >= least_bits and not any(a < m.end() and m.start() < e for a, _, e, _ in taken):
            out.append((m.start(), len(BASE), m.end(), s))
    return out


def secret_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", least_bits: float = 3.5) -> DataFrame:
    """One row for each document: ``id``, ``owner``, ``n_assign, n_access, n_hex, base_sha256`` and ``found``.

    ``found`` lists structs (kind, start, end, hash) ordered by start; hash is the secret's SHA-256, so that the
    secrets themselves travel no further than the task that read them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary())])
        kinds = (*BASE, "opaque")
        for b in batches:
            counts, digest, found = ([], [], []), [], []
            for text in b.column(2).to_pylist():
                base = base_spans(text or "")
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digest.append(hashlib.sha256(",".join(f"{BASE[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
                spans = sorted(base + opaque_spans(text or "", base, least_bits))
                found.append([{"kind": kinds[k], "start": s, "end": e, "hash": hashlib.sha256(x.encode()).digest()} for s, k, e, x in spans])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array(found, pa.list_(item))],
                ["id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind string, start int, end int, hash binary>>")


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None,
    example_owners: int = 3, example_repos: int = 5, least_bits: float = 3.5,
) -> DataFrame:
    """Every document's secrets, each with the number of repositories and owners that hold the same one.

    A secret seen with ``example_owners`` owners is a widely copied example, and so is one in ``example_repos``
    repositories of several owners if ``repo_col`` is given; else it belongs to its owner and may be live, however many
    copies there are. ``owner_col`` names the owner; a repository is ``repo_col``, or the document, which is only counted, if
    that is not given. Base matches always stay; a random-looking run that only the ``opaque``
    rule finds is kept where it belongs to its owner, not where many share it.

    Returns ``id_col, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, secrets``; ``secrets`` lists
    structs (kind, start, end, repos, owners, live). A null text is empty (no spans); null owners count as one
    owner, null ids or repositories as one repository; repeated rows each give a row. An empty table gives an
    empty one. The counts need one shuffle of (secret, repository, owner) rows, combined before they are sent; a
    document without secrets takes part in none.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.struct(F.col(owner_col).cast("string").alias("o"), (F.col(repo_col) if repo_col else F.col(id_col)).cast("string").alias("r")).alias("p"))
    packed = rows.select(F.col("i"), F.col("t"), F.to_json("p").alias("p"))
    kept, _ = save(secret_candidates(packed, "i", "t", "p", least_bits).withColumn("row", F.monotonically_increasing_id()), "secrets")
    place = F.from_json("owner", "o string, r string")
    each = kept.filter(F.size("found") > 0).select("row", place.alias("p"), F.explode("found").alias("s"))
    each = each.select("row", F.col("s.hash").alias("hash"), F.struct("s.start", "s.end", "s.kind").alias("at"), F.coalesce(F.col("p.o"), F.lit("\0")).alias("owner"), F.coalesce(F.col("p.r"), F.lit("\0")).alias("repo"))
    # distinct (secret, repository, owner), then distinct (secret, owner) with its repositories: a widely copied
    # secret is combined in the tasks that read it and spread over the second key before it meets in one row
    held = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    salted = held.groupBy("hash", "owner", F.pmod(F.xxhash64("repo"), F.lit(64)).alias("salt")).agg(F.count("*").alias("repos"))
    by_owner = salted.groupBy("hash", "owner").agg(F.sum("repos").alias("repos"))
    spread = by_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))
    copied = (F.col("owners") > 1) & (F.col("repos") >= example_repos) if repo_col else F.lit(False)
    judged = each.join(spread, "hash").withColumn("live", (F.col("owners") < example_owners) & ~copied)
    judged = judged.filter((F.col("at.kind") != "opaque") | F.col("live"))
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("at.start").alias("start"), F.array_position(F.array(*map(F.lit, (*BASE, "opaque"))), F.col("at.kind")).alias("nth"), F.col("at.kind").alias("kind"), F.col("at.end").alias("end"), "repos", "owners", "live"))).alias("secrets"))
    out = kept.select("row", "id", "n_assign", "n_access", "n_hex", "base_sha256").join(per_row, "row", "left")
    secrets = F.coalesce("secrets", F.array().cast("array<struct<start int, nth bigint, kind string, end int, repos bigint, owners bigint, live boolean>>"))
    return out.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256",
        F.concat_ws(",", F.transform(secrets, lambda s: F.concat_ws(":", s.kind, s.start, s.end))).alias("spans"),
        F.size(F.filter(secrets, lambda s: s.live)).cast("long").alias("n_live"),
        F.size(F.filter(secrets, lambda s: ~s.live)).cast("long").alias("n_example"),
        F.transform(secrets, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.repos.alias("repos"), s.owners.alias("owners"), s.live.alias("live"))).alias("secrets"),
    )
