"""Line deduplication by an exact set-similarity join of lines, in DataFrame operations alone.

Token sets of n and m members with a Jaccard similarity of t or more differ in at most ``k = (n + m) (1 - t) / (1 + t)`` tokens. So if their
tokens are dealt by hash to more than k parts, one part at least is equal in both: lines meet where a whole part of some five to
ten tokens is the same, and sizes and token sets decide. That needs no counts of tokens, and lines that merely share words never meet.

Arrays are exploded with their empty ones (``explode_outer``): the plain form makes Spark test an array's size first, which
computes it twice.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_counted, remove, save

WORDS = 1 << 17  # longs of the bitmap that says which lines are asked for
SMALL = 1  # a part of so many tokens or fewer says too little to be a key by itself

ODD_SPACE = "\t\r\f\v"


def tokens(line: Column) -> Column:
    """Lower-cased runs of characters other than space, tab, carriage return, form feed and vertical tab.

    Only lines that hold a white-space character other than the space pay for its replacement, and only lines with a space that parts no
    two tokens for the removal of empty strings.
    """
    odd = reduce(or_, [F.contains(line, F.lit(c)) for c in ODD_SPACE])
    plain = reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(" ")), ODD_SPACE, line)
    loose = odd | F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | (line == "")
    return F.when(loose, F.array_remove(F.split(F.lower(F.when(odd, plain).otherwise(line)), " "), "")).otherwise(F.split(F.lower(line), " "))


def spaced(line: Column) -> Column:
    """Whether a line has a token."""
    return F.ltrim(line, F.lit(" " + ODD_SPACE)) != ""


def token_set(line: Column) -> Column:
    """The distinct tokens of a line, as 64-bit hashes."""
    return F.array_distinct(F.transform(tokens(line), lambda w: F.xxhash64(w)))


def row_names(id_col: str, text_col: str) -> list[Column]:
    """128 bits that name a row by its id and text."""
    return [F.xxhash64(id_col, text_col), F.xxhash64(F.lit("row"), id_col, text_col)]


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id``, ``doc``, ``doc2``, ``no``, ``line``, ``h``, ``g``): every line with a token; (doc, doc2) names the row, (h, g) the line."""
    doc, doc2 = row_names(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), doc.alias("doc"), doc2.alias("doc2"), F.posexplode_outer(F.split(F.col(text_col), "\n")).alias("no", "line"))
    return rows.filter(spaced(F.col("line"))).withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit("line"), F.col("line")))


def part_keys(rows: DataFrame, t: float) -> DataFrame:
    """``rows`` with ``n``, the number of the line's distinct tokens, and ``keys``, of which two lines of similarity ``t`` share one at least.

    A set of m tokens is dealt to K parts by the first bits of their hashes, where K is the least power of 2 over ``2 m (1 - t) / (1 + t)``, the
    most tokens in which it differs from one that is no larger. A line has the keys of its own K and, if a larger partner may have the next,
    of that as well. Parts of ``SMALL`` tokens or fewer, which many lines share, are no keys: of K parts at least ``K - k`` are equal, so a line with
    at most ``K - k - 1`` small ones has another that is. One with more has keys for each small part together with each of K parts,
    by the last bits, of all its other tokens: if the small part is equal, the others differ in k tokens, so one of those is equal too.
    """
    most = lambda m: F.floor(m * (2 * (1 - t) / (1 + t)) + 1e-9)
    level = lambda k: F.when(k > 0, F.length(F.bin(k))).otherwise(0)
    rows = rows.withColumn("set", F.sort_array(token_set(F.col("line"))))
    rows = rows.withColumn("n", F.size("set")).withColumns({"b0": level(most(F.col("n"))), "b1": level(most(F.floor(F.col("n") / t + 1e-9)))})
    shift = lambda x, n: F.call_function("shiftleft", x.cast("long"), n)
    for b in ("b0", "b1"):
        level_of = F.col(b)
        used = level_of > 0 if b == "b0" else level_of > F.col("b0")
        half = shift(F.lit(1), level_of - 1).cast("int")
        places = F.transform(F.sequence(-half, half - 1), lambda p: F.coalesce(shift(p, 64 - F.col(b)), F.lit(0).cast("long")))  # noqa: B023
        # the first hash that each part can hold is put before its tokens, and names it
        rows = rows.withColumn("places", F.when(used, places)).withColumn("all", F.sort_array(F.concat("set", "places")))
        # looking for each place is the faster of the two as long as they are few
        low = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), level_of)
        many = F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: F.element_at("all", i).bitwiseAND(low) == 0)  # noqa: B023
        rows = rows.withColumn("at", F.when(level_of <= 5, F.transform("places", lambda p: F.array_position(F.col("all"), p).cast("int"))).otherwise(many))
        ends = lambda i, j: F.coalesce(F.get("at", j + 1), F.size("all") + 1) - i
        plain = F.transform("at", lambda i, j: F.when(ends(i, j) > SMALL + 1, F.xxhash64(F.col(b), F.slice("all", i, ends(i, j)))))  # noqa: B023
        rows = rows.withColumn("plain", F.array_compact(plain))
        parts = F.transform("at", lambda i, j: F.slice("all", i, ends(i, j)))
        n_parts = F.size("at")
        others = lambda x, q: F.filter("set", lambda h: ~F.array_contains(x, h) & (F.pmod(h, n_parts.cast("long")) == q))  # noqa: B023, E731
        small = F.filter(parts, lambda x: F.size(x) <= SMALL + 1)
        both = F.flatten(F.transform(small, lambda x: F.transform(F.sequence(F.lit(0), n_parts - 1), lambda q: F.xxhash64(F.lit("two"), F.col(b), x, q, others(x, q)))))  # noqa: B023
        # a partner of any size allowed differs in at most n (1 - t) / t tokens
        spare = n_parts - 1 - F.floor(F.col("n") * ((1 - t) / t) + 1e-9)
        none = F.array().cast("array<long>")
        keys = F.when(used, F.when(n_parts - F.size("plain") > F.greatest(spare, F.lit(0)), F.concat("plain", both)).otherwise(F.col("plain")))
        rows = rows.withColumn("keys_" + b, F.coalesce(keys, none)).drop("places", "all", "at", "plain")
    whole = F.when(F.col("b0") == 0, F.array(F.xxhash64(F.lit("whole"), "set"))).otherwise(F.array().cast("array<long>"))
    return rows.withColumn("keys", F.concat(whole, "keys_b0", "keys_b1")).drop("set", "b0", "b1", "keys_b0", "keys_b1")


def marked(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (with ``h``) that may be among ``names`` (``h``): a bitmap of ``64 * WORDS`` bits, whatever their number, keeps most others out of the next shuffle."""
    place = F.pmod(F.col("h"), F.lit(64 * WORDS))
    bit = place.bitwiseAND(F.lit(63).cast("long")).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    held = names.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    every = names.sparkSession.range(WORDS).join(held, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    row = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x.bits).alias("_marks"))
    hit = F.call_function("shiftright", F.get("_marks", F.shiftright(place, 6).cast("int")), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return rows.join(F.broadcast(row), hit).drop("_marks")


def similar_lines(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """(``h, g, id, no, doc, doc2, copies, later``): every distinct line with tokens, its first place, how many there are, and whether it
    matches an earlier one.

    Lines that share a key are first joined with the earliest of them alone; lines that match it are settled. All lines that are not settled
    are then joined with all lines. So a line that has thousands of variants is compared with as many, and no match is lost: a line is later
    if any earlier line matches, settled or not.
    """
    spark = docs.sparkSession
    keyed = part_keys(lines_of(docs, id_col, text_col), threshold)
    firsts = keyed.select("h", "g", F.struct("id", "no", "doc", "doc2").alias("at"), F.struct("n", "keys").alias("what")).groupBy("h", "g").agg(F.min("at").alias("at"), F.count("*").alias("copies"), F.any_value("what").alias("what"))
    lines, lines_path = save(firsts.select("h", "g", "at.*", "copies", "what.*"), "lines")
    shared = lines.select(F.explode_outer("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    posted = lines.select(F.struct("id", "no", "h", "g").alias("at"), "n", F.explode_outer("keys").alias("key"))
    met, met_path = save(posted.join(shared, "key"), "met")
    sets, sets_path = token_sets(docs, met.select("at.h", "at.g").distinct(), id_col, text_col)
    members, members_path = save(met.join(sets.select("h", "g", "marks"), (F.col("at.h") == F.col("h")) & (F.col("at.g") == F.col("g"))).select("key", "c", "at", "n", "marks"), "members")
    n, m = F.col("n"), F.col("e_n")
    apart = n + m - 2 * F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)
    fits = (F.col("e_at") < F.col("at")) & (n >= F.ceil(m * threshold - 1e-9)) & (m >= F.ceil(n * threshold - 1e-9)) & (F.bit_count(F.col("marks").bitwiseXOR(F.col("e_marks"))) <= apart)

    def later(late: DataFrame, early: DataFrame) -> tuple[DataFrame, str]:
        """(``h``, ``g``) of the lines of ``late`` that match an earlier one of ``early`` with which they share a key."""
        early = early.select("key", *[F.col(c).alias("e_" + c) for c in ("at", "n", "marks")])
        pairs = late.join(early, "key").filter(fits).select("at.h", "at.g", F.col("e_at.h").alias("e_h"), F.col("e_at.g").alias("e_g")).distinct()
        both = pairs.join(sets.select("h", "g", "a"), ["h", "g"]).join(sets.select(F.col("h").alias("e_h"), F.col("g").alias("e_g"), F.col("a").alias("b")), ["e_h", "e_g"])
        common = F.size(F.array_intersect("a", "b"))
        return save(both.filter(common >= F.lit(threshold) * (F.size("a") + F.size("b") - common) - 1e-9).select("h", "g").distinct(), "later")

    settled, settled_path = later(members, members.groupBy("key").agg(F.min(F.struct("at", "n", "marks")).alias("x")).select("key", "x.*"))
    several = members.filter("c > 2")
    rest, rest_path = later(several.join(settled, (F.col("at.h") == settled.h) & (F.col("at.g") == settled.g), "left_anti"), several)
    remove(spark, met_path, members_path, sets_path)
    late = settled.unionByName(rest).distinct().withColumn("later", F.lit(True))
    out = lines.drop("n", "keys").join(late, ["h", "g"], "left").withColumn("later", F.coalesce("later", F.lit(False)))
    return out, [lines_path, settled_path, rest_path]


def token_sets(docs: DataFrame, names: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(``h, g, a, marks``): the token sets of the lines that ``names`` (``h, g``) has, read from the texts again.

    ``marks`` are 64 bits that say whether an odd number of tokens fall on them: two lines differ in at most as many as their sets.
    """
    found = marked(lines_of(docs, id_col, text_col).select("h", "g", "line"), names).groupBy("h", "g").agg(F.any_value("line").alias("line"))
    held = found.join(names, ["h", "g"], "left_semi").select("h", "g", token_set(F.col("line")).alias("a"))
    marks = F.aggregate("a", F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))))
    return save(held.withColumn("marks", marks), "sets")


def removed_lines(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc``, ``doc2``, ``removed``): for each document that loses lines, their numbers from 0, ascending.

    Lines are ordered by document id (null first) and number. A line goes if the same line, or one with a Jaccard similarity of
    ``threshold`` or more between their token sets, comes earlier anywhere; lines without tokens stay. Rows with the same id and
    text count as one document, so that none of them loses a line to the others; (``doc``, ``doc2``) is a hash of both. Rows with one
    id and unlike texts are ordered by that hash. A null text has no lines; an empty table gives an empty one; very long texts
    and lines are compared whole. Lines that many rows hold are not gathered: see ``join_counted``.
    """
    found, paths = similar_lines(docs, threshold, id_col, text_col)
    gone_or_not, path = save(found.filter(F.col("later") | (F.col("copies") > 1)).select("h", "g", F.struct("id", "no", "doc", "doc2").alias("first"), "later", "copies"), "repeated")
    remove(docs.sparkSession, *paths)
    every, _ = save(marked(lines_of(docs, id_col, text_col).select("h", "g", F.struct("id", "no", "doc", "doc2").alias("at")), gone_or_not), "places")
    gone = join_counted(every, gone_or_not, ["h", "g"], F.col("copies")).filter(F.col("later") | (F.col("at") != F.col("first")))
    return gone.groupBy("at.doc", "at.doc2").agg(F.sort_array(F.collect_set("at.no")).alias("removed"))


def line_report(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_lines, n_removed, removed`` (numbers of removed lines, comma-joined) of every row, as ``removed_lines`` has them.

    A null text has no lines; repeated rows each give the same row; a null id is kept.
    """
    doc, doc2 = row_names(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), doc.alias("doc"), doc2.alias("doc2"), F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = rows.join(removed_lines(docs, threshold, id_col, text_col), ["doc", "doc2"], "left")
    return out.select(F.col("id").alias(id_col), F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.greatest(F.coalesce(F.size("removed"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


def dedup_lines(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with later lines, as ``removed_lines`` has them, taken out of ``text_col``.

    A null text stays null; a text all of whose lines go becomes empty; an empty table gives an empty one; columns may have any names.
    """
    a, b, r = (fresh(docs, x) for x in ("_doc", "_doc2", "_removed"))
    gone = removed_lines(docs, threshold, id_col, text_col).withColumnsRenamed({"doc": a, "doc2": b, "removed": r})
    doc, doc2 = row_names(id_col, text_col)
    rows = docs.withColumns({a: doc, b: doc2}).join(gone, [a, b], "left")
    lines = F.split(F.col(text_col), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(r))
    text = F.when(F.col(r).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return rows.withColumn(text_col, text).select(docs.columns)
