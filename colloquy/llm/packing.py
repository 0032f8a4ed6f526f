"""Packing token sequences into as few fixed-size ones as can be, by linear grouping and best fit.

The plan works on counts of lengths, of which there are at most as many as a sequence has tokens, so its size does not
depend on the corpus. Large lengths are rounded up within groups of equal cardinality, a linear program over
patterns of the few rounded sizes says how often each pattern is used, actual documents take the places of the
rounded sizes, and what is left, with all small lengths, goes by best fit, longest first, where least room is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, save, shuffle_parts
from .encoding import IdCoder, coder


@dataclass
class Run:
    """``bins`` sequences with the same content: (length, how many of it) in order; ``room`` tokens are free in each."""

    bins: int
    room: int
    content: list[tuple[int, int]] = field(default_factory=list)


def groups_of(counts: dict[int, int], most: int) -> list[list[int]]:
    """Lengths, longest first, in at most ``most`` groups of about equally many items; a group keeps a length whole."""
    lengths = sorted(counts, reverse=True)
    if len(lengths) <= most:
        return [[n] for n in lengths]
    out, left = [], sum(counts.values())
    group, held = [], 0
    for i, n in enumerate(lengths):
        group.append(n)
        held += counts[n]
        rest = most - len(out)
        if held * rest >= left or len(lengths) - i - 1 < rest:
            out.append(group)
            left -= held
            group, held = [], 0
    return out + [group] * bool(group)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most worth that fits, by dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    small, gain = sizes[order], worth[order]
    upto = np.searchsorted(small, np.arange(capacity + 1), side="right")
    for c in range(int(small[0]), capacity + 1):
        k = upto[c]
        value = best[c - small[:k]] + gain[:k]
        j = int(value.argmax())
        if value[j] > best[c - 1] + 1e-12:
            best[c], pick[c] = value[j], j
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[order[pick[c]]] += 1
            c -= int(small[pick[c]])
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 300, gap: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use them: the linear program's optimum, by column generation.

    Each round adds the pattern that the current prices value most and drops the one it displaces; it ends when
    no pattern is worth more than ``1 + gap`` sequences.
    """
    n = len(sizes)
    basis = np.diag(np.floor(capacity / sizes))
    inverse = np.diag(1 / np.diag(basis))
    use = inverse @ need
    for turn in range(rounds):
        price = inverse.sum(axis=0)
        worth, pattern = best_pattern(sizes, np.maximum(price, 0), capacity)
        if worth <= 1 + gap:
            break
        step = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, use / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        use = use - ratio[out] * step
        use[out] = ratio[out]
        basis[:, out] = pattern
        if turn % 100 == 99:
            inverse = np.linalg.inv(basis)
            use = inverse @ need
        else:
            pivot = inverse[out] / step[out]
            inverse = inverse - np.outer(step, pivot)
            inverse[out] = pivot
    return [(basis[:, i], float(use[i])) for i in range(n) if use[i] > 0]


def plan_runs(counts: dict[int, int], capacity: int, most_groups: int = 64, small_share: float = 0.4) -> list[Run]:
    """Runs that hold every item of ``counts`` (length: how many), each length from 1 to ``capacity``."""
    left = {n: c for n, c in counts.items() if c}
    runs = []
    if capacity in left:
        runs.append(Run(left.pop(capacity), 0, [(capacity, 1)]))
    large = {n: c for n, c in left.items() if n > capacity * small_share}
    groups = groups_of(large, most_groups)
    if groups:
        sizes = np.array([g[0] for g in groups])
        need = np.array([sum(left[n] for n in g) for g in groups], dtype=float)
        stock = [[[n, left[n]] for n in g] for g in groups]
        for pattern, use in sorted(configurations(sizes, need, capacity), key=lambda x: -x[1]):
            takes = [(g, int(m)) for g, m in enumerate(pattern) if m > 0]
            bins = int(use + 1e-6)
            for g, m in takes:
                bins = min(bins, sum(c for _, c in stock[g]) // m)
            while bins > 0:
                # as many sequences as have the same actual lengths; where a length runs out, one with several
                n = min([bins, *(stock[g][0][1] // m for g, m in takes)])
                content, times = [], max(n, 1)
                for g, m in takes:
                    need_now = m * times
                    while need_now:
                        length, c = stock[g][0]
                        took = min(c, need_now)
                        content.append((length, took // times))
                        left[length] -= took
                        need_now -= took
                        stock[g][0][1] -= took
                        if not stock[g][0][1]:
                            stock[g].pop(0)
                runs.append(Run(times, capacity - sum(a * b for a, b in content), content))
                bins -= times
    return best_fit(runs, {n: c for n, c in left.items() if c}, capacity)


def best_fit(runs: list[Run], items: dict[int, int], capacity: int) -> list[Run]:
    """Put ``items`` where least room is left, longest first; open new sequences when none has room."""
    rooms: dict[int, list[Run]] = {}
    order: list[int] = []
    done = []

    def add(r: Run) -> None:
        if r.room == 0:
            done.append(r)
        else:
            if r.room not in rooms or not rooms[r.room]:
                rooms[r.room] = []
                insort(order, r.room)
            rooms[r.room].append(r)

    for r in runs:
        add(r)
    for n in sorted(items, reverse=True):
        c = items[n]
        while c:
            at = bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                full, rest = divmod(c, each)
                if full:
                    add(Run(full, capacity - each * n, [(n, each)]))
                if rest:
                    add(Run(1, capacity - rest * n, [(n, rest)]))
                break
            room = order[at]
            r = rooms[room].pop()
            if not rooms[room]:
                order.pop(at)
            each = room // n
            full = min(r.bins, c // each)
            if full:
                add(Run(full, room - each * n, [*r.content, (n, each)]))
                c -= full * each
            rest = r.bins - full
            if rest and c and c < each:
                add(Run(1, room - c * n, [*r.content, (n, c)]))
                c, rest = 0, rest - 1
            if rest:
                add(Run(rest, room, r.content))
    return done + [r for rs in rooms.values() for r in rs]


def places(runs: list[Run], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, how many a sequence takes, offset of the first, first sequence), by rank."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for r in runs:
        offset = 0
        for n, each in r.content:
            out.setdefault(n, []).append((taken.get(n, 0), each, offset, sequence))
            taken[n] = taken.get(n, 0) + r.bins * each
            offset += n * each
        sequence += r.bins
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(``id, piece, start, length, ids_crc32``): every document's ids and the end id, cut to at most ``capacity``.

    Only a longer document is cut; all its pieces but the first are full. ``with_ids`` adds ``ids`` (array<int>).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, tail = coder(IdCoder, tokenizer), np.array([end_id], dtype="<u4")
        for b in batches:
            where, cols, held = [], ([], [], [], []), []
            for k, ids in enumerate(c.encode_all(b.column(1))):
                ids = np.concatenate((ids, tail))
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for piece, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    where.append(k)
                    for col, v in zip(cols, (piece, s, e - s, zlib.crc32(ids[s:e])), strict=True):
                        col.append(v)
                    if with_ids:
                        held.append(ids[s:e].astype(np.int32))
            arrays = [b.column(0).take(pa.array(where, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(x, pa.int64()) for x in cols[1:])]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(held, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, capacity: int, most_groups: int = 64) -> DataFrame:
    """``pieces`` (any columns, ``id``, ``piece``, ``length`` among them) with ``sequence_id`` and ``offset``, which get underscores before them if ``pieces`` has them.

    Lengths are from 1 to ``capacity``; ids may be null or repeat; no pieces give none.

    Items are ranked within their length, hashed into buckets so that a length that a third of the rows share is spread over
    many tasks; the plan then says where each rank goes. Only the counts of the lengths reach the driver.
    """
    spark = pieces.sparkSession
    rows = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = {r["length"]: r["count"] for r in rows}
    table = spark.sparkContext.broadcast(places(plan_runs(counts, capacity, most_groups), capacity))
    buckets = max(shuffle_parts(spark), sum(counts.values()) // 1_000_000)
    bucket, nth, before, n, sequence_name, offset_name = (fresh(pieces, x) for x in ("bucket", "nth", "before", "n", "sequence_id", "offset"))
    key = ["length", bucket]
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("id", "piece"))
    sizes = dealt.groupBy(*key).agg(F.count("*").alias(n))
    begins = sizes.select(*key, (F.sum(n).over(Window.partitionBy("length").orderBy(bucket)) - F.col(n)).alias(before))
    ranked = dealt.withColumn(nth, rank).join(begins, key).withColumn(nth, F.col(nth) - 1 + F.col(before)).drop(before, bucket)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, turn = np.asarray(b.column("length")), np.asarray(b.column(nth))
            sequence, offset = np.zeros(len(turn), dtype=np.int64), np.zeros(len(turn), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            ends = np.nonzero(np.diff(length[order], append=-1))[0] + 1
            for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                k = order[s:e]
                at = table.value[int(length[k[0]])]
                row = at[np.searchsorted(at[:, 0], turn[k], side="right") - 1]
                past = turn[k] - row[:, 0]
                sequence[k] = row[:, 3] + past // row[:, 1]
                offset[k] = row[:, 2] + past % row[:, 1] * length[k]
            i = b.schema.get_field_index(nth)
            cols, names = [c for j, c in enumerate(b.columns) if j != i], [x for x in b.schema.names if x != nth]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], [*names, sequence_name, offset_name])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != nth)
    return ranked.mapInArrow(place, f"{kinds}, {sequence_name} long, {offset_name} long").select(*[F.col(f"`{c}`") for c in pieces.columns], sequence_name, offset_name)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, most_groups: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text is empty (one piece that holds the end id alone); repeated rows are packed each; a null id is kept;
    an empty table gives an empty one. Sequences have at most ``capacity`` tokens and no gaps from offset 0.
    """
    pieces, _ = save(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    return pack(pieces, capacity, most_groups).withColumnRenamed("id", id_col)


def packed_sequences(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, most_groups: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` (array<int>) and ``docs``, the pieces they hold in order."""
    pieces, _ = save(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids=True), "pieces")
    item = F.struct("offset", "id", "piece", "ids")
    held = pack(pieces, capacity, most_groups).groupBy("sequence_id").agg(F.array_sort(F.collect_list(item)).alias("held"))
    ids = F.flatten(F.transform("held", lambda x: x.ids))
    return held.select("sequence_id", ids.alias("ids"), F.transform("held", lambda x: F.struct(x.id.alias(id_col), x.piece.alias("piece"), x.offset.alias("offset"))).alias("docs"))
