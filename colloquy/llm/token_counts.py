"""Token counts by merging whole batches of words at once, one rank a round."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import BYTE_LEVEL, PieceCoder, byte_letters, coder, slices

NONE = np.iinfo(np.int32).max


class RankMerger:
    """Byte-pair merges over many byte strings held as one flat array and their borders.

    A round finds every string's pair of lowest rank and merges all places of that pair, in all strings
    together. A string leaves when it has no pair with a rank; the symbols it still has are its tokens.
    """

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        self.start = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE, dtype=np.int32)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each word."""
        total = np.array([len(w) for w in words], dtype=np.int64)
        owner = np.nonzero(total > 1)[0]
        if not len(owner):
            return total
        sizes = total[owner]
        symbols = self.start[np.frombuffer(b"".join(words[i] for i in owner), dtype=np.uint8)]
        while len(owner):
            begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            rank = np.full(len(symbols), NONE, dtype=np.int32)
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
            rank[begins + sizes - 1] = NONE  # a pair never spans two words
            least = np.minimum.reduceat(rank, begins)
            live = least != NONE
            hit = (rank == np.repeat(least, sizes)) & (rank != NONE)
            # of a run of overlapping places ("aaa") every other one merges, from the left
            at = np.nonzero(hit)[0]
            run = np.concatenate(([True], np.diff(at) > 1)) if len(at) else np.zeros(0, dtype=bool)
            if len(at):
                first = at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
                at = at[(at - first) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            left = np.add.reduceat(keep.astype(np.int64), begins)
            total[owner] = left
            live &= left > 1
            keep &= np.repeat(live, sizes)
            symbols, owner, sizes = symbols[keep], owner[live], left[live]
        return total


class CountCoder(PieceCoder):
    """The number of tokens of each piece."""

    def __init__(self, path: str, most: int = 400_000) -> None:
        import regex

        super().__init__(most)
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError("only byte-level BPE files without a normalizer are merged here")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merger = RankMerger(spec["model"]["vocab"], spec["model"]["merges"])
        self.pattern = regex.compile(BYTE_LEVEL)
        self.around = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def compute(self, texts: list[str]) -> list[int]:
        found = [self.pattern.findall(t) for t in texts]
        place = {w: i for i, w in enumerate(dict.fromkeys(w for ws in found for w in ws))}
        n = self.merger.counts([w.encode("utf-8") for w in place]).tolist()
        return [sum(n[place[w]] for w in ws) for ws in found]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special):
            plain = self.around.split(text)
            return len(plain) - 1 + sum(sum(self.values(t)) for t in plain if t)
        return sum(self.values(text))

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text, null as empty."""
        out = []
        for part in slices(texts):
            n, fits = np.zeros(len(part), dtype=np.int64), self.plain(part)
            if fits.any():
                values, where, begins = self.spread(part.filter(pa.array(fits)))
                n[fits] = np.add.reduceat(np.array(values, dtype=np.int64)[where], begins)
            for k in np.nonzero(~fits)[0].tolist():
                n[k] = self.count(part[k].as_py())
            out.append(n)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id, ``n_bytes`` (UTF-8), ``n_tokens`` and whether that is over ``limit``.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows each give a row; other
    columns are not read. An empty table gives an empty one. No shuffle: a text is counted where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(CountCoder, path)
        for b in batches:
            size = pc.cast(pc.fill_null(pc.binary_length(b.column(1)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(c.count_all(b.column(1)))], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
