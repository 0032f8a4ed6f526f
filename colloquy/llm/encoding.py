"""Token ids and token counts of whole texts, with caches for the words that texts share.

A text is cut at single spaces between two other characters, where no pre-token of the supported
tokenizers crosses. The pieces repeat, so a worker computes each once and keeps it in a bounded cache.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The patterns of the two supported pre-tokenizers, as their files give them.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LATIN = re.compile("[\0-\xff]*").fullmatch  # composed characters alone, which every library lower-cases alike
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = "".join(c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n")
_ODD = f"  | \\n|\\n |\\n\\n\\n|\\n\\n$|^ | $|[{_ODD_SPACE}]"  # runs of line ends are one pre-token but for the last before a word


def byte_letters() -> list[str]:
    """The character that stands for each byte value in a byte-level vocabulary: itself if printable Latin-1, else one from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


_TO_LETTERS = dict(enumerate(byte_letters()))


def letters(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_TO_LETTERS)


def pieces(text: str) -> list[str]:
    """``text`` cut at single spaces that stand between two characters other than white space."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _ODD_SPACE):
        return _CUT.split(text)
    return text.split(" ")

RUN = 8_000_000  # bytes of text that are encoded together: a batch of ordinary texts, each distinct piece of which is looked up once


class Cache:
    """A map of at most twice ``most`` entries: a full generation becomes the old one, and the one before it goes."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def put(self, entries: dict) -> None:
        if len(self.new) + len(entries) > self.most:
            self.old, self.new = self.new, {}
        self.new.update(entries)


def slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``most`` bytes; one long text makes a run by itself."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    at = 0
    while at < len(texts):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        yield texts.slice(at, max(1, upto - at))
        at = max(upto, at + 1)


class PieceCoder:
    """Maps each piece of a text to a value. Sub-classes say how to compute the values of pieces not seen yet."""

    #: strings that the library takes for special tokens; texts that hold one take the slow way
    special: dict[str, int] = {}

    def __init__(self, most: int) -> None:
        self.inner, self.first = Cache(most), Cache(most // 8)

    def compute(self, texts: list[str]) -> list:
        raise NotImplementedError

    def look_up(self, cache: Cache, words: list[str], before: str) -> list:
        got = list(map(cache.new.get, words))
        lost = [i for i, v in enumerate(got) if v is None]
        if lost:
            old, missing, again = cache.old, [], {}
            for i in lost:
                if (v := old.get(words[i])) is None:
                    missing.append(i)
                else:
                    got[i] = again[words[i]] = v
            fresh = list(dict.fromkeys([words[i] for i in missing]))
            made = dict(zip(fresh, self.compute([w if w[:1] == "\n" else before + w for w in fresh]), strict=True))
            cache.put(again)
            for at in range(0, len(fresh), max(1, cache.most // 2)):  # so that no more than the most are held
                cache.put({w: made[w] for w in fresh[at : at + max(1, cache.most // 2)]})
            for i in missing:
                got[i] = made[words[i]]
        return got

    def values(self, text: str) -> list:
        first, *rest = pieces(text)
        return self.look_up(self.first, [first], "") + self.look_up(self.inner, rest, " ")

    def spread(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """Values; for each piece of all texts the place of its value; for each text the place of its first piece.

        Only for texts that ``plain`` accepts: they are cut at spaces and before line ends, and looked up together, each distinct piece once.
        """
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        begins = np.asarray(cut.offsets, dtype=np.int64)
        begins = begins - begins[0]
        coded = cut.flatten().dictionary_encode()
        where = np.array(coded.indices, dtype=np.int64)
        values = self.look_up(self.inner, coded.dictionary.to_pylist(), " ")
        heads = self.look_up(self.first, pc.list_element(cut, 0).to_pylist(), "")
        where[begins[:-1]] = len(values) + np.arange(len(heads))
        return values + heads, where, begins[:-1]

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts have a value, no white space but single spaces and line ends, and no special string."""
        odd = pc.match_substring_regex(texts, _ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        return ~np.asarray(pc.fill_null(odd, True), dtype=bool)


class IdCoder(PieceCoder):
    """Ids as the tokenizers library gives them, without added tokens. Words go to the library's BPE model."""

    def __init__(self, path: str, most: int = 600_000) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__(most)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.n_ids = self.library.get_vocab_size(with_added_tokens=True)
        self.words, pre, norm = Cache(most), spec["pre_tokenizer"] or {}, spec["normalizer"]
        self.pattern = None
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
            self.pattern, self.lower = regex.compile(BYTE_LEVEL), False
        elif pre.get("type") == "Sequence" and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and pre["pretokenizers"][0]["pattern"]["Regex"] == WORD_LEVEL:
            self.pattern, self.lower = regex.compile(WORD_LEVEL), True
        self.model = self.library.model

    def compute(self, texts: list[str]) -> list[bytes]:
        if self.lower:
            texts = [t.lower() if t.isascii() or _LATIN(t) else self.library.normalizer.normalize_str(t) for t in texts]
            found = [(t[1:],) if t[:1] == " " and t[1:].isalpha() else self.pattern.findall(t) for t in texts]
        else:
            found = [(t,) if t[:1] == " " and t[1:].isalpha() else self.pattern.findall(t) for t in texts]
        words = list(dict.fromkeys([w for ws in found for w in ws]))
        tokenize, ids, again, fresh = self.model.tokenize, {}, {}, {}
        for w, v in zip(words, map(self.words.new.get, words), strict=True):
            if v is None:
                v = self.words.old.get(w)
                if v is None:
                    v = fresh[w] = array("I", [k.id for k in tokenize(letters(w))]).tobytes()
                else:
                    again[w] = v
            ids[w] = v
        self.words.put(again)
        self.words.put(fresh)
        return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in found]

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.pattern is None or any(s in text for s in self.special):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(self.values(text))

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn, null as empty; works on a batch of ``RUN`` bytes of text at a time."""
        for part in slices(texts, RUN):
            fits = self.plain(part) if self.pattern else np.zeros(len(part), dtype=bool)
            ids, ends = np.zeros(0, dtype="<u4"), []
            if fits.any():
                values, where, begins = self.spread(part.filter(pa.array(fits)))
                flat = np.frombuffer(b"".join(values), dtype="<u4")
                size = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
                start = np.cumsum(size) - size
                n = size[where]
                done = np.cumsum(n)
                ids = flat[np.repeat(start[where] - (done - n), n) + np.arange(done[-1])]
                ends = np.append(done[begins[1:] - 1], done[-1]).tolist()
            at, turn = 0, iter(ends)
            for k, ok in enumerate(fits.tolist()):
                if ok:
                    end = next(turn)
                    yield ids[at:end]
                    at = end
                else:
                    yield np.frombuffer(self.encode(part[k].as_py()), dtype="<u4")


_coders: dict[tuple, PieceCoder] = {}


def coder(kind: type, path: str) -> PieceCoder:
    """One coder for each worker process, so that its caches outlive a task."""
    if (kind, path) not in _coders:
        gc.set_threshold(100_000, 20, 20)  # the caches hold strings and bytes, no cycles; default sweeps take a sixth of the time
        _coders[kind, path] = kind(path)
    return _coders[kind, path]


def forget_coders() -> None:
    """Free the caches in a worker process that an earlier step filled: for steps that do not encode and need the memory."""
    _coders.clear()
