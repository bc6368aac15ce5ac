"""Tokenizer encoding through bounded stores of chunks.

A text is cut only where the tokenizer itself always separates; each distinct
chunk goes through the ``tokenizers`` library once, and documents are put
together from stored ids by numpy.  Plain texts are cut, hashed and looked up
as arrays of bytes (:class:`HashStore`); any other text goes chunk by chunk
(:class:`Store`).  The stores are bounded: a full one keeps what came up most
often, so memory does not follow the vocabulary of the corpus.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat

import numpy as np

from .words import mix, strip, words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A lone word, or one with a blank before it, and closing marks: two independent pre-tokens.
_WORD_AND_MARKS = re.compile("(\r?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%$#*&|()\"]*)")
#: White space, beside blanks and line ends, that Python or the tokenizers see in Latin-1.
_ODD_BYTES = bytes([9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0])
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: What the tokenizers' own patterns call white space.
_UNICODE_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def _byte_level() -> dict[int, str]:
    """Byte-level pre-tokenizers write each byte of UTF-8 as a printable
    character: itself where it is one, else the next free one from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    of = [chr(b) if b in printable else chr(next(free)) for b in range(256)]
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(256)}


_BYTE_LEVEL = _byte_level()

class Store:
    """Chunk -> code, and each code's values in one flat array.

    Once it holds more than ``most`` chunks, it keeps only those that came up
    most often, half of ``most`` at the most."""

    def __init__(self, most: int):
        self.most = most
        self.codes: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.start = self.length = self.hits = np.empty(0, np.int64)

    def add(self, keys: list[str], values: list) -> None:
        n = len(self.codes)
        lengths = np.fromiter(map(len, values), np.int64, len(values))
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        self.start = np.concatenate([self.start, len(self.flat) + ends - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.hits = np.concatenate([self.hits, np.zeros(len(keys), np.int64)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(values), np.uint32, total)])
        self.codes.update(zip(keys, range(n, n + len(keys))))

    def join(self, keys: list[str], pairs: list[tuple[str, str]]) -> None:
        """Store under each key the values of two stored keys, one behind the other."""
        codes = self.look_up(list(chain.from_iterable(pairs)))
        values, ends = self._values(codes)
        self.start = np.concatenate([self.start, len(self.flat) + ends[:-1:2]])
        self.length = np.concatenate([self.length, np.diff(ends[::2])])
        self.hits = np.concatenate([self.hits, np.zeros(len(keys), np.int64)])
        self.flat = np.concatenate([self.flat, values])
        n = len(self.codes)
        self.codes.update(zip(keys, range(n, n + len(keys))))

    def look_up(self, keys: list[str]) -> np.ndarray:
        """Codes, -1 for what is not stored."""
        return np.fromiter(map(self.codes.get, keys, repeat(-1)), np.int64, len(keys))

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all codes in turn, and the offsets of each code's values."""
        self.hits += np.bincount(codes, minlength=len(self.hits))
        return self._values(codes)

    def _values(self, codes):
        lengths = self.length[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start[codes] - ends + lengths, lengths)
        return self.flat[at], np.concatenate([np.zeros(1, np.int64), ends])

    def trim(self) -> None:
        if len(self.codes) <= self.most:
            return
        keep = np.argsort(-self.hits, kind="stable")[: self.most // 2]
        keep = np.sort(keep[self.hits[keep] > 1])
        names = list(self.codes)
        self.codes = {names[c]: i for i, c in enumerate(keep.tolist())}
        self.flat, ends = self._values(keep)
        self.start, self.length, self.hits = ends[:-1], np.diff(ends), self.hits[keep] // 2


class HashStore:
    """An open-addressed table from a 64-bit hash and a 32-bit check to values,
    looked up for whole arrays at a time."""

    def __init__(self, bits: int = 20):
        self.most = 1 << (bits - 1)
        self._empty(bits)
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint32)
        self.flat = np.empty(0, np.uint32)
        self.start, self.length, self.hits = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)

    def _empty(self, bits: int) -> None:
        self.mask = np.int64((1 << bits) - 1)
        self.key = np.zeros(1 << bits, np.uint64)
        self.check = np.zeros(1 << bits, np.uint32)
        self.code = np.full(1 << bits, -1, np.int32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        slot = key.astype(np.int64) & self.mask
        code = self.code[slot]
        open_ = np.flatnonzero((code >= 0) & ((self.key[slot] != key) | (self.check[slot] != check)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at = slot[open_]
            code[open_] = self.code[at]
            open_ = open_[(code[open_] >= 0) & ((self.key[at] != key[open_]) | (self.check[at] != check[open_]))]
        return code

    def add(self, key: np.ndarray, check: np.ndarray, values: list) -> None:
        """New, distinct keys.  One very long text may outgrow the table, which
        is then made larger until the next :meth:`trim`."""
        n = len(self.keys)
        if 4 * (n + len(key)) > 3 * len(self.code):
            self._empty((2 * (n + len(key))).bit_length())
            self._place(np.arange(n))
        lengths = np.fromiter(map(len, values), np.int32, len(values))
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        self.start = np.concatenate([self.start, len(self.flat) + ends - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.hits = np.concatenate([self.hits, np.zeros(len(key), np.int32)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(values), np.uint32, total)])
        self.keys, self.checks = np.concatenate([self.keys, key]), np.concatenate([self.checks, check])
        self._place(np.arange(n, n + len(key)))

    def _place(self, codes: np.ndarray) -> None:
        slot = self.keys[codes].astype(np.int64) & self.mask
        while len(codes):
            free = self.code[slot] < 0
            self.code[slot[free]] = codes[free]  # of several for one slot the last stays
            won = self.code[slot] == codes
            self.key[slot[won]], self.check[slot[won]] = self.keys[codes[won]], self.checks[codes[won]]
            codes, slot = codes[~won], (slot[~won] + 1) & self.mask

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all codes in turn, and the offsets of each code's values."""
        if 8 * len(codes) > len(self.hits):
            self.hits += np.bincount(codes, minlength=len(self.hits)).astype(np.int32)
        else:
            np.add.at(self.hits, codes, 1)
        return self._values(codes)

    def _values(self, codes):
        lengths = self.length[codes]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start[codes] - ends + lengths, lengths)
        return self.flat[at], np.concatenate([np.zeros(1, np.int64), ends])

    def trim(self) -> None:
        if len(self.keys) <= self.most:
            return
        keep = np.argsort(-self.hits, kind="stable")[: self.most // 2]
        keep = np.sort(keep[self.hits[keep] > 1])
        self.keys, self.checks = self.keys[keep], self.checks[keep]
        self.flat, ends = self._values(keep)
        self.start, self.length, self.hits = ends[:-1], np.diff(ends).astype(np.int32), self.hits[keep] // 2
        self._empty(self.most.bit_length())
        self._place(np.arange(len(keep)))


class ChunkEncoder:
    """Ids of texts as ``tokenizers`` gives them with ``add_special_tokens=False``."""

    def __init__(self, path: str, most: int = 50_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.kind = self._kind(spec)
        self.store, self.fast = Store(most), HashStore()

    @staticmethod
    def _kind(spec: dict) -> str:
        """How texts may be cut: "byte" (a blank belongs to the word behind it),
        "word" (white space is dropped), or "whole" for any other tokenizer."""
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain = not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        if plain and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "byte"
        steps = [p.get("type") for p in pre.get("pretokenizers", [])]
        norms = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        if plain and steps == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1].get("pattern") == {"Regex": r"\s+"} and norm["normalizers"][1].get("content") == " " and r"[^\s\p{L}\p{N}]+" in pre["pretokenizers"][0]["pattern"].get("Regex", ""):
            return "word"
        return "whole"

    def _cut(self, text: str) -> list[str]:
        """Chunk keys of a text.  For "byte": ``w`` stands for a blank and w,
        ``\\r`` in front of w for w alone."""
        if not text:
            return []
        if self.kind == "whole":
            return [text]
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = None
        usual = raw is not None and len(raw.translate(None, _ODD_BYTES)) == len(raw)
        if self.kind == "word":
            if raw is not None:
                text = text.lower()
            return text.split() if usual else [w for w in _UNICODE_SPACE.split(text) if w]
        if usual and not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"):
            return ("\r" + text.replace("\n", " \n \r")).split(" ")
        return [c[1:] if c[0] == " " and not c[1:2].isspace() and len(c) > 1 else "\r" + c for c in _SAFE_CUT.split(text)]

    def _learn(self, keys: list[str]) -> None:
        """Store the ids of new keys.  A word with marks behind it is put
        together from its parts; a plain word needs only the merges, anything
        else the whole tokenizer."""
        byte, codes = self.kind == "byte", self.store.codes
        parts, plain, other = {}, {}, {}
        for k in keys:
            m = None if self.kind == "whole" else _WORD_AND_MARKS.fullmatch(k)
            if m is None:
                other[k] = k if not byte or k == "\n" else k[1:] if k[0] == "\r" else " " + k
                continue
            lone, word, marks = m.groups()
            if marks:
                parts[k] = (lone + word, "\r" + marks if byte else marks)
                if parts[k][1] not in codes:
                    other[parts[k][1]] = marks
            if lone + word not in codes:
                plain[lone + word] = (word if lone or not byte else " " + word).translate(_BYTE_LEVEL)
        merge = self.lib.model.tokenize
        self.store.add(list(plain), [[t.id for t in merge(w)] for w in plain.values()])
        self.store.add(list(other), [e.ids for e in self.lib.encode_batch_fast(list(other.values()), add_special_tokens=False)])
        self.store.join(list(parts), list(parts.values()))

    def encode(self, texts: list[str], blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of all texts, and len(texts) + 1 offsets.  ``blank``
        marks texts before which a blank is to be thought."""
        raws = [t.encode() for t in texts]
        if blank is None:
            blank = np.zeros(len(texts), bool)
        plain = np.array([self.kind != "whole" and _plain(r, self.kind) for r in raws], bool)
        if plain.all():
            return self._encode_plain(raws, blank)
        other = [" " + t if b else t for t, p, b in zip(texts, plain, blank) if not p]
        if not plain.any():
            return self._encode_chunks(other)
        parts = [self._encode_plain([r for r, p in zip(raws, plain) if p], blank[plain]), self._encode_chunks(other)]
        ids = np.concatenate([parts[0][0], parts[1][0]])
        start, length = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        for own, (_, at), shift in ((plain, parts[0], 0), (~plain, parts[1], len(parts[0][0]))):
            start[own], length[own] = at[:-1] + shift, np.diff(at)
        ends = np.cumsum(length)
        return ids[np.arange(len(ids)) + np.repeat(start - ends + length, length)], np.concatenate([[0], ends])

    def _encode_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        keys, ends = [], [0]
        for t in texts:
            keys += self._cut(t)
            ends.append(len(keys))
        self.store.trim()
        codes = self.store.look_up(keys)
        new = np.flatnonzero(codes < 0).tolist()
        if new:
            missing = [keys[i] for i in new]
            self._learn(list(dict.fromkeys(missing)))
            codes[new] = self.store.look_up(missing)
        ids, at = self.store.gather(codes)
        return ids, at[np.array(ends, np.int64)]

    def _encode_plain(self, raws: list[bytes], blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts in which single blanks and line ends stand between words.  Each
        word is a chunk, with the blank before it if that counts; a mark behind
        a letter at a word's end is one of its own, and so is a line end."""
        byte = self.kind == "byte"
        if not byte:
            raws = [r.lower() for r in raws]
        hashes, first, past, at, joined = words(raws)
        a = np.frombuffer(joined, np.uint8)
        last = a[past - 1]
        marked = _IS_MARK[last] & (past - first > 1)
        before, lead = a[np.maximum(past - 2, 0)], a[np.maximum(past - 3, 0)]
        letter = _IS_LETTER[before] | ((lead == 0xC3) & (past - first > 2) & (before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7))
        marked &= letter
        if marked.any():
            hashes = np.where(marked, strip(hashes, last, first, past), hashes)
        end = past - marked
        filled = np.diff(at) > 0
        starts = at[:-1][filled]
        lone = np.zeros(len(first), bool)
        if byte:
            lone = a[first - 1] == 10
            lone[starts] = False
        line = lone.copy()
        if byte:
            lone[starts] = ~blank[filled]
        hashes = hashes ^ (lone.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        check = ((end - first).astype(np.uint64) ^ (hashes >> np.uint64(40)) ^ (_check(joined, a, first, end))).astype(np.uint32)
        self.fast.trim()
        codes = self.fast.find(hashes, check)
        new = np.flatnonzero(codes < 0)
        if len(new):
            order = np.lexsort((check[new], hashes[new]))
            differs = np.r_[True, (np.diff(hashes[new][order]) != 0) | (np.diff(check[new][order].astype(np.int64)) != 0)]
            once = new[order[differs]]
            chunks = [joined[i:j].decode() for i, j in zip(first[once].tolist(), end[once].tolist())]
            self.fast.add(hashes[once], check[once], self._ids_of(chunks, ~lone[once] if byte else lone[once]))
            codes[new] = self.fast.find(hashes[new], check[new])
            if (codes[new] < 0).any():
                raise RuntimeError("a chunk has no code")
        grid = np.full((len(codes), 3), -1, np.int64)
        grid[:, 1] = codes
        if marked.any() or line.any():
            special = self._specials()
            grid[line, 0] = special[10]
            grid[marked, 2] = special[last[marked]]
        used = grid >= 0
        ids, ends = self.fast.gather(grid[used])
        return ids, ends[np.concatenate([[0], np.cumsum(used.sum(1))])[at]]

    def _ids_of(self, chunks: list[str], blank) -> list[list[int]]:
        """Ids of new chunks, with a blank before those marked; a plain word
        needs only the merges, anything else the whole tokenizer."""
        out: list = [None] * len(chunks)
        merge, rest = self.lib.model.tokenize, []
        for i, (c, b) in enumerate(zip(chunks, blank.tolist())):
            if _WORD.fullmatch(c) and (self.kind == "byte" or c.islower()):
                out[i] = [t.id for t in merge((" " + c if b else c).translate(_BYTE_LEVEL))]
            else:
                rest.append(i)
        if rest:
            for i, e in zip(rest, self.lib.encode_batch_fast([" " + chunks[i] if blank[i] else chunks[i] for i in rest], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def _specials(self) -> np.ndarray:
        """Codes of a line end and of single marks."""
        bytes_ = np.array([10, *b".,;:!?"], np.uint64)
        keys, check = mix(bytes_ ^ np.uint64(0x5851F42D4C957F2D)), np.full(len(bytes_), 0xFFFFFFFF, np.uint32)
        codes = self.fast.find(keys, check)
        if (codes < 0).any():
            new = codes < 0
            self.fast.add(keys[new], check[new], self._ids_of([chr(int(b)) for b in bytes_[new]], np.zeros(int(new.sum()), bool)))
            codes = self.fast.find(keys, check)
        out = np.full(256, -1, np.int64)
        out[bytes_.astype(np.int64)] = codes
        return out


def _plain(raw: bytes, kind: str) -> bool:
    """Whether :meth:`ChunkEncoder._encode_plain` may take a text: no white space
    but single blanks and line ends between words (any number, if dropped)."""
    if not raw:
        return True
    if len(raw.translate(None, _CONTROLS)) != len(raw):
        return False
    if b"\xc2" in raw and (b"\xc2\x85" in raw or b"\xc2\xa0" in raw):
        return False
    if _WIDE_SPACE.search(raw):
        return False
    if kind == "word":
        return True
    return not (b"  " in raw or b"\n\n" in raw or b" \n" in raw or b"\n " in raw or raw[0] in b" \n" or raw[-1] in b" \n")


_CONTROLS = bytes(c for c in range(32) if c != 10) + b"\x7f"
#: White space of three bytes in UTF-8.
_WIDE_SPACE = re.compile(b"\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_IS_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_IS_LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])


def _check(joined: bytes, a: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second, plain look at each chunk: its first four and last four bytes."""
    out = np.zeros(len(first), np.uint64)
    for k in range(4):
        out = out * np.uint64(0x9E3779B1) + a[np.minimum(first + k, end - 1)]
        out = out * np.uint64(0x85EBCA77) + a[np.maximum(end - 1 - k, first)]
    return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
