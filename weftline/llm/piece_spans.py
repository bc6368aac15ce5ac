"""SentencePiece encoding that keeps the place of every piece in the source.

The text is normalised by longest-prefix matching through the model's compiled
character map (a double-array trie and its replacement strings), and each
normalised byte remembers the source byte it came from.  Pieces are found in
the normalised text; the alignment projects each of them to a span of source
bytes.  The merges themselves are the library's: it is given the model with an
empty normaliser, and chunks between which no piece can reach are encoded once
and kept in a bounded store.

Defined results: a null text counts as empty; an empty text has only the begin
and end ids, one of any length is encoded whole; repeated rows each give their
row; between equally good merges the library's order decides (the leftmost
first); other columns are ignored by the digests and kept by
:func:`encode_spans` unless named like its own; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Store
from .common import text_groups

MARK = "▁"


class CharMap:
    """The compiled character map of a model: longest-prefix replacement."""

    def __init__(self, blob: bytes):
        self.units, self.strings = np.zeros(0, np.uint32), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.strings = blob[4 + size :]
        self.starts: dict[str, bool] = {}

    def match(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes consumed and their replacement, for the longest rule at ``at``."""
        if not len(self.units):
            return None
        units, found = self.units, None
        unit = int(units[0])
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & 0x800000FF != raw[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, int(units[node]) & 0x7FFFFFFF
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end]

    def may_start(self, char: str) -> bool:
        """Whether some rule begins with this character."""
        if char not in self.starts:
            raw, units, ok = char.encode(), self.units, len(self.units) > 0
            if ok:
                node = (int(units[0]) >> 10) << ((int(units[0]) & 512) >> 6)
                for c in raw:
                    node ^= c
                    if node >= len(units) or int(units[node]) & 0x800000FF != c:
                        ok = False
                        break
                    unit = int(units[node])
                    node ^= (unit >> 10) << ((unit & 512) >> 6)
            self.starts[char] = ok
        return self.starts[char]

    def segments(self, text: str):
        """(source bytes, normalised bytes, copied) from left to right."""
        raw = text.encode()
        active = "".join(c for c in set(text) if self.may_start(c))
        if not active:
            yield raw, raw, True
            return
        at, done = 0, 0
        for m in re.finditer(b"|".join(re.escape(c.encode()) for c in active), raw):
            at = m.start()
            if at < done or (hit := self.match(raw, at)) is None:
                continue
            if at > done:
                yield raw[done:at], raw[done:at], True
            yield raw[at : at + hit[0]], hit[1], False
            done = at + hit[0]
        if done < len(raw):
            yield raw[done:], raw[done:], True


class PieceEncoder:
    """Ids and source spans of texts under one SentencePiece model."""

    def __init__(self, path: str, most: int = 300_000):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        if any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: user-defined pieces and white space as a suffix are not supported")
        self.whole = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.chars = CharMap(model.normalizer_spec.precompiled_charsmap)
        self.spec = (model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces)
        spec = model.normalizer_spec
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.bare = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
        kinds = pb.ModelProto.SentencePiece
        self.width = np.array([1 if p.type == kinds.BYTE else -1 if p.type == kinds.UNKNOWN else len(p.piece.encode()) for p in model.pieces])
        normal = [p.piece for p in model.pieces if p.type in (kinds.NORMAL, kinds.UNUSED)]
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in normal)
        self.lines = self.cuts and not any("\n" in p for p in normal)
        self.begin, self.end = self.whole.bos_id(), self.whole.eos_id()
        self.store = Store(most)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the source byte."""
        prefix, trim, escape = self.spec
        if not text:
            return b"", np.zeros(1, np.int64)
        blank = MARK.encode() if escape else b" "
        out, origin, at = [], [], 0
        for source, norm, copied in self.chars.segments(text):
            place = at + np.arange(len(source)) if copied else np.full(len(norm), at)
            out.append(np.frombuffer(norm, np.uint8))
            origin.append(place)
            at += len(source)
        made = np.concatenate(out) if out else np.zeros(0, np.uint8)
        place = np.concatenate(origin) if origin else np.zeros(0, np.int64)
        end = at
        if trim:
            solid = np.flatnonzero(made != 32)
            if not len(solid):
                return b"", np.array([at])
            first, last = solid[0], solid[-1]
            end = int(place[last + 1]) if last + 1 < len(made) else at
            made, place = made[first : last + 1], place[first : last + 1]
            keep = (made != 32) | np.concatenate([[True], made[:-1] != 32])
            made, place = made[keep], place[keep]
        if not len(made):
            return b"", np.array([at])
        wide = np.where(made == 32, len(blank), 1)
        text_ = made.tobytes().replace(b" ", blank)
        place = np.repeat(place, wide)
        if prefix:
            text_, place = blank + text_, np.concatenate([np.full(len(blank), place[0]), place])
        return text_, np.append(place, end)

    def _cut(self, text: str) -> list[str]:
        """Chunk keys of the normalised text: ``w`` stands for a mark and w,
        ``\\r`` in front of w for w alone."""
        if not text:
            return []
        simple = self.lines and not len(self.chars.units) and self.spec == (True, False, True)
        if simple and not ("\r" in text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or MARK in text or text[0] in " \n" or text[-1] in " \n"):
            return text.replace("\n", " \n \r").split(" ")
        norm = self.normalise(text)[0].decode()
        if not norm:
            return []
        if not self.cuts:
            return ["\r" + norm]
        return [c[1:] if c[0] == MARK and c[1:2] not in ("", MARK, "\r", "\n") else "\r" + c for c in re.split(f"(?<=[^{MARK}])(?={MARK})", norm)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts without begin and end, and offsets."""
        keys, ends = [], [0]
        for t in texts:
            keys += self._cut(t)
            ends.append(len(keys))
        self.store.trim()
        codes = self.store.look_up(keys)
        new = np.flatnonzero(codes < 0).tolist()
        if new:
            missing = list(dict.fromkeys(keys[i] for i in new))
            chunks = [k if k == "\n" else k[1:] if k[0] == "\r" else MARK + k for k in missing]
            self.store.add(missing, self.bare.encode(chunks, num_threads=1))
            codes[new] = self.store.look_up([keys[i] for i in new])
        ids, at = self.store.gather(codes)
        return ids, at[np.array(ends, np.int64)]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte in the source of each piece.  Pieces cover the
        text without gaps, but for what the normaliser drops at its ends."""
        norm, place = self.normalise(text)
        width = self.width[ids]
        if len(width) and width.min() < 0:  # unknown pieces have no width of their own
            pieces = self.bare.encode(norm.decode(), out_type="immutable_proto").pieces
            width = np.array([len(p.surface.encode()) for p in pieces])
        ends = np.cumsum(width)
        return place[ends - width], place[ends]


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder a worker process and model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_spans(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, ids, starts, ends: one entry a piece,
    begin and end ids included with empty spans at the ends of the text."""

    def run(batches):
        enc = piece_encoder(model)
        for b in text_groups(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids, at = enc.encode(texts)
            rows = []
            for d, t, i, j in zip(b.column(0).to_pylist(), texts, at, at[1:]):
                start, end = enc.spans(t, ids[i:j])
                n = len(t.encode())
                rows.append({"doc_id": d, "ids": [enc.begin, *ids[i:j].tolist(), enc.end], "starts": [0, *start.tolist(), n], "ends": [0, *end.tolist(), n]})
            yield pa.RecordBatch.from_pylist(rows, _SPANS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


_SPANS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_spanned (source bytes
    that the projected spans cover): encoding, projection and the library's
    decoding in one pass, so no ids leave the task."""

    def run(batches):
        enc = piece_encoder(model)
        for b in text_groups(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids, at = enc.encode(texts)
            rows = []
            for d, t, i, j in zip(b.column(0).to_pylist(), texts, at.tolist(), at[1:].tolist()):
                own = np.empty(j - i + 2, "<u4")
                own[0], own[1:-1], own[-1] = enc.begin, ids[i:j], enc.end
                start, end = enc.spans(t, ids[i:j])
                said = enc.whole.decode(own.tolist())
                rows.append((d, j - i + 2, hashlib.sha256(own).hexdigest(), hashlib.sha256(said.encode()).hexdigest(), int((end - start).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_spanned"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_spanned long")
