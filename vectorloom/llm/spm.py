"""SentencePiece encoding and decoding that keeps offsets.

A text is normalised by the longest prefix that the model's compiled character map knows, recording for every
normalised character which source bytes it came from. Then the model's spaces rules apply (dummy prefix, escaped
spaces) and the library merges pieces. Every piece's surface has a known length, so running sums over the normalised
text, sent through the recorded alignment, project it to a span of original UTF-8 bytes.

Cases: null and empty texts have no ids; repeated rows give repeated results; an empty table gives an empty result;
long texts take memory in proportion to their length.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowmap import arrow_map

SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharMap:
    """A compiled character map: a double-array trie of prefixes and the strings that replace them."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        self.first: frozenset[int] = frozenset()
        if len(blob) > 4:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]
            root = self._offset(self.units[0])
            self.first = frozenset(c for c in range(256) if self._child(root, c) is not None)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _child(self, at: int, c: int) -> int | None:
        at ^= c
        return at if at < len(self.units) and (self.units[at] & 0x800000FF) == c else None

    def longest(self, data: bytes, start: int) -> tuple[int, int] | None:
        """Length of the longest known prefix at ``start`` and where its replacement begins."""
        found = None
        at = self._offset(self.units[0])
        for n in range(start, len(data)):
            node = self._child(at, data[n])
            if node is None:
                break
            unit = self.units[node]
            at = node ^ self._offset(unit)
            if unit >> 8 & 1:
                found = n - start + 1, self.units[at] & 0x7FFFFFFF
        return found

    def replacement(self, at: int) -> bytes:
        return self.strings[at : self.strings.index(b"\0", at)]


class Encoder:
    """A model file, read once a worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            data = f.read()
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=data)
        proto = pb.ModelProto()
        proto.ParseFromString(data)
        spec = proto.normalizer_spec
        if spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that drop or do not escape spaces, or have them as suffix, are not supported")
        self.dummy = SPACE if spec.add_dummy_prefix else ""
        self.map = CharMap(spec.precompiled_charsmap)
        pieces = [(p.piece, p.type) for p in proto.pieces]
        self.surface = [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(SPACE, " ").encode() for p, kind in pieces]
        self.width = np.array([len(x) for x in self.surface], np.int64)
        self.decimal = [str(i) for i in range(len(pieces))]
        if not proto.trainer_spec.byte_fallback:
            raise ValueError("spans need a model with byte fallback")
    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, and for each of its UTF-8 bytes where its source begins (None: each is its own source, but for spaces rules)."""
        if not self.map.units:
            return text, None
        data = text.encode()
        out, source, n = bytearray(), [], 0
        while n < len(data):
            hit = self.map.longest(data, n) if data[n] in self.map.first else None
            if hit:
                length, new = hit[0], self.map.replacement(hit[1])
            else:
                lead = data[n]
                length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[n : n + length]
            out += new
            source += [n] * len(new) if hit else range(n, n + length)
            n += length
        return out.decode(), np.array([*source, len(data)], np.int64)

    def encode(self, text: str) -> tuple[list[int], np.ndarray, str]:
        """Ids, the pieces' byte spans in the text (rows of begin, end), and the decoded text."""
        if not text:
            return [], np.zeros((0, 2), np.int64), ""
        normal, source = self.normalise(text)
        ids = self.lib.encode(text)
        decoded = self.lib.decode(ids)
        end = np.cumsum(self.width[ids], dtype=np.int64) - len(self.dummy)
        if SPACE in normal:  # in the text itself it has three bytes, as a surface one
            true = np.array([len(c.encode()) for c in normal], np.int64)
            one = np.where(np.array([c == SPACE for c in normal]), 1, true)
            end = np.concatenate(([0], np.cumsum(true)))[np.searchsorted(np.concatenate(([0], np.cumsum(one))), end, "left").clip(max=len(true))]
        if source is not None:
            end = source[np.minimum(end, len(source) - 1)]
        spans = np.zeros((len(end), 2), np.int64)
        spans[:, 1] = end
        spans[1:, 0] = end[:-1]
        return ids, spans, decoded


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(docs: DataFrame, path: str, schema: str, kernel) -> DataFrame:
    return arrow_map(docs, {"doc_id": "doc_id", "text": "text"}, schema, lambda b: kernel(b, encoder(path)))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, begins, ends (bytes of the original text), decoded: the full encoding of each text."""

    def kernel(b: pa.RecordBatch, e: Encoder) -> dict:
        rows = [e.encode(t or "") for t in b["text"].to_pylist()]
        return {"doc_id": b["doc_id"], "ids": pa.array([r[0] for r in rows], pa.list_(pa.int32())), "begins": pa.array([r[1][:, 0] for r in rows], pa.list_(pa.int64())), "ends": pa.array([r[1][:, 1] for r in rows], pa.list_(pa.int64())), "decoded": pa.array([r[2] for r in rows])}

    return _encoded(docs, path or default_model(), "doc_id long, ids array<int>, begins array<long>, ends array<long>, decoded string", kernel)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (of begin:end pairs, little-endian 64 bits): what ``encode`` gives, as digests."""
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def kernel(b: pa.RecordBatch, e: Encoder) -> dict:
        n, ids, decoded, spans = [], [], [], []
        for t in b["text"].to_pylist():
            i, s, d = e.encode(t or "")
            n.append(len(s))
            ids.append(sha(",".join([e.decimal[x] for x in i]).encode()))
            decoded.append(sha(d.encode()))
            spans.append(sha(s.tobytes()))
        return {"doc_id": b["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(decoded), "spans_sha256": pa.array(spans)}

    return _encoded(docs, path or default_model(), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", kernel)
