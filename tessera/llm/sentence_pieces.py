"""SentencePiece encoding that keeps source offsets, and decoding.

The model's compiled character map (a double-array trie over UTF-8 with a pool of replacements) is read from the model file.
Normalisation takes, at each place, the longest key of the trie that is a prefix of what remains, else one character, and
notes for every normalised byte which source byte it comes from. Pieces are consecutive in the normalised text, so running
sums of their lengths, looked up in that record, give each piece's source bytes.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import appended, blobs, documents, kept

SPACE = "▁".encode()
FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("spans_sha256", T.StringType())]
FULL = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("starts", T.ArrayType(T.LongType(), False)), T.StructField("ends", T.ArrayType(T.LongType(), False)), T.StructField("decoded", T.StringType())]


class CharMap:
    """The compiled character map: size of the trie (unsigned 32-bit), its units, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units, self.pool = (), b""
        if blob:
            n = struct.unpack_from("<I", blob)[0]
            self.units, self.pool = struct.unpack_from(f"<{n // 4}I", blob, 4), blob[4 + n :]

    def longest(self, s: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at``, and its replacement."""
        units, found = self.units, None
        if not units:
            return None

        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & 0x200) >> 6)

        node = offset(units[0])
        for i in range(at, len(s)):
            node ^= s[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != s[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.pool[value : self.pool.index(b"\0", value)]
        return found


class Pieces:
    """A model's encoder and decoder, with source offsets."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        self.spec, self.map = proto.normalizer_spec, CharMap(proto.normalizer_spec.precompiled_charsmap)
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        byte, unknown = pb.ModelProto.SentencePiece.BYTE, pb.ModelProto.SentencePiece.UNKNOWN
        self.unknown = {i for i, p in enumerate(proto.pieces) if p.type == unknown}
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == byte else p.piece.encode() for p in proto.pieces]
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self.text = [str(i) for i in range(len(proto.pieces))]

    def align(self, s: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text; for every byte of it, and its end, the source byte it comes from, -1 - x for bytes put before x.

        Where the model's map is empty and spaces stay, normalisation is the marking of spaces, and whole arrays do it.
        """
        spec = self.spec
        if not self.map.units and not spec.remove_extra_whitespaces and not self.suffix:
            b = np.frombuffer(s, np.uint8)
            wide = np.where(b == 32, len(SPACE), 1) if spec.escape_whitespaces else np.ones(len(b), np.int64)
            own = np.repeat(np.arange(len(b)), wide)
            lead = (len(SPACE) if spec.escape_whitespaces else 1) if spec.add_dummy_prefix and len(b) else 0
            space = SPACE if spec.escape_whitespaces else b" "
            return (space if lead else b"") + s.replace(b" ", space), np.concatenate([np.full(lead, -1), own, [len(b)]])
        text, own = self.normalise(s)
        return text, np.array(own, np.int64)

    def normalise(self, s: bytes) -> tuple[bytes, list[int]]:
        """Longest-prefix normalisation and the source byte of every normalised byte, its end included."""
        spec, chunks, at = self.spec, [], 0
        while at < len(s):
            hit = self.map.longest(s, at)
            n = hit[0] if hit else 1 if s[at] < 0xC0 else 2 if s[at] < 0xE0 else 3 if s[at] < 0xF0 else 4
            chunks.append((hit[1] if hit else s[at : at + n], at, at + n))
            at += n
        if spec.remove_extra_whitespaces:
            while chunks and chunks[0][0] in (b" ", b""):
                chunks.pop(0)
        if not chunks:
            return b"", [len(s)]
        space = SPACE if spec.escape_whitespaces else b" "
        out, own, end = bytearray(), [], 0
        if spec.add_dummy_prefix and not self.suffix:
            out += space
            own += [-1 - chunks[0][1]] * len(space)
        gap = spec.remove_extra_whitespaces
        for text, at, stop in chunks:
            if gap:
                text = text.lstrip(b" ")
            for x in text:
                new = space if x == 32 else bytes([x])
                out += new
                own += [at] * len(new)
                end = stop
            gap = spec.remove_extra_whitespaces and (text.endswith(b" ") if text else gap)
        if spec.remove_extra_whitespaces:
            while out.endswith(space):
                end = own[-len(space)]
                del out[-len(space) :], own[-len(space) :]
        if spec.add_dummy_prefix and self.suffix:
            out += space
            own += [end] * len(space)
        return bytes(out), [*own, end]

    def spans(self, s: bytes, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First source byte and end of every piece. Pieces that share a source character share its bytes.

        The pieces joined must be the normalised text.
        """
        text, source = self.align(s)
        if self.unknown and not self.unknown.isdisjoint(ids):
            pieces = [p.encode() for p in self.sp.encode(s.decode(), out_type=str)]
            ends = np.array(list(accumulate(map(len, pieces))), np.int64)
        else:
            pieces = map(self.bytes.__getitem__, ids)
            ends = np.cumsum(self.length[ids]) if ids else np.empty(0, np.int64)
        if b"".join(pieces) != text:
            raise ValueError("the pieces are not the normalised text")
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        lo = np.where(source[starts] < 0, -1 - source[starts], source[starts])
        later = np.maximum(np.where(source[ends] < 0, -1 - source[ends], source[ends]), lo)
        inside = (ends > starts) & (source[np.maximum(ends - 1, 0)] == source[ends])  # ends within a source character
        nxt = np.searchsorted(source, source[ends], side="right")
        hi = np.where(inside, source[np.minimum(nxt, len(source) - 1)], later)
        return lo, hi


def cached(model: str) -> Pieces:
    return kept(("pieces", model), lambda: Pieces(model))


def encode_digests(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with the number of ids, and digests of the ids, of the decoded text and of the pieces' source spans.

    The last is over starts, then ends, as little-endian signed 64-bit numbers. Null and empty texts have no ids. A text of any length is
    encoded whole. Repeated rows are encoded alike. Columns named as a result are replaced. An empty table gives an empty result.
    """

    def fn(col: pa.Array) -> list:
        m, rows = cached(model), []
        raw = blobs(col)
        for s, ids in zip(raw, m.sp.encode([x.decode() for x in raw], num_threads=1), strict=True):
            spans = np.concatenate(m.spans(s, ids)).astype("<i8").tobytes()
            rows.append((len(ids), *(hashlib.sha256(x).hexdigest() for x in (",".join(map(m.text.__getitem__, ids)).encode(), (m.sp.decode(ids) if ids else "").encode(), spans))))
        return [list(c) for c in zip(*rows, strict=True)]

    return appended(docs, text, FIELDS, fn, keeps=True)


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ids, source byte spans and the decoded text.

    Null and empty texts have none of them and decode to an empty text. Whole texts, repeated rows, clashing names and empty tables are as in
    ``encode_digests``.
    """

    def fn(col: pa.Array) -> list:
        m, rows = cached(model), []
        for s in blobs(col):
            ids = m.sp.encode(s.decode())
            lo, hi = m.spans(s, ids)
            rows.append((ids, lo.tolist(), hi.tolist(), m.sp.decode(ids) if ids else ""))
        return [list(c) for c in zip(*rows, strict=True)]

    return appended(docs, text, FULL, fn, keeps=True)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), default_model()).select("doc_id", *[f.name for f in FIELDS])
