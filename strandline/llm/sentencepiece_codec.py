"""SentencePiece encoding that keeps the source alignment, and decoding.

The text is normalised here, not by the library: at each position the longest key of the model's
compiled character map (a Darts double array over UTF-8) is replaced by its value, other characters
are copied, white space is escaped, and every normalised byte records the source byte it came from.
The normalised string then goes through the library's segmentation with a model whose own
normalisation is the identity, and the pieces' byte lengths, summed up, are projected through the
recorded alignment to spans of the original bytes. Consecutive spans tile the source.

Work is row by row within Arrow batches: no shuffle, memory bounded by the longest text.

Defined results: null counts as empty; an empty text has only the begin and end ids; repeated rows
repeat their results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import filled, map_rows, strings

SPACE = "▁".encode()


class CharacterMap:
    """A compiled character map: 4 bytes of trie size, the trie's units, NUL-ended replacements."""

    def __init__(self, blob: bytes):
        if not blob:
            self.units: list[int] = []
            return
        size = struct.unpack_from("<I", blob)[0]
        self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
        self.values = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that begins at ``at``, and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if (unit >> 8) & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        n, offset = found
        return n, self.values[offset : self.values.index(b"\0", offset)]


@dataclass
class Normaliser:
    """The normaliser that a model's specification describes."""

    table: CharacterMap
    dummy_prefix: bool
    squeeze: bool
    escape: bool

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes; for each of them, and one past the end, the source byte offset."""
        data = text.encode()
        if not self.table.units and not self.squeeze:
            return self._plain(data)
        return self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """No character map: only spaces change length, so the alignment is made by arrays."""
        if not data:
            return b"", np.zeros(1, np.int64)
        lead = b" " if self.dummy_prefix else b""
        raw = np.frombuffer(lead + data, np.uint8)
        width = np.where(raw == 32, len(SPACE), 1) if self.escape else np.ones(len(raw), np.int64)
        source = np.arange(len(raw)) - len(lead)
        source[: len(lead)] = 0
        out = (lead + data).replace(b" ", SPACE) if self.escape else lead + data
        return out, np.append(np.repeat(source, width), len(data))

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        pieces: list[tuple[bytes, int]] = []
        at = 0
        while at < len(data):
            hit = self.table.longest(data, at)
            if hit:
                n, value = hit
            else:
                first = data[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                value = data[at : at + n]
            pieces.append((value, at))
            at += n
        out, source = bytearray(), []
        end = len(data)
        space = SPACE if self.escape else b" "
        if self.squeeze:  # leading white space goes
            while pieces and not pieces[0][0].strip(b" "):
                pieces.pop(0)
        if not pieces:
            return b"", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out += space
            source += [pieces[0][1]] * len(space)
        blank = self.squeeze
        for value, begin in pieces:
            if self.squeeze and blank:
                value = value.lstrip(b" ")
            if not value:
                continue
            for byte in value:
                one = space if byte == 32 else bytes((byte,))
                out += one
                source += [begin] * len(one)
            blank = value.endswith(b" ")
        if self.squeeze:  # trailing white space goes
            while out.endswith(space):
                end = source[-len(space)]
                del out[-len(space) :], source[-len(space) :]
        return bytes(out), np.array([*source, end])


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model_file, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        spec = proto.normalizer_spec
        self.normalise = Normaliser(CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.segment = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        byte = pb.ModelProto.SentencePiece.BYTE
        self.width = np.array([1 if p.type == byte else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.fallback = proto.trainer_spec.byte_fallback
        self.unk = self.library.unk_id()
        self.ends = [self.library.bos_id()], [self.library.eos_id()]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids with begin and end, and an (n, 2) array of spans in the text's UTF-8 bytes; begin and
        end have empty spans."""
        form, source = self.normalise(text)
        inner = self.segment.encode(form.decode())
        ids = np.array(self.ends[0] + inner + self.ends[1], np.uint32)
        body = ids[1:-1].astype(np.int64)
        if not self.fallback and (body == self.unk).any():
            widths = np.array([len(p.surface.encode()) for p in self.segment.encode(form.decode(), return_type="proto").pieces], np.int64)
        else:
            widths = self.width[body]
        cuts = source[np.concatenate([[0], np.cumsum(widths)])] if len(body) else source[:1]
        n = len(text.encode())
        cuts = np.concatenate([[0], cuts, [n]]) if len(body) else np.array([0, 0, n])
        spans = np.stack([cuts[:-1], cuts[1:]], 1)
        spans[0], spans[-1] = (0, 0), (n, n)
        return ids, spans

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>, spans array<int> (begin and end byte offsets by turns)."""
    kind = docs.schema[id_col].dataType

    def make():
        model = codec(model_file)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            both = [model.encode(t) for t in strings(batch.column(1))]
            ids, spans = [i.astype(np.int32) for i, _ in both], [s.astype(np.int32).ravel() for _, s in both]
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)], dtype=np.int32), np.concatenate(x)) for x in (ids, spans)]
            return pa.RecordBatch.from_arrays([batch.column(0), *lists], ["__id", "ids", "spans"])

        return one

    out = map_rows(docs.select(docs[id_col], filled(text_col).alias("t")), make, f"__id {kind.simpleString()}, ids array<int>, spans array<int>")
    return out.withColumnRenamed("__id", id_col)


def encode_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256, n_spans, spans_sha256, tiled: ``encode`` and
    ``decode`` of each text with the arrays reduced to digests in the same pass.

    tiled: every span begins where the one before it ends, and together they cover the text."""
    kind = docs.schema[id_col].dataType

    def make():
        model = codec(model_file)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in strings(batch.column(1)):
                ids, spans = model.encode(text)
                said = model.decode(ids.tolist())
                tiled = bool((spans[1:, 0] == spans[:-1, 1]).all()) and int(spans[-1, 1]) == len(text.encode())
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest(), len(spans) - 2, hashlib.sha256(spans.astype("<u4").tobytes()).hexdigest(), tiled))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["__id", "n_tokens", "ids_sha256", "decoded_sha256", "n_spans", "spans_sha256", "tiled"])

        return one

    out = map_rows(docs.select(docs[id_col], filled(text_col).alias("t")), make, f"__id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_spans long, spans_sha256 string, tiled boolean")
    return out.withColumnRenamed("__id", id_col)
