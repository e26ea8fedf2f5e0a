"""SentencePiece encoding with source offsets, and decoding.

Normalisation walks the text with the longest prefix that the model's compiled character map
knows and records, for each normalised byte, the source byte it stems from. Ids come from the
sentencepiece library; each piece covers a run of normalised bytes, which the recorded alignment
projects to a half-open span of UTF-8 bytes of the original text. The pieces must cover the
normalised text to the byte; anything else is an error, so a wrong alignment cannot pass. A model
without a character map, as the default one, maps every character to itself.

Defined cases: a null text counts as empty; an empty text yields only begin and end ids; repeated
rows stay repeated; texts of any length are encoded whole; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import table

MODEL = "piece_bpe_32k.model"
_SPACE = "▁".encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _varint(buf: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = buf[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def proto_fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol-buffer message."""
    i = 0
    while i < len(buf):
        key, i = _varint(buf, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(buf, i)
        else:
            size, i = _varint(buf, i) if kind == 2 else ({5: 4, 1: 8}[kind], i)
            value, i = buf[i : i + size], i + size
        yield key >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie over source prefixes, and the replacement strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :] if size else b""

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of ``text[at:]``."""
        if not self.units:
            return None
        found = None
        node = self._offset(self.units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & ((1 << 31) | 0xFF) != text[i]:
                break
            node ^= self._offset(unit)
            if (unit >> 8) & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found


class Codec:
    """One loaded model; made once in each Python worker."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        blob, self.dummy, self.trim, self.escape = b"", True, True, True
        with open(path, "rb") as f:
            for field, value in proto_fields(f.read()):
                if field == 3:
                    for k, v in proto_fields(value):
                        if k == 2:
                            blob = v
                        elif k == 3:
                            self.dummy = bool(v)
                        elif k == 4:
                            self.trim = bool(v)
                        elif k == 5:
                            self.escape = bool(v)
        self.map = CharacterMap(blob)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        #: normalised bytes that each id covers
        self.width = np.array(
            [
                0 if self.sp.is_control(i) else 1 if self.sp.is_byte(i) else len(p.encode())
                for i, p in enumerate(pieces)
            ],
            np.int64,
        )

    def normalize(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each boundary between them the source byte where its unit starts; the end last."""
        space = _SPACE if self.escape else b" "
        if not self.map.units and not self.trim:  # nothing is replaced: each byte stands for itself, a space for its mark
            raw, head = np.frombuffer(source, np.uint8), len(space) if self.dummy and source else 0
            starts = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(space), 1))
            return space[:head] + source.replace(b" ", space), np.concatenate([np.zeros(head, np.int64), starts, [len(raw)]])
        at = 0
        while self.trim and at < len(source):
            n, put = self._unit(source, at)
            if put != b" ":
                break
            at += n
        if at == len(source):
            return b"", np.array([at], np.int64)
        out, starts = bytearray(space if self.dummy else b""), [at] * (len(space) if self.dummy else 0)
        after_space = self.trim
        while at < len(source):
            n, put = self._unit(source, at)
            if after_space:
                put = put.lstrip(b" ")
            if put:
                after_space = self.trim and put.endswith(b" ")
                put = put.replace(b" ", space)
                out += put
                starts += [at] * len(put)
            at += n
        end = at
        while self.trim and out.endswith(space):
            end = starts[-len(space)]
            del out[-len(space) :], starts[-len(space) :]
        return bytes(out), np.array([*starts, end], np.int64)

    def _unit(self, source: bytes, at: int) -> tuple[int, bytes]:
        """Length and normal form of the longest known prefix at a place, or of the character there."""
        found = self.map.longest(source, at)
        if found is None:
            lead = source[at]
            n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            found = n, source[at : at + n]
        return found

    def spans(self, source: bytes, ids: list[int]) -> np.ndarray:
        """Start and end byte in ``source`` of every id, as rows of a two-column array."""
        normal, starts = self.normalize(source)
        width = self.width[np.asarray(ids, np.int64)]
        unknown = np.asarray(ids) == self.sp.unk_id()
        if unknown.any():  # as wide as what it stands for
            said = self.sp.encode(source.decode(), out_type="immutable_proto").pieces
            own = [len(p.piece.encode()) for p in said if p.id == self.sp.unk_id()]
            width[unknown] = own
        ends = np.cumsum(width)
        if (ends[-1] if len(ends) else 0) != len(normal):
            raise ValueError("pieces and normalised text differ")
        edge = starts[np.concatenate([[0], ends]).astype(np.int64)]
        return np.stack([edge[:-1], edge[1:]], 1)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str | None = None, with_spans: bool = True) -> DataFrame:
    """Rows ``(doc_id, ids, starts, ends, decoded)`` for ``docs(doc_id, text)``: ids with begin and end, byte spans, the text decoded again."""
    path = model or default_model()

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = c.sp.encode(texts, add_bos=True, add_eos=True, num_threads=1)
            spans = [c.spans(t.encode(), i) for t, i in zip(texts, ids, strict=True)] if with_spans else None
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([s[:, 0] for s in spans] if spans else [None] * len(texts), pa.list_(pa.int64())),
                    pa.array([s[:, 1] for s in spans] if spans else [None] * len(texts), pa.list_(pa.int64())),
                    pa.array(c.sp.decode(ids, num_threads=1), pa.string()),
                ],
                ["doc_id", "ids", "starts", "ends", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string"
    )


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The digest of :func:`encode`, made in the same Python pass so that only digests leave it.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256, and covered_bytes, the source bytes
    that the projected spans cover without a gap.
    """
    path = model or default_model()

    def run(batches):
        c = codec(path)
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                texts = [t or "" for t in b.column("text").to_pylist()]
                ids = c.sp.encode(texts, add_bos=True, add_eos=True, num_threads=1)
                covered = []
                for t, i in zip(texts, ids, strict=True):
                    s = c.spans(t.encode(), i)
                    covered.append(int((s[:, 1] - s[:, 0]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in ids]),
                        pa.array([hashlib.sha256(d.encode()).hexdigest() for d in c.sp.decode(ids, num_threads=1)]),
                        pa.array(covered, pa.int64()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long"
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
