"""SentencePiece encoding and decoding with source offsets.

Normalisation goes by the model's compiled character map: at each place a user-defined symbol stays as it is, else the
longest prefix that the map holds is replaced, and every byte of the result keeps the place of the source bytes it came
from; then come the dummy prefix and the escape of spaces. The library segments this normalised text into pieces by a copy of the
model whose own normalisation is switched off, so ids and spans come from the same bytes. Pieces lie end to end on
them, so their byte lengths project each piece, unknown ones too, to the range of original bytes behind it.
Null texts count as empty; repeated rows are encoded alike.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.textblocks import byte_runs

#: Bytes of text encoded together, one text at least; ids, spans and places take about 40 times as much.
BLOCK_BYTES = 1 << 20
MARK = "▁".encode()


@dataclass
class Spec:
    """What normalisation needs from a model file."""

    char_map: dict[bytes, bytes]
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    kept: frozenset[bytes] = frozenset()  # user-defined symbols


def _fields(raw: bytes) -> Iterator[tuple[int, object, bytes]]:
    """Fields of a protocol-buffer message: (number, int or bytes, the field as it stands)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        begin = at
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            at += n
            value = raw[at - n : at]
        yield tag >> 3, value, raw[begin:at]


def without_normaliser(model: bytes) -> bytes:
    """The model with an identity in place of its normaliser: no map, dummy prefix, squeezing or escaping."""
    spec = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"
    return b"".join(field for number, _, field in _fields(model) if number != 3) + b"\x1a" + bytes([len(spec)]) + spec


def expand_char_map(blob: bytes) -> dict[bytes, bytes]:
    """All (source, replacement) pairs of a compiled map: a double-array trie, then replacement texts."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    out: dict[bytes, bytes] = {}

    def offset(u: int) -> int:
        return (u >> 10) << ((u & 512) >> 6)

    stack = [(offset(units[0]), b"")]
    while stack:
        node, prefix = stack.pop()
        for c in range(1, 256):
            child = node ^ c
            if child >= len(units) or units[child] & 0x800000FF != c:
                continue
            unit = units[child]
            below, key = child ^ offset(unit), prefix + bytes([c])
            if unit >> 8 & 1:
                value = units[below] & 0x7FFFFFFF
                out[key] = texts[value : texts.index(b"\0", value)]
            stack.append((below, key))
    return out


def read_spec(model: bytes) -> Spec:
    normaliser, kept = b"", set()
    for number, value, _ in _fields(model):
        if number == 3:
            normaliser = value
        elif number == 1:
            piece = {n: v for n, v, _ in _fields(value)}
            if piece.get(3) == 4:
                kept.add(piece[1])
        elif number == 2 and {n: v for n, v, _ in _fields(value)}.get(24):
            raise ValueError("models that put the mark of a space behind words are not supported")
    got = {n: v for n, v, _ in _fields(normaliser)}
    return Spec(expand_char_map(got.get(2, b"")), bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1)), frozenset(kept))


def normalise(raw: bytes, spec: Spec) -> tuple[bytes, np.ndarray]:
    """(normalised bytes, source place of each of them and of the end)."""
    if not raw:
        return b"", np.zeros(1, np.int64)
    if not spec.char_map and not spec.squeeze and not spec.kept:
        chars = np.frombuffer(raw, np.uint8)
        mark = MARK if spec.escape else b" "
        grown = np.where(chars == 32, len(mark), 1)
        lead = len(mark) if spec.dummy_prefix else 0
        body = raw.replace(b" ", mark)
        places = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(raw)), grown), [len(raw)]])
        return (mark if lead else b"") + body, places
    longest, longest_kept = max(map(len, spec.char_map), default=1), max(map(len, spec.kept), default=0)
    out, places, at = [], [], 0
    while at < len(raw):
        n = next((n for n in range(min(longest_kept, len(raw) - at), 0, -1) if raw[at : at + n] in spec.kept), 0)
        if n:
            out.append(raw[at : at + n])
            places.extend(range(at, at + n))
            at += n
            continue
        for n in range(min(longest, len(raw) - at), 0, -1):
            if (got := spec.char_map.get(raw[at : at + n])) is not None:
                break
        else:
            n = next((k for k in range(1, 5) if at + k >= len(raw) or raw[at + k] & 0xC0 != 0x80), 1)
            got = raw[at : at + n]
        out.append(got)
        places.extend([at] * len(got))
        at += n
    text = b"".join(out)
    if spec.squeeze:
        keep = [k for k, c in enumerate(text) if c != 32 or (k and text[k - 1] != 32)]
        while keep and text[keep[-1]] == 32:
            keep.pop()
        text, places = bytes(text[k] for k in keep), [places[k] for k in keep]
    final, where = bytearray(), []
    if spec.dummy_prefix and text:
        final += MARK if spec.escape else b" "
        where += [places[0] if places else 0] * len(final)
    for c, p in zip(text, places, strict=True):
        got = MARK if c == 32 and spec.escape else bytes([c])
        final += got
        where += [p] * len(got)
    return bytes(final), np.array([*where, len(raw)], np.int64)


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._load(f.read())

    @classmethod
    def of(cls, model: bytes) -> Codec:
        made = cls.__new__(cls)
        made._load(model)
        return made

    def _load(self, model: bytes) -> None:
        import sentencepiece

        self.spec = read_spec(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=without_normaliser(model))
        n = self.library.get_piece_size()
        self.length = np.array([1 if self.library.is_byte(i) else len(self.library.id_to_piece(i).encode()) for i in range(n)], np.int64)
        self.length[[i for i in range(n) if self.library.is_control(i)]] = 0
        self.unknown = self.library.unk_id()

    def encode(self, raws: list[bytes]) -> tuple[list[list[int]], list[np.ndarray]]:
        """(ids of every text with begin and end, (begin, end) of every id in the text's bytes; begin and end ids are empty)."""
        normal = [normalise(r, self.spec) for r in raws]
        texts = [t.decode("utf-8", "replace") for t, _ in normal]
        ids = self.pieces.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        return ids, [self._spans(t, i, places) for t, i, (_, places) in zip(texts, ids, normal, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []

    def _spans(self, text: str, ids: list[int], places: np.ndarray) -> np.ndarray:
        flat = np.asarray(ids)
        sizes = self.length[flat]
        if (flat == self.unknown).any():
            # the vocabulary does not tell an unknown piece's length, the pieces themselves do
            pieces = self.pieces.encode(text, out_type=str, add_bos=True, add_eos=True)
            sizes = np.where(flat == self.unknown, [len(p.encode()) for p in pieces], sizes)
        edge = np.minimum(np.concatenate([[0], np.cumsum(sizes)]), len(places) - 1)
        return np.column_stack([places[edge[:-1]], places[edge[1:]]])


@functools.cache
def _codec(path: str) -> Codec:
    """One per Python worker."""
    return Codec(path)


def encode(docs: DataFrame, model_path: str, with_output: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, spans_crc32, spans_cover) per document; ``with_output``
    adds ids, spans (begin and end in turn) and the decoded text. ``spans_cover``: spans follow each other from the text's
    first byte to its last. A narrow pass: no shuffle."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_crc32 long, spans_cover boolean"
    schema += ", ids array<int>, spans array<long>, decoded string" * with_output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)
        for b in batches:
            all_ids = b.column(0).to_pylist()
            for first, end in byte_runs(b.column(1), BLOCK_BYTES):
                docs_, raw = all_ids[first:end], [(t.as_py() or "").encode("utf-8", "replace") for t in b.column(1)[first:end]]
                ids, spans = codec.encode(raw)
                back = codec.decode(ids)
                cover = [bool((s[1:, 0] == s[:-1, 1]).all()) and s[-1, 1] == len(r) for s, r in zip(spans, raw, strict=True)]
                columns = [pa.array(docs_, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in back], pa.string())]
                columns += [pa.array([len(r) for r in raw], pa.int64()), pa.array([zlib.crc32(np.ascontiguousarray(s, "<i8").tobytes()) for s in spans], pa.int64()), pa.array(cover, pa.bool_())]
                if with_output:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([s.reshape(-1).tolist() for s in spans], pa.list_(pa.int64())), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
