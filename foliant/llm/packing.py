"""Best-fit packing by length-histogram planning.

Documents become token counts and pieces of at most ``CAPACITY``; only a histogram of piece lengths
(``CAPACITY`` entries at any input) reaches the driver. Best-fit decreasing runs over those counts,
a whole run of sequences alike at a time. A piece then takes its slot by its rank within its length: ranks come from
counts per task and length, added up before, never from sorting all pieces of one length in one task.

Null and empty texts are one id 0. A document of exactly ``CAPACITY`` ids is one piece. Rows of one
doc_id are packed each by itself.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.io import settle
from foliant.llm.textblocks import byte_runs

CAPACITY = 2048
BLOCK_BYTES = 8 << 20
WORDS_KEPT = 300_000
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_TAIL = ",.!?;:*#$%&"
#: Words of these letters alone are lower-cased and encoded by the library one by one, whatever stands beside them.
_PLAIN = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+$"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, seat long"


class Vocabulary:
    """Ids of words seen, end to end in one array; at ``WORDS_KEPT`` words it starts anew."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.words = self.used = 0

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        def room(held: np.ndarray, n: int) -> np.ndarray:
            return held if len(held) >= n else np.concatenate([held, np.zeros(max(n, 2 * len(held)) - len(held), held.dtype)])

        n, m = self.words + len(names), self.used + len(ids)
        self.flat, self.start, self.size = room(self.flat, m), room(self.start, n), room(self.size, n)
        self.flat[self.used : m], self.size[self.words : n] = ids, sizes
        self.start[self.words : n] = self.used + np.cumsum(sizes) - sizes
        self.number.update(zip(names, range(self.words, n), strict=True))
        self.words, self.used = n, m


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every run of ``size``, run after run."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class WordTokenizer:
    """Ids of many whole texts at once. The tokenizer splits at white space before anything else, so the
    parts between spaces and line feeds are told apart once a block, and each distinct part is encoded once:
    as a plain word and its punctuation where it is one, else by the library as it stands. Plain
    words are encoded many at a time and told apart by their end-of-word tokens. Texts that hold a special
    token's string go through the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known = Vocabulary()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, texts: list[str]) -> None:
        """Each text by itself."""
        for k in range(0, len(texts), 4096):
            got = self._ids(some := texts[k : k + 4096])
            self.known.add(some, np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64))

    def _learn_words(self, words: list[str]) -> None:
        """Plain lower-case words, joined by spaces."""
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            ids = np.array(self._ids([" ".join(some)])[0], np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(some):
                self.known.add(some, ids, np.diff(stop, prepend=0))
            else:
                self._learn(some)

    def _numbers(self, names: pa.Array, learn) -> np.ndarray:
        listed = names.to_pylist()
        if new := [w for w in listed if w not in self.known.number]:
            learn(new)
        return np.fromiter(map(self.known.number.__getitem__, listed), np.int64, len(listed))

    def _of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of distinct parts end to end, start and size of each)."""
        if self.known.words > WORDS_KEPT:
            self.known = Vocabulary()
        core = pc.utf8_rtrim(parts, _TAIL)
        plain = pc.match_substring_regex(core, _PLAIN).to_numpy(zero_copy_only=False)
        head, tail = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        at, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        words = pc.utf8_lower(core.take(pa.array(at))).dictionary_encode()
        head[at] = self._numbers(words.dictionary, self._learn_words)[words.indices.to_numpy()]
        head[odd] = self._numbers(parts.take(pa.array(odd)), self._learn)
        cut = pc.subtract(pc.binary_length(parts), pc.binary_length(core)).to_numpy()
        ended = np.flatnonzero(plain & (cut > 0))
        tails = pa.array([p[-n:] for p, n in zip(parts.take(pa.array(ended)).to_pylist(), cut[ended].tolist(), strict=True)], pa.string()).dictionary_encode()
        tail[:] = self._numbers(pa.array([""]), self._learn)[0]
        tail[ended] = self._numbers(tails.dictionary, self._learn)[tails.indices.to_numpy()]
        both, v = np.column_stack([head, tail]).reshape(-1), self.known
        sizes = v.size[both]
        own = sizes.reshape(-1, 2).sum(1)
        return v.flat[_spread(v.start[both], sizes)], np.cumsum(own) - own, own

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each text's ids followed by ``end``; number of ids of each text)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        special = {int(k): ids for k in whole if any(s in (t := texts[int(k)].as_py()) for s in _SPECIAL) for ids in self._ids([t])}
        if special:
            texts = pc.if_else(pa.array(np.isin(np.arange(len(texts)), list(special))), "", texts)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        parts = split.flatten().dictionary_encode()
        flat, start, size = self._of_parts(parts.dictionary.cast(pa.string()))
        # one more word stands for the end of a text
        flat, start, size = np.append(flat, np.uint32(end)), np.append(start, len(flat)), np.append(size, 1)
        count = pc.list_value_length(split).to_numpy().astype(np.int64)
        last = np.cumsum(count)
        code = np.insert(parts.indices.to_numpy().astype(np.int64), last, len(size) - 1)
        sizes = size[code]
        n = np.add.reduceat(sizes, last - count + np.arange(len(count)))
        ids = flat[_spread(start[code], sizes)]
        for k in sorted(special, reverse=True):
            a = int(n[:k].sum())
            ids = np.concatenate([ids[:a], np.array([*special[k], end], np.uint32), ids[a + n[k] :]])
            n[k] = len(special[k]) + 1
        return ids, n


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    """One per Python worker: its memory of words outlives a task."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its seat: the number of earlier pieces of its length in its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = _tokenizer(tokenizer_path), TaskContext.get().partitionId()
        seats = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for first, end in byte_runs(b.column(1), BLOCK_BYTES):
                docs_ = b.column(0).slice(first, end - first)
                ids, n = tokenizer.encode(b.column(1).slice(first, end - first), 0)
                count = -(-n // capacity)
                owner, place = np.repeat(np.arange(len(n)), count), _spread(np.zeros(len(n), np.int64), count)
                start = place * capacity
                length = np.minimum(n[owner] - start, capacity)
                raw, edge = memoryview(ids.astype("<u4").tobytes()), 4 * np.concatenate([[0], np.cumsum(length)])
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                per = np.bincount(length, minlength=capacity + 1)
                seat = np.empty(len(length), np.int64)
                seat[order] = _spread(seats[np.flatnonzero(per)], per[per > 0])
                seats += per
                columns = [docs_.take(pa.array(owner)), pa.array(place.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(owner), part, np.int32)), pa.array(seat)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, number, first sequence, offset): the pieces of a length with ranks
    from first rank on go, one each, to the sequences from first sequence on, all at that offset.

    Best-fit decreasing over counts: from the longest length down, pieces go to the sequences with the
    least room that still takes them, a whole run of sequences alike at a time; when none has room,
    new ones open, each with as many pieces of this length as it holds."""
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, number)
    rooms = np.zeros(capacity + 1, np.int64)
    slots, opened = [], 0

    def leave(room: int, first: int, number: int) -> None:
        if number and room:
            runs.setdefault(room, []).append((first, number))
            rooms[room] += number

    for length in sorted((n for n in histogram if histogram[n]), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                first, number = runs[room].pop()
                rooms[room] -= number
                used = min(left, number)
                slots.append((length, rank, used, first, capacity - room))
                leave(room - length, first, used)
                leave(room, first + used, number - used)
                rank, left = rank + used, left - used
                continue
            each = min(capacity // length, left)
            number = left // each
            for k in range(each):
                slots.append((length, rank, number, opened, k * length))
                rank += number
            leave(capacity - each * length, opened, number)
            opened, left = opened + number, left - each * number
    return slots


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and offset."""
    spark = docs.sparkSession
    cut = settle(pieces(docs, tokenizer_path, capacity), "pieces")
    per_task = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = settle(per_task.withColumn("base", before), "bases")
    histogram = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots = plan(histogram, capacity)
    by_length: dict[int, list] = {}
    for length, rank, number, sequence, offset in slots:
        by_length.setdefault(length, []).append((rank, sequence, offset))
    tables = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in by_length.items()}
    held = spark.sparkContext.broadcast(tables)  # bounded by capacity, not by documents

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                first, start, place = held.value[n]
                at = length == n
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = start[k] + rank[at] - first[k], place[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(base.drop("n"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("seat")).alias("rank"))
    return ranked.mapInArrow(seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
