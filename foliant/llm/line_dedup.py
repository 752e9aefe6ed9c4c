"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is a 128-bit hash of the line stripped of ``[\\x20\\x09-\\x0D]`` and lower-cased A-Z.
State, all as tables in the shared folder:

* ``references`` (key, doc_id): which document holds which key, once each;
* ``counts`` (key, n_docs, first_doc, last_doc): the exact reference counts derived from it;
* ``filters`` (shard, table): a cuckoo filter per shard of the keys held by two or more documents.

``insert`` adds documents and ``delete`` takes them away again. Both recount the keys of these documents alone and change the
filters in place: fingerprints of keys newly shared enter their shard's filter, those of keys no longer shared leave it,
so a deleted document's line is kept in the next holder again. A filter that is full is refilled larger from the exact counts, and shards are
dealt anew once they hold twice ``KEYS_PER_SHARD`` on average. References of new documents are added beside the old
ones; counts are written again without a shuffle where the batch's keys are few enough for Spark to send around.

``resolve`` gives the lines to drop: references meet their shard's filter, at every size in the same way: both are dealt by shard,
a shard with many references in parts of about ``REFERENCES_PER_PART``, each with its own copy of the filter. What
passes is joined with the exact counts, so a filter's false positives cost a row and never a result.

Null and empty texts are one empty line. Rows of one doc_id count as one document; rows with a null
doc_id take no part and keep all lines. Hot lines: counts are summed before the shuffle, parts split them at the filters, and the
join on keys is left to adaptive skew splitting. An input column that is named like an added one gets ``_input``
behind its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.io import rename_clashing, settle

MIN_POINTS = 10
SLOTS = 4
KEYS_PER_SHARD = 1 << 16
REFERENCES_PER_PART = 1 << 18
ADDED = ["kept_text", "n_lines", "n_dropped", "kept_sha256"]
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes | None:
    """Key of a line, or None where it is too short to count."""
    bare = line.strip(_STRIP)
    if len(bare) < MIN_POINTS or (len(bare) < 4 * MIN_POINTS and len(bare.decode("utf-8", "replace")) < MIN_POINTS):
        return None
    return xxhash.xxh3_128_digest(bare.lower())


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; a key has two buckets, each reachable from the other by the
    fingerprint. A full filter doubles and is refilled from its keys by the caller."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.85)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @staticmethod
    def _prints(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, first bucket hash) of 16-byte keys given as (n, 2) uint64."""
        return (keys[:, 0] >> np.uint64(48)).astype(np.uint16) | np.uint16(1), keys[:, 1]

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return (bucket ^ (print_.astype(np.uint64) * np.uint64(0x5BD1E995))) & np.uint64(len(self.table) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, h = self._prints(keys)
        one = h & np.uint64(len(self.table) - 1)
        two = self._other(one, p)
        return (self.table[one] == p[:, None]).any(1) | (self.table[two] == p[:, None]).any(1)

    def _in_rounds(self, buckets: tuple[np.ndarray, ...], slot_of, value: np.ndarray) -> np.ndarray:
        """Set a slot for each key, one key a bucket and round; returns the keys that found none. ``slot_of`` marks
        the slots that would do, for keys and their buckets."""
        todo = np.arange(len(value))
        for bucket in buckets:
            while len(todo):
                can = slot_of(todo, bucket[todo])
                able = np.flatnonzero(can.any(1))
                at, first = np.unique(bucket[todo[able]], return_index=True)
                if not len(at):
                    break
                chosen = able[first]
                self.table[at, can[chosen].argmax(1)] = value[todo[chosen]]
                todo = np.delete(todo, chosen)
        return todo

    def insert(self, keys: np.ndarray) -> bool:
        """False when a key finds no place within 500 moves."""
        p, h = self._prints(keys)
        one = h & np.uint64(len(self.table) - 1)
        left = self._in_rounds((one, self._other(one, p)), lambda todo, bucket: self.table[bucket] == 0, p)
        mask = len(self.table) - 1
        for at, f in zip(one[left].tolist(), p[left].tolist(), strict=True):
            for move in range(500):
                slot = move % SLOTS
                f, self.table[at, slot] = int(self.table[at, slot]), f
                at = (at ^ (f * 0x5BD1E995)) & mask
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = f
                    break
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        p, h = self._prints(keys)
        one = h & np.uint64(len(self.table) - 1)
        self._in_rounds((one, self._other(one, p)), lambda todo, bucket: self.table[bucket] == p[todo][:, None], np.zeros(len(p), np.uint16))


def _as_words(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2)


@dataclass
class State:
    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def references(docs: DataFrame) -> DataFrame:
    """(key, doc_id) once for each document and key."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()
            out_key, out_id = [], []
            for i, t in zip(ids, texts, strict=True):
                if i is not None and t:
                    own = {line_key(line) for line in t.split(b"\n")}
                    own.discard(None)
                    out_key.extend(own)
                    out_id.extend([i] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.binary()), pa.array(out_id, pa.int64())], ["key", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(keys, "key binary, doc_id long")


def count_references(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def _shard_column(shards: int):
    low = F.conv(F.hex(F.substring("key", 5, 4)), 16, 10).cast("long")
    return (low % shards).cast("int")


def _shared(counts: DataFrame) -> DataFrame:
    return counts.where("first_doc <> last_doc")


def build_filters(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, table): a filter of each shard's shared keys, about ``KEYS_PER_SHARD`` of them."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = _as_words(sorted(pdf["key"]))
        room = len(keys)
        made = CuckooFilter.sized(room)
        while not made.insert(keys):
            room *= 2
            made = CuckooFilter.sized(room)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "table": [made.table.tobytes()]})

    keyed = _shared(counts).select("key", _shard_column(shards).alias("shard"))
    return keyed.groupBy("shard").applyInPandas(build, "shard int, table binary")


def _change_filters(state: State, counts: DataFrame, joined: DataFrame, left: DataFrame) -> DataFrame:
    """The state's filters with the keys ``joined`` put in and the keys ``left`` taken out. A filter without room is built
    anew from ``counts``."""
    changes = joined.select("key", F.lit(True).alias("put")).unionByName(left.select("key", F.lit(False).alias("put"))).withColumn("shard", _shard_column(state.shards))

    def change(held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        table = held["table"].iloc[0] if len(held) else None
        if len(keys):
            out, put = keys.loc[~keys["put"], "key"], sorted(keys.loc[keys["put"], "key"])
            made = CuckooFilter(np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()) if table is not None else CuckooFilter.sized(len(put))
            made.delete(_as_words(list(out)))
            table = made.table.tobytes() if made.insert(_as_words(put)) else None
        shard = held["shard"].iloc[:1] if len(held) else keys["shard"].iloc[:1]
        return pd.DataFrame({"shard": shard.to_numpy(), "table": [table]})

    changed = settle(state.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change, "shard int, table binary"), "filters")
    full = changed.where("table is null").select("shard")
    if not full.limit(1).count():
        return changed
    keyed = counts.withColumn("shard", _shard_column(state.shards)).join(full, "shard", "left_semi").drop("shard")
    return settle(changed.where("table is not null").unionByName(build_filters(keyed, state.shards)), "filters")


def _new_state(refs: DataFrame, counts: DataFrame) -> State:
    shards = max(1, -(-_shared(counts).count() // KEYS_PER_SHARD))
    return State(refs, counts, settle(build_filters(counts, shards), "filters"), shards)


def _recount(state: State, refs: DataFrame, keys: DataFrame, around: DataFrame) -> State:
    """The state with ``refs`` in place of its references, of which only those of ``keys`` (key) have changed; ``around`` holds
    the references of these keys now."""
    again = settle(count_references(around), "recounted")
    counts = settle(state.counts.join(keys, "key", "left_anti").unionByName(again), "counts")
    if _shared(counts).count() > 2 * KEYS_PER_SHARD * state.shards:
        return _new_state(refs, counts)
    before = _shared(state.counts).join(keys, "key", "left_semi").select("key")
    now = _shared(again).select("key")
    filters = _change_filters(state, counts, now.join(before, "key", "left_anti"), before.join(now, "key", "left_anti"))
    return State(refs, counts, filters, state.shards)


def insert(state: State | None, docs: DataFrame) -> State:
    """``state`` with the documents added; from None, a new state. Known (key, doc_id) pairs stay single."""
    refs = references(docs)
    if state is None:
        if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
            refs = refs.distinct()
        refs = settle(refs, "references")
        return _new_state(refs, settle(count_references(refs), "counts"))
    new = settle(refs.distinct(), "references")
    keys = settle(new.select("key").distinct(), "touched")
    held = settle(state.references.join(keys, "key", "left_semi").select("key", "doc_id"), "held")
    new = settle(new.join(held, ["key", "doc_id"], "left_anti"), "references")
    return _recount(state, state.references.unionByName(new), keys, held.unionByName(new))


def delete(state: State, doc_ids: DataFrame) -> State:
    """``state`` without the documents of ``doc_ids``: counts are redone for their keys alone, and keys
    that are no longer shared leave their shard's filter."""
    gone = doc_ids.select("doc_id").distinct()
    refs = settle(state.references.join(gone, "doc_id", "left_anti").select("key", "doc_id"), "references")
    keys = settle(state.references.join(gone, "doc_id", "left_semi").select("key").distinct(), "touched")
    return _recount(state, refs, keys, refs.join(keys, "key", "left_semi").select("key", "doc_id"))


def _probe(state: State) -> DataFrame:
    """References that their shard's filter lets through."""
    shard = _shard_column(state.shards)
    # a row for about KEYS_PER_SHARD shared keys
    parts = state.counts.groupBy(shard.alias("shard")).agg(F.ceil(F.sum("n_docs") / REFERENCES_PER_PART).cast("int").alias("parts"))
    refs = state.references.withColumn("shard", shard).join(parts, "shard")
    refs = refs.select("shard", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), "key", "doc_id", F.lit(None).cast("binary").alias("table"))
    held = state.filters.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"), "table")
    dealt = held.unionByName(refs).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("table").isNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            place = np.column_stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)])
            is_filter = b.column(4).is_valid().to_numpy(zero_copy_only=False)
            ok = np.zeros(b.num_rows, bool)
            starts = np.flatnonzero(np.concatenate([[True], is_filter[1:] | (place[1:] != place[:-1]).any(1)])) if b.num_rows else []
            for x, y in zip(starts, [*starts[1:], b.num_rows], strict=True):
                if is_filter[x]:
                    at, held = tuple(place[x]), CuckooFilter(np.frombuffer(b.column(4)[int(x)].as_py(), np.uint16).reshape(-1, SLOTS))
                    x += 1
                if x < y and at == tuple(place[x]):
                    ok[x:y] = held.contains(_as_words(b.column(2).slice(x, y - x).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3)], ["key", "doc_id"]).filter(pa.array(ok))

    return dealt.mapInArrow(probe, "key binary, doc_id long")


def resolve(state: State) -> DataFrame:
    """(doc_id, drops): keys whose lines a document loses."""
    first = _shared(state.counts).select("key", "first_doc")
    lost = _probe(state).join(first, "key").where("doc_id <> first_doc")
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("drops"))


def _apply(text: bytes | None, drops: list[bytes] | None) -> tuple[bytes, int, int]:
    text = text or b""
    if not drops:
        return text, text.count(b"\n") + 1, 0
    gone, lines = set(drops), text.split(b"\n")
    kept = [x for x in lines if line_key(x) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _cut(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """(row: a struct of the input's columns but text, cut: a struct of what is left) of every row."""
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    packed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), rest.alias("row"))
    joined = packed.join(drops.withColumnRenamed("doc_id", "_drop_id").hint("merge"), F.col("_id") == F.col("_drop_id"), "left")

    @F.pandas_udf("text string, n_lines long, n_dropped long, sha string")
    def cut(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = []
        for t, d in zip(texts, keys, strict=True):
            kept, n, lost = _apply(None if t is None else t.encode("utf-8", "surrogatepass"), None if d is None else list(d))
            rows.append((kept.decode("utf-8", "replace"), n, lost, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped", "sha"])

    return joined.select("row", cut("_text", "drops").alias("cut"))


def rewrite(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """``docs`` with kept_text, n_lines, n_dropped and kept_sha256 instead of text; other columns stay."""
    docs = rename_clashing(docs, ADDED)
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    values = [F.col(f"cut.{c}").alias(a) for c, a in zip(("text", "n_lines", "n_dropped", "sha"), ADDED, strict=True)]
    return _cut(docs, drops).select(F.col("row.doc_id").cast("long").alias("doc_id"), *values, *[F.col("row").getField(c).alias(c) for c in names])


def dedup(docs: DataFrame) -> DataFrame:
    return rewrite(docs, resolve(insert(None, docs.select("doc_id", "text"))))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, without the lines that an earlier document holds; n_chars follows the text."""
    out = _cut(docs, resolve(insert(None, docs.select("doc_id", "text"))))
    made = {"text": F.col("cut.text"), "n_chars": F.length("cut.text")}
    return out.select(*[made.get(c, F.col("row").getField(c) if c != "text" else None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
