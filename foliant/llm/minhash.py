"""MinHash near-dedup with tensored banding.

A document has ``COLLECTIONS`` small collections of ``ROWS`` minhashes; a table's key combines a pair
of collections, so 190 tables cost 60 minhashes. Keys are formed only from collection values that some
other document shares, and once for documents whose shared values are all the same. Documents
meeting in a table are joined to its least one; components of that graph hold all links.

Verification compares whole shingle sets in two passes. First every document is compared with the
one that it meets in most tables, and with up to ``BLOCK`` others that chose the same one: work linear
in the documents, after which nearly all of a group of near copies is linked. Then only documents of
one component that are still apart are compared, in pairs of blocks, and only of blocks that hold two documents of one
table: work follows the tables that unlinked documents share and not the square of a component. A linked part of over
``BLOCK`` documents has blocks of its own, which are never compared with each other. Blocks hold about ``BLOCK`` documents
and ``BLOCK_SHINGLES`` shingles, whichever is less, so groups of long texts are cut finer.

At Jaccard 0.75 two documents share no table with probability 3e-4, and then still
meet where a chain of other documents connects them. Equal sets are one class before
all this, so a group of copies costs one row. Comparing a block gives a spanning forest and never its pairs.

Null and empty texts have an empty set and stay alone. Rows of one doc_id with
different texts are judged each by its text, and its links are those of all its rows; rows with a null
doc_id take no part and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.components import components
from foliant.llm.io import settle
from foliant.llm.textblocks import blocks, distinct_sorted, mix, shingle_hashes

COLLECTIONS, ROWS = 20, 3
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, slots array<long>"


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, 128-bit set hash and the collections' values of every document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(COLLECTIONS * ROWS)
        for b in batches:
            for first, end, data, at in blocks(b, "text"):
                h, off = shingle_hashes(data, at)
                h, new = distinct_sorted(h, off)
                n_texts = end - first
                some = np.flatnonzero(np.diff(off))
                heads = off[:-1][some]
                size, one, two = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.uint64), np.zeros(n_texts, np.uint64)
                slots = np.zeros((n_texts, COLLECTIONS), np.uint64)
                if len(some):
                    size[some] = np.add.reduceat(new.astype(np.int64), heads)
                    for out, salt in ((one, 0xA5A5), (two, 0x5A5A5A)):
                        out[some] = np.add.reduceat(np.where(new, mix(h ^ np.uint64(salt)), np.uint64(0)), heads)
                    for c in range(COLLECTIONS):
                        value = np.full(len(some), c + 1, np.uint64)
                        for r in range(ROWS):
                            value = mix(value ^ np.minimum.reduceat(h * seeds[c * ROWS + r], heads))
                        slots[some, c] = value
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, COLLECTIONS, 0))]), pa.int32()), pa.array(slots[size > 0].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n_texts).cast(pa.int64()), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], ["doc_id", "n_shingles", "set_a", "set_b", "slots"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, SIGNATURE)


def candidate_edges(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b, n): class representatives, the least one of a table that they meet in, and in how many;
    (rep, head, key): the tables of every representative that may meet another, under its stand-in's name)."""
    values = reps.select("rep", F.explode("slots").alias("h"))
    shared = values.groupBy("h").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("h")
    held = values.join(shared, "h").groupBy("rep").agg(F.sort_array(F.collect_set("h")).alias("hs")).where(F.size("hs") > 1)  # COLLECTIONS a text at most
    held = settle(held, "shared")
    # documents with the same shared values meet in all their tables: one of them stands for the rest there
    heads = settle(held.groupBy("hs").agg(F.min("rep").alias("head")), "heads")
    alike = held.join(heads, "hs").where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    # slot values hold their collection's number, so a pair of values names a pair of collections
    pairs = F.flatten(F.transform("hs", lambda x, i: F.transform(F.slice("hs", i + 2, F.size("hs")), lambda y: F.xxhash64(x, y))))
    keys = settle(heads.select(F.col("head").alias("rep"), F.explode(pairs).alias("key")), "keys")
    tables = keys.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("hi")).where("b < hi").select("key", "b")
    met = keys.join(tables, "key").where("rep <> b").groupBy(F.col("rep").alias("a"), "b").agg(F.count("*").alias("n"))
    own = held.join(heads, "hs").select("rep", "head")
    return met.unionByName(alike.withColumn("n", F.lit(COLLECTIONS**2).cast("long"))), own.join(keys.withColumnRenamed("rep", "head"), "head")


def _blocks(n, shingles):
    """Number of blocks for so many documents with so many shingles together."""
    return F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def _links(groups: pd.DataFrame) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows (doc_id, block, shingles); links inside a block
    count only where the group is that one block."""
    sets = [np.asarray(s, np.int64) for s in groups["shingles"]]
    ids, block = groups["rep"].to_numpy(np.int64), groups["block"].to_numpy(np.int64)
    size = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    df = np.bincount(column, minlength=len(values))
    keep = df[column] > 1
    _, column = np.unique(column[keep], return_inverse=True)
    row = row[keep]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        both += m @ m.T
    union = size[:, None] + size[None, :] - both
    linked = 100 * both.astype(np.int64) >= 75 * union.astype(np.int64)
    if len(set(block.tolist())) > 1:
        linked &= block[:, None] != block[None, :]
    np.fill_diagonal(linked, False)
    out, free = [], np.ones(len(sets), bool)
    for start in np.argsort(ids):
        front = np.zeros(len(sets), bool)
        front[start] = free[start]
        while front.any():
            free &= ~front
            reach = linked[front].any(0) & free
            for k in np.flatnonzero(reach).tolist():
                out.append((int(ids[k]), int(ids[start])))
            front = reach
    return out


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(_links(pdf), columns=["a", "b"], dtype="int64")


def _with_sets(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """``placed`` (rep, ...) with the shingle set of each rep's texts."""
    names = placed.columns

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, at in blocks(b, "text"):
                h, off = shingle_hashes(data, at)
                h, new = distinct_sorted(h, off)
                edge = np.concatenate([[0], np.cumsum(new)])[off]
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(first, end - first) for k in range(len(names))], pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(h[new].view(np.int64)))], [*names, "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    # texts go by doc_id at every size: a broadcast of the members would not last as they grow
    held = texts.join(placed.hint("merge"), texts["doc_id"] == placed["rep"]).select(*names, "text")
    return held.mapInArrow(sets, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema) + ", shingles array<long>")


def nearest_links(docs: DataFrame, edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links of 0.75 or more (a, b) among a document and those that meet it in most of their tables.

    A document's followers are split into parts of about a block, and it goes to each of them. ``sizes`` (rep, n_shingles)."""
    nearest = edges.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    nearest = settle(nearest.join(sizes.withColumnRenamed("rep", "a"), "a"), "nearest")
    parts = nearest.groupBy("b").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("n_parts"))
    part = F.pmod(F.xxhash64("a"), "n_parts").cast("int")
    followers = nearest.join(parts, "b").select(F.col("a").alias("rep"), F.col("b").alias("hub"), part.alias("first"), part.alias("last"))
    hubs = parts.select(F.col("b").alias("rep"), F.col("b").alias("hub"), F.lit(0).alias("first"), (F.col("n_parts") - 1).alias("last"))
    spread = _with_sets(docs, followers.unionByName(hubs)).select("rep", "hub", F.explode(F.sequence("first", "last")).alias("part"), F.lit(0).alias("block"), "shingles")
    return spread.groupBy("hub", "part").applyInPandas(_verify, "a long, b long")


def remaining_links(docs: DataFrame, edges: DataFrame, tables: DataFrame, sizes: DataFrame, linked: DataFrame) -> DataFrame:
    """Links of 0.75 or more (a, b) between parts of ``linked`` (node, component) that ``edges`` (a, b)
    connect: only documents of such parts that share a table with another part's are read again."""
    ends = edges.select("a", "b")
    for end in ("a", "b"):
        label = linked.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        ends = ends.join(label, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    apart = ends.where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    clusters = components(apart).select(F.col("node").alias("label"), "component")
    members = linked.select(F.col("component").alias("label"), F.col("node").alias("rep"))
    labelled = clusters.join(members, "label", "left").select(F.coalesce("rep", "label").alias("rep"), "component", "label")
    labelled = settle(labelled.join(sizes, "rep"), "labelled")
    parts = labelled.groupBy("component", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    parts = parts.withColumn("big", (F.col("n") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES))
    parts = parts.withColumn("own", F.when(F.col("big"), F.col("label")).otherwise(F.lit(0)))
    # a component has fewer rows here than one in a block of its documents, and one for all its small parts
    groups = parts.groupBy("component", "big", "own").agg(_blocks(F.sum("n"), F.sum("shingles")).alias("n_blocks"))
    before = Window.partitionBy("component").orderBy("big", "own").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("at", F.coalesce(F.sum("n_blocks").over(before), F.lit(0)).cast("int"))
    places = parts.join(groups, ["component", "big", "own"]).select("component", "label", "big", "own", "at", "n_blocks")
    block = (F.col("at") + F.pmod(F.xxhash64("rep"), "n_blocks")).cast("int")
    placed = settle(labelled.join(places, ["component", "label"]).select("rep", "component", "label", F.when(F.col("big"), F.col("own")).alias("own"), block.alias("block")), "placed")
    # blocks of each table that parts share, and the pairs of blocks that some table asks for
    met = tables.join(placed, "rep").groupBy("component", "key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.array_sort(F.collect_set(F.struct("block", "own"))).alias("bs"))
    pairs = F.flatten(F.transform("bs", lambda x, i: F.transform(F.slice("bs", i + 1, F.size("bs")), lambda y: F.struct(x["block"].alias("lo"), y["block"].alias("hi"), F.coalesce(x["own"] == y["own"], F.lit(False)).alias("same")))))
    asked = met.where("least < most").select("component", F.explode(pairs).alias("p")).where("not p.same").select("component", "p.lo", "p.hi").distinct()
    asked = settle(asked, "block-pairs")
    both = asked.select("component", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"), "lo", "hi")
    wanted = both.groupBy("component", "block").agg(F.collect_list(F.struct("lo", "hi")).alias("pairs"))
    spread = _with_sets(docs, placed.join(wanted, ["component", "block"]).select("rep", "component", "block", "pairs"))
    spread = spread.select("rep", "component", "block", F.explode("pairs").alias("p"), "shingles").select("rep", "component", "block", "p.lo", "p.hi", "shingles")
    return spread.groupBy("component", "lo", "hi").applyInPandas(_verify, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    signed = settle(signatures(docs), "signatures")
    own = signed.where("doc_id is not null")
    classes = own.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("slots", "doc_id").alias("slots"))
    classes = settle(classes, "classes")
    edges, tables = candidate_edges(classes)
    edges, sizes = settle(edges, "candidates"), classes.select("rep", "n_shingles")
    linked = settle(components(nearest_links(docs, edges, sizes)), "linked")
    stars = linked.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = components(stars.unionByName(remaining_links(docs, edges, tables, sizes, linked)))
    found = classes.select("set_a", "set_b", F.col("n_shingles").alias("n"), "rep").join(links, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component"))
    found = found.withColumnsRenamed({"set_a": "a", "set_b": "b"})
    s = signed.alias("s")
    out = s.join(found, (F.col("s.set_a") == F.col("a")) & (F.col("s.set_b") == F.col("b")) & (F.col("s.n_shingles") == F.col("n")) & F.col("s.doc_id").isNotNull(), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, columns as they are; rows with a null doc_id stay."""
    lost = near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct()
    return docs.join(lost.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
