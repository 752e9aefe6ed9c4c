"""Prefix trie of conversations, built as burst tries.

A node is a distinct sequence of first turns. A trie head is a node whose conversations' remaining turns, its suffix container,
are kept together. The root is the first head; a container of over ``CONTAINER_TURNS`` turns bursts: its conversations go
to heads further down, named by their next turn ids, one level down at first and twice as deep each time after it, so
copies of a long conversation cost a logarithm of rounds. Nodes that bursting passes, the crown, are counted with plain
aggregations. Every other container lies whole in a shard, where its suffixes are sorted and swept into nodes: the
longest common prefix with the suffix before tells which nodes close, and a closing node hands its sums to the one above.

A turn's id is a digest of its role and text, and a node's name combines the ids of its turns and their places by exclusive or, two
numbers of 64 bits, so names of any depth come from sums over blocks of turns and no conversation has to be read in one go.

Sums over the crown's subtrees follow paths. The nodes with the same least member form one path downwards; a path's sum
goes to the node that its top hangs from, and on from there, a round per path on the way to the root. Running sums along
the paths then give every node's. Digests of members that end at a node are cut into pieces of sorted ids in many tasks, and
only these pieces stream, in order, through the task that digests them.

Turns are ordered by turn (null first), role and text; null roles and texts count as empty, repeated rows are turns of
their own, rows with a null conv_id take no part, an empty table has no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.io import settle
from foliant.operators.numbering import numbered

#: Turns of a container that stays whole; places in a block of a conversation; ids in a piece of a digest.
CONTAINER_TURNS, BLOCK, PIECE_IDS = 4096, 1024, 20_000
NO_IDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
KEY = ["key_a", "key_b"]
LONGS = {n: pa.int64() for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "head_a", "head_b", "key_a", "key_b", "first")}


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_id, words): every turn with its place from 1 in its conversation, its id and its number of words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    turn_id = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    rows = numbered(rows, "conv_id", F.asc_nulls_first("turn"), "role", "text", keep=["conv_id", turn_id.alias("turn_id"), words.cast("long").alias("words")])
    first = rows.groupBy("conv_id").agg(F.min("number").alias("first"))
    return rows.join(first, "conv_id").select("conv_id", (F.col("number") - F.col("first") + 1).alias("place"), "turn_id", "words")


def share_heads(turns: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from ``turns``: the first ``head`` turns of conversation ``base`` (both of a conv_id), then the own turns
    after the first ``head``. Returns the turns, and (conv_id, n) of all conversations, n turns long, 0 too. ``head`` is 3 at most."""
    turns = settle(turns, "turns")
    first = turns.where("place <= 3").groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "turn_id", "words"))).alias("first"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", "own", base.alias("base"), head.cast("int").alias("head")).join(first, "base", "left")
    taken = F.when(F.col("head") > 0, F.slice("first", 1, "head"))
    convs = settle(convs.select("conv_id", "own", "head", F.coalesce(taken, F.expr("slice(array(named_struct('place', 0L, 'turn_id', x'', 'words', 0L)), 1, 0)")).alias("taken")), "heads")
    given = convs.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.place", "t.turn_id", "t.words")
    moved = convs.select("conv_id", "head", F.size("taken").alias("given"))
    own = turns.join(moved, "conv_id").where("place > head").select("conv_id", (F.col("place") - F.col("head") + F.col("given")).alias("place"), "turn_id", "words")
    return given.unionByName(own), convs.select("conv_id", (F.size("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).cast("long").alias("n"))


def running(rows: DataFrame, group: str, place: str, columns: list[str], total, add) -> DataFrame:
    """``rows`` with running totals of ``columns`` along ``place`` (a column of longs) within ``group``: totals of blocks of
    places first, then places within a block, so a group of any size is spread over tasks. ``rows`` is read twice."""
    rows = rows.withColumn("_block", F.floor(F.col(place) / BLOCK))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(group, "_block").agg(*[total(c).alias(f"_{c}") for c in columns])
    starts = starts.select(group, "_block", *[F.coalesce(total(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    within = Window.partitionBy(group, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(starts, [group, "_block"])
    return out.withColumns({c: add(F.col(f"_{c}"), total(c).over(within)) for c in columns}).drop("_block", *[f"_{c}" for c in columns])


def named_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, words, key_a, key_b, up_a, up_b): the names of the nodes that end at each turn and before it; the root's is (0, 0)."""
    own = settle(turns.select("conv_id", "place", "words", F.xxhash64("place", "turn_id").alias("own_a"), F.xxhash64("turn_id", "place", F.lit(1)).alias("own_b")), "turn-names")
    keyed = own.withColumns({"key_a": F.col("own_a"), "key_b": F.col("own_b")})
    keyed = running(keyed, "conv_id", "place", KEY, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return keyed.select("conv_id", "place", "words", *KEY, F.col("key_a").bitwiseXOR(F.col("own_a")).alias("up_a"), F.col("key_b").bitwiseXOR(F.col("own_b")).alias("up_b"))


def burst(named: DataFrame, convs: DataFrame, most: int) -> DataFrame:
    """(conv_id, bare, head_a, head_b): the depth and the name of the head whose container holds a conversation's other turns. A
    conversation that ends in the crown has none."""
    root = [F.lit(0).cast("long").alias(c) for c in ("bare", "head_a", "head_b")]
    active = convs
    if (convs.agg(F.sum("n")).first()[0] or 0) <= most:
        return convs.where("n > 0").select("conv_id", *root)
    levels, depth = [], 0
    while True:
        depth = max(1, 2 * depth)
        at = settle(named.where(F.col("place") == depth).join(active.select("conv_id", "n"), "conv_id").select("conv_id", "n", *KEY), "burst")
        large = at.groupBy(*KEY).agg(F.sum(F.col("n") - depth).alias("turns")).where(F.col("turns") > most).select(*KEY, F.lit(True).alias("large"))
        level = settle(at.join(large, KEY, "left").withColumn("large", F.coalesce("large", F.lit(False))), "level")
        levels.append(level.where(F.col("large") | (F.col("n") > depth)).where("not large").select("conv_id", F.lit(depth).cast("long").alias("bare"), F.col("key_a").alias("head_a"), F.col("key_b").alias("head_b")))
        active = level.where("large")
        if active.isEmpty():
            break
    placed = levels[0]
    for level in levels[1:]:
        placed = placed.unionByName(level)
    return placed


def _sweep_one(head: tuple[int, int], bare: int, suffixes: list[tuple[list, list, int]], out: dict[str, list]) -> None:
    """Nodes of one container: ``suffixes`` (node names, words, conv_id), sorted, against a stack of open nodes."""
    suffixes.sort(key=lambda s: (s[0], s[2]))

    def emit(*row) -> None:
        for column, v in zip(out.values(), row, strict=True):
            column.append(v)

    # name, words, least member, members, children, leaves, saved, ids of members that end here, children that wait for its least member
    stack: list[list] = [[None, 0, None, 0, 0, 0, 0, [], []]]

    def close() -> None:
        name, words, least, members, children, leaves, saved, ends, waiting = stack.pop()
        top = stack[-1]
        saved += (members - 1) * words
        leaves = leaves or 1
        depth = bare + len(stack)
        for row in waiting:
            emit(*row[:2], least, *row[2:], *head)
        ids = hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest() if ends else NO_IDS
        top[8].append((least, depth, members, children, leaves, saved, ids))
        top[2] = least if top[2] is None else min(top[2], least)
        top[3] += members
        top[4] += 1
        top[5] += leaves
        top[6] += saved

    before: list = []
    for names, words, conv in suffixes:
        same, n = 0, min(len(names), len(before))
        while same < n and names[same] == before[same]:
            same += 1
        while len(stack) - 1 > same:
            close()
        for k in range(same, len(names)):
            stack.append([names[k], words[k], None, 0, 0, 0, 0, [], []])
        last = stack[-1]
        last[7].append(conv)
        last[3] += 1
        last[2] = conv if last[2] is None else min(last[2], conv)
        before = names
    while len(stack) > 1:
        close()
    root = stack[0]
    for row in root[8]:
        emit(*row[:2], None, *row[2:], *head)
    emit(None, bare, None, root[3], root[4], root[5], root[6], None, *head)


SWEPT = NODE + ", head_a long, head_b long"


def _table(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, LONGS.get(n, pa.string())) for n, v in columns.items()], list(columns))


def sweep(containers: DataFrame) -> DataFrame:
    """Nodes of containers (head_a, head_b, bare, conv_id, place, key_a, key_b, words), which lie whole in a partition, and one row
    with a null conv_id for each container's own sums. The nodes below a head have a null parent."""
    names = [x.split()[0] for x in SWEPT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, bare, suffixes, conv, out = None, 0, [], None, {n: [] for n in names}
        for b in batches:
            for a, c, d, who, name_a, name_b, words in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if head != (a, c):
                    if head is not None:
                        _sweep_one(head, bare, suffixes, out)
                    head, bare, suffixes, conv = (a, c), d, [], None
                if conv != who:
                    suffixes.append(([], [], who))
                    conv = who
                suffixes[-1][0].append((name_a, name_b))
                suffixes[-1][1].append(words)
            yield _table(out)
            out = {n: [] for n in names}
        if head is not None:
            _sweep_one(head, bare, suffixes, out)
        yield _table(out)

    dealt = containers.repartition("head_a", "head_b").sortWithinPartitions("head_a", "head_b", "conv_id", "place")
    return dealt.select("head_a", "head_b", "bare", "conv_id", *KEY, "words").mapInArrow(run, SWEPT)


def digests(ends: DataFrame, piece_ids: int = PIECE_IDS) -> DataFrame:
    """(key_a, key_b, ends_sha256) of the ascending ids, joined by commas, of every key of ``ends`` (key_a, key_b, conv_id)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], {"key_a": [], "key_b": [], "first": [], "piece": []}

        def put() -> None:
            if ids:
                for column, v in zip(out.values(), (*key, ids[0], ",".join(map(str, ids))), strict=True):
                    column.append(v)
                ids.clear()

        for b in batches:
            for a, c, conv in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if key != (a, c) or len(ids) >= piece_ids:
                    put()
                    key = (a, c)
                ids.append(conv)
            yield _table(out)
            out.update({n: [] for n in out})
        put()
        yield _table(out)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made, out = None, None, {"key_a": [], "key_b": [], "ends_sha256": []}

        def put() -> None:
            if made is not None:
                for column, v in zip(out.values(), (*key, made.hexdigest()), strict=True):
                    column.append(v)

        for b in batches:
            for a, c, piece in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if key != (a, c):
                    put()
                    key, made = (a, c), hashlib.sha256()
                else:
                    made.update(b",")
                made.update(piece.encode())
            yield _table(out)
            out.update({n: [] for n in out})
        put()
        yield _table(out)

    pieces = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(cut, "key_a long, key_b long, first long, piece string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "key_a long, key_b long, ends_sha256 string")


def subtree_sums(own: DataFrame, tops: DataFrame) -> DataFrame:
    """(path, at, leaves, saved) summed over the subtrees of nodes. ``own`` (path, at, leaves, saved) has what each adds, ``tops``
    (path, at, up) every path's uppermost node and the path of the node above it, null for the root's."""
    carry, parts = own.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), [own]
    while True:
        moved = carry.join(tops, "path").where("up is not null").groupBy(F.col("up").alias("path"), (F.col("at") - 1).alias("at")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        moved = settle(moved, "moved-sums")
        if moved.isEmpty():
            break
        parts.append(moved)
        carry = moved.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = settle(every.groupBy("path", "at").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).withColumn("below", -F.col("at")), "sums")
    return running(every, "path", "below", ["leaves", "saved"], F.sum, lambda a, b: a + b).drop("below")


def prefix_trie(turns: DataFrame, convs: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """Nodes (``NODE``) of the trie of conversations ``convs`` (conv_id, n), of n turns each, and ``turns`` (conv_id, place, turn_id, words).
    ``saved_tokens`` is what storing each node once saves below it, in words."""
    convs = settle(convs, "conversations")
    named = settle(named_prefixes(turns), "prefixes")
    placed = settle(burst(named, convs, container_turns), "placed")
    laid = named.join(placed, "conv_id", "left")
    swept = settle(sweep(laid.where("place > bare").select("head_a", "head_b", "bare", "conv_id", "place", *KEY, "words")), "swept")
    crown = settle(laid.where("bare is null or place <= bare").select("conv_id", "place", "words", *KEY, "up_a", "up_b"), "crown-turns")

    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    nodes = crown.groupBy("place", *KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("place"), zero.alias("key_a"), zero.alias("key_b"), "conv_id", "n_convs", zero.alias("words"), null.alias("up_a"), null.alias("up_b"))
    nodes = settle(nodes.unionByName(root), "crown-nodes")
    above = nodes.select(F.col("key_a").alias("up_a"), F.col("key_b").alias("up_b"), F.col("conv_id").alias("parent"))
    inner = nodes.where("place > 0").groupBy(F.col("up_a").alias("key_a"), F.col("up_b").alias("key_b")).agg(F.count("*").alias("children"), zero.alias("leaves"), zero.alias("saved"))
    held = swept.where("conv_id is null").select(F.col("head_a").alias("key_a"), F.col("head_b").alias("key_b"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    below = inner.unionByName(held).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    full = nodes.join(above, ["up_a", "up_b"], "left").join(below, KEY, "left").na.fill(0, ["children", "leaves", "saved"])
    full = settle(full.withColumns({"leaves": F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")), "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("words")}), "crown-full")
    own = full.select(F.col("conv_id").alias("path"), F.col("place").alias("at"), "leaves", "saved")
    tops = settle(full.where("parent is null or parent <> conv_id").select(F.col("conv_id").alias("path"), F.col("place").alias("at"), F.col("parent").alias("up")), "tops")
    sums = subtree_sums(own, tops).select(F.col("path").alias("conv_id"), F.col("at").alias("place"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))

    length = convs.select("conv_id", F.col("n").alias("place"))
    ends = crown.join(length, ["conv_id", "place"]).select(*KEY, "conv_id").unionByName(convs.where("n = 0").select(zero.alias("key_a"), zero.alias("key_b"), "conv_id"))
    top = full.drop("leaves", "saved").join(sums, ["conv_id", "place"]).join(digests(ends), KEY, "left")
    top = top.select("conv_id", F.col("place").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))
    heads = nodes.select(F.col("key_a").alias("head_a"), F.col("key_b").alias("head_b"), F.col("conv_id").alias("head_conv"))
    low = swept.where("conv_id is not null")
    hung = low.where("parent_conv_id is null").join(heads, ["head_a", "head_b"]).withColumn("parent_conv_id", F.col("head_conv"))
    return top.unionByName(low.where("parent_conv_id is not null").select(*top.columns)).unionByName(hung.select(*top.columns))
