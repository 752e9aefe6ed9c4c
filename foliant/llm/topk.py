"""Exact top-k inner products of integer vectors by distributed histogram selection.

Every query is scored against every candidate, in blocks of queries and candidates that are dealt to tasks. A task keeps no
scores: it counts a block's scores of each query into ``bins`` equal bins of the query's range. The counts of all tasks, added
up, tell which bin holds the k-th value; that bin is the next round's range, until it is one integer wide. As
scores lie within the product of two lengths, ``log(range, bins)`` rounds do, two for unit vectors scaled by 256. A last pass
emits the scores that reach the k-th value, cut in each block to the k best by score and id, so ties of any number stay small.
Bins below those that hold a block's own k best can't hold the k-th value of all and are not sent.

Components become ``floor(scale * x)``, x as double. Equal vectors are one candidate with its ``k + 1`` least ids, and equal
queries are searched once, so a vector that fills a third of the table costs one row. Vectors that are null, hold null or
non-finite components or components that leave the range of a long take no part; vectors of different lengths have no
inner product, so a query meets those of its own length, all lengths in the same jobs. A zero or empty vector takes part with score 0.
Of several rows of one vec_id the least vector counts; rows with a null vec_id take no part. An empty table gives an
empty result. Scores are exact: products in double precision where no sum can reach 2**53, else Python integers; one beyond
about 2**62 on either side is held there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.io import discard, settle

BINS = 1024
#: Components in a block of candidates, and of queries.
BLOCK, QUERY_BLOCK = 1 << 18, 1 << 15
EXACT, LIMIT = float(1 << 53), (1 << 62) - 1024  # a double too


def scaled(embedding: Column, scale: int) -> Column:
    """array<long> of floor(scale * x); null where the vector takes no part."""
    v = embedding.cast("array<double>")
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < 9.2e18))
    return F.when(fits, F.transform(v, lambda x: F.floor(x * scale)))


def distinct_vectors(vectors: DataFrame, k: int, scale: int) -> DataFrame:
    """(rep, v, n, ids): each scaled vector once, its length, its least id and its k + 1 least ids."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null")
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", F.size("v").alias("n"), "ids")


def _blocks_of(rows: DataFrame, most: int, name: str) -> DataFrame:
    """``rows`` with their block's number and the number of blocks of their length, about ``most`` components in each."""
    counts = rows.groupBy("n").agg(F.ceil(F.count("*") * F.greatest("n", F.lit(1)) / most).cast("int").alias(f"{name}s"))
    return rows.join(counts, "n").withColumn(name, F.pmod(F.xxhash64("rep", F.lit(7)), f"{name}s").cast("int"))


def _packed(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One row per block: its columns of longs and its vectors as bytes."""

    def pack(t: pa.Table) -> pa.Table:
        key = {c: t.column(c).slice(0, 1) for c in ("n", name)}
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in t.column("v").chunks])
        return pa.table({**key, **{c: [t.column(c).to_numpy().astype(np.int64).tobytes()] for c in columns}, "m": [flat.tobytes()]})

    schema = f"n int, {name} int, " + ", ".join(f"{c} binary" for c in columns) + ", m binary"
    return rows.select("n", name, "v", *columns).groupBy("n", name).applyInArrow(pack, schema)


def _longs(t: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(t.column(name)[0].as_py(), np.int64)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of longs, exact, held within a long."""
    size = [np.sqrt((m.astype(float) ** 2).sum(1).max(initial=0.0)) for m in (q, c)]
    if size[0] * size[1] < EXACT:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return np.clip(q.astype(object) @ c.astype(object).T, -LIMIT, LIMIT).astype(np.int64)


def _bins_of(s: np.ndarray, times: np.ndarray, low: np.ndarray, span: np.ndarray, need: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, bin, count) of the scores within ``span`` from ``low`` of each query, from the top bin down to the one that
    holds ``need``."""
    off = s - low[:, None]
    row, col = np.nonzero((off >= 0) & (off < span[:, None]))
    bin_of = off[row, col] // -(-span // bins)[row]
    counts = np.bincount(row * bins + bin_of, times[col], len(s) * bins).reshape(-1, bins).astype(np.int64)
    above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts
    who, which = np.nonzero((counts > 0) & (above < need[:, None]))
    return who, which, counts[who, which]


def _each_pair(candidates: DataFrame, queries: DataFrame, body, schema: str) -> DataFrame:
    """``body`` of every pair of a block of candidates and a block of queries of one length."""
    nq = queries.groupBy("n").agg(F.max("qb").alias("last_q"))
    nc = candidates.groupBy("n").agg(F.max("cb").alias("last_c"))
    left = candidates.join(nq, "n").withColumn("qb", F.explode(F.sequence(F.lit(0), "last_q"))).drop("last_q")
    right = queries.join(nc, "n").withColumn("cb", F.explode(F.sequence(F.lit(0), "last_c"))).drop("last_c")
    keys = ("n", "cb", "qb")

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        if c.num_rows == 0 or q.num_rows == 0:
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        n = c.column("n")[0].as_py()
        rep, ask = _longs(c, "rep"), _longs(q, "rep")
        s = products(_longs(q, "m").reshape(len(ask), n), _longs(c, "m").reshape(len(rep), n))
        return pa.table(dict(zip([x.split()[0] for x in schema.split(", ")], map(pa.array, body(s, rep, c, ask, q)), strict=True)))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _count_pass(bins: int):
    def count(s, rep, c, ask, q):
        who, which, n = _bins_of(s, _longs(c, "times"), _longs(q, "low"), _longs(q, "span"), _longs(q, "need"), bins)
        return ask[who], which, n

    return count


def _filter_pass(k: int):
    def keep(s, rep, c, ask, q):
        who, what = np.nonzero(s >= _longs(q, "low")[:, None])
        score = s[who, what]
        order = np.lexsort((rep[what], -score, who))
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        order = order[place < k]
        return ask[who[order]], rep[what[order]], score[order]

    return keep


def refine(state: DataFrame, counts: DataFrame, bins: int = BINS) -> DataFrame:
    """The next ranges of the queries of ``state`` (rep, low, span, need): the bin of ``counts`` (rep, bin, n) that holds the
    ``need``-th value from the top. A query with fewer values than it needs keeps all: its range ends at its lower end."""
    whole = counts.groupBy("rep", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("rep").orderBy(F.desc("bin"))  # ``bins`` rows a query at most
    reached = whole.withColumn("upto", F.sum("n").over(down)).join(state, "rep").where("upto >= need")
    found = reached.groupBy("rep").agg(F.max(F.struct("bin", "upto", "n")).alias("f"))
    out = state.join(found, "rep", "left").withColumn("width", F.expr(f"(span - 1) div {bins} + 1"))
    known = F.col("f").isNotNull()
    return out.select(
        "rep", F.when(known, F.col("low") + F.col("f.bin") * F.col("width")).otherwise(F.col("low")).alias("low"), F.col("width").alias("span"),
        F.when(known, F.col("need") - (F.col("f.upto") - F.col("f.n"))).otherwise(F.col("need")).alias("need"), (known & (F.col("width") > 1)).alias("open"),
    )


def top_k(vectors: DataFrame, query_filter: str = "vec_id % 50 = 0", k: int = 5, scale: int = 256, bins: int = BINS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest integer inner products of every row of ``vectors`` (vec_id, embedding)
    that meets ``query_filter`` with all other rows, ties to the smaller vec_id."""
    vectors = vectors.select("vec_id", "embedding")
    distinct = settle(_blocks_of(distinct_vectors(vectors, k, scale), BLOCK, "cb"), "vectors")
    asked = vectors.where(query_filter).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null")
    asked = settle(asked.groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    queries = settle(_blocks_of(distinct.join(asked.select("v").distinct(), "v").select("rep", "v", "n"), QUERY_BLOCK, "qb"), "queries")
    blocks = settle(_packed(distinct.withColumn("times", F.size("ids").cast("long")), "cb", ["rep", "times"]), "blocks")
    size = F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + cast(x as double) * x))")
    longest = distinct.groupBy("n").agg(F.max(size).alias("longest"))
    # all scores lie within the product of the lengths, with a margin for rounding
    reach = F.least(size * F.col("longest") * 1.000001 + 2, F.lit(float(LIMIT))).cast("long")
    state = queries.join(longest, "n").select("rep", (-reach).alias("low"), (2 * reach + 1).alias("span"), F.lit(k + 1).cast("long").alias("need"), F.lit(True).alias("open"))
    state = settle(state, "ranges")
    while not state.where("open").isEmpty():
        held = queries.join(state.where("open"), "rep").select("n", "qb", "v", "rep", "low", "span", "need")
        held = settle(_packed(held, "qb", ["rep", "low", "span", "need"]), "asked-blocks")
        counts = _each_pair(blocks, held, _count_pass(bins), "rep long, bin long, n long")
        last, state = state, settle(refine(state.where("open").drop("open"), counts, bins).unionByName(state.where("not open")), "ranges")
        discard(last), discard(held)
    held = settle(_packed(queries.join(state, "rep").select("n", "qb", "v", "rep", "low"), "qb", ["rep", "low"]), "asked-blocks")
    hits = _each_pair(blocks, held, _filter_pass(k + 1), "q long, rep long, score long")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    hits = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r").join(distinct.select("rep", "ids"), "rep")
    each = hits.select("q", F.explode("ids").alias("id"), "score")
    near = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k + 1)  # of (k + 1) ** 2 at most
    lists = each.groupBy("q").agg(near.alias("near")).join(queries.select(F.col("rep").alias("q"), "v"), "q")
    out = asked.join(lists, "v").select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k)).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
