"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on at most ``SAMPLE`` distinct vectors; every vector is then put into a leaf. Vectors
are lifted by one coordinate so that largest inner product becomes least distance. A query takes leaves
from a priority queue by distance to their centroid; how many is calibrated: the leaf visits are widened
until they hold ``RECALL`` of the true neighbours of at most ``PROBES`` queries, found by brute force over
all vectors. Visited leaves are searched exactly: neighbouring leaves share groups of bounded size, a query goes to the
groups of its leaves, and a group's vectors go to as many blocks of queries as asked for it. Inside a block every leaf is
multiplied with its own queries alone. Scores from the product choose candidates with a margin for rounding; their exact
double-precision scores, summed in the order of the components, then decide, ties by id.

Equal vectors are one candidate with its ``k + 1`` smallest ids, and equal queries are searched
once, so a vector that fills a third of the table costs one row. Vectors that are null, zero, hold null or
non-finite components take no part. Vectors of different lengths have no inner product, so each length is searched by itself,
one after the other; of several rows of one vec_id the least vector counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.io import settle

SAMPLE, PROBES, RECALL = 20_000, 200, 0.97
BRANCH, LEAF_ROWS, MAX_LEAVES = 12, 400, 4096
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 4096


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(rep, v, ids): each vector once, with its least id and its k + 1 least ids."""
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids")


def lift(v: np.ndarray, norm: float, query: bool = False) -> np.ndarray:
    size = (v * v).sum(1)
    if query:
        return np.column_stack([v * (norm / np.sqrt(np.maximum(size, 1e-300)))[:, None], np.zeros(len(v))])
    return np.column_stack([v, np.sqrt(np.maximum(norm * norm - size, 0))])


@dataclass
class Tree:
    norm: float
    centroids: list[np.ndarray]  # of the children of each inner node
    children: list[list[int]]  # inner node number, or -1 - leaf
    leaves: int

    def assign(self, v: np.ndarray) -> np.ndarray:
        x, out = lift(v, self.norm), np.zeros(len(v), np.int64)
        todo = [(0, np.arange(len(v)))] if self.children else []
        while todo:
            node, rows = todo.pop()
            c = self.centroids[node]
            near = ((c * c).sum(1)[None, :] - 2 * x[rows] @ c.T).argmin(1)
            for k, child in enumerate(self.children[node]):
                own = rows[near == k]
                if len(own) and child < 0:
                    out[own] = -1 - child
                elif len(own):
                    todo.append((child, own))
        return out

    def visits(self, q: np.ndarray, sizes: np.ndarray, least: int, rows: int) -> list[int]:
        """Leaves in best-bin-first order: ``least`` at least, and until they hold ``rows`` vectors."""
        if not self.children:
            return [0]
        x, heap, out, held = lift(q[None, :], self.norm, True)[0], [(0.0, 0)], [], 0
        while heap and (len(out) < least or held < rows):
            _, node = heapq.heappop(heap)
            if node < 0:
                if sizes[-1 - node]:
                    out.append(-1 - node)
                    held += int(sizes[-1 - node])
                continue
            d = ((self.centroids[node] - x) ** 2).sum(1)
            for child, far in zip(self.children[node], d.tolist(), strict=True):
                heapq.heappush(heap, (far, child))
        return out


def fit_tree(v: np.ndarray, norm: float, rows: int, seed: int = 5) -> Tree:
    """``rows``: vectors that the sample ``v`` stands for; leaves aim at ``LEAF_ROWS`` of them."""
    tree, rng = Tree(norm, [], [], 0), np.random.default_rng(seed)
    x = lift(v, norm)
    aim = max(LEAF_ROWS, rows / MAX_LEAVES) * len(v) / max(rows, 1)

    def split(own: np.ndarray) -> int:
        k = min(BRANCH, int(np.ceil(len(own) / max(aim, 4))))
        if k < 2:
            tree.leaves += 1
            return -tree.leaves
        p = x[own]
        c = p[rng.choice(len(p), k, replace=False)]
        for _ in range(10):
            near = ((c * c).sum(1)[None, :] - 2 * p @ c.T).argmin(1)
            n = np.bincount(near, minlength=k)
            sums = np.column_stack([np.bincount(near, p[:, d], k) for d in range(p.shape[1])])
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], p[rng.choice(len(p), k)])
        near = ((c * c).sum(1)[None, :] - 2 * p @ c.T).argmin(1)
        if np.bincount(near, minlength=k).max() == len(p):
            tree.leaves += 1
            return -tree.leaves
        node = len(tree.children)
        tree.centroids.append(c)
        tree.children.append([])
        tree.children[node] = [split(own[near == j]) for j in range(k)]
        return node

    split(np.arange(len(x)))
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def _place(distinct: DataFrame, tree) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = tree.value.assign(_matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], [*b.schema.names, "leaf"])

    return distinct.mapInArrow(place, "rep long, v array<double>, ids array<long>, leaf int")


def _true_neighbours(spark, placed: DataFrame, probes: list, k: int) -> pd.DataFrame:
    """(probe, leaf) of the k nearest of each probe among all vectors; PROBES * k rows."""
    held = spark.sparkContext.broadcast(np.array([r["v"] for r in probes], float))
    own = np.array([r["rep"] for r in probes], np.int64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rep, leaf = b.column("rep").to_numpy(zero_copy_only=False), b.column("leaf").to_numpy(zero_copy_only=False)
            s = held.value @ _matrix(b.column("v")).T
            s[own[:, None] == rep[None, :]] = -np.inf
            top = np.argsort(-s, 1, kind="stable")[:, :k]
            probe = np.repeat(np.arange(len(s)), top.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(np.take_along_axis(s, top, 1).reshape(-1)), pa.array(rep[top.reshape(-1)]), pa.array(leaf[top.reshape(-1)])], ["probe", "s", "rep", "leaf"])

    found = placed.select("rep", "v", "leaf").mapInArrow(best, "probe long, s double, rep long, leaf int").where("s > double('-infinity')")
    w = Window.partitionBy("probe").orderBy(F.desc("s"), "rep")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("probe", "leaf").toPandas()


def calibrate(tree: Tree, probes: list, truth: pd.DataFrame, sizes: np.ndarray) -> int:
    """Leaf visits that hold ``RECALL`` of the probes' true neighbours."""
    ranks = []
    for p, leaves in truth.groupby("probe")["leaf"]:
        order = {leaf: r for r, leaf in enumerate(tree.visits(np.array(probes[p]["v"], float), sizes, tree.leaves, 0), 1)}
        ranks.extend(order[leaf] for leaf in leaves)
    return int(np.ceil(np.quantile(ranks, RECALL))) if ranks else tree.leaves


def leaf_groups(sizes: np.ndarray) -> dict[int, tuple[int, int]]:
    """leaf -> (first group, number of groups): neighbouring leaves fill groups of ``BLOCK_VECTORS``, a
    larger leaf is spread over groups of its own."""
    out, group, held = {}, 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if held and held + n > BLOCK_VECTORS:
            group, held = group + 1, 0
        parts = max(1, -(-n // BLOCK_VECTORS))
        out[leaf] = (group, parts)
        held += n
        if parts > 1:
            group, held = group + parts, 0
    return out


HITS = "query_id long, rank int, vec_id long, score double"


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last, whatever the number of rows."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * v[:, d]
    return out


def best_of(q: np.ndarray, v: np.ndarray, rep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the k best vectors of every query, by exact score, then the smaller ``rep``."""
    s = q @ v.T
    k = min(k, len(v))
    # a product may differ from the exact sum by about its length in units of the last place of the summands' size
    slack = 1e-15 * (v.shape[1] + 8) * np.sqrt((q * q).sum(1) * (v * v).sum(1).max())
    who, what = np.nonzero(s >= (np.partition(s, len(v) - k, 1)[:, len(v) - k] - 2 * slack)[:, None])
    score = exact_scores(q[who], v[what])
    order = np.lexsort((rep[what], -score, who))
    first = np.searchsorted(who[order], np.arange(len(q)))
    keep = order[np.arange(len(order)) - first[who[order]] < k]
    return who[keep], what[keep], score[keep]


def search(vectors: DataFrame, query_filter: str = "vec_id % 20 = 0", k: int = 20, least_visits: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of every row that meets ``query_filter``. ``least_visits``
    sets the number of leaves to visit in the place of the calibrated one."""
    rows = settle(usable(vectors), "usable")
    out = vectors.sparkSession.createDataFrame([], HITS)
    for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect():  # one row per length of vectors
        out = out.unionByName(_search(rows.where(F.size("v") == r["n"]), query_filter, k, least_visits))
    return out


def _search(rows: DataFrame, query_filter: str, k: int, least_visits: int | None) -> DataFrame:
    spark = rows.sparkSession
    distinct = settle(distinct_vectors(rows, k), "vectors")
    total = distinct.agg(F.count("*"), F.max(F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))"))).first()
    n, norm = total[0], total[1] or 1.0
    sample = np.array([r["v"] for r in distinct.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()], float)
    made = fit_tree(sample.reshape(len(sample), -1) if len(sample) else np.zeros((0, 1)), norm, n)
    tree = spark.sparkContext.broadcast(made)
    placed = settle(_place(distinct, tree), "placed")
    counts = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # bounded by the sample
    sizes = np.array([counts.get(i, 0) for i in range(max(made.leaves, 1))])
    asked = rows.where(query_filter)
    queries = settle(distinct.join(asked.select("v").distinct(), "v").select("rep", "v"), "queries")
    probes = queries.orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(PROBES).collect() if least_visits is None else []
    least = least_visits or (calibrate(made, probes, _true_neighbours(spark, placed, probes, k), sizes) if probes else 1)
    groups = leaf_groups(sizes)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, group, leaves = [], [], []
            for row, q in enumerate(_matrix(b.column(1)) if b.num_rows else []):
                own: dict[int, list[int]] = {}
                for leaf in tree.value.visits(q, sizes, least, 4 * (k + 1)):
                    first, parts = groups[leaf]
                    for g in range(first, first + parts):
                        own.setdefault(g, []).append(leaf)
                at += [row] * len(own)
                group += own
                leaves += own.values()
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(group, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], ["rep", "v", "grp", "leaves"])

    wanted = settle(queries.select("rep", "v").mapInArrow(visit, "rep long, v array<double>, grp int, leaves array<int>"), "wanted")
    # one row per group that is asked for, and the groups are bounded by the sample
    blocks = F.broadcast(wanted.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks")))
    right = wanted.join(blocks, "grp").withColumn("qb", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).drop("blocks")
    shape = F.broadcast(spark.createDataFrame([(leaf, first, parts) for leaf, (first, parts) in groups.items()], "leaf int, first int, parts int"))  # a row per leaf, bounded by the sample
    left = placed.select("rep", "v", "leaf").join(shape, "leaf").select("rep", "v", "leaf", F.expr("cast(first + pmod(xxhash64(rep), parts) as int)").alias("grp"))
    left = left.join(blocks, "grp").select("rep", "v", "leaf", "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qb"))

    def nearest(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": pd.Series([], dtype="int64"), "rep": pd.Series([], dtype="int64"), "score": pd.Series([], dtype=float)})]
        if len(vs) and len(qs):
            v, q = np.stack(vs["v"].to_numpy()).astype(float), np.stack(qs["v"].to_numpy()).astype(float)
            rep, asker = vs["rep"].to_numpy(np.int64), qs["rep"].to_numpy(np.int64)
            leaf_of = vs["leaf"].to_numpy()
            times = qs["leaves"].map(len).to_numpy()
            leaf_asked, by = np.concatenate(qs["leaves"].to_numpy()), np.repeat(np.arange(len(qs)), times)
            for leaf in np.unique(leaf_of).tolist():
                own, askers = np.flatnonzero(leaf_of == leaf), by[leaf_asked == leaf]
                for lo in range(0, len(askers), 512):
                    some = askers[lo : lo + 512]
                    who, what, score = best_of(q[some], v[own], rep[own], k + 1)
                    out.append(pd.DataFrame({"q": asker[some[who]], "rep": rep[own[what]], "score": score}))
            hits = pd.concat(out).sort_values(["q", "score", "rep"], ascending=[True, False, True])
            out = [hits.groupby("q", sort=False).head(k + 1)]
        return out[0]

    keys = ("grp", "qb")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "q long, rep long, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    hits = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")
    hits = hits.join(distinct.select("rep", "ids"), "rep")
    flat = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id")))))
    lists = hits.groupBy("q").agg(F.slice(F.sort_array(flat), 1, k + 1).alias("near")).join(queries.select(F.col("rep").alias("q"), "v"), "q")
    out = asked.join(lists, "v").select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k)).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
