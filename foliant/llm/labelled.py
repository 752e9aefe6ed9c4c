"""Bounded, balanced samples of labelled documents for training on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of every training sample: documents of each label, and characters of their texts together, half for each label.
PER_LABEL = 1500
MAX_CHARS = 12_000_000


def _within(size: pd.Series, most: int) -> list[bool]:
    """Which documents a budget of characters takes, in order; one that does not fit is passed over."""
    left, out = most, []
    for n in size.tolist():
        out.append(n <= left)
        left -= n * out[-1]
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> pd.DataFrame:
    """(text, y): up to ``per_label`` labelled documents of each class whose crc32(doc_id) mod
    ``modulus`` is not ``held_out``, the first by hash of doc_id. Whole texts; a document that the rest of its class's half
    of ``max_chars`` does not hold is passed over for later ones."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    usable = marks.where(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out)
    texts = docs.where("text is not null").select("doc_id", "text", F.length("text").alias("size"), F.xxhash64("doc_id").alias("h"))
    ranked = texts.select("doc_id", "size", "h").join(usable, "doc_id")
    chosen = [ranked.where(F.col("y") == y).orderBy("h", "doc_id", "size").limit(per_label) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).toPandas().drop_duplicates("doc_id").sort_values("h")
    ids = pd.concat([own[_within(own["size"], max_chars // 2)] for _, own in ids.groupby("y")] or [ids]).sort_values("h")
    if ids.empty:
        return pd.DataFrame({"text": pd.Series([], dtype=str), "y": pd.Series([], dtype=int)})
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame(ids[["doc_id", "y"]].astype("int64")))  # 2 * per_label rows at most
    got = texts.join(few, "doc_id").select("h", "doc_id", "text", "y").toPandas().drop_duplicates("doc_id")
    return got.sort_values(["h", "doc_id"])[["text", "y"]].reset_index(drop=True)


def platt(x, y, steps: int = 50):
    """Logistic calibration weights (last is the intercept) by damped Newton steps."""
    import numpy as np

    a = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    weight = np.append(np.full(a.shape[1] - 1, 0.05), 1e-3)  # the intercept is left nearly free
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + weight * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(weight)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
    return w
