"""Numbers of rows in a global order without a window over the whole table."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.scratch import settle


def numbered(rows: DataFrame, *order: Column | str, keep: list[Column | str] | None = None, name: str = "number") -> DataFrame:
    """``rows`` (of them ``keep``) with each one's place in ``order``, from 0, as the column ``name``.

    Rows are dealt to tasks by ranges of ``order`` and sorted there; a row's number is its place in its task plus the rows of the
    tasks before it. Only these counts, one a task, reach the driver. Rows that tie get numbers of their own in any order."""
    at = f"_{name}_at"
    kept = ["*"] if keep is None else keep
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*kept, F.monotonically_increasing_id().alias(at))
    dealt = settle(dealt, "numbered")
    counts = {r["task"]: r["n"] for r in dealt.groupBy(F.shiftright(at, 33).alias("task")).agg(F.count("*").alias("n")).collect()}
    tasks = sorted(counts)
    before = dict(zip(tasks, accumulate((counts[t] for t in tasks), initial=0), strict=False))
    starts = rows.sparkSession.createDataFrame([(t, before[t]) for t in tasks], "_task long, _before long")
    place = F.col("_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(starts), F.shiftright(at, 33) == F.col("_task")).withColumn(name, place).drop("_task", "_before", at)  # a row a task
