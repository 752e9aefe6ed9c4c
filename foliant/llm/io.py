"""Reading tables, writing intermediate results where every executor sees them, and column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.sources.scratch import discard, settle, shared_dir

__all__ = ["discard", "rename_clashing", "settle", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rename_clashing(df: DataFrame, added: list[str]) -> DataFrame:
    """``df`` with ``_input`` behind the names of columns that ``added`` ones would clash with, in any case of letters."""
    taken = {c.lower() for c in (*df.columns, *added)}
    for c in df.columns:
        if c.lower() in {a.lower() for a in added}:
            new = c + "_input"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            df = df.withColumnRenamed(c, new)
    return df
