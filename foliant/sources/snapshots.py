"""Snapshots of a library's tables that change shard by shard and switch all at once.

A table lies in shards by a hash of its key. A commit writes the changed shards' rows into a folder of its own, then a manifest that
names every table's shards, old and new. Manifests are numbered, the greatest one counts, and it appears by a
single rename: a run that ends before it leaves the snapshot before readable and unchanged, and two runs can't both take a number.
Unchanged shards keep their files.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


@dataclass
class Manifest:
    version: int = 0
    #: By table: its key, number of shards, schema, and the folder of each shard that has rows.
    tables: dict[str, dict] = field(default_factory=dict)
    #: What the writer wants to know again, such as the last batch of a stream.
    notes: dict = field(default_factory=dict)


def manifest(spark: SparkSession, folder: str) -> Manifest:
    """The manifest that counts; an empty one of version 0 before the first commit."""
    path, fs = _files(spark, folder)
    if not fs.exists(path(folder)):
        return Manifest()
    names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
    versions = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
    if not versions:
        return Manifest()
    with_bytes = fs.open(path(f"{folder}/manifest-{max(versions)}.json"))
    try:
        return Manifest(**json.loads(bytes(with_bytes.readAllBytes()).decode()))
    finally:
        with_bytes.close()


def shard(key: Column | str, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


class Commit:
    """Changes to a snapshot in ``folder``: ``put`` tables or some of their shards, then ``done``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.base = spark, folder, manifest(spark, folder)
        self.made = Manifest(self.base.version + 1, json.loads(json.dumps(self.base.tables)), dict(self.base.notes))

    def put(self, table: str, rows: DataFrame, key: str, shards: int = SHARDS, only: list[int] | None = None) -> None:
        """Replace a table by ``rows``, or the shards ``only`` of it by theirs."""
        if only is not None and table in self.made.tables:
            shards = self.made.tables[table]["shards"]
        at = f"{self.folder}/data/{table}-{uuid.uuid4().hex}"
        numbered = rows.withColumn("_shard", shard(key, shards))
        if only is not None:
            numbered = numbered.where(F.col("_shard").isin(only))
        numbered.repartition("_shard").write.partitionBy("_shard").parquet(at)
        path, fs = _files(self.spark, at)
        new = {s.getPath().getName()[7:]: f"{at}/{s.getPath().getName()}" for s in fs.listStatus(path(at)) if s.getPath().getName().startswith("_shard=")}
        kept = {} if only is None else {k: v for k, v in self.made.tables.get(table, {"parts": {}})["parts"].items() if int(k) not in only}
        self.made.tables[table] = {"key": key, "shards": shards, "schema": rows.schema.json(), "parts": kept | new}

    def done(self, **notes) -> int:
        """Switch to the new snapshot; fails if another commit was first. Returns its version."""
        self.made.notes |= notes
        path, fs = _files(self.spark, self.folder)
        to, temporary = path(f"{self.folder}/manifest-{self.made.version}.json"), path(f"{self.folder}/.manifest-{uuid.uuid4().hex}")
        fs.mkdirs(path(self.folder))
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(vars(self.made)).encode()))
        out.close()
        if fs.exists(to) or not fs.rename(temporary, to):
            fs.delete(temporary, False)
            raise RuntimeError(f"version {self.made.version} of {self.folder} was committed by another run")
        return self.made.version


def read(spark: SparkSession, folder: str, table: str, version: Manifest | None = None, only: list[int] | None = None) -> DataFrame:
    """A table of the snapshot that counts (or of ``version``), or the shards ``only`` of it."""
    from pyspark.sql.types import StructType

    held = (version or manifest(spark, folder)).tables[table]
    schema = StructType.fromJson(json.loads(held["schema"]))
    parts = [p for k, p in sorted(held["parts"].items()) if only is None or int(k) in only]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def upsert(spark: SparkSession, folder: str, table: str, changes: DataFrame, key: str, gone: Column | None = None, shards: int = SHARDS, newer: Column | None = None, **notes) -> int:
    """Commit ``changes``, one row a key: rows replace those of their key, rows that are ``gone`` remove them; with ``newer``, a value of
    both, only where theirs is not less. Only shards with changes are read and written."""
    commit = Commit(spark, folder)
    held = commit.base.tables.get(table)
    columns = [f.name for f in changes.schema] if held is None else [f["name"] for f in json.loads(held["schema"])["fields"]]
    shards = held["shards"] if held else shards
    touched = [r[0] for r in changes.select(shard(key, shards)).distinct().collect()]  # SHARDS at most
    rows = (changes if gone is None else changes.where(~gone)).select(*columns)
    if held:
        old = read(spark, folder, table, commit.base, touched)
        if newer is not None:
            held_back = old.select(F.col(key).alias("_key"), newer.alias("_held")).join(changes.select(F.col(key).alias("_key"), newer.alias("_new")), "_key").where("_new < _held").select(F.col("_key").alias(key))
            changes = changes.join(held_back, key, "left_anti")
            rows = (changes if gone is None else changes.where(~gone)).select(*columns)
        rows = old.join(changes.select(key), key, "left_anti").select(*columns).unionByName(rows)
    commit.put(table, rows, key, shards, touched)
    return commit.done(**notes)
