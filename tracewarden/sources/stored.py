"""Stored tables that change: keyed tables in buckets behind a manifest, and retention of day-partitioned ones."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.params import DAY_MS
from tracewarden.session import cut_lineage
from tracewarden.sources.tables import day_of

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Folders:
    """The folders below a path, wherever it lies."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.system = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        if not self.system.exists(self._at(name)):
            return []
        return sorted(status.getPath().getName() for status in self.system.listStatus(self._at(name)))

    def delete(self, name: str) -> None:
        self.system.delete(self._at(name), True)

    def put_new(self, name: str, content: str) -> None:
        """Write a small file that must not exist yet; it appears whole or not at all."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        out = self.system.create(self._at(part), False)
        out.write(bytearray(content.encode()))
        out.close()
        if self.system.exists(self._at(name)) or not self.system.rename(self._at(part), self._at(name)):
            self.delete(part)
            raise FileExistsError(f"{self.path}/{name} was written by another job")


class KeyedTable:
    """A table with one row per key, in ``buckets`` by hash of the key.

    A change writes the buckets it touches to a new folder, and then a manifest that names the folder of every bucket. Readers
    take the newest manifest, so they see all of a change or nothing; buckets without a changed key are neither read
    nor written. The number of buckets, fixed when the table is made, bounds the manifest and what one task rewrites.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets
        self.folders = Folders(spark, path)

    def manifest(self) -> dict:
        versions = [name for name in self.folders.names("manifest") if name.endswith(".json")]
        if not versions:
            return {"version": 0, "batch": None, "folders": {}}
        text = self.spark.read.text(f"{self.path}/manifest/{versions[-1]}").first()[0]
        return json.loads(text)

    def read(self) -> DataFrame:
        return self._read(self.manifest()["folders"].values())

    def _read(self, folders) -> DataFrame:
        paths = [f"{self.path}/data/{folder}" for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _commit(self, rows: DataFrame, touched: list[int], before: dict, batch_id: int | None) -> None:
        version = before["version"] + 1
        name = f"{version:010d}-{uuid.uuid4().hex}"
        self._placed(rows).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        written = {f.removeprefix("_bucket="): f"{name}/{f}" for f in self.folders.names(f"data/{name}") if f.startswith("_bucket=")}
        kept = {b: f for b, f in before["folders"].items() if int(b) not in touched}
        content = {"version": version, "batch": before["batch"] if batch_id is None else batch_id, "folders": {**kept, **written}}
        self.folders.put_new(f"manifest/{version:010d}.json", json.dumps(content))

    def upsert(self, updates: DataFrame, merge: Merge, batch_id: int | None = None) -> list[int]:
        """Merge updates into the rows stored under their keys; the buckets that were rewritten.

        With ``batch_id``, that of a micro-batch, a batch that was already merged changes nothing.
        """
        before = self.manifest()
        if batch_id is not None and before["batch"] is not None and before["batch"] >= batch_id:
            return []
        placed = cut_lineage(self._placed(updates))
        touched = sorted(r["_bucket"] for r in placed.select("_bucket").distinct().collect())
        stored = self._read(f for b, f in before["folders"].items() if int(b) in touched)
        self._commit(merge(stored, placed.drop("_bucket")), touched, before, batch_id)
        return touched

    def delete(self, condition: Column) -> int:
        """Delete rows; the number of them. Only buckets that hold such rows are rewritten."""
        before = self.manifest()
        gone = self._placed(self.read()).filter(condition).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()
        if gone:
            touched = [r["_bucket"] for r in gone]
            rows = self._read(f for b, f in before["folders"].items() if int(b) in touched)
            self._commit(rows.filter(~F.coalesce(condition, F.lit(False))), touched, before, None)
        return sum(r["n"] for r in gone)

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the newest ``keep``, and folders that none of those names. Readers of older ones must be done."""
        versions = [name for name in self.folders.names("manifest") if name.endswith(".json")]
        for name in versions[:-keep]:
            self.folders.delete(f"manifest/{name}")
        live = set()
        for name in versions[-keep:]:
            text = self.spark.read.text(f"{self.path}/manifest/{name}").first()[0]
            live |= set(json.loads(text)["folders"].values())
        for version in self.folders.names("data"):
            for bucket in self.folders.names(f"data/{version}"):
                if bucket.startswith("_bucket=") and f"{version}/{bucket}" not in live:
                    self.folders.delete(f"data/{version}/{bucket}")


def prune_stored(
    spark: SparkSession, path: str, as_of_ms: int, retention_days: int, minimum_days: int = 0, ts_col: str = "ts", most_files: int = 8
) -> int:
    """Delete what is older than retention from a table written by ``append_events``; the number of rows removed.

    Days wholly before the cutoff go as folders. The day it falls into is rewritten without the rows before it, and with it
    days of more than ``most_files`` files, as many small batches leave them: their rows meet in few files. Rewritten days replace
    the old ones when the job commits; running it again does no harm.
    """
    cutoff = as_of_ms - max(retention_days, minimum_days) * DAY_MS
    table = Folders(spark, path)
    boundary = str(spark.range(1).select(day_of(F.lit(cutoff))).first()[0])
    days = {name.removeprefix("dt="): name for name in table.names() if name.startswith("dt=")}
    days = {day: name for day, name in days.items() if day <= boundary or _files(table, name) > most_files}
    if not days:
        return 0
    stored = spark.read.option("basePath", path).parquet(*[f"{path}/{name}" for name in days.values()])
    old = F.col(ts_col) < cutoff
    removed = dict(stored.filter(F.col("dt") <= F.lit(boundary)).groupBy(F.col("dt").cast("string")).agg(F.count_if(old)).collect())
    again = [d for d in days if d > boundary or d == boundary and (removed.get(d) or _files(table, days[d]) > most_files)]
    if again:
        rows = stored.filter(F.col("dt").cast("string").isin(again) & ~old)
        left = rows.hint("rebalance", "dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt")
        left.parquet(path)
        if boundary in again and spark.read.option("basePath", path).parquet(f"{path}/{days[boundary]}").filter(~old).isEmpty():
            table.delete(days[boundary])
    for day, name in days.items():
        if day < boundary:
            table.delete(name)
    return sum(removed.values())


def _files(table: Folders, name: str) -> int:
    return sum(file.endswith(".parquet") for file in table.names(name))
