"""Stored tables and the streams that write them."""

import pytest
from pyspark.sql import functions as F

from tracewarden import schemas
from tracewarden.sources import tables
from tracewarden.sources.stored import Folders, KeyedTable, prune_stored
from tracewarden.streaming import series
from tracewarden.streaming.state import folder_sink

DAY = 86_400_000
META = "k string, v string"


def meta(spark, rows):
    return spark.createDataFrame(rows, "k string, v string, arrival bigint")


def files_of(table):
    return {b: sorted(table.folders.names(f"data/{f}")) for b, f in table.manifest()["folders"].items()}


def test_upserts_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], META, buckets=8)
    assert table.read().count() == 0
    table.upsert(meta(spark, [(f"k{i}", "old", 0) for i in range(40)]), tables.upsert_meta)
    before = files_of(table)
    touched = table.upsert(meta(spark, [("k3", "new", 1), ("k3", "newest", 2), ("fresh", "x", 1)]), tables.upsert_meta)
    after = files_of(table)
    assert 1 <= len(touched) <= 2 and len(before) > 4
    assert {b for b in after if after[b] != before.get(b)} == {str(b) for b in touched}
    got = {r.k: r.v for r in table.read().collect()}
    assert len(got) == 41 and got["k3"] == "newest" and got["fresh"] == "x" and got["k4"] == "old"


def test_a_reader_keeps_its_version_and_vacuum_drops_old_ones(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], META, buckets=2)
    table.upsert(meta(spark, [("a", "1", 0)]), tables.upsert_meta)
    reader = table.read()
    table.upsert(meta(spark, [("a", "2", 1)]), tables.upsert_meta)
    assert [r.v for r in reader.collect()] == ["1"] and [r.v for r in table.read().collect()] == ["2"]
    table.vacuum(keep=1)
    assert len(table.folders.names("manifest")) == 1 and [r.v for r in table.read().collect()] == ["2"]


def test_a_batch_is_merged_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], META, buckets=2)
    count = lambda stored, new: tables.upsert_meta(stored, new).withColumn("v", F.concat("v", F.lit("!")))
    for batch in (0, 1, 1, 0):
        table.upsert(meta(spark, [("a", f"b{batch}", batch)]), count, batch_id=batch)
    assert [tuple(r) for r in table.read().collect()] == [("a", "b1!")] and table.manifest()["version"] == 2


def test_two_writers_of_one_version(spark, tmp_path):
    folders = Folders(spark, str(tmp_path / "m"))
    folders.put_new("manifest/1.json", "{}")
    with pytest.raises(FileExistsError):
        folders.put_new("manifest/1.json", "{}")
    assert folders.names("manifest") == ["1.json"]


def test_delete_from_a_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], META, buckets=4)
    table.upsert(meta(spark, [(f"k{i}", str(i % 2), 0) for i in range(10)] + [("n", None, 0)]), tables.upsert_meta)
    assert table.delete(F.col("v") == "1") == 5 and table.delete(F.col("v") == "1") == 0
    assert sorted(r.k for r in table.read().collect()) == ["k0", "k2", "k4", "k6", "k8", "n"]
    assert table.delete(F.lit(True)) == 6 and table.read().count() == 0


def volumes(spark, days):
    return spark.createDataFrame([(i, int(d * DAY), 1, "a", 0, i, 1000) for i, d in enumerate(days)], schemas.VOLUMES)


def test_prune_rewrites_the_boundary_day_and_merges_small_files(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = volumes(spark, [x / 4 for x in range(80)])
    for part in range(4):
        tables.append_events(rows.filter(F.col("seq") % 4 == part), path)
    folders = Folders(spark, path)
    files = lambda day: [f for f in folders.names(f"dt={day}") if f.endswith(".parquet")]
    assert len(files("1970-01-20")) == 4
    kept_day = files("1970-01-11")
    assert prune_stored(spark, path, 15 * DAY + DAY // 2, 5, most_files=4) == 42
    assert files("1970-01-10") == [] and files("1970-01-12") != [] and files("1970-01-11") != kept_day
    left = spark.read.schema(schemas.VOLUMES).parquet(path)
    assert sorted(r.seq for r in left.collect()) == list(range(42, 80))
    assert prune_stored(spark, path, 15 * DAY + DAY // 2, 5, most_files=4) == 0
    assert prune_stored(spark, path, 15 * DAY + DAY // 2, 5, most_files=2) == 0
    assert len(files("1970-01-20")) == 1 and sorted(r.seq for r in spark.read.schema(schemas.VOLUMES).parquet(path).collect()) == list(range(42, 80))


def test_prune_of_a_boundary_day_without_rows_left(spark, tmp_path):
    path = str(tmp_path / "v")
    tables.append_events(volumes(spark, [1.0, 1.1, 2.0]), path)
    assert prune_stored(spark, path, int(6.5 * DAY), 5) == 2
    assert spark.read.schema(schemas.VOLUMES).parquet(path).count() == 1


def test_inventory_stream(spark, tmp_path):
    scans = [{"a": (1, 1), "b": (1, 1), "c": (1, 1)}, {"a": (1, 1), "b": (2, 1), "d": (5, 5)}, {"a": (1, 9), "c": (1, 1), "d": (5, 5)}, {"a": (1, 9)}]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "agent_id string, path string, size bigint, mtime bigint, scan_ts bigint"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for i, scan in enumerate(scans):
        rows = [("x", p, *s, (i + 1) * 100) for p, s in scan.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        if i == 1:  # the snapshot outlives the query
            series.stream_inventory(stream(), out, str(tmp_path / "ckpt")).awaitTermination()
    series.stream_inventory(stream(), out, str(tmp_path / "ckpt")).awaitTermination()
    got = sorted((r.path, r.scan_ts, r.change) for r in series.inventory_changes(spark, out).collect())
    assert got == [
        ("a", 100, "new"), ("a", 300, "changed"), ("b", 100, "new"), ("b", 200, "changed"), ("b", 200, "vanished"), ("c", 100, "new"),
        ("c", 100, "vanished"), ("c", 300, "new"), ("c", 300, "vanished"), ("d", 200, "new"), ("d", 300, "vanished"),
    ]


def test_inventory_stream_shares_state_by_bucket(spark, tmp_path):
    """Files of one bucket keep their own scans, big numbers stay whole beside missing ones."""
    folder, out, stamp = str(tmp_path / "in"), str(tmp_path / "out"), 1_760_000_000_000_000_001
    schema = "agent_id string, path string, size bigint, mtime bigint, scan_ts bigint"
    for at in (100, 200):
        rows = [("x", "a", 1, stamp, at), (None, "a", 1, stamp + at, at), ("x", "b", None, stamp, at)]
        spark.createDataFrame(rows[: 3 if at == 100 else 2], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([("x", "end", 1, 1, 300)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    series.stream_inventory(stream, out, str(tmp_path / "ckpt"), buckets=1).awaitTermination()
    got = {tuple(r) for r in series.inventory_changes(spark, out).filter("path != 'end'").collect()}
    assert got == {
        ("x", "a", 100, 1, stamp, "new"), (None, "a", 100, 1, stamp + 100, "new"), ("x", "b", 100, None, stamp, "new"),
        (None, "a", 200, 1, stamp + 200, "changed"), ("x", "b", 100, None, stamp, "vanished"),
        ("x", "a", 200, 1, stamp, "vanished"), (None, "a", 200, 1, stamp + 200, "vanished"),
    }


def test_a_batch_written_again_adds_nothing(spark, tmp_path):
    sink = folder_sink(str(tmp_path / "alerts"))
    batch = spark.createDataFrame([(1,), (2,)], "id long")
    sink(batch, 0)
    sink(batch, 0)
    sink(batch, 1)
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 4
