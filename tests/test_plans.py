import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tracewarden import schemas
from tracewarden.operators import windows
from tracewarden.params import Params
from tracewarden.plans import reports, rules, scan
from tracewarden.sources import inventory, tables
from tracewarden.sources.profiles import load_profiles
from tracewarden.streaming import detect, series

P = Params()


def finding(i, ts, severity, rule="r", agent="a", key="k"):
    return (i, ts, rule, severity, "t", "d", agent, 1, [], "open", key, i)


def findings(spark, rows):
    return spark.createDataFrame(rows, schemas.FINDINGS)


def test_finding_status(spark):
    found = findings(spark, [finding(1, 10, 4), finding(2, 20, 0)])
    overrides = spark.createDataFrame([(1, "ignored", 1), (1, "open", 2), (2, "ignored", 3)], "id bigint, status string, arrival bigint")
    shown = tables.set_finding_status(found, overrides)
    assert [r.id for r in reports.list_findings(shown).collect()] == [1]
    assert [r.id for r in reports.list_findings(shown, include_ignored=True).collect()] == [2, 1]
    assert [r.id for r in reports.list_findings(shown, status="ignored").collect()] == [2]
    assert reports.list_findings(shown, min_severity="high", include_ignored=True).count() == 1


def test_counts(spark):
    found = findings(spark, [finding(i, i, s) for i, s in enumerate([0, 1, 2, 3, 4, 9])])
    assert tuple(reports.finding_counts(found).first()) == (2, 1, 1, 2)
    assert reports.alert_route(found).count() == 3
    keys = spark.createDataFrame([("r", "k"), ("r", "z")], "rule_id string, dedupe_key string")
    assert reports.recent_finding_exists(found, keys, 5).count() == 1
    assert reports.recent_finding_exists(found, keys, 6).count() == 0


def test_volume_series(spark):
    rows = [(i, 1_000_000 + i, 1, "a", 1, 100, 1000) for i in range(5)]
    series_ = reports.volume_series(spark.createDataFrame(rows, schemas.VOLUMES), bucket_ms=10_000).collect()
    assert [tuple(r) for r in series_] == [(1_000_000, 500, 5)]


def test_agent_summaries(spark):
    agents = spark.createDataFrame([("a", "A", "v", 0, 5), ("b", "B", "v", 0, 9)], schemas.AGENTS)
    volumes = spark.createDataFrame([(1, 100_000_000, 1, "a", 0, 7, 1), (2, 1, 1, "a", 0, 50, 1)], schemas.VOLUMES)
    found = findings(spark, [finding(1, 1, 2, agent="a"), finding(2, 1, 3, agent="a")])
    rows = reports.agent_summaries(agents, volumes, found, 100_000_000).collect()
    assert [(r.id, r.bytes_out_24h, r.open_findings, r.worst_severity) for r in rows] == [("b", 0, 0, None), ("a", 7, 2, "high")]


# --- scan -----------------------------------------------------------------------------------


@pytest.fixture()
def tree(spark, tmp_path):
    base = tmp_path / ".zcode"
    (base / "cache").mkdir(parents=True)
    noise = os.urandom(200_000)
    (base / "blob.bin").write_bytes(noise)
    (base / "clip.mp4").write_bytes(noise)
    (base / "plain.txt").write_bytes(b"abc" * 60_000)
    (base / "config.json").write_text('{"telemetryEndpoint": "https://collect.unknown.example/in", "baseURL": "https://api.z.ai/v1", "uploadUrl": "https://x.github.com"}')
    (base / "cache" / "skip.json").write_text('{"endpoint": "https://other.unknown.example"}')
    roots = spark.createDataFrame([("zcode", str(base))], "agent_id string, root string")
    return inventory.ingest_file_inventory(inventory.read_tree(roots), roots)


def test_scan(spark, tree):
    params = replace(P, hidden_blob_bytes=100_000)
    found = scan.scan_findings(tree, load_profiles(spark), params, 5).collect()
    assert [(f.rule_id, f.dedupe_key.split("/")[-1]) for f in found] == [
        ("artifact.hidden_blob", "blob.bin"), ("artifact.unexpected_endpoint", "config.json")
    ]
    changed, snapshot = series.incremental_scan(tree, tree.filter("path like '%blob.bin'"))
    assert changed.count() == 4 and snapshot.columns == ["path", "mtime", "size"]
    again = scan.detect_hidden_blobs(tree, params, 6, previous=snapshot)
    assert again.count() == 0


def test_installed(spark):
    wanted = spark.createDataFrame([("a", "/h/.a"), ("b", "/h/.b"), ("c", "/h/c.json")], "agent_id string, path string")
    files = spark.createDataFrame([("/h/.a/x/y",), ("/h/c.json",)], "path string")
    assert sorted(r.agent_id for r in reports.installed_agents(wanted, files).collect()) == ["a", "c"]


# --- streaming ------------------------------------------------------------------------------


def events(spark, n=400, span=2_000_000, seed=5):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        kind = rng.choice(["volume", "file", "connection", "http"])
        row = {"event_type": kind, "seq": seq, "ts": 10_000_000 + rng.randint(0, span), "pid": 1, "agent_id": rng.choice(["zcode", "aider"])}
        if kind == "volume":
            row |= {"bytes_out": rng.randint(0, 4 << 20), "bytes_in": 1}
        elif kind == "file":
            row |= {"path": rng.choice(["/p/.env", "/p/.git/x", f"/p/s{rng.randint(0, 9)}.py"]), "op": "open", "repo_root": "/p"}
        elif kind == "connection":
            row |= {"remote_ip": f"8.8.8.{rng.randint(0, 3)}", "remote_addr": "x", "remote_host": None}
        else:
            row |= {"host": rng.choice(["evil.example", "z.ai"]), "method": "POST", "path": "/", "bytes_out": 10, "class": rng.choice(["secret", "text"])}
        rows.append(row)
    return spark.createDataFrame(rows, schemas.STREAM_EVENTS)


PARAMS = replace(
    P, volume_spike_bytes=5 << 20, bulk_read_files=4, git_read_rows=3, bulk_read_window_ms=60_000, slice_ms=20_000,
    repeat_ms=400_000, alert_repeat_ms=200_000,
)


def shown(found):
    return sorted(map(tuple, found.select("rule_id", "agent_id", "ts", "seq", "dedupe_key", F.to_json("evidence")).collect()))


def land(rows, folder, cuts, mark=True):
    low = -1
    for high in [*cuts, 1 << 60]:
        rows.filter((F.col("ts") > low) & (F.col("ts") <= high)).coalesce(1).write.mode("append").parquet(folder)
        low = high
    if mark:
        land_mark(rows, folder)


def land_mark(rows, folder, ts=10**9):
    mark = rows.sparkSession.createDataFrame([{"ts": ts}], schemas.STREAM_EVENTS)
    mark.coalesce(1).write.mode("append").parquet(folder)


def opened(spark, folder, files=1):
    return spark.readStream.schema(schemas.STREAM_EVENTS).option("maxFilesPerTrigger", files).parquet(folder)


def detected(spark, folder, tmp_path, **options):
    query = detect.stream_detect(opened(spark, folder), load_profiles(spark), PARAMS, str(tmp_path / "store"), str(tmp_path / "ckpt"), **options)
    query.awaitTermination()
    return query


def test_stream_equals_batch(spark, tmp_path):
    rows = events(spark)
    land(rows, str(tmp_path / "in"), [10_500_000, 10_900_000, 11_700_000])
    query = detected(spark, str(tmp_path / "in"), tmp_path)
    expected = shown(rules.all_findings(detect.tables_of(rows), load_profiles(spark), PARAMS))
    assert len(expected) > 20
    assert shown(detect.stream_findings(spark, str(tmp_path / "store"), PARAMS)) == expected
    assert detect.stream_late(spark, str(tmp_path / "store")).count() == 0
    # nothing is remembered once no window can look back on it
    sizes = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    assert max(sizes) > 20 and sizes[-1] == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = events(spark)
    folder = str(tmp_path / "in")
    for low in range(10_000_000, 12_000_001, 170_000):
        part = rows.filter((F.col("ts") >= low) & (F.col("ts") < low + 170_000))
        part.coalesce(1).write.mode("append").parquet(folder)
        if (low // 170_000) % 4 == 0:
            detected(spark, folder, tmp_path)
    land_mark(rows, folder)
    detected(spark, folder, tmp_path)
    expected = shown(rules.all_findings(detect.tables_of(rows), load_profiles(spark), PARAMS))
    assert shown(detect.stream_findings(spark, str(tmp_path / "store"), PARAMS)) == expected


def test_findings_and_late_rows_account_for_every_row(spark, tmp_path):
    """Rows in any order: what is not late gives the findings of the batch rules over just those rows."""
    rows = events(spark).withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(6)))
    folder = str(tmp_path / "in")
    for i in range(6):
        rows.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(folder)
    land_mark(rows, folder)
    detected(spark, folder, tmp_path, delay_ms=1_500_000)
    late = detect.stream_late(spark, str(tmp_path / "store"))
    numbers = {r.seq for r in late.collect()}
    assert 0 < len(numbers) < 200 and late.join(rows.drop("part"), rows.columns[:-1]).count() <= len(numbers)
    assert {tuple(r) for r in late.collect()} <= {tuple(r) for r in rows.drop("part").collect()}
    on_time = rows.filter(~F.col("seq").isin(*numbers)).drop("part")
    expected = shown(rules.all_findings(detect.tables_of(on_time), load_profiles(spark), PARAMS))
    assert len(expected) > 10
    assert shown(detect.stream_findings(spark, str(tmp_path / "store"), PARAMS)) == expected


def test_rows_of_the_last_instant_wait(spark, tmp_path):
    rows = events(spark, 60)
    land(rows, str(tmp_path / "in"), [], mark=False)
    detected(spark, str(tmp_path / "in"), tmp_path)
    last = rows.agg(F.max("ts")).first()[0]
    assert detect.stream_findings(spark, str(tmp_path / "store"), PARAMS).filter(F.col("ts") >= last).count() == 0
    land_mark(rows, str(tmp_path / "in"))
    detected(spark, str(tmp_path / "in"), tmp_path)
    expected = shown(rules.all_findings(detect.tables_of(rows), load_profiles(spark), PARAMS))
    assert shown(detect.stream_findings(spark, str(tmp_path / "store"), PARAMS)) == expected


def test_rate_limit_stream(spark, tmp_path):
    rows = [(i, 1000 + i * 130 % 5000, i % 3, f"/p/{i}", "secret" if i % 9 == 0 else None) for i in range(120)]
    frame = spark.createDataFrame(rows, "seq long, ts long, pid long, path string, sensitivity string")
    folder = str(tmp_path / "in")
    for i in range(4):
        frame.filter(F.col("seq") % 4 == i).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(None, 10**8, None, None, None)], frame.schema).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    detect.stream_rate_limit(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), 3, delay_ms=9000).awaitTermination()
    got = detect.rate_limited(spark, str(tmp_path / "out"), frame.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windows.rate_limit_reads(frame, 3).collect()))
    assert detect.rate_limited(spark, str(tmp_path / "out"), frame.schema, "late").count() == 0


def test_rate_limit_of_processes_in_one_bucket(spark, tmp_path):
    rows = [(i, 1000 + i * 7 % 1000, i % 5 or None, "/p", None) for i in range(40)]
    frame = spark.createDataFrame(rows, "seq long, ts long, pid long, path string, sensitivity string")
    folder = str(tmp_path / "in")
    frame.unionByName(spark.createDataFrame([(None, 10**8, None, None, None)], frame.schema)).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(frame.schema).parquet(folder)
    detect.stream_rate_limit(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), 3, buckets=1).awaitTermination()
    got = detect.rate_limited(spark, str(tmp_path / "out"), frame.schema)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, windows.rate_limit_reads(frame, 3).collect()))


def test_hits_of_single_rows_are_dealt_to_parts(spark):
    """A hit that needs no window leaves the agent's own part, which keeps every row once."""
    rows = events(spark, 400)
    facts = detect._facts(rows, load_profiles(spark), PARAMS, 0, None)
    assert facts.filter("part = 0").count() == rows.count() and facts.filter("part = 0 and rule_id != ''").count() == 0
    hits = facts.filter("part > 0")
    assert hits.select("part").distinct().count() > 1 and hits.filter("flags != 0 or rule_id = ''").count() == 0


def test_rate_limit_lists_late_rows(spark, tmp_path):
    frame = spark.createDataFrame([(1, 9000, 1, "/a", None), (2, 1000, 1, "/b", "secret"), (3, 9100, 1, "/c", None)], "seq long, ts long, pid long, path string, sensitivity string")
    folder = str(tmp_path / "in")
    for i in (1, 2, 3):
        frame.filter(F.col("seq") == i).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(None, 10**8, None, None, None)], frame.schema).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    detect.stream_rate_limit(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), 3).awaitTermination()
    read = lambda what: sorted(r.seq for r in detect.rate_limited(spark, str(tmp_path / "out"), frame.schema, what).collect())
    assert (read("kept"), read("late")) == ([1, 3], [2])


def test_store_sink(spark, tmp_path):
    rows = events(spark, 50)
    land(rows, str(tmp_path / "in"), [11_000_000])
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    series.stream_store_sink(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == 50 and stored.select("table").distinct().count() == 4
