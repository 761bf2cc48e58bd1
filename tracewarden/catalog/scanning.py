"""Scan queries over a file inventory made of the document table.

Every document is a file in an agent's data directory; its first line is a setting that points to
the host of a page.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden import telemetry as T
from tracewarden.catalog.oracle import benign, host_allowed
from tracewarden.catalog.registry import query
from tracewarden.plans import reports as Q
from tracewarden.plans import rules as R
from tracewarden.plans import scan as C
from tracewarden.sources.inventory import entropy_of_file, ingest_file_inventory, profile_configs, profile_roots, shannon_entropy
from tracewarden.telemetry import VIEW_PARAMS

SCAN_TS = 1_706_745_600_000
PARAMS = replace(VIEW_PARAMS, hidden_blob_bytes=1500, hidden_blob_entropy=4.25)

_DIRS = ["/cache", "/a/b/c", "", "/1/2/3/4/5/6/7/8/9", "/conf"]
_ENDS = [".json", ".bin", ".zip", ".txt"]
TABLES = {
    "stored": f"""SELECT doc_id, 'agent-' || (doc_id % 17) AS agent_id, '/home/u/.agent-' || (doc_id % 17) AS root,
        CASE doc_id % 5 {' '.join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(_DIRS))} END AS dir,
        '/f' || doc_id || CASE doc_id % 4 {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDS))} END AS name,
        page_host, '{{"telemetryEndpoint": "https://' || page_host || '/v1"}}' || chr(10) || text AS content
        FROM documents JOIN hosts ON page_id = doc_id % (SELECT count(*) FROM pages)""",
    "inventory": """SELECT *, root || dir || name AS path, CAST(strlen(content) AS BIGINT) AS size, doc_id % 5 != 0 AS scannable,
        CAST(len(string_split(dir, '/')) - 1 AS INT) AS depth FROM stored""",
    "bytes": "SELECT path, unnest(regexp_extract_all(hex(encode(content)), '..')) AS b FROM inventory",
    "counted": "SELECT path, b, count(*) AS n FROM bytes GROUP BY 1, 2",
    "entropies": """SELECT path, -sum(n / t * log2(n / t)) AS exact FROM (
        SELECT path, n, sum(n) OVER (PARTITION BY path) AS t FROM counted) GROUP BY path""",
    "big": f"SELECT * FROM inventory WHERE size >= {PARAMS.hidden_blob_bytes} AND doc_id % 4 != 2",
    "big_chars": """SELECT path, c, (strlen(content) - strlen(replace(content, c, ''))) // strlen(c) AS n FROM (
        SELECT path, content, unnest(list_distinct(string_split(content, ''))) AS c FROM big)""",
    "big_bytes": """SELECT path, b, sum(n) AS n FROM (SELECT path, n, unnest(regexp_extract_all(hex(encode(c)), '..')) AS b FROM big_chars) GROUP BY 1, 2""",
    "big_entropies": """SELECT path, -sum(n / t * log2(n / t)) AS exact FROM (
        SELECT path, n, sum(n) OVER (PARTITION BY path) AS t FROM big_bytes) GROUP BY path""",
    "blobs": f"""SELECT big.* FROM big JOIN big_entropies USING (path) WHERE CAST(exact AS FLOAT) >= {PARAMS.hidden_blob_entropy}""",
    "configured": """SELECT * FROM inventory WHERE doc_id % 40 = 1""",
    "odd_configured": f"""SELECT agent_id, page_host AS host, min(path) AS path FROM (SELECT * FROM inventory WHERE scannable AND doc_id % 4 IN (0, 3)
        UNION SELECT * FROM configured) i WHERE NOT {host_allowed('i.agent_id', 'i.page_host')} AND NOT {benign('page_host')} GROUP BY 1, 2""",
    "odd": f"""SELECT agent_id, page_host AS host, min(path) AS path FROM inventory i WHERE scannable AND doc_id % 4 IN (0, 3)
        AND NOT {host_allowed('i.agent_id', 'i.page_host')} AND NOT {benign('page_host')} GROUP BY 1, 2""",
}


def _landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = T.documents(spark, sf_dir)
    pages = T.page_hosts(spark, sf_dir)
    count = pages.count()
    rows = documents.withColumn("page_id", F.col("doc_id") % count).join(pages, "page_id")
    doc = F.col("doc_id")
    folder = F.get(F.array(*[F.lit(d) for d in _DIRS]), (doc % 5).cast("int"))
    end = F.get(F.array(*[F.lit(e) for e in _ENDS]), (doc % 4).cast("int"))
    content = F.concat(F.lit('{"telemetryEndpoint": "https://'), "page_host", F.lit('/v1"}\n'), "text").cast("binary")
    path = F.concat(F.lit("/home/u/.agent-"), doc % T.AGENTS, folder, F.lit("/f"), doc, end)
    return rows.select(path.alias("path"), F.octet_length(content).cast("bigint").alias("size"), doc.alias("mtime"), content.alias("content"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, size, mtime) of the stored documents."""
    return _landed_files(spark, sf_dir).drop("content")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of the stored documents; joined only to files chosen on metadata."""
    return _landed_files(spark, sf_dir).select("path", "content")


def _homes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    profiles = T.profiles(spark).withColumn("data_dirs", F.transform("data_dirs", lambda d: F.replace(d, F.lit("/home/u/"), F.lit("~/"))))
    return profiles, spark.createDataFrame([("/home/u",)], "home string")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_file_inventory(files(spark, sf_dir), profile_roots(*_homes(spark)))


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles' config files: one of the stored documents each, of an ending that the text search skips."""
    profiles, homes = _homes(spark)
    names = files(spark, sf_dir).filter(F.col("mtime") % 40 == 1)
    own = names.groupBy(F.regexp_extract("path", r"\.(agent-\d+)/", 1).alias("id")).agg(F.collect_list(F.regexp_replace("path", "^/home/u/", "~/")).alias("config_files"))
    return profile_configs(profiles.drop("config_files").join(own, "id"), homes)


@query("ingest_file_inventory", "SELECT agent_id, root, path, size, doc_id AS mtime, depth, scannable FROM inventory", TABLES)
def file_inventory(spark, sf_dir):
    return inventory(spark, sf_dir)


@query("dir_usage", "SELECT agent_id, root, CAST(sum(size) AS BIGINT) AS size, count(*) AS files FROM inventory GROUP BY 1, 2", TABLES)
def dir_usage(spark, sf_dir):
    return Q.dir_usage(inventory(spark, sf_dir))


_RUNNING = "(SELECT count(*) FROM latest p WHERE p.pid % 5 = 0 AND 'agent-' || (p.pid % 17) = a.agent_id)"


@query("installed_agents", "SELECT DISTINCT agent_id FROM inventory WHERE doc_id % 3 = 0", TABLES)
def installed_agents(spark, sf_dir):
    return _installed(spark, sf_dir)


def _installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = T.profiles(spark).select(F.col("id").alias("agent_id"), F.explode("data_dirs").alias("path"))
    return Q.installed_agents(wanted, files(spark, sf_dir).filter(F.col("mtime") % 3 == 0))


@query(
    "agent_inventory",
    f"""SELECT agent_id AS id, 'Agent ' || i AS name, 'vendor-' || (i % 4) AS vendor, agent_id IN (SELECT agent_id FROM stored WHERE doc_id % 3 = 0) AS installed,
        CAST(coalesce((SELECT sum(size) FROM inventory v WHERE v.agent_id = a.agent_id), 0) AS BIGINT) AS data_dir_bytes, {_RUNNING} AS running_processes FROM agents a""",
    TABLES,
)
def agent_inventory(spark, sf_dir):
    running = T.processes(spark, sf_dir).filter(F.col("pid") % 5 == 0).withColumn(
        "agent_id", F.concat(F.lit("agent-"), F.col("pid") % T.AGENTS)
    )
    usage = Q.dir_usage(inventory(spark, sf_dir))
    return Q.agent_inventory(T.profiles(spark), _installed(spark, sf_dir), usage, running)


@query("entropy_of_file", "SELECT path, round(exact, 3) AS entropy FROM entropies", TABLES)
def file_entropy(spark, sf_dir):
    measured = entropy_of_file(inventory(spark, sf_dir), stored=contents(spark, sf_dir))
    return measured.select("path", F.round(F.col("entropy").cast("double"), 3).alias("entropy"))


@query(
    "shannon_entropy",
    """SELECT doc_id, round(-sum(n / t * log2(n / t)), 3) + 0.0 AS entropy FROM (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS t FROM (
        SELECT doc_id, b, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY 1, 2)) GROUP BY 1""",
)
def entropy(spark, sf_dir):
    documents = T.documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("body"))
    measured = shannon_entropy(documents, "body")
    return measured.select("doc_id", F.round(F.col("entropy").cast("double"), 3).alias("entropy"))


@query("detect_hidden_blobs", "SELECT agent_id, path, size, 'hidden_blob' AS kind FROM blobs", TABLES)
def detect_hidden_blobs(spark, sf_dir):
    found = C.detect_hidden_blobs(inventory(spark, sf_dir), PARAMS, SCAN_TS, stored=contents(spark, sf_dir))
    return found.select("agent_id", "path", "size", "kind")


@query("incremental_scan", "SELECT agent_id, path, size, 'hidden_blob' AS kind FROM blobs WHERE doc_id % 3 != 0", TABLES)
def incremental_scan(spark, sf_dir):
    previous = files(spark, sf_dir).filter(F.col("mtime") % 3 == 0)
    found = C.detect_hidden_blobs(inventory(spark, sf_dir), PARAMS, SCAN_TS, previous, contents(spark, sf_dir))
    return found.select("agent_id", "path", "size", "kind")


@query("detect_unexpected_endpoints", "SELECT agent_id, host, path, 'telemetryendpoint' AS key FROM odd", TABLES)
def detect_unexpected_endpoints(spark, sf_dir):
    found = C.detect_unexpected_endpoints(inventory(spark, sf_dir), T.profiles(spark), PARAMS, stored=contents(spark, sf_dir))
    return found.select("agent_id", "host", "path", "key")


@query("scan_config_files", "SELECT agent_id, host, path, 'telemetryendpoint' AS key FROM odd_configured", TABLES)
def scan_config_files(spark, sf_dir):
    configs = config_files(spark, sf_dir)
    found = C.detect_unexpected_endpoints(inventory(spark, sf_dir), T.profiles(spark), PARAMS, configs, contents(spark, sf_dir))
    return found.select("agent_id", "host", "path", "key")


@query(
    "endpoint_artifacts",
    f"""SELECT CAST({SCAN_TS} AS BIGINT) AS ts, agent_id, path, CAST(0 AS BIGINT) AS size, 'unexpected_endpoint' AS kind,
        'setting telemetryendpoint points to ' || host || ' outside the allow list (' || path || ')' AS detail FROM odd""",
    TABLES,
)
def endpoint_artifacts(spark, sf_dir):
    found = C.detect_unexpected_endpoints(inventory(spark, sf_dir), T.profiles(spark), PARAMS, stored=contents(spark, sf_dir))
    return C.endpoint_artifacts(found, SCAN_TS).drop("entropy")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scan_artifacts(inventory(spark, sf_dir), T.profiles(spark), PARAMS, SCAN_TS, stored=contents(spark, sf_dir))


@query(
    "list_artifacts",
    """SELECT * FROM (SELECT agent_id, path, size, 'hidden_blob' AS kind FROM blobs UNION ALL
        SELECT agent_id, path, CAST(0 AS BIGINT), 'unexpected_endpoint' FROM odd) ORDER BY size DESC, path LIMIT 200""",
    TABLES,
)
def list_artifacts(spark, sf_dir):
    return Q.list_artifacts(artifacts(spark, sf_dir), 0, 200).select("agent_id", "path", "size", "kind")


_BLOB_FINDINGS = "SELECT 'artifact.hidden_blob' AS rule_id, CAST(2 AS INT) AS severity, agent_id, path AS dedupe_key FROM blobs"
_ENDPOINT_FINDINGS = "SELECT DISTINCT 'artifact.unexpected_endpoint' AS rule_id, CAST(1 AS INT) AS severity, agent_id, path AS dedupe_key FROM odd"
_SHOWN = ["rule_id", "severity", "agent_id", "dedupe_key"]


@query("rule_hidden_blob", _BLOB_FINDINGS, TABLES)
def rule_hidden_blob(spark, sf_dir):
    blobs = C.detect_hidden_blobs(inventory(spark, sf_dir), PARAMS, SCAN_TS, stored=contents(spark, sf_dir))
    return R.rule_hidden_blob(blobs, PARAMS).select(*_SHOWN)


@query("rule_unexpected_endpoint", _ENDPOINT_FINDINGS, TABLES)
def rule_unexpected_endpoint(spark, sf_dir):
    endpoints = C.detect_unexpected_endpoints(inventory(spark, sf_dir), T.profiles(spark), PARAMS, stored=contents(spark, sf_dir))
    return R.rule_unexpected_endpoint(C.endpoint_artifacts(endpoints, SCAN_TS), PARAMS).select(*_SHOWN)


@query("scan_findings", f"{_BLOB_FINDINGS} UNION ALL {_ENDPOINT_FINDINGS}", TABLES)
def scan_findings(spark, sf_dir):
    return C.scan_findings(inventory(spark, sf_dir), T.profiles(spark), PARAMS, SCAN_TS, stored=contents(spark, sf_dir)).select(*_SHOWN)
