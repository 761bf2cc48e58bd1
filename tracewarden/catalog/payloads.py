"""Scalar expressions over whole documents, hosts and events."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tracewarden import telemetry as T
from tracewarden.catalog.oracle import (
    LOOPBACK, PREVIEW, PRIVATE, RESERVED, benign, extension, file_name, ip_test, is_source, lines, matches, one_of,
    secret_kind, size_text, source_summary,
)
from tracewarden.catalog.registry import query
from tracewarden.functions import fmt, globs, net, paths, payload
from tracewarden.session import in_arrays, values_of
from tracewarden.sources import listings
from tracewarden.sources.captures import classify_payload, decompress_prefix, tar_entries


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.documents(spark, sf_dir).withColumn("body", F.col("text").cast("binary"))


@F.arrow_udf(BinaryType())
def packed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Gzip form of landed texts: the input of the unwrapping queries."""
    return in_arrays((gzip.compress(t, 1, mtime=0) for t in values_of(texts)), len, pa.binary())


@F.arrow_udf(BinaryType())
def tarred(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A tar of two entries per row."""

    def entry(name: str, body: bytes) -> list[bytes]:
        header = bytearray(512)
        header[: len(name)] = name.encode()
        header[124:136] = b"%011o\0" % len(body)
        header[257:262] = b"ustar"
        return [bytes(header), body, b"\0" * (-len(body) % 512)]

    rows = ((n.as_py(), b.as_py()) for names, bodies in batches for n, b in zip(names, bodies))
    tars = (b"".join([*entry(n, b), *entry(n + ".bak", b), b"\0" * 1024]) for n, b in rows)
    return in_arrays(tars, len, pa.binary())


# --- payload classification -----------------------------------------------------------------

_WRAP = "CASE doc_id % 3 WHEN 1 THEN 'inside gzip: ' || {0} WHEN 2 THEN 'inside gzip: inside gzip: ' || {0} ELSE {0} END"
_BARE = "CASE doc_id % 3 WHEN 1 THEN 'gzip content' WHEN 2 THEN 'inside gzip: gzip content' END"


@query("classify_payload", f"SELECT doc_id, class, coalesce({_WRAP.format('sample')}, {_BARE}) AS sample FROM doc_class")
def classify(spark, sf_dir):
    body = F.col("body")
    wraps = F.col("doc_id") % 3
    landed = documents(spark, sf_dir).withColumn("body", F.when(wraps == 0, body).otherwise(packed(body)))
    landed = landed.withColumn("body", F.when(wraps == 2, packed("body")).otherwise(F.col("body")))
    return classify_payload(landed, "body").select("doc_id", "class", "sample")


@query("decompress_prefix", "SELECT doc_id, sha256(text) AS digest, CAST(strlen(text) AS INT) AS size FROM documents")
def inflate(spark, sf_dir):
    landed = documents(spark, sf_dir).withColumn("body", packed("body"))
    inflated = decompress_prefix(landed, "body")
    return inflated.select("doc_id", F.sha2("inflated", 256).alias("digest"), F.octet_length("inflated").alias("size"))


@query("tar_entries", "SELECT doc_id, 'docs/' || doc_id || '.txt,docs/' || doc_id || '.txt.bak' AS entries FROM documents")
def tar(spark, sf_dir):
    name = F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt"))
    landed = documents(spark, sf_dir).withColumn("body", tarred(name, "body"))
    return tar_entries(landed, "body").select("doc_id", F.array_join("entries", ",").alias("entries"))


@query(
    "decode_base64",
    "SELECT doc_id, CASE WHEN (strlen(text) + 2) // 3 * 4 >= 256 THEN sha256(text) END AS digest FROM documents",
)
def base64_decoded(spark, sf_dir):
    landed = F.base64("body").cast("binary")
    return documents(spark, sf_dir).select("doc_id", F.sha2(payload.decode_base64(landed), 256).alias("digest"))


_MAGIC = ["504B0304", "377ABCAF271C", "52617221", "00" * 257 + "7573746172", ""]


@query("archive_kind", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'zip' WHEN 1 THEN '7z' WHEN 2 THEN 'rar' WHEN 3 THEN 'tar' END AS kind FROM documents")
def archives(spark, sf_dir):
    magic = F.get(F.array(*[F.lit(m) for m in _MAGIC]), (F.col("doc_id") % 5).cast("int"))
    body = F.concat(F.unhex(magic), F.col("body"))
    return documents(spark, sf_dir).select("doc_id", payload.archive_kind(body).alias("kind"))


@query("detect_secret", f"SELECT doc_id, {secret_kind('text')} AS kind FROM documents")
def secrets(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", payload.detect_secret(F.col("text")).alias("kind"))


_AS_CODE = "CASE WHEN doc_id % 2 = 0 THEN replace(replace(text, ' the ', ';' || chr(10) || 'let '), '. ', '};' || chr(10) || 'fn ') ELSE text END"


def _as_code() -> Column:
    """Every second document rewritten line by line into something code-shaped."""
    code = F.replace("text", F.lit(" the "), F.lit(";\nlet "))
    code = F.replace(code, F.lit(". "), F.lit("};\nfn "))
    return F.when(F.col("doc_id") % 2 == 0, code).otherwise(F.col("text"))


_CODED = {"coded": f"SELECT doc_id, {_AS_CODE} AS text FROM documents"}


@query("looks_like_source", f"SELECT doc_id, {is_source('text')} AS is_source, CAST({lines('text')} AS INT) AS lines FROM coded", _CODED)
def source(spark, sf_dir):
    coded = documents(spark, sf_dir).select("doc_id", _as_code().alias("text"))
    text = F.col("text")
    return coded.select("doc_id", payload.looks_like_source(text).alias("is_source"), payload.line_count(text).alias("lines"))


@query(
    "is_code_keyword_line",
    f"""SELECT doc_id, count(*) FILTER ({matches("ltrim(line)", payload.CODE_LINE_PATTERN.replace('(?m)', ''))}) AS code_lines
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM coded) GROUP BY doc_id""",
    _CODED,
)
def keyword_lines(spark, sf_dir):
    split = documents(spark, sf_dir).select("doc_id", F.explode(F.split(_as_code(), "\n")).alias("line"))
    return split.groupBy("doc_id").agg(F.count_if(payload.is_code_keyword_line(F.col("line"))).alias("code_lines"))


_LISTED = "text || CASE doc_id % 3 WHEN 0 THEN ' see a.py and b.rs' WHEN 1 THEN ' x.yaml' ELSE '' END"


@query("describe_source", f"SELECT doc_id, {source_summary('text')} AS summary FROM (SELECT doc_id, {_LISTED} AS text FROM documents)")
def described(spark, sf_dir):
    kind = F.col("doc_id") % 3
    text = F.concat("text", F.when(kind == 0, " see a.py and b.rs").when(kind == 1, " x.yaml").otherwise(""))
    listed = documents(spark, sf_dir).select("doc_id", text.alias("text"))
    return listed.select("doc_id", payload.describe_source(F.col("text")).alias("summary"))


def _bounded(size: int) -> str:
    """The first ``size`` bytes as text, a cut character replaced by U+FFFD; null when not printable."""
    head = f"substr(hex(encode(text)), 1, {2 * size})"
    whole = f"regexp_replace({head}, '(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){{0,2}})$', '')"
    shown = f"decode(unhex({whole})) || CASE WHEN {whole} != {head} THEN chr(65533) ELSE '' END"
    controls = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
    return (
        f"SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INT) AS size FROM (SELECT doc_id, CASE WHEN length(t) > 0 AND NOT contains(t, chr(0)) "
        f"AND (length(t) - len(regexp_extract_all(t, '{controls}'))) * 100 // length(t) >= 90 THEN t END AS t FROM (SELECT doc_id, {shown} AS t FROM documents))"
    )


@query("text_preview", _bounded(PREVIEW))
def preview(spark, sf_dir):
    shown = documents(spark, sf_dir).select("doc_id", payload.text_preview(F.col("body")).alias("t"))
    return shown.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("size"))


@query("stored_body", _bounded(777))
def stored(spark, sf_dir):
    shown = documents(spark, sf_dir).select("doc_id", payload.stored_body(F.col("body"), 777).alias("t"))
    return shown.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("size"))


@query("body_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def digest(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", payload.body_sha256(F.col("body")).alias("digest"))


@query(
    "extract_endpoints",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'upload_url' ELSE 'endpoint' END AS key, page_host AS host,
        CASE WHEN doc_id % 2 = 0 THEN 'https://' ELSE 'http://' END || page_host AS url FROM documents JOIN hosts ON page_id = doc_id % (SELECT count(*) FROM pages)
        UNION ALL SELECT doc_id, 'url', 'api.' || page_host, 'https://api.' || page_host FROM documents JOIN hosts ON page_id = doc_id % (SELECT count(*) FROM pages)""",
)
def endpoints(spark, sf_dir):
    pages = T.page_hosts(spark, sf_dir)
    count = pages.count()
    doc = F.col("doc_id")
    host = F.col("page_host")
    text = F.concat(
        F.when(doc % 3 == 0, '"upload_url": "').otherwise("endpoint = '"),
        F.when(doc % 2 == 0, "https://").otherwise("http://"), host, F.lit("/v1\"'\n"), F.col("text"),
        F.lit('\nurl: "https://plain.'), host, F.lit('"\n"Url" : "https://api.'), host, F.lit('." "see": "https://w3.org" endpoint="https://'),
        host, F.lit('"'),
    )
    joined = documents(spark, sf_dir).withColumn("page_id", doc % count).join(pages, "page_id")
    found = joined.select("doc_id", F.inline(payload.extract_endpoints(text)))
    return found.select("doc_id", "key", "host", F.rtrim("url", F.lit(".")).alias("url"))


# --- addresses and hosts --------------------------------------------------------------------


@query(
    "ip_predicates",
    f"""SELECT seq, remote_ip, {ip_test('remote_ip', PRIVATE)} AS is_private, {ip_test('remote_ip', RESERVED)} AS is_reserved,
        {ip_test('remote_ip', LOOPBACK)} AS is_loopback FROM connections""",
)
def ip_predicates(spark, sf_dir):
    ip = F.col("remote_ip")
    return T.connections(spark, sf_dir).select(
        "seq", "remote_ip", net.is_private_ip(ip).alias("is_private"), net.is_reserved_ip(ip).alias("is_reserved"),
        net.is_loopback_ip(ip).alias("is_loopback"),
    )


for _name, _column, _tests in (
    ("is_private_ip", net.is_private_ip, PRIVATE),
    ("is_reserved_ip", net.is_reserved_ip, RESERVED),
    ("is_loopback_ip", net.is_loopback_ip, LOOPBACK),
):

    def _one_predicate(spark, sf_dir, column=_column, name=_name):
        return T.connections(spark, sf_dir).select("seq", column(F.col("remote_ip")).alias(name))

    query(_name, f"SELECT seq, {ip_test('remote_ip', _tests)} AS {_name} FROM connections")(_one_predicate)


@query(
    "parse_addresses",
    """SELECT seq, CASE WHEN seq % 4 != 3 THEN CASE WHEN seq % 4 = 1 THEN '2001:db8::' || (seq % 9) ELSE remote_ip END END AS ip,
        CASE WHEN seq % 4 != 3 THEN CAST(443 AS INT) END AS port, CAST(1024 + seq % 60000 AS INT) AS local_port FROM connections""",
)
def parse_addresses(spark, sf_dir):
    named = _connection_names(spark, sf_dir)
    remote = net.parse_remote(F.col("name"))
    return named.select("seq", remote["ip"].alias("ip"), remote["port"].alias("port"), net.parse_local_port(F.col("name")).alias("local_port"))


def _connection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    peer = (
        F.when(seq % 4 == 1, F.concat(F.lit("[2001:db8::"), seq % 9, F.lit("]:443")))
        .when(seq % 4 == 3, "*:443")
        .otherwise(F.col("remote_addr"))
    )
    local = F.when(seq % 2 == 0, "10.0.0.1").otherwise("[fe80::1]")
    name = F.concat(local, F.lit(":"), F.lit(1024) + seq % 60000, F.lit("->"), peer, F.lit(" (ESTABLISHED)"))
    return T.connections(spark, sf_dir).select("seq", name.alias("name"))


@query(
    "parse_remote",
    """SELECT seq, CASE WHEN seq % 4 = 1 THEN '2001:db8::' || (seq % 9) ELSE remote_ip END AS ip, CAST(443 AS INT) AS port
        FROM connections WHERE seq % 4 != 3""",
)
def parse_remote(spark, sf_dir):
    parsed = _connection_names(spark, sf_dir).select("seq", net.parse_remote(F.col("name")).alias("r"))
    return parsed.filter(F.col("r").isNotNull()).select("seq", "r.ip", "r.port")


@query("parse_local_port", "SELECT seq, CAST(1024 + seq % 60000 AS INT) AS local_port FROM connections")
def parse_local_port(spark, sf_dir):
    return _connection_names(spark, sf_dir).select("seq", net.parse_local_port(F.col("name")).alias("local_port"))


@query(
    "split_authority",
    """SELECT page_id, CASE WHEN page_id % 3 = 2 THEN '::1' ELSE page_host END AS host,
        CASE WHEN page_id % 3 = 0 THEN CAST(8000 + page_id % 1000 AS INT) WHEN page_id % 6 = 2 THEN CAST(443 AS INT) END AS port FROM hosts""",
)
def authorities(spark, sf_dir):
    page = F.col("page_id")
    text = (
        F.when(page % 3 == 0, F.concat("page_host", F.lit(":"), 8000 + page % 1000))
        .when(page % 6 == 2, "[::1]:443").when(page % 6 == 5, "[::1]").otherwise(F.col("page_host"))
    )
    hosts = T.page_hosts(spark, sf_dir).select("page_id", text.alias("authority"))
    parsed = net.split_authority(F.col("authority"))
    return hosts.select("page_id", parsed["host"].alias("host"), parsed["port"].alias("port"))


@query(
    "host_matches",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_host = 'example.org' OR ends_with(page_host, '.example.org') ELSE true END AS matches FROM hosts""",
)
def host_matches(spark, sf_dir):
    pattern = F.when(F.col("page_id") % 2 == 0, "*.Example.ORG.").otherwise(F.upper("page_host"))
    return T.page_hosts(spark, sf_dir).select("page_id", net.host_matches(pattern, F.col("page_host")).alias("matches"))


@query("is_benign_host", f"SELECT page_id, page_host, {benign('page_host')} AS benign FROM hosts")
def is_benign(spark, sf_dir):
    return T.page_hosts(spark, sf_dir).select("page_id", "page_host", net.is_benign_host(F.col("page_host")).alias("benign"))


@query(
    "domain_variants",
    "SELECT page_id, page_host AS variant FROM hosts UNION ALL SELECT page_id, '*.' || page_host FROM hosts WHERE page_id % 2 = 0",
)
def variants(spark, sf_dir):
    pattern = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" *."), F.upper("page_host"), F.lit("."))).otherwise(F.col("page_host"))
    return T.page_hosts(spark, sf_dir).select("page_id", F.explode(net.domain_variants(pattern)).alias("variant"))


# --- paths and text -------------------------------------------------------------------------

_GLOB = "**/repo{0,2}/**/f?[135]*.py"


@query("glob_to_regex", f"SELECT seq, path, {matches('path', r'^/home/u/repo[02]/src/f.[135].*\.py$')} AS matches FROM files")
def glob_match(spark, sf_dir):
    matched = F.col("path").rlike(globs.glob_to_regex(_GLOB))
    return T.file_events(spark, sf_dir).select("seq", "path", matched.alias("matches"))


_MIXED = {"mixed": "SELECT seq, path || CASE seq % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '/node_modules/x' WHEN 2 THEN '.Json' ELSE '' END AS path FROM files"}
_COMPRESSED = " OR ".join(
    [one_of(extension("path"), paths.COMPRESSED_EXTENSIONS)] + [f"contains(path, '{n}')" for n in paths.COMPRESSED_NEEDLES]
)


@query(
    "file_kinds",
    f"""SELECT seq, path, {_COMPRESSED} AS compressed, {one_of(extension('path'), paths.TEXT_EXTENSIONS)} OR lower({file_name('path')}) = '.env' AS texty FROM mixed""",
    _MIXED,
)
def file_kinds(spark, sf_dir):
    kind = F.col("seq") % 4
    path = F.concat("path", F.when(kind == 0, ".PNG").when(kind == 1, "/node_modules/x").when(kind == 2, ".Json").otherwise(""))
    mixed = T.file_events(spark, sf_dir).select("seq", path.alias("path"))
    path = F.col("path")
    return mixed.select(
        "seq", "path", paths.is_known_compressed(path).alias("compressed"), paths.is_text_candidate(path).alias("texty")
    )


@query("is_known_compressed", f"SELECT seq, path, {_COMPRESSED} AS compressed FROM mixed", _MIXED)
def known_compressed(spark, sf_dir):
    return file_kinds(spark, sf_dir).select("seq", "path", "compressed")


@query(
    "is_text_candidate",
    f"SELECT seq, path, {one_of(extension('path'), paths.TEXT_EXTENSIONS)} OR lower({file_name('path')}) = '.env' AS texty FROM mixed",
    _MIXED,
)
def text_candidate(spark, sf_dir):
    return file_kinds(spark, sf_dir).select("seq", "path", "texty")


_SIZES = "CAST(bytes_out AS BIGINT) * CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 100000000 END // CASE WHEN k % 8 = 0 THEN 1000 ELSE 1 END"


@query(
    "format_bytes",
    f"SELECT seq, n, {size_text('n')} AS size FROM (SELECT seq, {_SIZES} AS n FROM (SELECT *, CAST(floor(value * 100000) AS BIGINT) AS bytes_out FROM base WHERE event_type = 'purchase'))",
)
def sizes(spark, sf_dir):
    k = F.col("k")
    scale = F.when(k % 4 == 0, 1).when(k % 4 == 1, 1000).when(k % 4 == 2, 1_000_000).otherwise(100_000_000)
    rows = T.base(spark, sf_dir, "purchase").withColumn("bytes_out", F.floor(F.col("value") * 100000).cast("bigint"))
    n = F.floor(F.col("bytes_out") * scale / F.when(k % 8 == 0, 1000).otherwise(1)).cast("bigint")
    return rows.select("seq", n.alias("n"), fmt.format_bytes(n).alias("size"))


@query(
    "expand_tilde",
    "SELECT seq, CASE seq % 3 WHEN 0 THEN '/home/u' || pid || '/x' WHEN 1 THEN '/home/u' || pid ELSE path END AS path FROM files",
)
def tilde(spark, sf_dir):
    kind = F.col("seq") % 3
    path = F.when(kind == 0, "~/x").when(kind == 1, "~").otherwise(F.col("path"))
    home = F.concat(F.lit("/home/u"), F.col("pid"), F.lit(""))
    return T.file_events(spark, sf_dir).select("seq", fmt.expand_tilde(path, home).alias("path"))


@query("strip_ansi", r"SELECT doc_id, md5(regexp_replace(text, '\x1B\[[^A-Za-z]*(?:[A-Za-z]|$)|\x1B|\r', '', 'g')) AS digest FROM documents")
def ansi(spark, sf_dir):
    coloured = F.replace(F.col("text"), F.lit(" "), F.lit("\x1b[1;32m \r\x1b[0m"))
    return documents(spark, sf_dir).select("doc_id", F.md5(listings.strip_ansi(coloured)).alias("digest"))


@query("split_name_pid", "SELECT seq, 'My.Tool ' || k AS name, pid FROM base WHERE event_type = 'signup'")
def name_pid(spark, sf_dir):
    text = F.concat(F.lit("My.Tool "), F.col("k"), F.lit("."), F.col("pid"))
    parsed = listings.split_name_pid(text)
    return T.base(spark, sf_dir, "signup").select("seq", parsed["name"].alias("name"), parsed["pid"].alias("pid"))


@query(
    "enum_parse",
    """SELECT seq, CASE WHEN k % 3 != 0 THEN ['open', 'write', 'create', 'rename', 'unlink'][k % 5 + 1] END AS op FROM base WHERE event_type = 'click'""",
)
def enums(spark, sf_dir):
    k = F.col("k")
    raw = F.when(k % 3 == 0, "Chmod").otherwise(F.initcap(F.get(F.array(*[F.lit(o) for o in fmt.FILE_OPS]), (k % 5).cast("int"))))
    return T.base(spark, sf_dir, "click").select("seq", fmt.parse_enum(raw, fmt.FILE_OPS).alias("op"))
