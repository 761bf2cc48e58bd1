"""Landed text dumps: socket listings, per-process byte counters, socket statistics.

All parsers take lines (file, block, pos, line). ``block`` is the byte offset of the file split a
line came from and ``pos`` its order within it, so large files stay splittable and ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions.net import parse_local_port, parse_remote
from tracewarden.operators.slices import latest_values


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )


def lines_of(texts: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """The same shape from rows that hold a dump each."""
    return texts.select(
        F.col(file_col).cast("string").alias("file"),
        F.lit(0).cast("bigint").alias("block"),
        F.posexplode(F.split(text_col, "\n")).alias("pos", "line"),
    )


# --- columns --------------------------------------------------------------------------------


def strip_ansi(text: Column) -> Column:
    """Remove escape sequences, stray escapes and carriage returns."""
    return F.regexp_replace(text, r"\x1B\[[^A-Za-z]*(?:[A-Za-z]|$)|\x1B|\r", "")


def split_name_pid(prefix: Column) -> Column:
    """``Some Name.123`` to struct(name, pid): the last dot that is followed by digits decides."""
    pattern = r"^(.*)\.\s*([0-9]+)(?:\s.*)?$"
    pid = F.regexp_extract(prefix, pattern, 2).try_cast("bigint")
    name = F.trim(F.regexp_extract(prefix, pattern, 1))
    return F.when(pid.between(0, 4294967295), F.struct(name.alias("name"), pid.alias("pid")))


# --- parsers --------------------------------------------------------------------------------


def parse_connections(lines: DataFrame) -> DataFrame:
    """``p<pid>``, ``c<command>``, ``n<local>-><remote>`` lines to one row per connection with a peer."""
    tag, value = F.substring("line", 1, 1), F.substring(F.col("line"), F.lit(2), F.length("line"))
    # wrapped in structs so that an unreadable pid and the cleared command count as latest values
    owner = F.when(tag == "p", F.struct(value.try_cast("bigint").alias("pid")))
    command = F.when(tag == "p", F.struct(F.lit("").alias("command"))).when(
        tag == "c", F.struct(value.alias("command"))
    )
    tagged = lines.filter(tag.isin("p", "c", "n"))
    filled = latest_values(tagged, ["file"], ["block", "pos"], {"owner": owner, "cmd": command}, 1)
    remote = parse_remote(value)
    return (
        filled.filter((tag == "n") & F.col("owner.pid").isNotNull())
        .select(
            "file", "block", "pos", F.col("owner.pid").alias("pid"), F.col("cmd.command").alias("command"),
            parse_local_port(value).alias("local_port"), remote.alias("_remote"),
        )
        .filter(F.col("_remote").isNotNull())
        .select("*", F.col("_remote.ip").alias("remote_ip"), F.col("_remote.port").alias("remote_port"))
        .drop("_remote")
    )


def parse_byte_counters(lines: DataFrame) -> DataFrame:
    """``<name>.<pid>  <in>  <out>`` lines to cumulative counters; anything else is skipped."""
    clean = F.trim(F.regexp_replace(strip_ansi(F.col("line")), r"\s+", " "))
    pattern = r"^(.*\S) ([0-9]+) ([0-9]+)$"
    owner = split_name_pid(F.regexp_extract(clean, pattern, 1))
    return (
        lines.select(
            "file", "block", "pos", owner.alias("_owner"),
            F.regexp_extract(clean, pattern, 2).try_cast("bigint").alias("bytes_in"),
            F.regexp_extract(clean, pattern, 3).try_cast("bigint").alias("bytes_out"),
        )
        .filter((F.col("_owner.name") != "") & F.col("bytes_in").isNotNull() & F.col("bytes_out").isNotNull())
        .select("file", "block", "pos", "_owner.name", "_owner.pid", "bytes_in", "bytes_out")
    )


def parse_socket_counters(lines: DataFrame) -> DataFrame:
    """Socket statistics to (file, pid, bytes_in, bytes_out): a header line names the pid, the
    indented lines below it carry counters."""
    detail = F.col("line").rlike(r"^[ \t]")
    owner = F.when(~detail, F.struct(F.regexp_extract("line", r"pid=([0-9]+)", 1).try_cast("bigint").alias("pid")))
    filled = latest_values(lines, ["file"], ["block", "pos"], {"owner": owner}, 1)

    def counter(name: str) -> Column:
        number = F.regexp_extract("line", name + r":([0-9]+)", 1).try_cast("bigint")
        counts = detail & F.col("line").contains("bytes_acked")
        return F.sum(F.when(counts, F.coalesce(number, F.lit(0))).otherwise(0))

    return (
        filled.filter(F.col("owner.pid").isNotNull())
        .groupBy("file", F.col("owner.pid").alias("pid"))
        .agg(counter("bytes_received").alias("bytes_in"), counter("bytes_acked").alias("bytes_out"))
    )


# --- file entry points ----------------------------------------------------------------------


def ingest_connections(spark: SparkSession, path: str) -> DataFrame:
    return parse_connections(read_lines(spark, path))


def ingest_byte_counters(spark: SparkSession, path: str) -> DataFrame:
    return parse_byte_counters(read_lines(spark, path))


def ingest_socket_counters(spark: SparkSession, path: str) -> DataFrame:
    return parse_socket_counters(read_lines(spark, path))
