"""Formatting and enumeration columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in rank order, and the other enumerations.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
FILE_OPS = ["open", "write", "create", "rename", "unlink"]
ARTIFACT_KINDS = ["hidden_blob", "large_file", "unexpected_endpoint", "data_dir_growth"]
FINDING_STATUSES = ["open", "ignored"]
PAYLOAD_CLASSES = ["empty", "text", "source_code", "secret", "archive", "binary"]
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def rank_of(severity: str) -> int:
    return SEVERITIES.index(severity.lower())


def severity_rank(label: Column) -> Column:
    """Rank 0..4 of a severity name in any case; null when unknown."""
    position = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(label))
    return F.when(position > 0, (position - 1).cast("int"))


def severity_label(rank: Column) -> Column:
    """Name of a rank; anything outside 0..3 reads as critical."""
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.when(rank.between(0, 3), F.get(names, rank.cast("int"))).when(
        rank.isNotNull(), F.lit("critical")
    )


def parse_enum(value: Column, allowed: list[str]) -> Column:
    """Lower-cased member of an enumeration; null when unknown."""
    lowered = F.lower(value)
    return F.when(lowered.isin(allowed), lowered)


def format_bytes(n: Column) -> Column:
    """1024-based size: whole bytes, then one decimal below 100 units and none from there on."""
    n = n.cast("bigint")
    out = F.concat(n.cast("string"), F.lit("B"))
    for power, unit in enumerate(BYTE_UNITS[1:], start=1):
        scaled = n.cast("double") / F.lit(float(1024**power))
        text = F.when(scaled >= 100, _fixed(scaled, 0)).otherwise(_fixed(scaled, 1))
        out = F.when(n >= F.lit(1024**power), F.concat(text, F.lit(unit))).otherwise(out)
    return out


def _fixed(value: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, ties to even."""
    return F.bround(value.cast("decimal(38,20)"), digits).cast(f"decimal(20,{digits})").cast("string")


def expand_tilde(path: Column, home: Column) -> Column:
    """Replace a leading ``~`` or ``~/`` by the home directory, if there is one."""
    expanded = F.when(path == "~", home).when(
        path.startswith("~/"), F.concat(F.rtrim(home, F.lit("/")), F.lit("/"), F.substring(path, 3, 1 << 30))
    )
    return F.coalesce(expanded, path)
