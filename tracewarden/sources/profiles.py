"""Agent profiles: built-in ones shipped as data, user files override by id."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden import schemas
from tracewarden.sources.builtin_profiles import BUILTIN_PROFILES


def _record(raw: dict) -> dict:
    process = raw.get("process") or {}
    lists = {k: list(process.get(k) or []) for k in ("names", "exe", "cmdline_contains", "cmdline_regex")}
    for key in ("data_dirs", "config_files", "allowed_domains", "telemetry_domains"):
        lists[key] = list(raw.get(key) or [])
    return {"id": raw["id"], "name": raw["name"], "vendor": raw.get("vendor", ""), "notes": raw.get("notes"), **lists}


def _read(path: Path) -> list[dict]:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        loaded = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as error:  # optional dependency
            raise RuntimeError(f"reading {path} needs PyYAML; use JSON instead") from error
        loaded = yaml.safe_load(text)
    return [_record(r) for r in (loaded if isinstance(loaded, list) else [loaded])]


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    order = [c.split()[0] for c in schemas.PROFILES.split(", ")]
    return spark.createDataFrame([[i if c == "ord" else r[c] for c in order] for i, r in enumerate(rows)], schemas.PROFILES)


def load_profiles(
    spark: SparkSession, paths: list[str] | None = None, user_paths: list[str] | None = None
) -> DataFrame:
    """Built-in profiles (or ``paths``) with user files (YAML or JSON, name order) applied on top."""
    rows = [r for p in paths for r in _read(Path(p))] if paths else [_record(r) for r in BUILTIN_PROFILES]
    builtin = _frame(spark, rows)
    if not user_paths:
        return builtin
    return override_profiles(builtin, _frame(spark, [r for p in sorted(user_paths) for r in _read(Path(p))]))


def override_profiles(base: DataFrame, user: DataFrame) -> DataFrame:
    """User profiles replace those with the same id and come last; a later one wins among themselves."""
    latest = user.groupBy("id").agg(F.max("ord").alias("ord"))
    user = user.join(latest, ["id", "ord"], "left_semi").withColumn("ord", F.col("ord") + 1_000_000)
    return base.join(user, "id", "left_anti").unionByName(user)
