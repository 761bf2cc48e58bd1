"""Static scan of agent data directories: hidden blobs and unexpected endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.fmt import format_bytes
from tracewarden.functions.net import is_benign_host
from tracewarden.functions.paths import is_known_compressed, is_text_candidate
from tracewarden.functions.payload import endpoint_matches, utf8_text
from tracewarden.operators.joins import domain_allowed
from tracewarden.operators.windows import endpoint_cap, first_endpoints
from tracewarden.params import Params
from tracewarden.plans.rules import rule_artifacts
from tracewarden.schemas import ARTIFACTS
from tracewarden.session import cut_lineage
from tracewarden.sources.inventory import entropy_of_file, with_content

_ARTIFACT_COLUMNS = [c.split()[0] for c in ARTIFACTS.split(", ")]


def unchanged_skip(files: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Files that are new or whose (mtime, size) changed since the previous scan."""
    if previous is None:
        return files
    return files.join(previous.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def blob_candidates(inventory: DataFrame, params: Params, previous: DataFrame | None = None) -> DataFrame:
    """Big files worth an entropy test; decided on metadata, before any content is read."""
    big = inventory.filter((F.col("size") >= params.hidden_blob_bytes) & ~is_known_compressed(F.col("path")))
    return unchanged_skip(big, previous)


def detect_hidden_blobs(
    inventory: DataFrame,
    params: Params,
    scan_ts: int,
    previous: DataFrame | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Artifacts of big, not known-compressed files whose entropy reaches the threshold.

    Contents come from ``stored`` (path, content) or from the files; either way only those of candidates.
    """
    measured = entropy_of_file(blob_candidates(inventory, params, previous), params.entropy_sample_bytes, stored)
    blobs = measured.filter(F.col("entropy") >= F.lit(params.hidden_blob_entropy).cast("float"))
    detail = F.concat(
        format_bytes(F.col("size")),
        F.lit(" high-entropy file (entropy "),
        F.format_string("%.2f", F.col("entropy").cast("double")),
        F.lit("), possibly locally packed or encrypted data"),
    )
    return blobs.select(
        F.lit(scan_ts).cast("bigint").alias("ts"), "agent_id", "path", "size", "entropy",
        F.lit("hidden_blob").alias("kind"), detail.alias("detail"),
    )


def endpoint_candidates(
    inventory: DataFrame, params: Params, config_files: DataFrame | None = None
) -> DataFrame:
    """(agent_id, path) of text files worth searching: scannable and of a text format; plus profile config files."""
    worth = F.col("scannable") & (F.col("size") >= 1) & is_text_candidate(F.col("path"))
    if params.endpoint_file_bytes is not None:
        worth &= F.col("size") <= params.endpoint_file_bytes
    texts = inventory.filter(worth).select("agent_id", "path")
    if config_files is not None:
        texts = texts.unionByName(config_files.select("agent_id", "path"))
    return texts.distinct()


def detect_unexpected_endpoints(
    inventory: DataFrame,
    profiles: DataFrame,
    params: Params,
    config_files: DataFrame | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """(agent_id, host, path, pos, url, key) of configured endpoints outside every allow list.

    One row per agent and host, its first occurrence; ``params.endpoints_per_agent`` may bound the hosts.
    """
    texts = with_content(endpoint_candidates(inventory, params, config_files), stored, params.endpoint_file_bytes)
    text = utf8_text(F.col("content"))
    found = (
        texts.select("agent_id", "path", text.alias("_text"))
        .filter(F.col("_text").contains("http"))
        .select("agent_id", "path", F.inline(endpoint_matches(F.col("_text"))))
    )
    flagged = domain_allowed(found, "host", profiles, params.global_allowed_domains)
    odd = flagged.filter(~F.col("allowed") & ~is_benign_host(F.col("host"))).drop("allowed")
    if params.endpoints_per_agent is not None:
        return endpoint_cap(odd, params.endpoints_per_agent)
    return first_endpoints(odd)


def endpoint_artifacts(endpoints: DataFrame, scan_ts: int) -> DataFrame:
    detail = F.concat(
        F.lit("setting "), "key", F.lit(" points to "), "host", F.lit(" outside the allow list ("), "path", F.lit(")")
    )
    return endpoints.select(
        F.lit(scan_ts).cast("bigint").alias("ts"), "agent_id", "path", F.lit(0).cast("bigint").alias("size"),
        F.lit(0.0).cast("float").alias("entropy"), F.lit("unexpected_endpoint").alias("kind"), detail.alias("detail"),
    )


def scan_artifacts(
    inventory: DataFrame,
    profiles: DataFrame,
    params: Params,
    scan_ts: int,
    previous: DataFrame | None = None,
    config_files: DataFrame | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    inventory = cut_lineage(inventory)  # both branches choose their files from it
    blobs = detect_hidden_blobs(inventory, params, scan_ts, previous, stored)
    endpoints = detect_unexpected_endpoints(inventory, profiles, params, config_files, stored)
    return blobs.select(*_ARTIFACT_COLUMNS).unionByName(endpoint_artifacts(endpoints, scan_ts))


def scan_findings(
    inventory: DataFrame,
    profiles: DataFrame,
    params: Params,
    scan_ts: int,
    previous: DataFrame | None = None,
    config_files: DataFrame | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Findings of a scan, worst first."""
    artifacts = scan_artifacts(inventory, profiles, params, scan_ts, previous, config_files, stored)
    return rule_artifacts(artifacts, params).orderBy(F.desc("severity"), "rule_id", "agent_id", "dedupe_key")
