"""Thresholds and limits. Every job takes a ``Params``; nothing reads the wall clock."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1024 * 1024
DAY_MS = 86_400_000

# Domains every agent may contact.
GLOBAL_ALLOWED_DOMAINS = [
    "*.apple.com",
    "*.icloud.com",
    "*.github.com",
    "*.githubusercontent.com",
    "*.npmjs.org",
    "*.npmjs.com",
    "*.crates.io",
    "*.pypi.org",
    "*.rust-lang.org",
    "*.microsoft.com",
    "*.windowsupdate.com",
    "*.googleapis.com",
    "*.gstatic.com",
    "*.sentry.io",
    "*.statsig.com",
    "*.cloudflare.com",
    "*.amazonaws.com",
]


@dataclass(frozen=True)
class Params:
    # detection thresholds
    volume_spike_bytes: int = 20 * MIB
    volume_spike_window_ms: int = 300_000
    bulk_read_files: int = 200
    bulk_read_window_ms: int = 60_000
    git_read_rows: int = 20
    exfil_correlation_ms: int = 120_000
    significant_upload_bytes: int = MIB
    hidden_blob_bytes: int = 50 * MIB
    hidden_blob_entropy: float = 7.5
    # repeat suppression
    repeat_ms: int = 3_600_000
    alert_repeat_ms: int = 600_000
    # sizes of evidence lists (part of the finding's definition)
    evidence_limit: int = 8
    destination_tail: int = 64
    destination_top: int = 6
    sample_paths: int = 5
    # rule variants
    bulk_key: str = "count"  # or "repo"
    file_ops: tuple[str, ...] | None = None  # None: every operation counts as a read
    sensitive_globs: tuple[str, ...] = ()
    global_allowed_domains: tuple[str, ...] = tuple(GLOBAL_ALLOWED_DOMAINS)
    # static scan; None: whole files, every host
    entropy_sample_bytes: int | None = None
    endpoint_file_bytes: int | None = None
    endpoints_per_agent: int | None = None
    # maintenance
    retention_days: int = 7
    # physical layout: width of the time slices hot keys are split into
    slice_ms: int = 10_000
