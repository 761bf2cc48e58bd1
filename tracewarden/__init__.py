"""Agent-activity audit jobs on Spark: ingest, attribute, classify, detect, report."""

__version__ = "0.1.0"
