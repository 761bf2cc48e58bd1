"""The registered queries."""

from importlib import import_module

MODULES = ["detection", "reporting", "collection", "scanning", "payloads", "streams"]


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"tracewarden.catalog.{name}")
