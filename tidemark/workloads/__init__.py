"""The runnable queries, by family."""

from importlib import import_module

FAMILIES = ("market", "joins", "options", "metrics", "relations", "risk", "text", "vectors", "catalog", "earnings", "streams", "scans", "research", "stores", "models", "landing", "sinks")


def load():
    for family in FAMILIES:
        import_module(f"tidemark.workloads.{family}")
    from tidemark.workloads.registry import WORKLOADS
    return WORKLOADS
