"""Every operator wired to the benchmark tables, each with an equivalent SQL text."""

from importlib import import_module

from pulsegrid.catalog.registry import REGISTRY

FAMILIES = ("sources", "scalars", "joins", "rollups", "cohort", "metrics", "windows", "sampling", "picks", "models")


def load_all():
    """Import every family once and return the registry."""
    for f in FAMILIES:
        import_module(f"pulsegrid.catalog.{f}")
    return REGISTRY
