"""Registered queries over the test tables, each beside its SQL oracle."""

import importlib

MODULES = ["tabular", "spatial", "draws", "model", "abundance", "chains"]


def load() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        importlib.import_module(f"tidegrid.workload.{name}")
