"""Queries over the given tables, grouped by area."""

from __future__ import annotations

import importlib

from .registry import REGISTRY

AREAS = ("series", "features", "ingest", "quality", "evaluate", "process", "fit", "decide", "streams", "refits", "evidence")


def load():
    """All registered queries (importing an area registers its queries)."""
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
    return REGISTRY
