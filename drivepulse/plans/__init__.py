"""Queries composed from the operators over the driver tables."""

from __future__ import annotations

import importlib

MODULES = (
    "shaping_queries",
    "health_queries",
    "evaluation_queries",
    "split_queries",
    "index_queries",
    "spectral_queries",
    "model_queries",
    "stream_queries",
)


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
