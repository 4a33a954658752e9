"""Imports every query module so the catalog is complete."""

from __future__ import annotations

import importlib

from . import catalog

_MODULES = ["q_features", "q_profile", "q_forecast", "q_returns", "q_planning", "q_style", "q_ml"]
_loaded = False


def _load():
    global _loaded
    if not _loaded:
        for m in _MODULES:
            importlib.import_module(f"{__package__}.{m}")
        _loaded = True


def queries():
    _load()
    return dict(catalog.QUERIES)


def oracle_sql():
    _load()
    return {k: v for k, v in catalog.ORACLE.items() if k in catalog.QUERIES}
