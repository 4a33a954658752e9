"""Training-data operators over documents, pages and conversations.

One module per operator (``op1_...`` to ``op13_...``) with a general
interface, and a thin registered query each. Nothing outside this package
imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""

from __future__ import annotations

import importlib

_MODULES = ["exact_dedup", "substring_dedup", "mixing", "language_id", "simhash", "license_scan",
            "html_text", "imatch", "chat_format", "packing", "token_alignment", "conversation_repair", "suffix_dedup"]


def queries():
    out = {}
    for m in _MODULES:
        out.update(importlib.import_module(f"{__name__}.{m}").QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _MODULES:
        out.update(importlib.import_module(f"{__name__}.{m}").ORACLE_SQL)
    return out
