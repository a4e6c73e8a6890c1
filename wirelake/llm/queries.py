"""All queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from wirelake.llm import sqlforms as S


def _modules() -> list:
    here = importlib.import_module(__name__.rpartition(".")[0])
    names = sorted(m.name for m in pkgutil.iter_modules(here.__path__) if m.name != "queries")
    return [importlib.import_module(f"{here.__name__}.{n}") for n in names]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can state and small tables can bear."""
    return {
        "p1_found": S.HISTORY, "p2_found": S.GROUPS, "p4_found": S.NEAREST, "p7_found": S.LOOKALIKES, "p7_classes": S.CLASSES, "p9_found": S.LEAKS, "p9_leak_report": S.LEAK_REPORT,
    }
