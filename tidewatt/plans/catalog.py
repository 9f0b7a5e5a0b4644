"""Registry of every implemented operator query and its DuckDB oracle."""

from __future__ import annotations

import importlib

_MODULES = ["q_core", "q_features", "q_dispatch", "q_metrics", "q_ml", "q_stream", "q_sources"]


def _load():
    q, s = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"tidewatt.plans.{m}")
        q.update(mod.Q)
        s.update(mod.SQL)
    return q, s


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
