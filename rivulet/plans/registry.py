"""The engine's named queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import importlib

_QUERIES: dict = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: put a ``(spark, sf_dir) -> DataFrame`` function in the registry under ``name``."""

    def put(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return put


#: Modules whose import registers queries.
MODULES = ["zones", "joins", "listing", "series", "text_queries", "folded", "faces", "clip_queries", "scalar_queries", "parse_queries", "slot_queries", "frame_queries", "rule_queries", "subject_queries", "camera_queries", "speaker_queries", "registry_queries", "focus_queries", "transcript_queries"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"rivulet.plans.{name}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
