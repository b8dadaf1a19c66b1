"""Replaceable engines: what query, eval, sql and the statistics run on."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from loomframe.plans import sql as builtin


@runtime_checkable
class SqlEngine(Protocol):
    name: str
    version: str

    def query(self, text: str, tables: dict, this) -> object: ...

    def supports(self, capability: str) -> bool: ...


class BuiltIn:
    name, version = "loomframe", "0.1.0"
    description = "own parser, planned onto DataFrames"

    def query(self, text: str, tables: dict, this=None):
        return builtin.sql(text, this=this, **tables)

    def supports(self, capability: str) -> bool:
        return builtin.CAPABILITIES.get(capability.upper(), False)


class SparkSql:
    """Hands the text to Spark SQL."""

    name, version = "spark", "4"

    def query(self, text: str, tables: dict, this=None):
        return builtin.sql(text, this=this, mode="spark", **tables)

    def supports(self, capability: str) -> bool:
        return True


_current: SqlEngine = BuiltIn()


def current() -> SqlEngine:
    return _current


def use_custom(engine: SqlEngine) -> None:
    global _current
    if not isinstance(engine, SqlEngine):
        raise TypeError("an engine has name, version, query and supports")
    _current = engine


def reset() -> None:
    global _current
    _current = BuiltIn()


def run(text: str, this=None, **tables):
    """By the engine in use."""
    return _current.query(text, tables, this)


def capabilities() -> dict[str, bool]:
    return {c: _current.supports(c) for c in builtin.CAPABILITIES}
