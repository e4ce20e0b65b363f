"""Named queries over the driver tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def half_up_sql(expr: str, digits: int) -> str:
    """SQL form of :func:`drivepulse.functions.scalars.half_up`."""
    return f"(floor(({expr})*1e{digits}+0.5e0)/1e{digits})"


def mix_sql(word: str) -> str:
    """SQL form of :func:`drivepulse.functions.scalars.with_mix32`."""
    def fold(x: str) -> str:
        return f"xor(({x}) >> 16, {x})"

    once = f"(({fold(word)} * 73244475) & 4294967295)"
    return fold(f"(({fold(once)} * 73244475) & 4294967295)")


def hash_sql(*parts: str) -> str:
    """SQL form of :func:`drivepulse.functions.scalars.hash_word`."""
    text = "||'|'||".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x'||substr(sha256({text}),1,8))::UBIGINT AS BIGINT)"
