"""Named queries with their oracle text.

A query's ``spec`` lists its output columns once for both engines: ``name`` as is, ``name:i`` as a
64-bit integer, ``name:4`` rounded to four decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.plans.binding import OBS_SQL

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Runner
    sql: str | None


QUERIES: dict[str, Query] = {}

# Added before rounding on both sides: means of short decimals often lie exactly between two
# roundings, where the last bit of a sum would decide.
TIE_SHIFT = 1e-10


def _columns(spec: str) -> list[tuple[str, str]]:
    parts = [p.strip() for p in spec.split(",")]
    return [(p.rpartition(":")[0], p.rpartition(":")[2]) if ":" in p else (p, "") for p in parts]


def _spark_columns(spec: str) -> list:
    out = []
    for name, kind in _columns(spec):
        c = F.col(f"`{name}`")
        if kind == "i":
            c = c.cast("bigint")
        elif kind:
            c = F.round(c.cast("double") + TIE_SHIFT, int(kind))
        out.append(c.alias(name))
    return out


def _sql_columns(spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        if kind == "i":
            out.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        elif kind:
            # adding 0.0 turns a negative zero into a plain one
            out.append(f'round(CAST("{name}" AS DOUBLE) + {TIE_SHIFT}, {kind}) + 0.0 AS "{name}"')
        else:
            out.append(f'"{name}"')
    return ", ".join(out)


def add(
    name: str,
    covers: str,
    spec: str,
    run: Runner,
    select: str | None,
    ctes: tuple[str, ...] = (OBS_SQL,),
) -> None:
    """Register a query; ``select`` is the oracle body over ``ctes``."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    sql = None
    if select is not None:
        parts = ",".join([*ctes, f"res AS ({select})"])
        sql = f"WITH {parts}\nSELECT {_sql_columns(spec)} FROM res"
    QUERIES[name] = Query(
        name, covers, lambda spark, d: run(spark, d).select(*_spark_columns(spec)), sql
    )
