"""Named queries over the driver's test tables, each with its DuckDB oracle.

Every entry is ``name -> (build(spark, sf_dir) -> DataFrame, sql | None, rounds)``.
``rounds`` maps double columns to the digits both sides keep; rounding is
``round(x * 10^d) / 10^d`` on both engines (identical for the same double).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable, str | None, dict]] = {}


def register(name: str, sql: str | None = None, rounds: dict | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql, dict(rounds or {}))
        return fn
    return deco


def _round_df(df: DataFrame, rounds: dict) -> DataFrame:
    cols = {c: F.round(F.col(c).cast("double") * (10.0 ** d)) / (10.0 ** d) + F.lit(0.0)
            for c, d in rounds.items() if c in df.columns}
    return df.withColumns(cols) if cols else df


def _round_sql(sql: str, rounds: dict) -> str:
    if not rounds:
        return sql
    rep = ", ".join(f"round(CAST({c} AS DOUBLE) * {10.0 ** d!r}) / {10.0 ** d!r} + 0.0 AS {c}"
                    for c, d in rounds.items())
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _q"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    out = {}
    for name, (fn, _sql, rounds) in sorted(REGISTRY.items()):
        def run(spark, sf_dir, _fn=fn, _r=rounds):
            return _round_df(_fn(spark, sf_dir), _r)
        out[name] = run
    return out


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {name: _round_sql(sql, rounds) for name, (_fn, sql, rounds) in sorted(REGISTRY.items())
            if sql is not None}


def _load_all() -> None:
    # importing the modules fills REGISTRY
    from cohortkit.plans import q_base, q_segments  # noqa: F401
    for mod in ("q_series", "q_clusters"):
        try:
            __import__(f"cohortkit.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"cohortkit.plans.{mod}":
                raise
