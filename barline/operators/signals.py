"""Detecting signals: every rule in one pass over the derived panel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.fragments import render
from .features import densify, densify_sql, derive, derive_sql, stages_for
from .rules import Rule

COLUMNS = ("date", "ticker", "family", "signal", "direction", "strength", "horizon")


def needed(some: list[Rule]) -> list[dict[str, str]]:
    return stages_for(*(x for r in some for x in (r.mask, r.direction, r.strength)))


def detect(panel: DataFrame, some: list[Rule], derived: DataFrame | None = None) -> DataFrame:
    """date, ticker, family, signal, direction, strength, horizon: a row where a rule's mask holds.

    One projection makes an array of what fired on a row, and one generator unrolls it: no union over rules, one scan.
    derived: the dense panel with the stages that the rules need, if at hand.
    """
    dense = derive(densify(panel), needed(some)) if derived is None else derived
    fired = ", ".join(
        f"CASE WHEN {render(r.mask, 'spark')} THEN named_struct('family', '{r.family}', 'signal', '{r.signal}', 'direction', CAST({r.direction} AS INT), "
        f"'strength', CAST(coalesce({render(r.strength, 'spark')}, 0) AS DOUBLE), 'horizon', {r.horizon}) END"
        for r in some
    )
    return dense.where("present").selectExpr("date", "ticker", f"inline(filter(array({fired}), x -> x IS NOT NULL))")


def detect_sql(source_ctes: list[str], source: str, some: list[Rule]) -> str:
    """The same rows in DuckDB."""
    ctes, last = derive_sql("dense", needed(some))
    each = " UNION ALL ".join(
        f"SELECT date, ticker, '{r.family}' AS family, '{r.signal}' AS signal, CAST({r.direction} AS INT) AS direction, CAST(coalesce({render(r.strength, 'duckdb')}, 0) AS DOUBLE) AS strength, {r.horizon} AS horizon FROM {last} WHERE present AND {render(f'({r.mask})', 'duckdb')}"
        for r in some
    )
    chain = ", ".join([*source_ctes, *(render(c, "duckdb") for c in (f"dense AS ({densify_sql(source)})", *ctes))])
    return f"WITH {chain} {each}"
