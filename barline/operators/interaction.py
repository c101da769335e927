"""Interaction tables: what follows a gap or a breakout by news and volume. {panel} stands for the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.fragments import no, render
from .features import densify_sql, derive_sql, stages_for

_NEXT = "lead(close, 1) OVER (PARTITION BY ticker ORDER BY date) / nullif(lead(open, 1) OVER (PARTITION BY ticker ORDER BY date), 0) - 1"
_FIVE = "lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / nullif(lead(open, 1) OVER (PARTITION BY ticker ORDER BY date), 0) - 1"
LEAST = 30
_NAMES = "CASE WHEN {all} THEN 'all' WHEN rvol_tercile = 0 THEN 'lowV' WHEN rvol_tercile = 1 THEN 'midV' ELSE 'highV' END"


def _chain(dialect: str, source: str, *wanted: str) -> tuple[str, str]:
    ctes, last = derive_sql("dense", stages_for(*wanted))
    text = ", ".join([f"dense AS ({densify_sql(source)})", *ctes])
    return text, last


def gap_sql(dialect: str, source: str = "{panel}") -> str:
    ctes, last = _chain(dialect, source, "gap rvol_tercile catalyst c1 close open")
    grouped = "GROUPING SETS ((size, news), (size, news, rvol_tercile))"
    return render(
        f"WITH {ctes}, cells AS (SELECT *, CASE WHEN abs(gap) >= 0.07 THEN 'huge' WHEN abs(gap) >= 0.03 THEN 'large' WHEN abs(gap) >= 0.015 THEN 'mid' WHEN abs(gap) >= 0.005 THEN 'small' END AS size, "
        f"coalesce(catalyst, 0) <> 0 AS news, ({_NEXT}) * sign(gap) AS next_day, ({_FIVE}) * sign(gap) AS five_days, "
        "coalesce((close - open) * sign(gap) > 0, false) AS goes_on, coalesce((sign(gap) > 0 AND close <= c1) OR (sign(gap) < 0 AND close >= c1), false) AS filled "
        f"FROM {last}), picked AS (SELECT * FROM cells WHERE size IS NOT NULL) "
        f"SELECT size, news, {_NAMES.format(all='whole = 1')} AS rvol, n, p_intraday_cont, p_filled_same_day, nextday_drift_bps, d5_drift_bps FROM ("
        "SELECT size, news, rvol_tercile, grouping(rvol_tercile) AS whole, count(*) AS n, avg(CASE WHEN goes_on THEN 1.0 ELSE 0.0 END) AS p_intraday_cont, "
        "avg(CASE WHEN filled THEN 1.0 ELSE 0.0 END) AS p_filled_same_day, 1e4 * avg(next_day) AS nextday_drift_bps, 1e4 * avg(five_days) AS d5_drift_bps "
        f"FROM picked GROUP BY {grouped}) g WHERE n >= {LEAST} AND (whole = 1 OR rvol_tercile IS NOT NULL)",
        dialect,
    )


def breakout_sql(dialect: str, source: str = "{panel}") -> str:
    ctes, last = _chain(dialect, source, "rvol_tercile news2 beyond20_up beyond20_dn beyond20_up_1 beyond20_dn_1 close open")
    return render(
        f"WITH {ctes}, cells AS (SELECT *, CASE WHEN beyond20_up AND {no('beyond20_up_1')} THEN 1.0 WHEN beyond20_dn AND {no('beyond20_dn_1')} THEN -1.0 END AS way, {_NEXT} AS next_day, {_FIVE} AS five_days FROM {last}), "
        "picked AS (SELECT *, way * next_day AS next_way, way * five_days AS five_way FROM cells WHERE way IS NOT NULL) "
        f"SELECT news2 AS news, {_NAMES.format(all='whole = 1')} AS rvol, n, nextday_drift_bps, d5_drift_bps, p_nextday_cont FROM ("
        "SELECT news2, rvol_tercile, grouping(rvol_tercile) AS whole, count(*) AS n, 1e4 * avg(next_way) AS nextday_drift_bps, 1e4 * avg(five_way) AS d5_drift_bps, "
        "avg(CASE WHEN next_way > 0 THEN 1.0 ELSE 0.0 END) AS p_nextday_cont FROM picked GROUP BY GROUPING SETS ((news2), (news2, rvol_tercile))) g "
        f"WHERE n >= {LEAST} AND (whole = 1 OR rvol_tercile IS NOT NULL)",
        dialect,
    )


def gap_interaction(panel: DataFrame) -> DataFrame:
    return panel.sparkSession.sql(gap_sql("spark"), panel=panel)


def breakout_interaction(panel: DataFrame) -> DataFrame:
    return panel.sparkSession.sql(breakout_sql("spark"), panel=panel)
