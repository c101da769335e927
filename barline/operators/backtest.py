"""Forward returns, what signals earn after costs, and event-study tables.

Statements hold for Spark and DuckDB alike; {panel} and {signals} stand for the inputs, and the Spark functions take
them as DataFrames. Signals are known at a row's close: they enter at the next open, or, for the signal names in
SAME_CLOSE, at the same close. Returns against the market use the benchmark of the same entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.fragments import div, render
from ..sources.kept import kept
from .features import densify_sql

HORIZONS = (1, 2, 3, 5, 10, 20)
SIDE_BPS = 3.0 + 4.0 + 0.5
ROUND_TRIP = 2 * SIDE_BPS / 1e4
SAME_CLOSE = "(substr(signal, 1, 4) IN ('gap_', 'orb_'))"
_T = "PARTITION BY ticker ORDER BY date"

SNAP = "CASE WHEN {h} <= 1 THEN 1 WHEN {h} = 2 THEN 2 WHEN {h} <= 4 THEN 3 WHEN {h} <= 7 THEN 5 WHEN {h} <= 15 THEN 10 ELSE 20 END"


def snap(h: str) -> str:
    """The nearest of HORIZONS, the lower one on ties."""
    return SNAP.replace("{h}", h)


def daily_ctes(panel: str = "{panel}") -> str:
    """dense: the grid; daily: cc and oc; market: their means by date, and over each horizon."""
    following = lambda a, b: f"exp(sum(ln(1 + mkt_cc)) OVER (ORDER BY date ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING))"
    by_h = ", ".join(
        f"CASE WHEN lead(date, {h}) OVER (ORDER BY date) IS NOT NULL THEN {following(1, h)} - 1 END AS mkt_sc_{h}, "
        f"CASE WHEN lead(date, {h}) OVER (ORDER BY date) IS NOT NULL THEN (1 + lead(mkt_oc, 1) OVER (ORDER BY date)) * {following(2, h) if h > 1 else '1.0'} - 1 END AS mkt_no_{h}"
        for h in HORIZONS
    )
    return (
        f"dense AS ({densify_sql(panel)}), "
        f"daily AS (SELECT *, {div('close', f'lag(close) OVER ({_T})')} - 1 AS cc, {div('close', 'open')} - 1 AS oc FROM dense), "
        "by_date AS (SELECT date, date_idx, coalesce(avg(cc), 0) AS mkt_cc, coalesce(avg(oc), 0) AS mkt_oc FROM daily GROUP BY date, date_idx), "
        f"market AS (SELECT date, date_idx, mkt_cc, mkt_oc, {by_h} FROM by_date)"
    )


def forward_ctes() -> str:
    """forward: returns of each row over each horizon, by either entry."""
    entry = f"lead(open, 1) OVER ({_T})"
    each = ", ".join(f"{div(f'lead(close, {h}) OVER ({_T})', entry)} - 1 AS no_{h}, {div(f'lead(close, {h}) OVER ({_T})', 'close')} - 1 AS sc_{h}" for h in HORIZONS)
    return f"forward AS (SELECT date, date_idx, ticker, present, cc, oc, {each} FROM daily)"


def attached_ctes(signals: str = "{signals}") -> str:
    """attached: signals with ret_h and abn_h for each horizon."""
    each = ", ".join(
        f"direction * CASE WHEN {SAME_CLOSE} THEN sc_{h} ELSE no_{h} END AS ret_{h}, "
        f"direction * (CASE WHEN {SAME_CLOSE} THEN sc_{h} - mkt_sc_{h} ELSE no_{h} - mkt_no_{h} END) AS abn_{h}"
        for h in HORIZONS
    )
    return f"attached AS (SELECT s.date, s.ticker, family, signal, direction, strength, horizon, f.date_idx, {each} FROM {signals} s JOIN forward f ON f.date = s.date AND f.ticker = s.ticker JOIN market m ON m.date = s.date)"


def newey_west(groups: str, daily: str, x: str, lags: str) -> str:
    """A select of groups, n and tstat from daily means x, one row per date, in order of date. lags: an expression.

    Autocovariances come from lags within a group, all in one window pass; a group has a row per date at most.
    """
    w = f"PARTITION BY {groups} ORDER BY date"
    most = max(HORIZONS) + 1
    products = ", ".join(f"e * lag(e, {k}) OVER ({w}) AS p{k}" for k in range(1, most + 1))
    total = " + ".join(f"CASE WHEN {k} <= least(max(lags), count(*) - 1) THEN 2 * (1 - {k} / (max(lags) + 1.0)) * coalesce(sum(p{k}), 0) / count(*) ELSE 0 END" for k in range(1, most + 1))
    return (
        f"SELECT {groups}, CASE WHEN count(*) >= 8 THEN avg({x}) / sqrt(greatest(sum(e * e) / count(*) + {total}, 1e-18) / count(*)) END AS tstat "
        f"FROM (SELECT *, {products} FROM (SELECT *, {x} - avg({x}) OVER (PARTITION BY {groups}) AS e, {lags} AS lags FROM {daily} WHERE {x} IS NOT NULL)) GROUP BY {groups}"
    )


def modal(value: str, of: str) -> str:
    """family, signal and the most frequent value, the smallest on ties."""
    return (
        f"SELECT family, signal, {value} AS modal_{value} FROM (SELECT family, signal, {value}, row_number() OVER (PARTITION BY family, signal ORDER BY count(*) DESC, {value}) AS place "
        f"FROM {of} GROUP BY family, signal, {value}) WHERE place = 1"
    )


def stats_ctes() -> str:
    """stats: a row per signal: n, direction, horizon, mean abnormal returns, hit rate, clustered t, net of costs."""
    own = "CASE " + " ".join(f"WHEN h0 = {h} THEN abn_{h}" for h in HORIZONS) + " END"
    means = ", ".join(f"CASE WHEN count(abn_{h}) >= 8 THEN avg(abn_{h}) END AS abn_{h}" for h in HORIZONS)
    return (
        f"modes AS (SELECT d.family, d.signal, modal_direction, {snap('modal_horizon')} AS h0 FROM ({modal('direction', 'attached')}) d JOIN ({modal('horizon', 'attached')}) h ON h.family = d.family AND h.signal = d.signal), "
        f"owned AS (SELECT a.*, modal_direction, h0, {own} AS own FROM attached a JOIN modes m ON m.family = a.family AND m.signal = a.signal), "
        f"means AS (SELECT family, signal, modal_direction, h0, count(*) AS n, {means}, CASE WHEN count(own) >= 8 THEN avg(CASE WHEN own > 0 THEN 1.0 WHEN own IS NOT NULL THEN 0.0 END) END AS hit, "
        "CASE WHEN count(own) >= 8 THEN avg(own) END AS own FROM owned GROUP BY family, signal, modal_direction, h0), "
        "by_day AS (SELECT family, signal, h0, date, avg(own) AS x FROM owned GROUP BY family, signal, h0, date), "
        f"tested AS ({newey_west('family, signal, h0', 'by_day', 'x', 'h0 + 1')}), "
        f"stats AS (SELECT m.family, m.signal, m.n, m.modal_direction AS direction, m.h0 AS horizon, {', '.join(f'm.abn_{h}' for h in HORIZONS)}, m.hit, "
        f"CASE WHEN m.own IS NOT NULL THEN t.tstat END AS tstat, m.own - {ROUND_TRIP!r} AS net_per_trade, (m.own - {ROUND_TRIP!r}) / m.h0 AS net_daily_equiv "
        "FROM means m LEFT JOIN tested t ON t.family = m.family AND t.signal = m.signal)"
    )


def decay_ctes() -> str:
    """decay: mean abnormal return at a signal's own horizon by year, in long form, with n_total."""
    own = "CASE " + " ".join(f"WHEN {snap('horizon')} = {h} THEN abn_{h}" for h in HORIZONS) + " END"
    return (
        f"yearly AS (SELECT family, signal, year(date) AS year, {own} AS own FROM attached), "
        "totals AS (SELECT family, signal, count(*) AS n_total FROM yearly GROUP BY family, signal), "
        "decay AS (SELECT y.family, y.signal, y.year, avg(own) AS abn_own, n_total FROM yearly y JOIN totals t ON t.family = y.family AND t.signal = y.signal GROUP BY y.family, y.signal, y.year, n_total HAVING count(own) > 0)"
    )


def portfolio_ctes(signals: str = "{signals}", cost: float = ROUND_TRIP) -> str:
    """portfolio: family, date, ret: the equal-weight mean over trades open that day, 0 where there is none.

    Trades of one entry day, ticker, family, entry, direction and horizon are counted first and spread over their days
    after: sums of marks are linear in the count, so rows grow with distinct trades, not with signals.
    """
    return (
        f"counted AS (SELECT d.date_idx, s.ticker, family, {SAME_CLOSE} AS at_close, direction, horizon, count(*) AS k FROM {signals} s JOIN by_date d ON d.date = s.date "
        f"GROUP BY d.date_idx, s.ticker, family, {SAME_CLOSE}, direction, horizon), "
        "held AS (SELECT c.*, step FROM counted c JOIN steps ON step <= horizon), "
        "marked AS (SELECT family, d.date, k, direction * CASE WHEN step = 1 AND NOT at_close THEN oc ELSE cc END - CASE WHEN step = 1 THEN "
        f"{cost!r} ELSE 0 END AS mark FROM held h JOIN daily d ON d.date_idx = h.date_idx + h.step AND d.ticker = h.ticker), "
        "summed AS (SELECT family, date, sum(k * mark) / sum(CASE WHEN mark IS NOT NULL THEN k END) AS ret FROM marked WHERE mark IS NOT NULL GROUP BY family, date), "
        f"portfolio AS (SELECT f.family, b.date, coalesce(s.ret, 0) AS ret FROM (SELECT DISTINCT family FROM {signals}) f CROSS JOIN by_date b LEFT JOIN summed s ON s.family = f.family AND s.date = b.date)"
    )


def steps_cte(dialect: str, most: int = 21) -> str:
    return "steps AS (SELECT explode(sequence(1, %d)) AS step)" % most if dialect == "spark" else "steps AS (SELECT unnest(generate_series(1, %d)) AS step)" % most


SUMMARY = "SELECT family, avg(ret) * 1e4 AS mean_bp, sqrt(252.0) * avg(ret) / (stddev_samp(ret) + 1e-12) AS sharpe, CAST(sum(CASE WHEN ret <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS active_days FROM portfolio GROUP BY family"


def run(panel: DataFrame, ctes: list[str], select: str, signals: DataFrame | None = None) -> DataFrame:
    """A statement over DataFrames."""
    inputs = {"panel": panel} | ({"signals": signals} if signals is not None else {})
    return panel.sparkSession.sql(render("WITH " + ", ".join(ctes) + " " + select, "spark"), **inputs)


def attach_forward(panel: DataFrame, signals: DataFrame) -> DataFrame:
    return run(panel, [daily_ctes(), forward_ctes(), attached_ctes()], "SELECT * FROM attached", signals)


def _on_attached(panel: DataFrame, signals: DataFrame, ctes: str, select: str) -> DataFrame:
    """A statement over attached signals, which it reads several times and which are kept for that."""
    attached = kept(attach_forward(panel, signals), "attached")
    return panel.sparkSession.sql(render(f"WITH attached AS (SELECT * FROM {{attached}}), {ctes} {select}", "spark"), attached=attached)


def per_signal_stats(panel: DataFrame, signals: DataFrame) -> DataFrame:
    """Sorted by t, nulls last."""
    return _on_attached(panel, signals, stats_ctes(), "SELECT * FROM stats ORDER BY tstat DESC NULLS LAST, family, signal")


def decay(panel: DataFrame, signals: DataFrame) -> DataFrame:
    """family, signal, year, abn_own, n_total."""
    return _on_attached(panel, signals, decay_ctes(), "SELECT * FROM decay")


def decay_by_year(panel: DataFrame, signals: DataFrame, years: list[int] | None = None) -> DataFrame:
    """decay with a column per year."""
    return decay(panel, signals).groupBy("family", "signal", "n_total").pivot("year", years).avg("abn_own")


def family_portfolio(panel: DataFrame, signals: DataFrame, cost: float = ROUND_TRIP) -> DataFrame:
    return run(panel, [daily_ctes(), steps_cte("spark"), portfolio_ctes(cost=cost)], "SELECT * FROM portfolio", signals)
