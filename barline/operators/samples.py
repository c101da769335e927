"""Sample trades to look at: of each family the strongest winner and the strongest loser, in a fixed order of families."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .backtest import HORIZONS, SAME_CLOSE, attached_ctes, daily_ctes, forward_ctes, run

#: Families in the order in which they are shown.
SHOWN = ("gaps", "lmw", "breakouts", "anchors", "ml", "novel", "candles", "trend")


def sample_ctes(most: int = 8) -> str:
    """samples, after daily and attached: number, the signal, had_news, and the day and price of entry and exit.

    Equal strengths go by date, ticker and signal. Days after the last one are the last one.
    """
    place = "CASE family " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(SHOWN)) + " END"
    held = f"CASE WHEN horizon IN {HORIZONS} THEN horizon ELSE 5 END"
    return (
        f"decided AS (SELECT *, {place} AS place, CASE WHEN ret_5 > 0 THEN 0 ELSE 1 END AS lost FROM attached WHERE ret_5 <> 0), "
        "foremost AS (SELECT *, row_number() OVER (PARTITION BY family, lost ORDER BY round(strength, 9) DESC, date, ticker, signal) AS nth FROM decided WHERE place IS NOT NULL), "
        f"shown AS (SELECT *, row_number() OVER (ORDER BY place, lost) AS number, CASE WHEN {SAME_CLOSE} THEN 0 ELSE 1 END AS wait, {held} AS held FROM foremost WHERE nth = 1), "
        "closing AS (SELECT max(date_idx) AS final FROM by_date), "
        "samples AS (SELECT s.number, s.date, s.ticker, s.family, s.signal, s.direction, s.strength, s.ret_5, coalesce(d.catalyst, 0) = 1 AS had_news, i.date AS entry_date, o.date AS exit_date, "
        "CASE WHEN wait = 0 THEN i.close ELSE i.open END AS entry_price, o.close AS exit_price FROM shown s CROSS JOIN closing JOIN daily d ON d.date_idx = s.date_idx AND d.ticker = s.ticker "
        f"JOIN daily i ON i.date_idx = least(s.date_idx + wait, final) AND i.ticker = s.ticker JOIN daily o ON o.date_idx = least(s.date_idx + held, final) AND o.ticker = s.ticker WHERE s.number <= {most})"
    )


def sample_trades(panel: DataFrame, signals: DataFrame, most: int = 8) -> DataFrame:
    return run(panel, [daily_ctes(), forward_ctes(), attached_ctes(), sample_ctes(most)], "SELECT * FROM samples", signals)


def trade_bars(panel: DataFrame, trades: DataFrame, before: int = 40, after: int = 20) -> DataFrame:
    """The bars of each of the trades' tickers around the signal, with their place from it: what a chart of it shows."""
    inputs = {"panel": panel, "trades": trades}
    of = "SELECT t.number, t.date AS at, p.date, p.ticker, p.open, p.high, p.low, p.close, p.volume, row_number() OVER (PARTITION BY t.number ORDER BY p.date) AS rn FROM {trades} t JOIN {panel} p ON p.ticker = t.ticker"
    placed = f"SELECT *, CAST(rn - max(CASE WHEN date = at THEN rn END) OVER (PARTITION BY number) AS INT) AS step FROM ({of}) b"
    return panel.sparkSession.sql(f"SELECT number, step, date, ticker, open, high, low, close, volume FROM ({placed}) s WHERE step BETWEEN {-before} AND {after}", **inputs)
