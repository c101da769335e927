"""Columns derived from a panel, in stages: a stage's columns see those of the stages before it.

A panel has a row per (date, ticker): open, high, low, close, volume, catalyst 0/1, news_sign -1/0/1, quality,
or30_high, or30_low, nulls for what is missing. `densify` puts every ticker on every date first, since lags count
calendar rows, and marks the rows that were there as present. All windows by ticker share one exchange and one sort;
those by date share another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fragments import clip, div, ewm, fill, frame, lag, no, pct_rank, quantile, render, roll, running, tercile, yes

PANEL = ("date", "ticker", "open", "high", "low", "close", "volume", "catalyst", "news_sign", "quality", "or30_high", "or30_low")

#: Half-life of an anchor's weight, in rows.
ANCHOR_ROWS = 63
_TR = "abs(high - c1), abs(low - c1)"
MONTH_START = "coalesce(month(date) <> month(prior_date), false)"

STAGES: list[dict[str, str]] = [
    {
        "rn": "row_number() OVER (PARTITION BY ticker ORDER BY date)",
        "cf": fill("close"),
        **{f"c{n}": lag("close", n) for n in (1, 2, 3, 6, 20)},
        **{f"{k}{n}": lag(x, n) for k, x in (("o", "open"), ("h", "high"), ("l", "low")) for n in (1, 2)},
        **{f"ma{n}": roll("avg", "close", n) for n in (5, 20, 50, 200)},
        "sd20": roll("stddev_samp", "close", 20),
        "vavg63": roll("avg", "volume", 63, 20, before=1),
        "vsum20": roll("sum", "volume", 20),
        "hi52": roll("max", "high", 252, 60, before=1),
        "lo52": roll("min", "low", 252, 60, before=1),
        **{f"top{n}": roll("max", "close", n, before=1) for n in (20, 55, 60)},
        **{f"bottom{n}": roll("min", "close", n, before=1) for n in (20, 55)},
        "hi5": roll("max", "high", 5),
        "lo5": roll("min", "low", 5),
        "hi15": roll("max", "high", 15, before=1),
        "flag_hi": roll("max", "high", 6, before=1),
        "flag_lo": roll("min", "low", 6, before=1),
        "anchor_id": running("sum", "coalesce(catalyst, 0)"),
        "news2": f"coalesce(max(catalyst) OVER {frame(-1, 0)}, 0) > 0",
        "news3": f"max(catalyst) OVER {frame(-2, 0)}",
        "body": "abs(close - open)",
        "span": "nullif(high - low, 0)",
    },
    {
        "ret": f"{div('cf', lag('cf'))} - 1",
        "ret2": f"{div('cf', lag('cf', 2))} - 1",
        "ret5": f"{div('cf', lag('cf', 5))} - 1",
        "ret10": f"{div('cf', lag('cf', 10))} - 1",
        "ret21": f"{div('cf', lag('cf', 21))} - 1",
        "ret126": f"{div('cf', lag('cf', 126))} - 1",
        "ret252": f"{div('cf', lag('cf', 252))} - 1",
        "gap": f"{div('open', 'c1')} - 1",
        "rvol": div("volume", "vavg63"),
        "tr": f"greatest(high - low, {_TR})",
        "tr_known": f"CASE WHEN c1 IS NOT NULL THEN greatest(high - low, {_TR}) END",
        "e20": ewm("close", 20, 20),
        "up_shadow": "high - greatest(open, close)",
        "dn_shadow": "least(open, close) - low",
        "body1": lag("body"),
        "body2": lag("body", 2),
        "falling": "c1 < c6",
        "rising": "c1 > c6",
        "swing_hi": fill("CASE WHEN h2 = hi5 THEN h2 END"),
        "swing_lo": fill("CASE WHEN l2 = lo5 THEN l2 END"),
        "clv": "((close - low) - (high - close)) / span",
        "range5": "hi5 - lo5",
        "avwap": "sum((high + low + close) / 3.0 * volume) OVER (PARTITION BY ticker, anchor_id ORDER BY date) / nullif(sum(volume) OVER (PARTITION BY ticker, anchor_id ORDER BY date), 0)",
        "round_level": "BROUND(close / CASE WHEN close < 50 THEN 5 WHEN close < 200 THEN 10 ELSE 25 END, 0) * CASE WHEN close < 50 THEN 5 WHEN close < 200 THEN 10 ELSE 25 END",
        "over5_20": yes("ma5 > ma20"),
        "over20_50": yes("ma20 > ma50"),
        "over50_200": yes("ma50 > ma200"),
        **{f"beyond{n}_up": yes(f"close > top{n}") for n in (20, 55)},
        **{f"beyond{n}_dn": yes(f"close < bottom{n}") for n in (20, 55)},
        **{f"above{n}": yes(f"close > ma{n}") for n in (20, 50, 200)},
        "above52": yes("close > hi52"),
        "band_up": "ma20 + 2 * sd20",
        "band_dn": "ma20 - 2 * sd20",
        "pressure": "((high - greatest(open, close)) - (least(open, close) - low)) / span",
        "trend20": "sign(close - c20)",
        "pole": f"{div(lag('cf', 6), lag('cf', 16))} - 1",
    },
    {
        "atr": roll("avg", "tr", 14, 5),
        "atr5": roll("avg", "tr_known", 5, 3),
        "atr50": roll("avg", "tr_known", 50, 16),
        "vol20": roll("stddev_samp", "ret", 20, 10),
        "quiet5": roll("avg", "rvol", 5, 3),
        "mom121": lag("ret252", 21),
        "obv": running("sum", "coalesce(sign(ret), 0) * volume"),
        "ad": f"CASE WHEN clv * volume IS NOT NULL THEN {running('sum', 'clv * volume')} END",
        "range5_5": lag("range5", 5),
        "range5_10": lag("range5", 10),
        "swing_hi1": lag("swing_hi"),
        "swing_lo1": lag("swing_lo"),
        "avwap1": lag("avwap"),
        **{f"ma{n}_1": lag(f"ma{n}") for n in (20, 50, 200)},
        **{f"above{n}_1": lag(f"above{n}") for n in (20, 50, 200)},
        **{f"over{k}_1": lag(f"over{k}") for k in ("5_20", "20_50", "50_200")},
        **{f"beyond{n}_{d}_1": lag(f"beyond{n}_{d}") for n in (20, 55) for d in ("up", "dn")},
        "above52_60": f"max(CASE WHEN above52 THEN 1 ELSE 0 END) OVER {frame(-60, -1)}",
        "band_up1": lag("band_up"),
        "falling2": lag("falling", 2),
        "rising2": lag("rising", 2),
        "shadow_index": ewm("pressure", 10, 10),
        "purity": f"CASE WHEN count(volume / nullif(vsum20, 0)) OVER {frame(-19, 0)} >= 20 THEN sum(CASE WHEN sign(ret) = trend20 THEN volume / nullif(vsum20, 0) ELSE CASE WHEN vsum20 IS NOT NULL THEN 0.0 END END) OVER {frame(-19, 0)} END",
        "gap2": lag("gap", 2),
        "cat2": lag("catalyst", 2),
        "anchor_num": f"{running('sum', f'CASE WHEN catalyst = 1 AND close IS NOT NULL THEN coalesce(rvol, 1.0) * close * power(2.0, rn / {ANCHOR_ROWS}.0) END')} * power(2.0, -rn / {ANCHOR_ROWS}.0)",
        "anchor_den": f"{running('sum', f'CASE WHEN catalyst = 1 AND close IS NOT NULL THEN coalesce(rvol, 1.0) * power(2.0, rn / {ANCHOR_ROWS}.0) END')} * power(2.0, -rn / {ANCHOR_ROWS}.0)",
        "climax": f"max(rvol) OVER {frame(-1, 0)}",
        "news5": f"max(catalyst) OVER {frame(-4, 0)}",
    },
    {
        "cer": div("atr5", "atr50"),
        "or_range": div("or30_high - or30_low", "atr"),
        "ad20": f"ad - {lag('ad', 20)}",
        "obv20": roll("max", "obv", 20, before=1),
        "contracting": "range5 < 0.75 * range5_5 AND range5_5 < 0.75 * range5_10",
        "stout_up": yes("close > open AND body > 0.5 * atr"),
        "stout_dn": yes("close < open AND body > 0.5 * atr"),
        "kup": "e20 + 2 * atr",
        "memory": f"(close - {div('anchor_num', 'anchor_den')}) / nullif(atr, 0)",
        "prox": div("close", "hi52"),
        "range_place": div("close - lo52", "hi52 - lo52"),
    },
    {
        "cer_q20": quantile("cer", 0.2, 252, 120),
        "or_median": quantile("or_range", 0.5, 20, 10),
        "ad_z": div("ad20", roll("stddev_samp", "ad20", 120, 40)),
        "contracting1": lag("contracting"),
        "quiet5_1": lag("quiet5"),
        **{f"stout_{d}_{n}": lag(f"stout_{d}", n) for d in ("up", "dn") for n in (1, 2)},
        "kup1": lag("kup"),
        "memory1": lag("memory"),
    },
    {
        "squeezed": yes("cer < cer_q20"),
    },
    {
        "squeezed5": f"CASE WHEN count(*) OVER {frame(-5, -1)} >= 5 THEN min(CASE WHEN squeezed THEN 1 ELSE 0 END) OVER {frame(-5, -1)} END",
    },
    {
        "quality_rank": pct_rank("quality"),
        "mom_rank": pct_rank("mom121"),
        "rvol_rank": pct_rank("rvol"),
    },
    {
        "month_start": MONTH_START,
        "rvol_tercile": tercile("rvol_rank"),
    },
]


def _resolve(stages, wanted):
    """The columns of stages that wanted columns need, in the same stages."""
    import re

    words = lambda text: set(re.findall(r"[a-z_][a-z_0-9]*", text))
    need, kept = set().union(*(words(w) for w in wanted)), []
    for stage in reversed(stages):
        some = {k: v for k, v in stage.items() if k in need}
        need |= set().union(set(), *(words(v) for v in some.values()))
        kept.append(some)
    return [s for s in reversed(kept) if s]


def stages_for(*expressions: str) -> list[dict[str, str]]:
    """The stages that the given expressions need, without the columns that they don't."""
    return _resolve(STAGES, expressions)


def densify(panel: DataFrame) -> DataFrame:
    """Every ticker on every date; present: whether the row was there; prior_date: the date before on the calendar.

    The calendar and the tickers are dimensions; the grid they span is the panel's own size but for gaps.
    """
    dates = panel.select("date").distinct()
    calendar = dates.selectExpr("date", "lag(date) OVER (ORDER BY date) AS prior_date", "row_number() OVER (ORDER BY date) AS date_idx")
    tickers = panel.select("ticker").distinct()
    grid = calendar.crossJoin(tickers)
    return grid.join(panel.withColumn("present", F.lit(True)), ["date", "ticker"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def densify_sql(source: str) -> str:
    columns = ", ".join(c for c in PANEL if c not in ("date", "ticker"))
    return (
        f"SELECT d.date, d.prior_date, d.date_idx, t.ticker, {columns}, p.date IS NOT NULL AS present FROM "
        f"(SELECT date, lag(date) OVER (ORDER BY date) AS prior_date, row_number() OVER (ORDER BY date) AS date_idx FROM (SELECT DISTINCT date FROM {source})) d "
        f"CROSS JOIN (SELECT DISTINCT ticker FROM {source}) t LEFT JOIN {source} p ON p.date = d.date AND p.ticker = t.ticker"
    )


def derive(dense: DataFrame, stages: list[dict[str, str]] | None = None) -> DataFrame:
    """dense with the columns of all stages, or of those given."""
    return reduce(lambda df, s: df.selectExpr("*", *(f"{render(e, 'spark')} AS {n}" for n, e in s.items())), stages or STAGES, dense)


def derive_sql(source: str, stages: list[dict[str, str]], prefix: str = "s") -> tuple[list[str], str]:
    """Common table expressions, still to be rendered, and the name of the last."""
    ctes, last = [], source
    for i, stage in enumerate(stages):
        ctes.append(f"{prefix}{i} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in stage.items()) + f" FROM {last})")
        last = f"{prefix}{i}"
    return ctes, last


def features(panel: DataFrame) -> DataFrame:
    """The whole set of derived columns on the panel's own rows."""
    return derive(densify(panel)).where("present")


__all__ = ["PANEL", "STAGES", "clip", "densify", "densify_sql", "derive", "derive_sql", "features", "no", "stages_for"]
