"""Studies on a panel: crash events and what follows them, the day's winners, random traders, and what skill would pay.

Statements hold for Spark and DuckDB; {panel} stands for the input.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fragments import frame, lag, render
from .backtest import ROUND_TRIP, daily_ctes, forward_ctes, newey_west, run
from .features import densify, densify_sql, derive, derive_sql, stages_for
from .fusion import by_month

COOLDOWN, WARM_UP, AHEAD = 10, 260, 21
#: Weights of ten log closes, oldest first, whose sum is the curvature of their best quadratic.
_PATH = np.arange(10.0)
CURVATURE = [float(x) for x in np.linalg.pinv(np.vstack([_PATH**2, _PATH, np.ones(10)]).T)[0]]
EVENT_FEATURES = (
    "depth5", "sigma_crash", "accel", "convexity", "news_crash", "climax_rvol", "reversal_bar", "gap_exhaust", "below_ma50_atr", "rangepos52", "quality", "mom126", "vol20", "kind_fast", "kind_ext", "kind_grind",
)
_FAST, _EXT, _GRIND = "ret5 <= -0.15", "ret10 <= -0.20", "down10 >= 8 AND ret10 <= -0.10"
_flag = lambda p: f"CASE WHEN {p} THEN 1 ELSE 0 END"
_EVENT = {
    "kind_fast": _flag(_FAST),
    "kind_ext": _flag(_EXT),
    "kind_grind": _flag(_GRIND),
    "depth5": "ret5",
    "sigma_crash": "ret5 / (vol20 * sqrt(5) + 1e-9)",
    "accel": "(close / nullif(c2, 0) - 1) / least(ret5, -1e-6)",
    "convexity": "convexity",
    "news_crash": _flag("news5 > 0"),
    "climax_rvol": "climax",
    "reversal_bar": _flag("(close - low) / span >= 0.6 AND rvol >= 2"),
    "gap_exhaust": _flag("gap <= -0.03 AND close >= open - 0.5 * (open - c1)"),
    "below_ma50_atr": "(ma50 - close) / (atr + 1e-9)",
    "rangepos52": "range_place",
    "mom126": "ret126",
}


def crash_events(panel: DataFrame, warm_up: int = WARM_UP, ahead: int = AHEAD, first_date: str | None = None) -> DataFrame:
    """A row per crash: its features, what came after it against the market, and whether it fell on.

    A crash within COOLDOWN rows of the last one taken doesn't count; the cooldown is applied before any other filter,
    by one pass over each ticker's crash rows in order.
    """
    stages = stages_for(*_EVENT.values(), "ret2 quality vol20")
    base = derive(densify(panel), stages)
    w = Window.partitionBy("ticker").orderBy("date")
    base = base.selectExpr("*", f"CASE WHEN count(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10 THEN sum({_flag('ret < 0')}) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS down10")
    base = base.withColumn("convexity", sum((F.lag(F.log("close"), 9 - i).over(w) * c for i, c in enumerate(CURVATURE)), F.lit(0.0)))
    base = base.withColumn("second_knife", (F.min("low").over(w.rowsBetween(1, 10)) / F.col("close") - 1 <= -0.10).cast("int"))
    base = base.withColumn("_last", F.max("date_idx").over(Window.partitionBy("ticker")))
    crashed = base.where(render(f"coalesce({_FAST}, false) OR coalesce({_EXT}, false) OR coalesce({_GRIND}, false)", "spark"))
    kept = F.aggregate(
        F.sort_array(F.collect_list("date_idx")),
        F.struct(F.lit(-99).alias("last"), F.array().cast("array<int>").alias("kept")),
        lambda a, t: F.when(t - a["last"] >= COOLDOWN, F.struct(t.alias("last"), F.concat(a["kept"], F.array(t)).alias("kept"))).otherwise(a),
    )["kept"]
    taken = crashed.groupBy("ticker").agg(kept.alias("kept")).select("ticker", F.explode("kept").alias("date_idx"))
    events = crashed.join(taken, ["ticker", "date_idx"]).where((F.col("date_idx") > warm_up) & (F.col("date_idx") + ahead <= F.col("_last")) & F.col("present"))
    if first_date is not None:
        events = events.where(F.col("date") >= F.lit(first_date).cast("date"))
    made = {k: v for k, v in _EVENT.items() if k != "convexity"}
    out = events.selectExpr("date", "ticker", *(f"{render(v, 'spark')} AS _e_{k}" for k, v in made.items()), "convexity", "quality", "vol20", "second_knife")
    out = out.select("date", "ticker", *(F.col(f"_e_{k}").alias(k) for k in made), "convexity", "quality", "vol20", "second_knife")
    after = run(panel, [daily_ctes(), forward_ctes()], "SELECT f.date, f.ticker, " + ", ".join(f"no_{h} - mkt_no_{h} AS fwd{h}" for h in (1, 5, 10, 20)) + " FROM forward f JOIN market m ON m.date = f.date")
    return out.join(after, ["date", "ticker"])


def events_sql(panel: str, warm_up: int = WARM_UP, ahead: int = AHEAD) -> list[str]:
    """Common table expressions, of a recursive WITH, of which the last one, events, has the rows of crash_events."""
    ctes, last = derive_sql("dense", stages_for(*_EVENT.values(), "ret ret2 quality vol20"), "e")
    curved = " + ".join(["0.0", *(f"ln({lag('close', 9 - i) if i < 9 else 'close'}) * {c!r}" for i, c in enumerate(CURVATURE))])
    made = ", ".join(f"{v} AS {k}" for k, v in _EVENT.items() if k != "convexity")
    after = ", ".join(f"f.no_{h} - m.mkt_no_{h} AS fwd{h}" for h in (1, 5, 10, 20))
    return [
        daily_ctes(panel),
        forward_ctes(),
        *ctes,
        f"based AS (SELECT *, CASE WHEN count(ret) OVER {frame(-9, 0)} = 10 THEN sum({_flag('ret < 0')}) OVER {frame(-9, 0)} END AS down10, {curved} AS convexity, "
        f"CAST(min(low) OVER {frame(1, 10)} / close - 1 <= -0.10 AS INT) AS second_knife, max(date_idx) OVER (PARTITION BY ticker) AS final FROM {last})",
        f"crashed AS (SELECT * FROM based WHERE ({_FAST}) OR ({_EXT}) OR ({_GRIND}))",
        "taken AS (SELECT ticker, min(date_idx) AS date_idx FROM crashed GROUP BY ticker UNION ALL "
        f"SELECT c.ticker, min(c.date_idx) FROM taken t JOIN crashed c ON c.ticker = t.ticker AND c.date_idx - t.date_idx >= {COOLDOWN} GROUP BY c.ticker)",
        f"chosen AS (SELECT c.* FROM crashed c JOIN taken t ON t.ticker = c.ticker AND t.date_idx = c.date_idx WHERE c.date_idx > {warm_up} AND c.date_idx + {ahead} <= final AND c.present)",
        f"described AS (SELECT date, ticker, {made}, convexity, quality, vol20, second_knife FROM chosen)",
        f"events AS (SELECT d.*, {after} FROM described d JOIN forward f ON f.date = d.date AND f.ticker = d.ticker JOIN market m ON m.date = d.date)",
    ]


EVENT_DOUBLES = "depth5 sigma_crash accel convexity climax_rvol below_ma50_atr rangepos52 mom126 quality vol20 fwd1 fwd5 fwd10 fwd20"

COHORTS = {
    "ALL knives": "true",
    "news-driven crash": "news_crash = 1",
    "no-news crash": "news_crash = 0",
    "fast (-15%/5d)": "kind_fast = 1",
    "grind (8/10 down)": "kind_grind = 1",
    "climax volume >=3x": "climax_rvol >= 3",
    "reversal bar": "reversal_bar = 1",
    "gap-down exhaustion": "gap_exhaust = 1",
    "FORK RULE: no-news + (reversal|climax)": "news_crash = 0 AND (reversal_bar = 1 OR climax_rvol >= 3)",
    "news + climax (the trap)": "news_crash = 1 AND climax_rvol >= 3",
    "crash >4 sigma": "sigma_crash <= -4",
    "high quality": "quality > 0.5",
    "low quality": "quality < -0.5",
    "parabolic finish": "accel > 0.5",
    "accelerating path (convex down)": "convexity < 0",
}


def cohort_sql(least: int = 15) -> str:
    """Overlapping cohorts of {events}, each event once in each that it belongs to."""
    union = " UNION ALL ".join(f"SELECT '{name}' AS cohort, fwd5, fwd10, second_knife FROM {{events}} WHERE {p}" for name, p in COHORTS.items())
    return (
        f"SELECT cohort, count(*) AS n, 1e4 * avg(fwd5) AS fwd5_bps, 1e4 * avg(fwd10) AS fwd10_bps, avg(CASE WHEN fwd5 > 0 THEN 1e0 ELSE 0e0 END) AS p_bounce5, 100 * PCTL(fwd5, 0.9) AS p90_5d_pct, "
        f"100 * PCTL(fwd5, 0.1) AS p10_5d_pct, avg(CAST(second_knife AS DOUBLE)) AS p_second_knife FROM ({union}) x GROUP BY cohort HAVING count(*) >= {least}"
    )


def cohorts(events: DataFrame, least: int = 15) -> DataFrame:
    tagged = F.filter(F.array(*(F.when(F.expr(render(p, "spark")), F.lit(name)) for name, p in COHORTS.items())), lambda x: x.isNotNull())
    each = events.select(F.explode(tagged).alias("cohort"), "fwd5", "fwd10", "second_knife")
    return (
        each.groupBy("cohort")
        .agg(
            F.count("*").alias("n"),
            (1e4 * F.avg("fwd5")).alias("fwd5_bps"),
            (1e4 * F.avg("fwd10")).alias("fwd10_bps"),
            F.avg(F.when(F.col("fwd5") > 0, 1.0).otherwise(0.0)).alias("p_bounce5"),
            (100 * F.percentile("fwd5", F.lit(0.9))).alias("p90_5d_pct"),
            (100 * F.percentile("fwd5", F.lit(0.1))).alias("p10_5d_pct"),
            F.avg(F.col("second_knife").cast("double")).alias("p_second_knife"),
        )
        .where(F.col("n") >= least)
    )


def analogs(events: DataFrame, features=EVENT_FEATURES, outcome: str = "fwd5", k: int = 25, least: int = 300) -> DataFrame:
    """date, ticker, outcome and knn_pred: the mean outcome of the k nearest events of earlier months.

    Features are standardised by the moments of the earlier months, kept as running sums by month. Months with fewer
    than `least` earlier events have no prediction.
    """
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    points = events.select("date", "ticker", F.col(outcome).alias("y"), F.trunc("date", "MM").alias("month"), x.alias("x"))
    n = len(features)
    sums = points.groupBy("month").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("x", F.lit(i))) for i in range(n))).alias("s"), F.array(*(F.sum(F.pow(F.get("x", F.lit(i)), F.lit(2.0))) for i in range(n))).alias("ss"))
    before = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)  # a row per month
    past = sums.select("month", F.sum("n").over(before).alias("n"), *(F.sum(F.get(c, F.lit(i))).over(before).alias(f"{c}{i}") for c in ("s", "ss") for i in range(n))).where(F.col("n") >= least)
    spread = lambda i: F.sqrt(F.greatest(F.lit(0.0), F.col(f"ss{i}") / F.col("n") - F.pow(F.col(f"s{i}") / F.col("n"), F.lit(2.0)))) + 1e-9
    scales = past.select("month", F.array(*(spread(i) for i in range(n))).alias("sd"))
    now = points.join(scales, "month")
    # every event is a query against all events of earlier months: a stated theta join over the events alone
    earlier = points.select(F.col("month").alias("past_month"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("ticker").alias("pt"), F.col("date").alias("pd"))
    gap = F.zip_with(F.zip_with("x", "px", lambda a, b: a - b), F.col("sd"), lambda d, s: (d / s) * (d / s))
    pairs = now.join(earlier, F.col("past_month") < F.col("month")).withColumn("d2", F.aggregate(gap, F.lit(0.0), lambda a, b: a + b))
    nearest = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("date", "ticker").orderBy("d2", "pd", "pt"))).where(F.col("_r") <= k)
    return nearest.groupBy("date", "ticker").agg(F.first("y").alias("y"), F.avg("py").alias("knn_pred"))


def analogs_sql(features=EVENT_FEATURES, outcome: str = "fwd5", k: int = 25, least: int = 300) -> list[str]:
    """Common table expressions after events, of which the last one, predicted, has the rows of analogs."""
    n = range(len(features))
    xs = ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0.0) AS x{i}" for i, f in enumerate(features))
    sums = ", ".join(f"sum(x{i}) AS s{i}, sum(x{i} * x{i}) AS q{i}" for i in n)
    before = ", ".join(f"sum(s{i}) OVER w AS s{i}, sum(q{i}) OVER w AS q{i}" for i in n)
    spreads = ", ".join(f"sqrt(greatest(0.0, q{i} / n - power(s{i} / n, 2.0))) + 1e-9 AS d{i}" for i in n)
    gap = " + ".join(f"power((a.x{i} - b.x{i}) / d{i}, 2.0)" for i in n)
    return [
        f"points AS (SELECT date, ticker, {outcome} AS y, date_trunc('month', date) AS month, {xs} FROM events)",
        f"months AS (SELECT month, count(*) AS n, {sums} FROM points GROUP BY month)",
        f"past AS (SELECT month, sum(n) OVER w AS n, {before} FROM months WINDOW w AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        f"scales AS (SELECT month, {spreads} FROM past WHERE n >= {least})",
        "nearest AS (SELECT a.date, a.ticker, a.y, b.y AS py, row_number() OVER (PARTITION BY a.date, a.ticker ORDER BY "
        f"{gap}, b.date, b.ticker) AS place FROM points a JOIN scales s ON s.month = a.month JOIN points b ON b.month < a.month)",
        f"predicted AS (SELECT date, ticker, first(y) AS y, avg(py) AS knn_pred FROM nearest WHERE place <= {k} GROUP BY date, ticker)",
    ]


def model_forecasts(events: DataFrame, features=EVENT_FEATURES, outcome: str = "fwd5", trees: int = 120, depth: int = 3, rate: float = 0.07, least: int = 300, every: int = 1) -> DataFrame:
    """date, ticker and gbm_pred: the outcome that boosted trees, trained on the events of earlier months, expect."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = events.select("date", "ticker", F.trunc("date", "MM").alias("month"), F.col(outcome).alias("y"), *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features))
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows).persist()
    scored, _ = by_month(rows, GBTRegressor(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=rate, seed=2), least, every)
    return (rows.where("false").withColumn("prediction", F.lit(0.0)) if scored is None else scored).select("date", "ticker", F.col("prediction").alias("gbm_pred"))


def forks(events: DataFrame, predicted: DataFrame, modelled: DataFrame, cost: float = ROUND_TRIP) -> DataFrame:
    """What catching all predicted events, the rule's, the model's or the analogs' picks would have made, net."""
    rows = events.join(modelled, ["date", "ticker"]).join(predicted.select("date", "ticker", "knn_pred"), ["date", "ticker"], "left")
    picks = {"catch ALL knives": "true", "rule fork (no-news + reversal|climax)": COHORTS["FORK RULE: no-news + (reversal|climax)"], "model fork (GBM pred > +100bp)": "gbm_pred > 0.01", "analog fork (kNN cohort > +100bp)": "knn_pred > 0.01"}
    tagged = F.filter(F.array(*(F.when(F.expr(render(p, "spark")), F.lit(name)) for name, p in picks.items())), lambda x: x.isNotNull())
    each = rows.select(F.explode(tagged).alias("strategy"), F.concat_ws(" ", F.col("date").cast("string"), "ticker").alias("date"), (F.col("fwd5") - cost).alias("x"))
    tested = each.sparkSession.sql(render(newey_west("strategy", "{each}", "x", "6"), "spark"), each=each)
    stats = each.groupBy("strategy").agg(F.count("*").alias("n_trades"), (1e4 * F.avg("x")).alias("avg_5d_net_bps"), F.avg(F.when(F.col("x") > 0, 1.0).otherwise(0.0)).alias("hit"), (1e4 * F.avg("x") / 5).alias("daily_equiv_bps"))
    return stats.where("n_trades >= 10").join(tested.withColumnRenamed("tstat", "nw_t"), "strategy", "left")


EX_ANTE = {
    "rvol": "rvol",
    "gap_abs": "abs(gap)",
    "vol20": "vol20",
    "mom5": "ret5",
    "mom21": "ret21",
    "mom252": "ret252",
    "prox52": "prox",
    "news_today": "catalyst * 1e0",
    "news_3d": "news3 * 1e0",
    "compression": "(atr / nullif(close, 0)) / (vol20 + 1e-9)",
    "quality": "quality",
    "ret_today": "ret",
}


def oracle_ctes(source: str, top: int = 3, days: int = 252, universe: int = 150) -> tuple[list[str], str]:
    """winners: the last `days` dates' rows with rank by return, known-before features and whether they are on top.

    The universe is the tickers of the highest mean volume.
    """
    stages = stages_for(*EX_ANTE.values(), "ret rvol gap")
    ctes, last = derive_sql("grid", stages, "w")
    before = ", ".join(f"{lag(x)} AS x_{n}" for n, x in EX_ANTE.items())
    return [
        f"universe AS (SELECT ticker FROM (SELECT ticker, avg(volume) AS v FROM {source} GROUP BY ticker) u ORDER BY v DESC, ticker LIMIT {universe})",
        f"members AS (SELECT p.* FROM {source} p WHERE p.ticker IN (SELECT ticker FROM universe))",
        f"grid AS ({densify_sql('members')})",
        *ctes,
        f"known AS (SELECT date, date_idx, ticker, ret, catalyst, rvol, gap, open, close, {before}, max(date_idx) OVER () AS final FROM {last})",
        f"winners AS (SELECT *, CASE WHEN place <= {top} THEN 1 ELSE 0 END AS won FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret DESC NULLS LAST, ticker) AS place FROM known WHERE date_idx > final - {days}) k WHERE ret IS NOT NULL)",
    ], "winners"


TOP_TABLE = (
    "SELECT date, place AS rank, ticker, 100 * ret AS return_pct, coalesce(catalyst, 0) AS news_that_day, rvol AS rvol_that_day, 100 * gap AS gap_that_day_pct, "
    "x_rvol AS exante_rvol, x_news_3d AS exante_news_3d, x_mom21 AS exante_mom21, x_prox52 AS exante_prox52, x_vol20 AS exante_vol20, x_compression AS exante_compression FROM winners WHERE won = 1"
)


def profile_select() -> str:
    """For each feature: winners' and all rows' median (mean for news), and the winners' median rank among all."""
    from ..functions.fragments import pct_rank

    parts = []
    for n in EX_ANTE:
        x = f"x_{n}"
        if n.startswith("news"):
            parts.append(f"SELECT '{n}' AS feature, avg(CASE WHEN won = 1 THEN {x} END) AS winners, avg({x}) AS universe, avg(CASE WHEN won = 1 THEN {x} END) / greatest(avg({x}), 1e-9) AS lift FROM winners")
        else:
            parts.append(f"SELECT '{n}' AS feature, PCTL(CASE WHEN won = 1 THEN {x} END, 0.5) AS winners, PCTL({x}, 0.5) AS universe, PCTL(CASE WHEN won = 1 THEN r END, 0.5) AS lift FROM (SELECT won, {x}, {pct_rank(x)} AS r FROM winners) ranked")
    return " UNION ALL ".join(parts)


def winners(panel: DataFrame, select: str = TOP_TABLE) -> DataFrame:
    ctes, _ = oracle_ctes("{panel}")
    return panel.sparkSession.sql(render("WITH " + ", ".join(ctes) + " " + select, "spark"), panel=panel)


CEILING = "SELECT avg(CASE WHEN won = 1 THEN ret END) * 100 AS oracle_avg_daily_pct, avg(ret) * 100 AS universe_avg_daily_pct, avg(CASE WHEN won = 1 THEN coalesce(catalyst, 0) * 1e0 END) AS news_share_of_top3 FROM winners"

RETAIL_BPS, ACTIVE_BPS = 5.0, 15.0
_GRID = " UNION ALL ".join(f"SELECT {k} AS cycles_per_day, '{name}' AS costs, {bps}e0 AS bps" for k in (1, 2, 3, 5, 10, 20) for name, bps in (("retail 5bp", RETAIL_BPS), ("active 15bp", ACTIVE_BPS)))
TREADMILL = f"SELECT cycles_per_day, costs, -cycles_per_day * bps AS net_daily_bps, 100 * (-cycles_per_day * bps) * 252 / 1e4 AS net_annual_pct FROM ({_GRID}) g"
REQUIRED_SKILL = (
    "SELECT cycles_per_day, costs, 1e4 * (0.01 + cycles_per_day * bps / 1e4) / cycles_per_day AS per_trade_edge_bps, "
    f"0.5 + ((0.01 + cycles_per_day * bps / 1e4) / cycles_per_day) / (2 * sd * {math.sqrt(2 / math.pi)!r}) AS hit_rate_needed FROM ({_GRID}) g CROSS JOIN (SELECT stddev_pop(close / nullif(open, 0) - 1) AS sd FROM {{panel}}) s"
)


#: Name: (only names in the day's top decile of relative volume, less the mean intraday return, a random part of the day's move).
TRADERS = {
    "random, sim-world (upper bound)": (False, False, False),
    "random, overnight-adjusted (realistic)": (False, True, False),
    "hot movers (attention bias), adj": (True, True, False),
    "random entry time, adj": (False, True, True),
}
#: Cells of the return matrix that random traders draw from.
MAX_CELLS = 20_000_000


def day_traders(panel: DataFrame, n_traders: int = 2000, days: int = 252, k: int = 3, cost_bps: float = RETAIL_BPS, variants=TRADERS, seed: int = 5) -> DataFrame:
    """variant, trader, pnl: each trader's year of picking k names a day at random, bought at the open and sold at the close.

    Only the matrix of day returns is sent out, bounded by MAX_CELLS; traders are dealt out and each draws a year at
    once from a seed of its own. A day with fewer than k names isn't traded.
    """
    rows = derive(densify(panel), stages_for("rvol_rank")).selectExpr("date_idx", "ticker", "close / nullif(open, 0) - 1 AS oc", "rvol_rank >= 0.9 AS is_hot")
    size = rows.agg(F.max("date_idx").alias("t"), F.count_distinct("ticker").alias("n")).first()
    if not size["t"] or size["t"] * size["n"] > MAX_CELLS:
        raise ValueError(f"the matrix of returns must have 1 to {MAX_CELLS} cells")
    got = rows.toPandas()
    oc = got.pivot(index="date_idx", columns="ticker", values="oc").sort_index().to_numpy(float)
    mask = got.assign(is_hot=got.is_hot.eq(True)).pivot(index="date_idx", columns="ticker", values="is_hot").sort_index().to_numpy(bool)
    sent = panel.sparkSession.sparkContext.broadcast((oc, mask, float(np.nanmean(oc))))
    days = min(days, len(oc) - 1)

    def year(rng, hot: bool, adjusted: bool, random_entry: bool) -> float:
        oc, mask, shift = sent.value
        start = rng.integers(0, len(oc) - days)
        moves, hits = oc[start : start + days], mask[start : start + days]
        can = np.isfinite(moves) & (hits if hot else True)
        if moves.shape[1] < k:
            return 0.0
        drawn = np.argpartition(np.where(can, rng.random(can.shape), 2.0), k - 1, axis=1)[:, :k]
        r = np.take_along_axis(moves, drawn, 1) - (shift if adjusted else 0.0)
        if random_entry:
            r = r * rng.uniform(0, 1, r.shape)
        return float((r.mean(axis=1) - cost_bps / 1e4)[can.sum(axis=1) >= k].sum())

    def live(batches):
        import pandas as pd

        for batch in batches:
            for i, (name, kind) in enumerate(variants.items()):
                yield pd.DataFrame({"variant": name, "trader": batch["id"], "pnl": [year(np.random.default_rng([seed, i, int(t)]), *kind) for t in batch["id"]]})

    return panel.sparkSession.range(n_traders).repartition(8).mapInPandas(live, "variant string, trader long, pnl double")


def annual_distribution(pnl: DataFrame) -> DataFrame:
    return pnl.groupBy("variant").agg(
        (100 * F.avg("pnl")).alias("mean_annual_pct"),
        (100 * F.percentile("pnl", F.lit(0.5))).alias("median_annual_pct"),
        F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("p_profitable_year"),
        (100 * F.percentile("pnl", F.lit(0.05))).alias("p5_pct"),
        (100 * F.percentile("pnl", F.lit(0.95))).alias("p95_pct"),
        (1e4 * F.avg("pnl") / 252).alias("daily_bps"),
    )


def bootstrap(daily: DataFrame, column: str = "ret", n_draws: int = 1000, block: int = 21, seed: int = 11) -> DataFrame:
    """draw, avg: means of resamples of a daily series in blocks of random length, `block` days on average.

    The series, a number a day, is sent out; draws are dealt out, each with a seed of its own.
    """
    series = np.array([r[0] for r in daily.where(F.col(column).isNotNull()).orderBy("date").select(column).collect()])
    sent = daily.sparkSession.sparkContext.broadcast(series)

    def draw(batches):
        import pandas as pd

        r = sent.value
        for batch in batches:
            out = []
            for b in batch["id"]:
                rng = np.random.default_rng([seed, int(b)])
                jump = rng.random(len(r)) < 1 / block
                jump[0] = True
                begins = np.flatnonzero(jump)
                lengths = np.diff(np.append(begins, len(r)))
                at = np.repeat(rng.integers(0, len(r), len(begins)) - begins, lengths) + np.arange(len(r))
                out.append(float(r[at % len(r)].mean()))
            yield pd.DataFrame({"draw": batch["id"], "avg": out})

    return daily.sparkSession.range(n_draws if len(series) else 0).mapInPandas(draw, "draw long, avg double")


def average_path(panel: DataFrame, events: DataFrame, before: int = 15, after: int = 20) -> DataFrame:
    """offset, path: the mean log close of events relative to the event's, by rows from it."""
    dense = densify(panel).select("date", "date_idx", "ticker", "close")
    at = events.select("date", "ticker").join(dense, ["date", "ticker"]).select("ticker", F.col("date_idx").alias("t0"), F.col("close").alias("c0"))
    steps = at.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("date_idx", F.col("t0") + F.col("offset"))
    return steps.join(dense.select("date_idx", "ticker", "close"), ["date_idx", "ticker"]).groupBy("offset").agg(F.avg(F.log("close") - F.log("c0")).alias("path"))


def information_coefficient(predicted: DataFrame, a: str = "knn_pred", b: str = "y") -> DataFrame:
    return predicted.agg(F.corr(a, b).alias("ic"))


def equity(daily: DataFrame, column: str = "ret") -> DataFrame:
    """date, equity, drawdown of compounding a daily return. One row a day passes through the window."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = daily.select("date", F.exp(F.sum(F.log1p(column)).over(w)).alias("equity"))
    return grown.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)

