"""Fusing signals into scores, and portfolios of the highest and lowest scores.

Scores come from a linear baseline (family scores standardised within a day) or from gradient-boosted trees retrained
each month on the months before. Statements hold for Spark and DuckDB; {panel} and {signals} stand for the inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fragments import clip
from .backtest import ROUND_TRIP, daily_ctes, forward_ctes, run, steps_cte
from .features import densify, derive, stages_for
from .rules import FAMILIES

CONTEXT = ("gap", "rvol", "catalyst", "news_sign", "prox", "mom121", "vol20", "quality")
MIN_TRAIN_ROWS, MAX_TRAIN_ROWS = 320 * 5, 200_000
#: (variant, names a side, holding period, conviction quantile, round-trip cost in bp)
FRONTIER = (
    *(("all", k, hold, q, 15.0) for k in (10, 5, 3, 1) for hold in (1, 2, 5) for q in (0.0, 0.8, 0.95)),
    *(("cost", 3, 2, 0.8, bps) for bps in (15.0, 8.0, 2.0)),
    ("news_only", 3, 2, 0.0, 15.0),
)


def pivot_ctes(families=FAMILIES, signals: str = "{signals}") -> str:
    """pivoted: a row per panel row: f_<family>, the sum of signed strengths, and n_active, the families that fired."""
    strength = clip("strength", -10, 10)
    each = ", ".join(f"coalesce(sum(CASE WHEN family = '{f}' THEN direction * ({strength}) END), 0) AS f_{f}" for f in families)
    fill = ", ".join(f"coalesce(f_{f}, 0) AS f_{f}" for f in families)
    return (
        f"fired AS (SELECT date, ticker, {each}, count(DISTINCT family) AS n_active FROM {signals} GROUP BY date, ticker), "
        f"pivoted AS (SELECT d.date, d.date_idx, d.ticker, {fill}, coalesce(n_active, 0) AS n_active FROM daily d LEFT JOIN fired f ON f.date = d.date AND f.ticker = d.ticker WHERE d.present)"
    )


def linear_ctes(families=FAMILIES) -> str:
    """scored: date, date_idx, ticker, score of active rows. The day's moments are over all its rows."""
    z = " + ".join(f"coalesce((f_{f} - avg(f_{f}) OVER (PARTITION BY date)) / (stddev_samp(f_{f}) OVER (PARTITION BY date) + 1e-9), 0)" for f in families)
    return f"zs AS (SELECT date, date_idx, ticker, n_active, {z} AS score FROM pivoted), scored AS (SELECT date, date_idx, ticker, round(score, 9) AS score FROM zs WHERE n_active > 0)"


def sides_ctes(top_k: int, scored: str = "scored") -> str:
    """book: date, gross, net of holding a day's top and bottom names over the next day. Equal scores go by ticker."""
    return (
        f"placed AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS low, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker DESC) AS high, count(*) OVER (PARTITION BY date) AS n FROM {scored}), "
        f"legs AS (SELECT p.date, avg(CASE WHEN high <= least({top_k}, floor(n / 2e0)) THEN no_1 END) AS rl, avg(CASE WHEN low <= least({top_k}, floor(n / 2e0)) THEN no_1 END) AS rs FROM placed p JOIN forward f ON f.date = p.date AND f.ticker = p.ticker WHERE n >= 2 GROUP BY p.date), "
        f"book AS (SELECT m.date, coalesce((rl - rs) / 2, 0) AS gross, coalesce((rl - rs) / 2 - {ROUND_TRIP!r}, 0) AS net FROM by_date m LEFT JOIN legs l ON l.date = m.date)"
    )


def frontier_ctes(configs=FRONTIER, scored: str = "scored") -> str:
    """frontier: each configuration's mean, Sharpe ratio and active days, all in one pass.

    A day's picks are held `hold` days in a tranche of 1/hold of the capital; a day's conviction threshold is that
    day's quantile of absolute scores. news_only keeps names with news within their own last three rows.
    """
    rows = " UNION ALL ".join(f"SELECT {i} AS cfg, '{v}' AS variant, {k} AS top_k, {hold} AS hold, {q} AS q, {bps} AS rt_bps" for i, (v, k, hold, q, bps) in enumerate(configs))
    levels = sorted({c[3] for c in configs})
    cuts = ", ".join(f"PCTL(abs(score), {q}) OVER (PARTITION BY s.date) AS cut_{i}" for i, q in enumerate(levels))
    cut = "CASE " + " ".join(f"WHEN c.q = {q} THEN cut_{i}" for i, q in enumerate(levels)) + " END"
    half = "least(top_k, floor(n / 2.0))"
    return (
        f"configs AS ({rows}), newsy AS (SELECT date, ticker, max(catalyst) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS news3 FROM daily), "
        f"cuts AS (SELECT s.date_idx, s.ticker, s.score, news3, {cuts} FROM {scored} s JOIN newsy w ON w.date = s.date AND w.ticker = s.ticker), "
        f"cands AS (SELECT c.cfg, c.top_k, c.hold, c.rt_bps, s.date_idx, s.ticker, s.score FROM cuts s CROSS JOIN configs c WHERE (c.q = 0 OR abs(s.score) >= {cut}) AND (c.variant <> 'news_only' OR news3 > 0)), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY cfg, date_idx ORDER BY score, ticker) AS low, row_number() OVER (PARTITION BY cfg, date_idx ORDER BY score DESC, ticker DESC) AS high, count(*) OVER (PARTITION BY cfg, date_idx) AS n FROM cands), "
        f"picks AS (SELECT *, CASE WHEN high <= {half} THEN 1 ELSE -1 END AS side FROM ranked WHERE n >= 2 AND (low <= {half} OR high <= {half})), "
        "marks AS (SELECT p.cfg, p.hold, p.rt_bps, p.date_idx, step, d.date_idx AS day, avg(CASE WHEN side = 1 THEN CASE WHEN step = 1 THEN oc ELSE cc END END) AS rl, avg(CASE WHEN side = -1 THEN CASE WHEN step = 1 THEN oc ELSE cc END END) AS rs "
        "FROM picks p JOIN steps ON step <= p.hold JOIN daily d ON d.date_idx = p.date_idx + step AND d.ticker = p.ticker GROUP BY p.cfg, p.hold, p.rt_bps, p.date_idx, step, d.date_idx), "
        "by_book AS (SELECT cfg, day, sum(((rl - rs) / 2 - CASE WHEN step = 1 THEN rt_bps / 1e4 ELSE 0 END) / hold) AS ret FROM marks GROUP BY cfg, day), "
        "frontier AS (SELECT c.variant, c.top_k, c.hold, c.q AS conviction_q, c.rt_bps, avg(coalesce(b.ret, 0)) * 1e4 AS mean_bp, sqrt(252.0) * avg(coalesce(b.ret, 0)) / (stddev_samp(coalesce(b.ret, 0)) + 1e-12) AS sharpe, count(b.ret) AS active_days "
        "FROM configs c CROSS JOIN by_date m LEFT JOIN by_book b ON b.cfg = c.cfg AND b.day = m.date_idx GROUP BY c.cfg, c.variant, c.top_k, c.hold, c.q, c.rt_bps)"
    )


def linear_book(panel: DataFrame, signals: DataFrame, top_k: int = 10, families=FAMILIES) -> DataFrame:
    return run(panel, [daily_ctes(), forward_ctes(), pivot_ctes(families), linear_ctes(families), sides_ctes(top_k)], "SELECT * FROM book", signals)


def frontier(panel: DataFrame, signals: DataFrame, families=FAMILIES) -> DataFrame:
    return run(panel, [daily_ctes(), forward_ctes(), pivot_ctes(families), linear_ctes(families), steps_cte("spark"), frontier_ctes()], "SELECT * FROM frontier", signals)


def training_rows(panel: DataFrame, signals: DataFrame, families=FAMILIES) -> DataFrame:
    """date, ticker, month, the features, n_active, y (next open to close, less the market) and raw."""
    pivoted = run(panel, [daily_ctes(), forward_ctes(), pivot_ctes(families)], "SELECT p.*, f.no_1 AS raw, f.no_1 - m.mkt_no_1 AS y FROM pivoted p JOIN forward f ON f.date = p.date AND f.ticker = p.ticker JOIN market m ON m.date = p.date", signals)
    context = derive(densify(panel), stages_for(*CONTEXT)).where("present").select("date", "ticker", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in CONTEXT))
    return pivoted.join(context, ["date", "ticker"]).withColumn("month", F.trunc("date", "MM"))


def by_month(rows: DataFrame, estimator, least: int, every: int = 1, most: int = MAX_TRAIN_ROWS):
    """rows (date, ticker, month, features and the estimator's label) as models of the months before see them, None
    where no month has `least` labelled rows before it; and the last model.

    Months are a driver loop, as each model depends on more data than the one before; all of it stays distributed. A
    training set keeps its most recent `most` rows. every: months between retrainings.
    """
    label = estimator.getLabelCol()
    months = [(r["month"], r["n"]) for r in rows.groupBy("month").agg(F.sum(F.col(label).isNotNull().cast("int")).alias("n")).orderBy("month").collect()]
    scored, model, seen, since = None, None, 0, every
    for month, n in months:
        if seen >= least:
            if model is None or since >= every:
                past = rows.where((F.col("month") < F.lit(month)) & F.col(label).isNotNull())
                if seen > most:
                    past = past.orderBy(F.col("date").desc(), "ticker").limit(most)
                model = estimator.fit(past)
                since = 0
            since += 1
            now = model.transform(rows.where(F.col("month") == F.lit(month)))
            scored = now if scored is None else scored.unionByName(now)
        seen += n
    return scored, model


def walk_forward(rows: DataFrame, families=FAMILIES, trees: int = 20, depth: int = 4, rate: float = 0.06, least: int = MIN_TRAIN_ROWS, every: int = 1):
    """Scores of active rows, by trees trained on the months before; and the last model."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    inputs = [*(f"f_{f}" for f in families), "n_active", *CONTEXT]
    rows = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(rows.where("n_active > 0")).select("date", "date_idx", "ticker", "month", "features", "y", "raw").persist()
    scored, model = by_month(rows, GBTRegressor(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=rate, seed=3), least, every)
    if scored is None:
        scored = rows.where("false").withColumn("prediction", F.lit(0.0))
    return scored.select("date", "date_idx", "ticker", F.col("prediction").alias("score"), "raw", "y"), model, rows, inputs


def permutation_importance(model, rows: DataFrame, inputs: list[str], most: int = 20_000, repeats: int = 3, top: int = 15) -> DataFrame:
    """The loss of explained variance as one feature's values are dealt out anew by a hash order."""
    n = rows.where("y IS NOT NULL").count()
    step = max(1, n // most)
    numbered = rows.where("y IS NOT NULL").withColumn("_rn", F.row_number().over(Window.orderBy("date", "ticker")))
    sample = numbered.where(F.col("_rn") % step == 0).withColumn("place", F.row_number().over(Window.orderBy("_rn"))).select("place", "features", "y").persist()
    spark = rows.sparkSession
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def r2(df):
        e = model.transform(df).agg(F.sum(F.pow(F.col("y") - F.col("prediction"), 2)).alias("e"), F.var_pop("y").alias("v"), F.count("*").alias("n")).first()
        return 1 - e["e"] / max(e["v"] * e["n"], 1e-18)

    whole, out = r2(sample), []
    for j, name in enumerate(inputs):
        drops = []
        for k in range(repeats):
            dealt = sample.select(F.row_number().over(Window.orderBy(F.xxhash64("place", F.lit(k)))).alias("place"), F.get(vector_to_array("features"), F.lit(j)).alias("_v"))
            a = vector_to_array("features")
            mixed = sample.join(dealt, "place").withColumn("features", array_to_vector(F.concat(F.slice(a, 1, j), F.array("_v"), F.slice(a, j + 2, len(inputs)))))
            drops.append(whole - r2(mixed))
        out.append((name, float(sum(drops) / repeats)))
    return spark.createDataFrame(out, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(top)


__all__ = ["by_month", "frontier", "linear_book", "permutation_importance", "training_rows", "walk_forward"]
