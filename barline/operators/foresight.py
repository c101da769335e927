"""What could be known of a day's winners before the open: picks by trees of earlier months, against picks by chance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fragments import render
from ..sources.kept import kept
from .backtest import ROUND_TRIP, newey_west
from .fusion import by_month
from .studies import CEILING, EX_ANTE, oracle_ctes, winners

#: Dates at the beginning that have no winners; rows a day that picks need; rows that a model needs and takes.
FIRST_DATE, LEAST_NAMES, LEAST_ROWS, MOST_ROWS = 30, 10, 20_000, 400_000


def chance_select(top: int = 3) -> str:
    """The mean return of `top` names of each date in the order of a hash, and how often one such is among the winners."""
    drawn = "row_number() OVER (PARTITION BY date ORDER BY md5(concat('0 ', CAST(date AS STRING), ' ', ticker)))"
    return (
        f"SELECT 100 * avg(ret) AS random3_avg_daily_pct, {top} / (SELECT count(*) * 1e0 FROM universe) AS random_hit_rate "
        f"FROM (SELECT date, avg(ret) AS ret FROM (SELECT date, ret, {drawn} AS drawn FROM winners) d WHERE drawn <= {top} GROUP BY date) r"
    )


def chances(panel: DataFrame, top: int = 3, trees: int = 120, depth: int = 4, rate: float = 0.07, least: int = LEAST_ROWS, every: int = 1) -> DataFrame:
    """date, date_idx, final (the last date's index), ticker, oc, won and chance: that of being among the day's `top`,
    by trees that learned from the months before and see what was known at the close before."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ctes, _ = oracle_ctes("{panel}", top)
    names = [f"x_{n}" for n in EX_ANTE]
    placed = f"CASE WHEN ret IS NOT NULL AND date_idx > {FIRST_DATE} AND row_number() OVER (PARTITION BY date ORDER BY ret DESC NULLS LAST, ticker) <= {top} THEN 1e0 ELSE 0e0 END"
    values = ", ".join(f"coalesce({n}, 0) AS {n}" for n in names)
    select = f"SELECT date, date_idx, final, ticker, close / nullif(open, 0) - 1 AS oc, trunc(date, 'MM') AS month, {placed} AS won, coalesce({', '.join(names)}) IS NOT NULL AS is_known, {values} FROM known"
    rows = panel.sparkSession.sql(render("WITH " + ", ".join(ctes) + " " + select, "spark"), panel=panel).where("is_known")
    rows = kept(rows, "known")
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    scored, _ = by_month(rows, GBTClassifier(labelCol="won", maxIter=trees, maxDepth=depth, stepSize=rate, seed=1), least, every, MOST_ROWS)
    if scored is None:
        scored, chance = rows.where("false"), F.lit(0.0)
    else:
        chance = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select("date", "date_idx", "final", "ticker", "oc", "won", chance.alias("chance"))


def honest_picks(scored: DataFrame, top: int = 3, days: int = 252, cost: float = ROUND_TRIP) -> DataFrame:
    """date, picked, prob, hits_in_actual_top3, net_return_pct: each of the last `days` dates' names of the highest
    chance (the first by ticker on ties), bought at the open and sold at the close."""
    w = Window.partitionBy("date")
    placed = scored.where(F.col("date_idx") > F.col("final") - days).withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("chance"), "ticker")))
    by_date = placed.where(F.col("n") >= LEAST_NAMES).groupBy("date").agg(
        F.sort_array(F.collect_list(F.when(F.col("place") <= top, F.struct("place", "ticker", "chance")))).alias("picks"),
        F.collect_list(F.when(F.col("won") == 1, F.col("ticker"))).alias("actual"),
        F.avg(F.when(F.col("place") <= top, F.col("oc"))).alias("oc"),
    )
    return by_date.select(
        "date",
        F.array_join("picks.ticker", ",").alias("picked"),
        F.array_join(F.transform("picks", lambda p: F.format_string("%.3f", p["chance"])), ",").alias("prob"),
        F.size(F.array_intersect("picks.ticker", "actual")).alias("hits_in_actual_top3"),
        (100 * (F.col("oc") - cost)).alias("net_return_pct"),
    )


def oracle_summary(panel: DataFrame, picks: DataFrame, top: int = 3) -> DataFrame:
    """One row: what the day's winners, the honest picks and picks by chance made a day, and how often picks hit."""
    picks = kept(picks, "picks")
    daily = picks.select(F.lit(1).alias("one"), "date", (F.col("net_return_pct") / 100).alias("x"))
    tested = panel.sparkSession.sql(render(newey_west("one", "{daily}", "x", "5"), "spark"), daily=daily)
    honest = picks.agg(F.avg("net_return_pct").alias("honest_avg_daily_net_pct"), (F.sum("hits_in_actual_top3") / F.greatest(F.lit(1), top * F.count("*"))).alias("honest_hit_rate"))
    # tables of one row each
    row = winners(panel, CEILING).crossJoin(winners(panel, chance_select(top))).crossJoin(honest).join(tested, F.lit(True), "left")
    return row.select(
        "oracle_avg_daily_pct",
        "honest_avg_daily_net_pct",
        F.col("tstat").alias("honest_nw_t"),
        "random3_avg_daily_pct",
        "honest_hit_rate",
        "random_hit_rate",
        (F.col("honest_avg_daily_net_pct") / F.col("oracle_avg_daily_pct")).alias("capture_ratio"),
        "news_share_of_top3",
    )
