"""Whether signals fire where a simulated market has hidden drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.simulator import TRUTH


def ground_truth_recovery(signals: DataFrame, truth: DataFrame, rows: int = 10) -> DataFrame:
    """family, signal, n, mean_true_drift_bps: the hidden drift of the rows after a signal, in its direction; beside it
    the mean absolute drift of any row."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(1, rows)
    total = sum((F.col(t) for t in TRUTH), F.lit(0.0))
    ahead = truth.select("date", "ticker", total.alias("_t")).select("date", "ticker", F.sum("_t").over(w).alias("ahead"))
    base = ahead.agg((1e4 * F.avg(F.abs("ahead"))).alias("baseline_abs_bps"))
    found = signals.join(ahead, ["date", "ticker"], "left").groupBy("family", "signal").agg(F.count("*").alias("n"), (1e4 * F.avg(F.col("direction") * F.col("ahead"))).alias("mean_true_drift_bps"))
    return found.crossJoin(base)  # one row
