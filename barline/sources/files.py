"""Panels from files: downloaded daily prices, news volume, ticker lists; and estimates from an index series.

Fetching over a network is left to whoever writes the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fragments import render, roll
from ..operators.features import PANEL


def daily_csv(spark: SparkSession, path: str, ticker: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Date,Open,High,Low,Close,Volume[,Ticker] with a header, rows without a close or a date left out."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    rows = rows.toDF(*(c.strip().lower().replace(" ", "_") for c in rows.columns))
    name = F.lit(ticker) if ticker is not None else F.col("ticker") if "ticker" in rows.columns else F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[a-z]+)?(?:\.csv)?$", 1)
    out = rows.select(F.expr("try_cast(date AS DATE)").alias("date"), F.upper(name).alias("ticker"), *(F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in ("open", "high", "low", "close", "volume")))
    out = out.where("date IS NOT NULL AND close IS NOT NULL")
    for edge, op in ((start, ">="), (end, "<=")):
        if edge is not None:
            out = out.where(f"date {op} DATE'{edge}'")
    return out


def news_json(spark: SparkSession, path: str) -> DataFrame:
    """date, value from a timeline: {"timeline": [{"data": [{"date": "yyyyMMdd...", "value": n}]}]}."""
    shape = "timeline array<struct<data:array<struct<date:string,value:double>>>>"
    data = spark.read.schema(shape).json(path, multiLine=True).select(F.explode(F.get("timeline", F.lit(0))["data"]).alias("d"))
    return data.select(F.to_date(F.substring("d.date", 1, 8), "yyyyMMdd").alias("date"), F.col("d.value").alias("value"))


def news_flags(volume: DataFrame, by: list[str] | None = None) -> DataFrame:
    """date and flag: is the value more than two deviations above the mean of the 63 before it (20 at least)."""
    keyed = volume if by else volume.withColumn("ticker", F.lit(""))
    z = f"(value - ({roll('avg', 'value', 63, 20, before=1)})) / nullif({roll('stddev_samp', 'value', 63, 20, before=1)}, 0)"
    out = keyed.selectExpr("*", f"CASE WHEN {render(z, 'spark')} > 2 THEN 1 ELSE 0 END AS flag")
    return out if by else out.drop("ticker")


def ticker_list(spark: SparkSession, path: str) -> DataFrame:
    """ticker: the words of a text."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("ticker")).where("ticker <> ''").distinct()


def assemble(prices: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """A panel from prices, with flags (date, ticker, flag) aligned by date: no flag is no news; no quality or range."""
    joined = prices if flags is None else prices.join(flags.select("date", "ticker", F.col("flag").alias("catalyst")), ["date", "ticker"], "left")
    if flags is None:
        joined = joined.withColumn("catalyst", F.lit(0))
    w = Window.partitionBy("ticker").orderBy("date")
    news = F.coalesce("catalyst", F.lit(0)).cast("int")
    out = joined.withColumn("catalyst", news).withColumn("news_sign", (F.signum(F.col("close") - F.lag("close").over(w)) * F.col("catalyst")).cast("int"))
    for c in ("quality", "or30_high", "or30_low"):
        out = out.withColumn(c, F.lit(None).cast("double"))
    return out.withColumn("news_sign", F.coalesce("news_sign", F.lit(0))).select(*PANEL)


_ESTIMATES = """
WITH r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS ret, ln(open / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS night,
  ln(close / open) AS day, ln(high) - ln(low) AS width, ln(volume) - ln(lag(volume) OVER (PARTITION BY ticker ORDER BY date)) AS dv FROM {panel} WHERE open > 0 AND low > 0 AND volume > 0),
m AS (SELECT ticker, count(ret) AS n_obs, avg(ret) AS mu, var_samp(ret) AS var_ret, var_samp(night) AS var_night, var_samp(day) AS var_day, avg(night) AS mean_night, count(night) AS n,
  avg(width * width) AS width2, avg(CASE WHEN dv IS NOT NULL THEN abs(ret) END) AS mx, avg(CASE WHEN ret IS NOT NULL THEN dv END) AS my FROM r GROUP BY ticker),
d AS (SELECT r.ticker, sum(power(night - mean_night, 4)) AS s4, sum(power(night - mean_night, 2)) AS s2, sum((abs(ret) - mx) * (dv - my)) AS sxy, sum((abs(ret) - mx) * (abs(ret) - mx)) AS sxx FROM r JOIN m ON m.ticker = r.ticker GROUP BY r.ticker)
SELECT m.ticker, n_obs, mu, var_night / nullif(var_night + var_day, 0) AS overnight_var_share, sqrt(var_night) AS gap_std,
  CASE WHEN n > 3 AND s2 > 0 THEN (CAST(n AS DOUBLE) * (n + 1) * (n - 1) * s4 / (s2 * s2) - 3.0 * (n - 1) * (n - 1)) / ((n - 2.0) * (n - 3.0)) END AS gap_kurtosis,
  sxy / nullif(sxx, 0) AS volume_abs_ret_beta, width2 / (4 * ln(2)) / nullif(var_ret, 0) AS range_var_ratio FROM m JOIN d ON d.ticker = m.ticker"""


def estimates_sql(dialect: str, panel: str = "{panel}") -> str:
    return render(_ESTIMATES.replace("{panel}", panel), dialect)


def estimates(panel: DataFrame) -> DataFrame:
    """A row per ticker: drift, overnight share of variance, size and bias-corrected kurtosis of gaps, the response of
    log volume to absolute returns, and range variance against close-to-close variance."""
    return panel.sparkSession.sql(estimates_sql("spark"), panel=panel)
