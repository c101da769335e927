"""Bars from trade-like tables: weekly walks and bounded bars from order lines, hourly bars from events.

Stated once as SQL for Spark and DuckDB alike; {lineitem}, {part} and {events} stand for the tables. Running sums are of
integers, so both engines come to the same prices bit by bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LINES = """
SELECT p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_quantity, l_linenumber, l_returnflag, l_discount, l_tax,
  row_number() OVER (PARTITION BY p_brand, date_trunc('week', l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""

WALK = f"""
WITH lines AS ({_LINES}),
kept AS (SELECT *, count(*) OVER (PARTITION BY ticker, date) AS n FROM lines WHERE rn <= 8),
steps AS (SELECT *, CAST(round((100 * (1 - l_discount) * (1 + l_tax) - 98.8) * 100) AS BIGINT) * CASE WHEN rn = 1 THEN 4 ELSE 1 END AS st FROM kept),
priced AS (SELECT *, round(100 * exp(sum(st) OVER (PARTITION BY ticker ORDER BY date, rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 40000.0), 4) AS px FROM steps),
shaped AS (SELECT date, ticker, max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high, min(px) AS low, max(CASE WHEN rn = n THEN px END) AS close,
  max(CASE WHEN rn = 1 THEN l_quantity * power(2, l_linenumber) END) AS volume,
  max(CASE WHEN rn = 1 AND l_returnflag = 'R' AND l_linenumber = 7 THEN 1 ELSE 0 END) AS catalyst,
  max(CASE WHEN rn = 1 OR 3 * rn <= n THEN px END) AS or30_high, min(CASE WHEN rn = 1 OR 3 * rn <= n THEN px END) AS or30_low
  FROM priced GROUP BY date, ticker),
brands AS (SELECT p_brand, avg(p_size) AS size FROM {{part}} GROUP BY p_brand),
scored AS (SELECT p_brand, (size - avg(size) OVER ()) / nullif(stddev_samp(size) OVER (), 0) AS quality FROM brands)
SELECT date, ticker, open, high, low, close, CAST(volume AS DOUBLE) AS volume, CAST(catalyst AS INT) AS catalyst,
  CAST(sign(close - open) * catalyst AS INT) AS news_sign, round(quality, 9) AS quality, or30_high, or30_low
FROM shaped JOIN scored ON p_brand = ticker""".replace("{{part}}", "{part}")

BOUNDED = f"""
WITH lines AS ({_LINES}),
priced AS (SELECT *, round(100 * (1 - l_discount) * (1 + l_tax), 4) AS px, count(*) OVER (PARTITION BY ticker, date) AS n FROM lines)
SELECT date, ticker, max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high, min(px) AS low, max(CASE WHEN rn = n THEN px END) AS close,
  sum(l_quantity) AS volume, max(CASE WHEN rn = 1 AND l_returnflag = 'R' AND l_linenumber = 7 THEN 1 ELSE 0 END) AS catalyst
FROM priced GROUP BY date, ticker"""

HOURLY = """
WITH placed AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS hour, value,
  row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn,
  count(*) OVER (PARTITION BY event_type, date_trunc('hour', ts)) AS n FROM {events})
SELECT hour, ticker, max(CASE WHEN rn = 1 THEN value END) AS open, max(value) AS high, min(value) AS low, max(CASE WHEN rn = n THEN value END) AS close,
  CAST(count(*) AS DOUBLE) AS volume FROM placed GROUP BY hour, ticker"""


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of a price that walks by each order line."""
    return spark.sql(WALK, **_tables(spark, sf_dir, "lineitem", "part"))


def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of a price that stays around 100."""
    return spark.sql(BOUNDED, **_tables(spark, sf_dir, "lineitem", "part"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events by type."""
    return spark.sql(HOURLY, **_tables(spark, sf_dir, "events"))


def in_duckdb(text: str) -> str:
    return text.format(lineitem="lineitem", part="part", events="events")
