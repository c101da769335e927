"""Results as files: a folder of CSV parts for each table, and a JSON summary."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .kept import _path


def tables(results: dict[str, DataFrame], folder: str) -> None:
    """Writes each table to folder/name.csv with a header, replacing what is there. Executors write their own parts."""
    for name, df in results.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def nested(df: DataFrame, key: str | None = None):
    """A bounded table as what a summary holds: one row as a mapping, several as mappings by their key."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return {str(r.pop(key)): r for r in rows} if key else rows[0] if rows else None


def summary(spark: SparkSession, values: dict, path: str) -> None:
    """Writes one JSON object to a file on whatever file system the path belongs to, replacing what is there."""
    at, files = _path(spark, path)
    out = files.create(at, True)
    out.write(bytearray(json.dumps(values, indent=2, default=str).encode()))
    out.close()
