"""Reading tables, naming rows, and joins that one hot key doesn't hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..sources.kept import drop, shared_folder, written

__all__ = ["ROW", "drop", "has_copies", "join_split", "shared_folder", "table", "with_row", "written"]

#: The two columns that name a row by all that it holds.
ROW = ("_row_a", "_row_b")
#: A key of more than this share of all rows is hot; there are no more than its inverse of them.
HOT_SHARE, HOT_ROWS, HOT_PARTS = 1 / 256, 256, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row(docs: DataFrame) -> DataFrame:
    """docs with ROW: 128 bits of hash over every column (but maps, which have no hash), so that true copies share it
    and rows that differ anywhere don't."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]
    # xxhash64 passes over nulls: where they stand counts as well
    nulls = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in columns))
    return docs.withColumn(ROW[0], F.xxhash64(*columns, nulls)).withColumn(ROW[1], F.xxhash64(F.lit(1), nulls, *columns))


def has_copies(keyed: DataFrame) -> bool:
    """Whether a table with ROW has rows that are alike in every column."""
    return not keyed.groupBy(*ROW).count().where("count > 1").isEmpty()


def join_split(left: DataFrame, right: DataFrame, key: str, salt: str, how: str = "inner", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """left joined with right by key, where a third of left's rows may share one. right has a row for each key at most,
    salt is a column of left that tells rows of a key apart.

    Hot keys, at most 1 / HOT_SHARE of them, are counted first; their rows are dealt to HOT_PARTS parts, and the one
    row of right goes to each part. counts: key and count of left, if at hand; keys of one row may be left out. total:
    left's rows, if at hand; with both, left is worked out for the join only.
    """
    counts = left.groupBy(key).count() if counts is None else counts
    total = left.count() if total is None else total
    hot = [r[key] for r in counts.where(F.col("count") > max(HOT_ROWS, total * HOT_SHARE)).collect() if r[key] is not None]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    dealt = left.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64(salt), F.lit(HOT_PARTS))).otherwise(0).cast("int"))
    every = right.withColumn("_part", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(every, [key, "_part"], how).drop("_part")
