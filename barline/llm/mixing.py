"""Mixing sources to target weights as a time-varying curriculum.

Every source has a weight schedule over training time 0..1, given as knots of a piecewise-linear curve. The schedule's
integral is the source's weight, its share of the demand; weights and the sources' sizes make the targets. A source's
documents, in a fixed pseudo-random order, form a stream of words; the stream is run through as often as the source's
target asks. The inverse of the cumulative demand curve at the middle of a document's stretch of the stream is its
training position, and documents are range-sorted by position. What a document gives is the sum over these placings.

Everything here is DataFrame expressions. Prefix sums over a source's stream never pass through one task: a source is
cut into as many buckets of its hash order as its document count asks, buckets are summed first, and only the rows
within a bucket are swept together. Sources may be as many as hosts: their ranks come from a range sort whose parts are
counted first, and the level of the targets from a few sums over all sources, not from a sort in one task.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; repeated rows are rows of
their own, also without an id; documents of size 0 take 0 words and have no position; an empty table gives an empty
result; a source all of whose documents are empty has target 0; a row with a null id is mixed like any other. Columns
besides the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import shared_folder, table, written

#: No document is taken more often than this.
MAX_PASSES = 3
#: Documents of a source that one bucket of the sweep holds, about.
BUCKET_ROWS = 2048
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """sources: source, source_size, weight, one row each, a written table. Adds target.

    Targets share the total size by weight, none above max_passes times its source's size. Sources whose share is above
    that are set to it, what they leave raises the level of the others, and so on until no further source is above: a
    sum over all sources for each step, and a step for each set of sources that the last rise brought above.
    """
    cap, level, known = (F.col("source_size") * max_passes).cast("double"), 0.0, -1
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        now = sources.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("source_size") * max_passes)).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        if now["n"] == known or not now["weights"]:
            break
        known, level = now["n"], (total - (now["caps"] or 0)) / now["weights"]
    return sources.withColumn("target", F.least(cap, F.lit(float(level)) * F.col("weight")) if now["weights"] else cap)


def rank_sources(sources: DataFrame, folder: str) -> DataFrame:
    """sources with rank, from 1 by code point, null last. The driver sees a count for each part of the range sort."""
    key = F.col("source").asc_nulls_last()
    parts = written(sources.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), folder, "sources")
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    before = F.expr(f"cast(split('{','.join(str(sum(n for p, n in counts.items() if p < i)) for i in range(max(counts, default=0) + 1))}', ',') as array<bigint>)")
    return parts.withColumn("rank", F.get(before, F.col("_part")) + F.row_number().over(Window.partitionBy("_part").orderBy(key))).drop("_part")


def rotating_weight(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating."""
    return ((rank - 1) % 3 + 1).cast("double")


def _knots(first: Column, last: Column) -> Column:
    return F.array(F.struct(F.lit(0.0).alias("at"), first.alias("height")), F.struct(F.lit(1.0).alias("at"), last.alias("height")))


def flat_schedule(rank: Column) -> Column:
    """Asks for a source evenly throughout."""
    return _knots(rotating_weight(rank), rotating_weight(rank))


def ramp_schedule(rank: Column) -> Column:
    """Sources of odd rank fade in, from half their weight to one and a half of it, those of even rank fade out."""
    weight, first = rotating_weight(rank), F.when(rank % 2 == 0, 1.5).otherwise(0.5)
    return _knots(weight * first, weight * (2 - first))


def _segments(knots: Column) -> Column:
    """Each stretch between two knots with its share of the whole integral, running and own."""
    pair = lambda i: F.struct(
        F.get(knots, i)["at"].alias("at"),
        (F.get(knots, i + 1)["at"] - F.get(knots, i)["at"]).alias("width"),
        F.get(knots, i)["height"].alias("h0"),
        F.get(knots, i + 1)["height"].alias("h1"),
        ((F.get(knots, i + 1)["at"] - F.get(knots, i)["at"]) * (F.get(knots, i)["height"] + F.get(knots, i + 1)["height"]) / 2).alias("area"),
    )
    return F.transform(F.sequence(F.lit(0), F.size(knots) - 2), pair)


def integral(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0.0), lambda a, s: a + s["area"])


def invert_demand(fraction: Column, segments: Column) -> Column:
    """The time by which the given fraction of a schedule's integral has been asked for."""
    whole = integral(segments)
    found = F.aggregate(
        segments,
        F.struct((fraction * whole).alias("left"), F.lit(None).cast("double").alias("at")),
        lambda a, s: F.struct(
            (a["left"] - s["area"]).alias("left"),
            F.when(
                a["at"].isNull() & (a["left"] <= s["area"]) & (s["area"] > 0),
                # solves (h1 - h0) / (2 width) x^2 + h0 x = left, in the form that stays exact for a flat stretch
                s["at"] + 2 * a["left"] / (s["h0"] + F.sqrt(F.greatest(F.lit(0.0), s["h0"] * s["h0"] + 2 * a["left"] * (s["h1"] - s["h0"]) / s["width"]))),
            ).otherwise(a["at"]).alias("at"),
        ),
    )
    return F.least(F.lit(1.0), F.coalesce(F.when(fraction <= 0, 0.0).otherwise(found["at"]), F.lit(1.0)))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def takings(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized with where each document's stretch of its source's stream begins, and its placings: an entry for each time
    that it is taken, with pass, words and position.

    sized: doc_id, source, size and any other columns; targets: source, source_size, source_rows, target, segments.
    A source's target is so many whole passes of its stream and a part of one more; the document at the end of that
    part gives only the words that are missing, so that a source's words add up to its target but for rounding.
    """
    others = [c for c in sized.columns if c not in ("source",)]
    keyed = sized.withColumn("_order", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.md5(F.concat(F.lit("-"), F.xxhash64(*others).cast("string")))))
    with_targets = keyed.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # the first 28 bits of the order key, scaled to the number of the source's buckets
    leading = F.conv(F.substring("_order", 1, 7), 16, 10).cast("long")
    n_buckets = F.ceil(F.col("source_rows") / F.lit(BUCKET_ROWS))
    bucketed = with_targets.withColumn("_bucket", F.floor(leading * n_buckets / F.lit(float(1 << 28))).cast("long"))
    sums = bucketed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = sums.select(
        F.col("source").alias("_s"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_bucket_from"),
    )
    joined = bucketed.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    within = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_bucket_from") + F.coalesce(F.sum("size").over(within), F.lit(0))
    wanted, size, whole = F.round(F.col("target")).cast("long"), F.col("size"), F.col("source_size")
    passes = F.when(whole > 0, F.floor(F.col("_wanted") / whole)).otherwise(0).cast("long")
    part = F.least(size, F.greatest(F.lit(0).cast("long"), F.col("_wanted") - F.col("passes") * whole - F.col("stream_start")))

    def placing(i: Column) -> Column:
        words = F.when(i < F.col("passes"), size).otherwise(F.col("part"))
        middle = (i * whole + F.col("stream_start") + words / 2) / F.greatest(F.col("target"), F.lit(1.0))
        return F.struct(i.alias("pass"), words.alias("words"), invert_demand(middle, F.col("segments")).alias("position"))

    each = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), placing), lambda x: x["words"] > 0)
    return (
        joined.withColumn("stream_start", start)
        .withColumn("_wanted", wanted)
        .withColumn("passes", passes)
        .withColumn("part", part)
        .withColumn("placings", each)
        .drop("_order", "_bucket", "_bucket_from", "_wanted", "part", "passes", "segments", "source_rows")
    )


def totals(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))


def mix(spark, docs: DataFrame, schedule=ramp_schedule, max_passes: int = MAX_PASSES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, stream_start, placings and the columns to carry, a row per document.

    schedule: knots by a source's rank; the integral is its weight. The text is read once; what follows works on the
    narrow table of sizes, kept in the shared folder.
    """
    folder = shared_folder(spark)
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry), folder, "sizes")
    sources = rank_sources(totals(sized), folder).withColumn("segments", _segments(schedule(F.col("rank")))).withColumn("weight", integral(F.col("segments")))
    targets = source_targets(written(sources, folder, "weighted"), max_passes).drop("rank", "weight")
    return takings(sized, targets)


def curriculum(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row for each time that a document is taken, with pass, words and position (0 to 1), in training order. words
    are below size only for the one document of a source where its target ends."""
    placed = mixed.withColumn("_p", F.explode("placings")).drop("placings").select("*", "_p.*").drop("_p")
    keys = ("position", "doc_id", "pass")
    ranged = placed.repartitionByRange(partitions, *keys) if partitions else placed.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """Also position: when in training, from 0 to 1, the document is first taken."""
    mixed = mix(spark, table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = F.aggregate("placings", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    first = F.round(F.get("placings", F.lit(0))["position"], 9)
    placed = mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), first.alias("position"))
    return placed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


_ORACLE = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM g)),
c AS (SELECT *, CAST(source_size * 3 AS DOUBLE) AS cap, CAST(source_size * 3 AS DOUBLE) / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
  sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
o AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM o), 1e300) * weight) AS target, weight, rank FROM l),
d AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.weight, t.rank, CAST(round(t.target) AS BIGINT) AS wanted,
  coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(CAST(s.doc_id AS VARCHAR)), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS passes FROM d),
q AS (SELECT *, CASE WHEN passes > 0 THEN size ELSE least(size, greatest(0, wanted - begins)) END AS words, weight * CASE WHEN rank % 2 = 0 THEN 1.5e0 ELSE 0.5e0 END AS h0 FROM p),
f AS (SELECT *, 2 * weight - h0 AS h1, weight * ((begins + words / 2) / greatest(target, 1e0)) AS asked FROM q)
SELECT doc_id, size, source_size, target, CAST(passes * size + least(size, greatest(0, wanted - passes * source_size - begins)) AS BIGINT) AS taken,
  CASE WHEN words > 0 THEN round(least(1e0, 2 * asked / (h0 + sqrt(greatest(0e0, h0 * h0 + 2 * asked * (h1 - h0))))), 9) END AS position FROM f
"""
QUERIES = {"op3_mixing": op3_mixing}
ORACLES = {"op3_mixing": _ORACLE}
