"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's words are lower-cased and parted by white space; each run of SHINGLE_WORDS words is hashed, and the K smallest
distinct hashes are the sketch. The sketch of several parts is the K smallest of their sketches together, so sketches
merge in any order. Two sketches estimate resemblance (the share of the K smallest of both together that both hold),
containment and, by the K-th smallest hash, the number of distinct shingles.

All of it is DataFrame expressions, row by row. The one shuffle is for neighbours: documents are dealt by ranges of ids,
and a range also gets the first document of the next one, so each finds its successor within its range.

Defined cases: a null text is empty; a text with fewer words than a shingle has the whole sequence as its one shingle;
one without words has the empty sketch; two empty sketches are alike (1), an empty and another are not (0); rows of
equal ids follow each other by a hash of their text; a null id comes after all others; with one document only, it is its own successor;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import table

SHINGLE_WORDS = 5
K = 64
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Documents of one range of ids, about: so many while there are no more than MANY_RANGES ranges; then ranges grow as
#: the square root of the documents, and their number, which the driver sees, does as well.
RANGE_ROWS, MANY_RANGES = 2048, 1 << 12


def shingle_hashes(text: Column, words_each: int = SHINGLE_WORDS) -> Column:
    """64-bit hashes of a text's shingles, repeats included. A shingle's hash is that of its words' hashes."""
    words = F.filter(F.split(F.lower(text), WHITE_SPACE), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        whole = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - words_each), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words_each))))
        return F.when(F.size(h) == 0, F.array().cast("array<long>")).when(F.size(h) < words_each, whole).otherwise(runs)

    # bound once, so that the words are hashed once
    return F.get(F.transform(F.array(hashes), shingles), F.lit(0))


def sketch(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group of parts. Hashes, not sketches, are gathered, the k smallest at each step."""
    hashes = sketches.select(*by, F.explode(column).alias("_h")).distinct()
    salted = Window.partitionBy(*by, "_salt").orderBy("_h")
    first = hashes.withColumn("_salt", F.pmod(F.hash("_h"), F.lit(64))).withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= k)
    last = first.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_n") <= k)
    return last.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of distinct shingles of either text that both have."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    total = F.size(merge(a, b, k))
    return F.when(total == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / total)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; above, (k - 1) over the k-th smallest hash as a share of all."""
    kth = (F.element_at(a, -1).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's distinct shingles that b has, at most 1."""
    r = resemblance(a, b, k)
    joint = r / (1 + r) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), joint / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def longs(values: list[int]) -> Column:
    """A constant array."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)") if values else F.array().cast("array<long>")


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most key, by halving."""
    steps, held = [1 << i for i in range(max(1, len(bounds)).bit_length() - 1, -1, -1)], longs(bounds)
    go = lambda at, step: F.when(F.coalesce(F.get(held, (at + step - 1).cast("int")) <= key, F.lit(False)), at + step).otherwise(at)
    return F.aggregate(longs(steps), F.lit(0).cast("long"), go)


def n_ranges(n: int) -> int:
    """How many ranges n documents are dealt to."""
    ranges = math.ceil(n / RANGE_ROWS)
    return ranges if ranges <= MANY_RANGES else math.ceil(math.sqrt(ranges * MANY_RANGES))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with next_text, the text of the next document by descending id; the last one's is the
    first's. Also next_sketch, for docs with a column sketch.

    The driver sees the range bounds and the first row of each range: three numbers a range.
    """
    ids = docs.select("doc_id")
    ranges, bounds = n_ranges(ids.count()), []
    if ranges > 1:
        shares = F.expr(f"cast(split('{','.join(str(i / ranges) for i in range(1, ranges))}', ',') as array<double>)")
        bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 20 * ranges))).alias("b")).first()["b"] or []))
    keyed = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(range_of(F.col("doc_id"), bounds)).cast("int")).withColumn("_key", F.xxhash64("text"))
    # the first document of each range, the greatest by id, then the least by text, follows the last one of the range above
    order = [F.col("doc_id").desc_nulls_last(), F.col("_key").asc()]
    first = F.min(F.struct((-F.coalesce("doc_id", F.lit(0)).cast("decimal(20,0)")).alias("less"), F.col("_key").alias("key"))).alias("f")
    firsts = keyed.groupBy("_range").agg(first).orderBy("_range").select("_range", (-F.col("f.less")).cast("long").alias("i"), F.col("f.key").alias("k")).collect()
    given = F.lit(None).cast("int")
    if firsts:
        # by place: range -1, of rows without an id, stands at 0
        above, id_of, key_of = ([0] * (firsts[-1]["_range"] + 2) for _ in range(3))
        for j, r in enumerate(firsts):
            at = r["_range"] + 1
            above[at], id_of[at], key_of[at] = firsts[(j + 1) % len(firsts)]["_range"], r["i"], r["k"]
        at = F.col("_range") + 1
        is_first = (F.coalesce("doc_id", F.lit(0)) == F.get(longs(id_of), at)) & (F.col("_key") == F.get(longs(key_of), at))
        given = F.when(is_first, F.get(longs(above), at).cast("int"))
    targets = F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy")), F.struct(given.alias("r"), F.lit(1).alias("copy")))
    dealt = keyed.withColumn("_to", F.explode(F.filter(targets, lambda x: x["r"].isNotNull())))
    dealt = dealt.select(*docs.columns, "_key", F.col("_to.r").alias("_r"), F.col("_to.copy").alias("_copy"))
    carried = [c for c in ("text", "sketch") if c in docs.columns]
    w = Window.partitionBy("_r").orderBy("_copy", *order)
    after = dealt.withColumn("_next", F.lead(F.struct(*carried)).over(w)).where("_copy = 0")
    return after.select(*docs.columns, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in carried))


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS, k: int = K) -> DataFrame:
    """docs (text and any other columns) with sketch."""
    return docs.withColumn("sketch", sketch(shingle_hashes(F.coalesce("text", F.lit("")), words_each), k))


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = with_next(fingerprints(docs))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    found = found.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    found = found.withColumn("edited_sketch", sketch(shingle_hashes(F.col("edited"))))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept"),
    )


QUERIES = {"op9_fingerprints": op9_fingerprints}
ORACLES: dict[str, str] = {}
