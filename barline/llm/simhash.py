"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit for each bit position that is set in over half the hashes of its word shingles. Two
fingerprints link when they differ in at most RADIUS bits.

Candidates come from structured bit masks: every bit position gets a nonzero vector of RADIUS + 1 bits, and the mask of
a nonzero vector v keeps the positions whose vector has an odd product with v. RADIUS positions span too little to
touch every v, so some mask misses all the bits in which two linked fingerprints differ: they collide in that table,
with certainty. Only fingerprints that share a bucket with another one go on.

Within buckets no pairs are made. Two fingerprints are within 2 bits exactly if flipping at most one bit in each leads
to a common point; so a fingerprint lists the points reached by flipping one bit that its bucket's mask doesn't keep,
and fingerprints that share a point are tied to the point's smallest. A point has at most 65 fingerprints within a
bit, whatever the size of the bucket, so the ties are as many as the fingerprints, and their components are those of
the links. Equal fingerprints are one node from the start.

Components come from alternating large and small stars, each round kept in the shared folder.

Two bits are far less than a fifth of the shingles: copies that resemble each other to 0.8 differ in 5 to 14 bits, a
radius for which masks that cover every pair would run to thousands. Where a similarity is asked for, documents are
therefore linked in a second way as well, by their sets of shingles; documents of one set are one node from the start.
BANDS keys of three minima each out of a one-permutation min-hash bring sets together in buckets, and buckets of the
same members count once. Each member is held against the ends of an order of its bucket, or of two orders in a large
one; bottom-K sketches decide, or, near the line, the shingles themselves. What a bucket then still has in several
components goes on: in a bucket of at most SMALL each pair of different components is compared, in a larger one all are
held against the member of most links, and what is left after that goes through an exact join: two sets that resemble each other that much share one of their rarest shingles, so many as they may miss
and one more. Only pairs of different components, and of sizes and places that allow the similarity, are compared, in
blocks, by their whole sets. So no pair of a bucket goes untested, whatever the bucket's size. What may still be lost: a
pair of similarity 0.8 shares no key with a chance of about one in 100,000, and a sketch may err by more than UNSURE,
four and a half deviations, with one of about one in 100,000 as well. Sets are told apart by 64 bits of hash.

Defined cases: a null text or one without a word has fingerprint 0, linked like any other; one with fewer words than a
shingle has the whole sequence as its one shingle; a bit set in exactly half the hashes is 0; repeated rows, of equal
ids or not, are of one component; an empty table gives an empty result; rows without an
id link as well, but name no component; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.kept import kept
from ._tables import ROW, join_split, shared_folder, table, with_row, written
from ._words import giving_back, slices
from .fingerprint import resemblance

RADIUS = 2
SHINGLE_WORDS = 5
SEED = 42
#: Shingles hashed in one go.
BLOCK = 1 << 15
#: For links by similarity: hashes in a sketch, keys, and minima in a key.
SKETCH, BANDS, BAND_ROWS = 256, 16, 3
#: How far a sketch's estimate may be off: four and a half deviations.
UNSURE = 0.1125
#: Rows of three numbers that are sent to all executors, 24 MB at most; more are joined by a shuffle.
SENT_ROWS = 1 << 20
#: Members of a bucket that are all held against each other; rounds of hubs in larger ones; rows of a block of a join.
SMALL, HUB_ROUNDS, JOIN_ROWS = 16, 1, 512


def shingle_hashes(text: str, words_each: int = SHINGLE_WORDS):
    """Hashes of a text's shingles, repeats included, a block at a time. ASCII letters are lower-cased and words are
    what ASCII white space parts."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - words_each + 1)
    first, last = (stops - lengths)[:n].tolist(), stops[len(words) - n :].tolist()
    for at in range(0, n, BLOCK):
        yield np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], "<u8")


def fingerprint(blocks) -> int:
    """64 bits of the hashes in blocks; 0 without any."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def distinct(blocks: list[np.ndarray]) -> np.ndarray:
    """The distinct hashes of the blocks, sorted."""
    return np.unique(np.concatenate([np.unique(b) for b in blocks])) if blocks else np.zeros(0, "<u8")


def sketch_and_bands(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper halves of the SKETCH smallest of distinct hashes, as signed numbers, and BANDS keys; none of either
    without any."""
    if not len(hashes):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    bins = BANDS * BAND_ROWS
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (hashes % np.uint64(bins)).astype(np.int64), hashes)
    have = np.flatnonzero(least != np.iinfo(np.uint64).max)
    if len(have):  # an empty bin takes the next one's
        least = least[have[np.searchsorted(have, np.arange(bins)) % len(have)]]
    mixed = least.reshape(BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(BAND_ROWS):
        key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ mixed[:, j]
    return np.unique((np.sort(hashes.view(np.int64))[:SKETCH] >> 32).astype(np.int32)), key.view(np.int64)


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS, sketched: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry (longs) and fp: the fingerprint's 64 bits as a signed long. If asked for, also what
    follows from the set of shingles alone: set_id, its hash, sketch and bands."""
    from xxhash import xxh64_intdigest

    def compute(batches):
        for batch in batches:
            for part in slices(batch):
                blocks = [list(shingle_hashes(t or "", words_each)) for t in part.column("text").to_pylist()]
                found = np.array([fingerprint(b) for b in blocks], np.uint64)
                columns, names = [part.column(c) for c in ("doc_id", *carry)] + [pa.array(found.view(np.int64))], ["doc_id", *carry, "fp"]
                if sketched:
                    sets = [distinct(b) for b in blocks]
                    more = [sketch_and_bands(s) for s in sets]
                    columns.append(pa.array(np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)))
                    columns += [pa.array([m[i] for m in more], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.int64()))]
                    names += ["set_id", "sketch", "bands"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"{c} long" for c in ("doc_id", *carry, "fp")) + ", set_id long, sketch array<int>, bands array<long>" * sketched
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text").mapInArrow(giving_back(compute), schema)


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One mask for each nonzero vector of radius + 1 bits."""
    vectors = [1 + i % ((2 << radius) - 1) for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 2 << radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ties(distinct: DataFrame) -> DataFrame:
    """Edges u > v between distinct fingerprints (column fp) whose components are those of the links."""
    masks = covering_masks(RADIUS)
    table_of = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    keyed = distinct.select("fp", F.explode(table_of).alias("b")).select("fp", "b.t", "b.key")
    shared = keyed.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("t", "key")
    inside = keyed.join(shared, ["t", "key"], "left_semi")
    flips = [F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1)) for m in masks]
    points = inside.select("fp", F.explode(F.get(F.array(*flips), F.col("t"))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    # at most the point and its 64 neighbours, so these sets are bounded
    met = points.groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """u, v: each node of the edges (u > v) that isn't the smallest of its component, and the smallest."""
    edges, mark, step = written(edges, folder, "ties"), None, 0
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges
        mark, step = now, step + 1
        edges = written(_small_star(_large_star(edges)), folder, f"stars{step}")


def sent(names: DataFrame) -> DataFrame:
    """names, a written table of a few numbers a row, marked to be sent to all executors if it has few enough rows."""
    return F.broadcast(names) if names.count() <= SENT_ROWS else names


def shingle_sets(docs: DataFrame, prints: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """node and s, the distinct shingles of a set, for each node of wanted; docs has ROW."""
    spoken = prints.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(*ROW)).alias("r")).select("node", *(f"r.{c}" for c in ROW))

    def compute(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [distinct(list(shingle_hashes(t or "", words_each))).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    # sent, the texts lie still
    texts = docs.select(*ROW, "text").join(sent(kept(spoken, "spoken")), list(ROW)).select("node", "text")
    return texts.mapInArrow(giving_back(compute), "node long, s array<long>").dropDuplicates(["node"])  # true copies of the row


def beside(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """pairs (u, v), a written table, with a and b, what `of` (node and column) has for either. A hub may stand in a third
    of the pairs. The first join leaves one row a pair, so the second one's counts are those of pairs, and each is made
    once."""
    a, b = (of.select(F.col("node").alias(x), F.col(column).alias(y)) for x, y in (("u", "a"), ("v", "b")))
    total = pairs.count()
    return join_split(join_split(pairs, a, "u", "v", total=total), b, "v", "u", counts=pairs.groupBy("v").count(), total=total)


def exact_resemblance(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v) with r, the share of the distinct shingles of either set that both have."""
    common = F.size(F.array_intersect("a", "b"))
    return beside(pairs, sets, "s").select("u", "v", (common / F.greatest(F.lit(1), F.size("a") + F.size("b") - common)).alias("r"))


def unsettled(members: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """members (bucket, node and any others) of buckets that the links leave in several components, with root, their component."""
    roots = components(links, folder).select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = written(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), folder, "rooted")
    several = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    return written(rooted.join(several, "bucket", "left_semi"), folder, "unsettled")


def hub_pairs(members: DataFrame, links: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each bucket of members (bucket, node, k, root) the one of most links that isn't among used (bucket, node), and it
    against the members of other components."""
    degrees = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct(F.col("node").alias("hub"), F.col("k").alias("hub_k"), F.col("root").alias("hub_root")), F.struct("n", F.xxhash64("node"), "node"))
    hubs = members.join(used, ["bucket", "node"], "left_anti").join(degrees, "node").groupBy("bucket").agg(best.alias("h")).select("bucket", "h.*")
    met = join_split(members, hubs, "bucket", "node").where("root <> hub_root")
    return hubs.select("bucket", F.col("hub").alias("node")), met.select("node", "k", F.col("hub").alias("other"), F.col("hub_k").alias("other_k"))


def sharing_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs u > v of sets (node, root, s) of different roots, among them all that resemble each other that much. Of
    each set the rarest shingles count, so many that sets without a common one among them are too far apart; the first
    common one of a pair tells how many may follow."""
    spread = sets.select("node", F.explode("s").alias("token"))
    counts = spread.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # a shingle of one set only has no pair; these come first and need only be counted
    ordered = spread.join(counts, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("o"))
    sized = sets.select("node", "root", F.size("s").alias("n"))
    placed = ordered.join(sized, "node").select("node", "root", "n", F.posexplode("o").alias("at", "x"), (F.col("n") - F.size("o")).alias("alone"))
    first = placed.select("node", "root", "n", (F.col("alone") + F.col("at")).alias("at"), F.col("x.token").alias("token")).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9))
    shared = first.groupBy("token").agg(F.ceil(F.count("*") / JOIN_ROWS).cast("long").alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token", "blocks")
    rows = first.join(shared, "token")
    a = rows.select("token", F.pmod(F.xxhash64("node"), "blocks").alias("block"), F.col("node").alias("u"), F.col("root").alias("ru"), F.col("n").alias("nu"), F.col("at").alias("au"))
    b = rows.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("node").alias("v"), F.col("root").alias("rv"), F.col("n").alias("nv"), F.col("at").alias("av"))
    may = F.least(F.col("nu") - F.col("au"), F.col("nv") - F.col("av")) >= similarity / (1 + similarity) * (F.col("nu") + F.col("nv")) - 1e-9
    alike = (F.col("u") > F.col("v")) & (F.col("ru") != F.col("rv")) & may
    return a.alias("a").join(b.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.block") == F.col("b.block")) & alike).select("u", "v").distinct()


def buckets_of(keyed: DataFrame) -> DataFrame:
    """Buckets of keyed (node, k, bucket) with several members: how many, and the ends (node, k) of two orders of them. Of
    buckets that have the same members one stands for all."""
    order, member = F.xxhash64("node"), F.struct("node", "k")
    ends = (F.min(member).alias("lo"), F.max(member).alias("hi"), F.min_by(member, order).alias("first"), F.max_by(member, order).alias("last"))
    mark = F.sum(F.xxhash64(F.lit(2), F.col("node")).cast("decimal(38,0)")).alias("mark")
    found = keyed.groupBy("bucket").agg(F.count("*").alias("n"), *ends, mark).where("lo < hi")
    return found.groupBy("n", "lo", "hi", "first", "last", "mark").agg(F.min("bucket").alias("bucket")).drop("mark")


def similar(docs: DataFrame, prints: DataFrame, similarity: float, words_each: int, folder: str) -> DataFrame:
    """Edges u > v between nodes, sets of shingles that resemble each other that much, enough of them for the
    components. docs has ROW, prints ROW, node, sketch and bands. Sketches decide where they are sure; near the line
    the shingles themselves do."""
    # sketch and bands follow from the set, so any row of a node has the same
    # and k, the sketch's size, goes along: sketches whose sizes are too far apart need no comparison
    keyed = prints.select("node", F.size("sketch").cast("short").alias("k"), "bands").dropDuplicates(["node"]).select("node", "k", F.posexplode("bands").alias("t", "key"))
    keyed = keyed.select("node", "k", F.xxhash64("t", "key").alias("bucket"))
    keyed = written(keyed, folder, "keyed")
    # most keys are those of one set: what is told of a bucket is worked out for the others only
    shared = written(keyed.groupBy("bucket").agg(F.count("*").alias("count"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket", "count"), folder, "shared")
    among = written(join_split(keyed, shared.select("bucket"), "bucket", "node", counts=shared), folder, "among")
    inside = written(join_split(among, written(buckets_of(among), folder, "buckets"), "bucket", "node", counts=shared), folder, "inside")
    # only sets that share a bucket are looked at from here on
    sharing = sent(written(inside.select("node").distinct(), folder, "nodes"))
    each = written(prints.select("node", "sketch").join(sharing, "node", "left_semi").dropDuplicates(["node"]), folder, "sketches")

    def alike(pairs: DataFrame, step: str) -> DataFrame:
        # what is estimated is the lesser size in the greater one at most, so this drops what the estimate would
        may = pairs.where(F.least("k", "other_k") >= F.greatest("k", "other_k") * (similarity - UNSURE) - 1e-6)
        pairs = written(may.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct(), folder, f"met{step}")
        guessed = beside(pairs, each, "sketch").select("u", "v", resemblance(F.col("a"), F.col("b"), SKETCH).alias("r"))
        guessed = written(guessed.where(F.col("r") >= similarity - UNSURE), folder, f"pairs{step}")
        near = guessed.where(F.col("r") < similarity + UNSURE).select("u", "v")
        close = exact_resemblance(near, shingle_sets(docs, prints, near.select(F.explode(F.array("u", "v")).alias("node")).distinct(), words_each))
        return written(guessed.where(F.col("r") >= similarity + UNSURE).unionByName(close.where(F.col("r") >= similarity)).select("u", "v"), folder, f"links{step}")

    is_large = F.col("n") > SMALL
    ends = F.array_distinct(F.when(is_large, F.array("lo", "hi", "first", "last")).otherwise(F.array("lo", "hi")))
    links = alike(inside.select("node", "k", F.explode(ends).alias("e")).select("node", "k", F.col("e.node").alias("other"), F.col("e.k").alias("other_k")).where("node <> other"), "")
    used = written(inside.where(is_large).select("bucket", F.explode(F.array("lo.node", "hi.node", "first.node", "last.node")).alias("node")).distinct(), folder, "used")
    members = unsettled(inside.select("bucket", "node", "k", "n"), links, f"{folder}/open")
    few = members.where(~is_large).groupBy("bucket").agg(F.collect_list(F.struct("node", "k", "root")).alias("all")).select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    pairs = few.where("a.node > b.node AND a.root <> b.root").select(F.col("a.node").alias("node"), F.col("a.k").alias("k"), F.col("b.node").alias("other"), F.col("b.k").alias("other_k"))
    members = members.where(is_large).drop("n")
    for k in range(HUB_ROUNDS):
        hubs, met = hub_pairs(members, links, used)
        more = alike(pairs.unionByName(met), f"-hubs{k}")
        links, used, pairs = links.unionByName(more), used.unionByName(written(hubs, folder, f"hubs{k}")), pairs.limit(0)
        members = unsettled(members.drop("root"), links, f"{folder}/open{k}")
    if not HUB_ROUNDS:
        links = links.unionByName(alike(pairs, "-small"))
    if members.isEmpty():
        return links
    left = members.select("node", "root").distinct()
    sets = written(shingle_sets(docs, prints, left.select("node"), words_each).join(left, "node"), folder, "sets")
    pairs = written(sharing_pairs(sets, similarity), folder, "sharing")
    return links.unionByName(exact_resemblance(pairs, sets.select("node", "s")).where(F.col("r") >= similarity).select("u", "v"))


def link(prints: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """prints (a written table with doc_id and node) with root, one node of each component of the edges (u > v), and
    component_id, its smallest doc_id."""
    roots = components(edges, folder).select(F.col("u").alias("node"), F.col("v").alias("root"))
    least = prints.groupBy("node").agg(F.min("doc_id").alias("least"))
    by_root = written(least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), folder, "roots")
    ids = by_root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = join_split(by_root.select("node", "root"), ids, "root", "node")
    return join_split(prints, written(named, folder, "named"), "node", "doc_id")


def near_fingerprints(docs: DataFrame, folder: str, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp, component_id for each of docs. Links are fingerprints within RADIUS bits."""
    prints = written(fingerprints(docs, words_each).withColumn("node", F.col("fp")), folder, "fingerprints")
    return link(prints, ties(prints.select("fp").distinct()), folder).select("doc_id", "fp", "component_id")


def near_duplicates(spark, docs: DataFrame, words_each: int = SHINGLE_WORDS, similarity: float = 0.8) -> DataFrame:
    """ROW, doc_id, fp, root, component_id for each of docs (with ROW). Links are fingerprints within RADIUS bits, and
    documents whose shingles resemble each other that much. Nodes are sets of shingles, so texts that share a
    fingerprint but not their shingles keep links of their own."""
    folder = shared_folder(spark)
    prints = written(fingerprints(docs, words_each, True, ROW).withColumnRenamed("set_id", "node"), folder, "fingerprints")
    least = prints.groupBy("fp").agg(F.min("node").alias("least"))
    pairs = ties(prints.select("fp").distinct())
    tied = pairs.join(least.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v")
    same = prints.select("fp", "node").distinct().join(least, "fp")
    edges = tied.select("a", "b").unionByName(same.select(F.col("node").alias("a"), F.col("least").alias("b")))
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    more = similar(docs, prints, similarity, words_each, folder)
    return link(prints.select(*ROW, "doc_id", "fp", "node"), edges.unionByName(more).distinct(), folder).select(*ROW, "doc_id", "fp", "root", "component_id")


def one_of_each(spark, docs: DataFrame, words_each: int = SHINGLE_WORDS, similarity: float = 0.8) -> DataFrame:
    """docs, one row of each group of near copies: that of the smallest id, of several such rows the one of the least
    hash. A row without an id stands behind all others of its group; rows of equal ids but other texts are documents of
    their own. Of rows that are alike in every column one is left."""
    keyed = with_row(docs)
    found = near_duplicates(spark, keyed, words_each, similarity)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW)).alias("best")
    chosen = kept(found.groupBy("root").agg(best).select(*(f"best.{c}" for c in ROW)), "chosen")
    out = keyed.join(chosen, list(ROW), "left_semi")
    copies = found.groupBy(*ROW).count().where("count > 1")
    if not copies.join(chosen, list(ROW), "left_semi").isEmpty():
        out = out.dropDuplicates(list(ROW))
    return out.select(docs.columns)


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_fingerprints(table(spark, sf_dir, "documents"), shared_folder(spark), words_each=3)
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
