"""Best-fit packing of tokenised documents in bulk-synchronous rounds.

A document is tokenised, closed with an end id, and cut into pieces only where it is longer than a sequence. Rounds then
place pieces. Every round range-sorts what it offers and the sequences' gaps by size: a row's place is the count of
larger ones, known from a histogram of at most capacity entries, and its rank among its equals, which is distributed. A
successor sweep runs over that order from the largest size down. A gap raises the depth by one, a piece lowers it, and a
piece takes the gap that raised the depth to where it stands, as a bracket closes another: the smallest free gap that
holds it. Rows of one depth meet in one task (a depth is reached at most twice for each size, so these groups are
bounded by the capacity) and each piece looks at the row before it. Among pieces that want the same gaps the lower rank
goes first. Matched gaps shrink, and the next round begins. Pieces of over half a sequence open one each before the
first round; where no piece fits any gap, the longest left open new ones, no more than their tokens need at least.

A gap takes one thing a round. So that short pieces don't need a round each, the first rounds offer them in bundles of
equal ones, about BUNDLE tokens each, but for a share that stays to fill small gaps at the end.

The driver sees histograms by length, at most capacity rows each; ranks, sweeps and the join that places each piece are
distributed, and a length that a third of all rows share is ranked in as many parts as its rows ask.

Defined cases: a null or empty text is the end id alone; every piece of a document longer than a sequence is full but
the last; repeated rows are documents of their own; an empty table gives an empty result; a null id stays null;
other columns are ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import drop, shared_folder, table, written
from ._words import Split, gather, giving_back, slices
from .token_counts import byte_alphabet

CAPACITY = 4096
END_ID = 1
#: Rows of one size that are ranked together.
RANK_ROWS = 1000
#: Tokens of a bundle, and the share of a length's pieces that stays single while bundles are offered.
BUNDLE, SINGLE_SHARE = 1024, 0.25
#: Bundles end once a round places less than this share of the tokens left.
LEAST_GAIN = 0.02
#: Runs of letters that lower-casing and NFC keep as they are but for case, then a run of punctuation: one or two pre-tokens.
SIMPLE = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[.,;:!?|%&*$#]*)$"
#: Texts tokenised together, in bytes, and places of words whose ids are joined in one go.
BATCH_BYTES, PLACES = 4 << 20, 1 << 16


class WordIds:
    """The ids of texts whose tokenizer drops white space: those of their words, joined.

    Each different word of a batch is looked at once, each different pre-token of simple letters merged once: by rank,
    with a byte that stands for the end of a word after it. The merges with that byte come first, the others follow in
    the order of ids. All other words go to the library. Nothing is kept from batch to batch.
    """

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model, alphabet = json.loads(Path(vocabulary).read_text())["model"], byte_alphabet()
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        singles = [c for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ordered = all(ids[a] < ids[b] for a, b in zip(made, made[1:], strict=False))
        ranks = {}
        for token in [*singles, *(c + suffix for c in singles), *made]:
            plain = token.removesuffix(suffix)
            ranks[bytes(alphabet[c] for c in plain) + b"\0" * (plain != token)] = len(ranks)
        self.by_rank = np.array([ids[t] for t in (*singles, *(c + suffix for c in singles), *made)], "<u4")
        # merging by rank is the library's way only where each token has one rank, in the order of ids
        self.ranks_hold = ordered and len(ranks) == len(self.by_rank)
        if self.ranks_hold:
            self.ends = np.zeros(len(ranks), bool)
            self.ends[[r for t, r in ranks.items() if t.endswith(b"\0")]] = True
            self.merge = tiktoken.Encoding("marked", pat_str="[^\\x00]*\\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def pre_tokens(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, joined, and how many each has."""
        if not some:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        got = np.array(self.merge("\0".join(some) + "\0"))
        return self.by_rank[got], np.diff(np.flatnonzero(self.ends[got]), prepend=-1)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each word two runs of them: where they begin and how long they are, in turn."""
        starts, lengths = np.zeros((2, len(words), 2), np.int64)
        ids, filled = [], 0
        simple = pc.extract_regex(words, SIMPLE) if self.ranks_hold else pa.nulls(len(words), pa.struct([("letters", pa.string()), ("signs", pa.string())]))
        is_simple = simple.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(is_simple)
        for j, part in enumerate((pc.utf8_lower(pc.struct_field(simple, "letters")), pc.struct_field(simple, "signs"))):
            coded = part.filter(simple.is_valid()).dictionary_encode()
            parts = coded.dictionary.to_pylist()
            found, each = self.pre_tokens([p for p in parts if p])
            n = np.zeros(len(parts), np.int64)
            n[[i for i, p in enumerate(parts) if p]] = each
            codes = coded.indices.to_numpy()
            starts[at, j], lengths[at, j] = (filled + np.cumsum(n) - n)[codes], n[codes]
            ids.append(found)
            filled += len(found)
        for i in np.flatnonzero(~is_simple).tolist():
            found = np.array(self.tokenizer.encode(words[i].as_py(), add_special_tokens=False).ids, "<u4")
            starts[i, 0], lengths[i, 0] = filled, len(found)
            ids.append(found)
            filled += len(found)
        return np.concatenate(ids), starts, lengths

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin, with the end of the last one's."""
        split = Split(texts)  # ASCII white space only: a boundary for the tokenizer as well
        ids, starts, lengths = self.words(split.words)
        edges = np.concatenate([[0], np.cumsum(split.sums(lengths.sum(axis=1)[split.codes]))]).astype(np.int64)
        out = np.empty(int(edges[-1]), "<u4")
        filled = 0
        for at in range(0, len(split.codes), PLACES):
            codes = split.codes[at : at + PLACES]
            some = ids[gather(starts[codes].ravel(), lengths[codes].ravel())]
            out[filled : filled + len(some)] = some
            filled += len(some)
        return out, edges


@lru_cache(maxsize=1)
def word_ids(vocabulary: str) -> WordIds:
    """One for all tasks that a Python worker runs."""
    return WordIds(vocabulary)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document."""
    end, names = np.array([end_id], "<u4").tobytes(), ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3]

    def cut(batches):
        encode, step = word_ids(vocabulary), 4 * capacity
        for batch in batches:
            for part in slices(batch, 4096, BATCH_BYTES):
                ids, edges = encode(part.column("text"))
                data, out = ids.tobytes(), []
                for key, a, b in zip(part.column("doc_id").to_pylist(), (4 * edges[:-1]).tolist(), (4 * edges[1:]).tolist(), strict=True):
                    own = data[a:b] + end
                    out += [(key, at // step, at // 4, len(p := own[at : at + step]) // 4, zlib.crc32(p)) for at in range(0, len(own), step)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(giving_back(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def histogram(rows: DataFrame, column: str) -> dict[int, int]:
    """Rows by a size: at most capacity entries."""
    return {r[column]: r["count"] for r in rows.groupBy(column).count().collect()}


def by_size(values: dict[int, int], size: Column, otherwise: int = 0) -> Column:
    """What a small table of the driver's, of at most capacity entries, says of a size."""
    listed = ",".join(str(values.get(i, otherwise)) for i in range(max(values, default=0) + 1))
    return F.coalesce(F.get(F.expr(f"cast(split('{listed}', ',') as array<bigint>)"), size.cast("int")), F.lit(otherwise))


def ranked(rows: DataFrame, by: str, key: str, counts: dict[int, int], into: str) -> DataFrame:
    """rows with their rank, from 0, among those of equal `by`. A size with many rows is ranked in parts, dealt by key,
    whose counts are summed first."""
    parts = {v: math.ceil(n / RANK_ROWS) for v, n in counts.items()}
    keyed = rows.withColumn("_part", F.pmod(F.xxhash64(key), by_size(parts, F.col(by), 1)).cast("int"))
    rank = F.row_number().over(Window.partitionBy(by, "_part").orderBy(key)) - 1
    if max(parts.values(), default=1) == 1:
        return keyed.withColumn(into, rank.cast("long")).drop("_part")
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(by, "_part").count().select(by, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    return keyed.join(starts, [by, "_part"]).withColumn(into, F.col("_from") + rank).drop("_part", "_from")


def offers(left: dict[int, int], bundled: bool) -> list[tuple[int, int, int]]:
    """(length, pieces in a unit, units) of a round."""
    out = []
    for length, n in left.items():
        each = max(1, BUNDLE // length) if bundled else 1
        out.append((length, each, int(n * (1 - SINGLE_SHARE)) // each) if each > 1 and n >= 4 * each else (length, 1, n))
    return [o for o in out if o[2]]


def depths(gaps: dict[int, int], units: list[tuple[int, int, int]]) -> tuple[dict[int, int], dict[int, tuple[int, int]], dict[int, int]]:
    """Where the sweep stands as it reaches the gaps of each size, and the units of each length with how many of these
    find a gap; and the gaps that are left. From the largest size down, gaps before units."""
    opens, closes, runs, depth = {}, {}, [], 0
    after = dict(gaps)
    for size, is_unit, n, length in sorted([(g, 0, n, 0) for g, n in gaps.items()] + [(e * u, 1, n, u) for u, e, n in units], key=lambda b: (-b[0], b[1], -b[3])):
        if not is_unit:
            opens[size], depth = depth, depth + n
            runs.append([size, n])
            continue
        n = min(n, depth)
        closes[length], depth = (depth, n), depth - n
        while n:
            gap, free = runs[-1]
            some = min(n, free)
            for g, change in ((gap, -some), (gap - size, some)):
                after[g] = after.get(g, 0) + change
            n, runs[-1][1] = n - some, free - some
            if some == free:
                runs.pop()
    return opens, closes, {g: n for g, n in after.items() if g and n}


def sweep(gaps: DataFrame, sizes: dict[int, int], found: DataFrame, opens: dict[int, int], closes: dict[int, tuple[int, int]], each_of: dict[int, int], done: dict[int, int]) -> DataFrame:
    """gaps (sequence_id, gap; sizes: how many of each) with the length, the first rank and the number of the pieces
    that each takes, null where it takes none. found: length and rank of all pieces."""
    none = F.lit(None).cast("long")
    a = ranked(gaps, "gap", "sequence_id", sizes, "_rank")
    a = a.select((by_size(opens, F.col("gap")) + F.col("_rank") + 1).alias("depth"), F.col("gap").alias("size"), F.lit(0).alias("kind"), "sequence_id", none.alias("length"), none.alias("rank"), none.alias("each"))
    length = F.col("length")
    j, each = F.col("rank") - by_size(done, length), by_size(each_of, length, 1)
    b = found.select("length", "rank", j.alias("_j"), each.alias("each"), by_size({k: d for k, (d, _) in closes.items()}, length).alias("_depth"), by_size({k: n for k, (_, n) in closes.items()}, length).alias("_n"))
    b = b.where("_j >= 0 AND _j % each = 0 AND _j < _n * each")
    b = b.select((F.col("_depth") - F.expr("_j div each")).alias("depth"), (F.col("length") * F.col("each")).alias("size"), F.lit(1).alias("kind"), none.alias("sequence_id"), "length", "rank", "each")
    order = Window.partitionBy("depth").orderBy(F.col("size").desc(), "kind", F.col("length").desc())
    after = F.lead(F.struct("kind", "length", "rank", "each")).over(order)
    met = a.unionByName(b).withColumn("_after", after).where("kind = 0").withColumn("_took", F.when(F.col("_after.kind") == 1, F.col("_after")))
    return met.select("sequence_id", F.col("size").alias("gap"), "_took.length", "_took.rank", "_took.each")


def place(found: DataFrame, counts: dict[int, int], folder: str, capacity: int = CAPACITY) -> DataFrame:
    """length, rank, sequence_id, offset for each piece. found: a written table with length and rank, from 0 among the
    pieces of a length."""
    found = found.select("length", "rank")
    left, done, opened, placed, step = dict(counts), dict.fromkeys(counts, 0), 0, [], 0
    gaps, sizes, bundled = None, {}, True

    def open_sequences(wanted: dict[int, int]) -> DataFrame:
        """New sequences that begin with the next pieces of each length: so many of each."""
        nonlocal opened
        first, length = {}, F.col("length")
        begin = {n: done[n] for n in wanted}
        for size, n in wanted.items():
            first[size], opened = opened, opened + n
            done[size] += n
            left[size] -= n
            if gap := capacity - size:
                sizes[gap] = sizes.get(gap, 0) + n
        fresh = found.withColumn("_j", F.col("rank") - by_size(begin, length)).where((F.col("_j") >= 0) & (F.col("_j") < by_size(wanted, length)))
        fresh = fresh.select("length", "rank", (by_size(first, length) + F.col("_j")).alias("sequence_id"))
        placed.append(fresh.select("length", "rank", F.lit(1).cast("long").alias("each"), "sequence_id", F.lit(0).cast("long").alias("offset")))
        return fresh.select("sequence_id", (F.lit(capacity) - F.col("length")).alias("gap")).where("gap > 0")

    # no two pieces of over half a sequence fit together
    if large := {length: n for length, n in left.items() if 2 * length > capacity}:
        gaps = open_sequences(large)
    while left := {k: n for k, n in left.items() if n}:
        units = offers(left, bundled)
        each_of = {length: each for length, each, _ in units}
        opens, closes, after = depths(sizes, units)
        gained = sum(length * each_of[length] * n for length, (_, n) in closes.items())
        if gained:
            met, step = written(sweep(gaps, sizes, found, opens, closes, each_of, done), folder, f"round{step}"), step + 1
            sizes = after
            for length, (_, n) in closes.items():
                done[length] += n * each_of[length]
                left[length] -= n * each_of[length]
            placed.append(met.where("length IS NOT NULL").select("length", "rank", "each", "sequence_id", (F.lit(capacity) - F.col("gap")).alias("offset")))
            gaps = met.select("sequence_id", (F.col("gap") - F.coalesce(F.col("length") * F.col("each"), F.lit(0))).alias("gap")).where("gap > 0")
        if bundled and gained < LEAST_GAIN * sum(k * n for k, n in left.items()):
            bundled = False
        elif not gained:
            need, wanted = math.ceil(sum(k * n for k, n in left.items()) / capacity), {}
            for length in sorted(left, reverse=True):
                if need > 0:
                    wanted[length] = min(need, left[length])
                    need -= wanted[length]
            fresh = open_sequences(wanted)
            gaps, bundled = fresh if gaps is None else gaps.unionByName(fresh), True
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.col("each") - 1)).alias("_i")
    return out.select("*", i).select("length", (F.col("rank") + F.col("_i")).alias("rank"), "sequence_id", (F.col("offset") + F.col("_i") * F.col("length")).alias("offset"))


def pack(spark, found: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """found, any table with a length (1 to capacity) and key columns that tell most rows apart, with sequence_id and
    offset added. found is read twice, so it should be a written table."""
    folder = shared_folder(spark)
    columns = [c for c in found.columns if c not in ("sequence_id", "offset")]
    counts = histogram(found, "length")
    if not counts:
        return found.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # rows that are alike in all of the key are told apart by where they stand, so that they too are dealt out
    salted = written(found.select(*columns, F.xxhash64(*key, F.monotonically_increasing_id()).alias("_salt")), folder, "salted")
    rows = written(ranked(salted, "length", "_salt", counts, "rank").drop("_salt"), folder, "ranked")
    drop(spark, f"{folder}/salted")
    placed = place(rows, counts, folder, capacity)
    return rows.join(placed, ["length", "rank"]).select(*columns, "sequence_id", "offset")


def pack_documents(spark, docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(spark, written(pieces(docs, vocabulary, capacity), shared_folder(spark), "pieces"), capacity)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
