"""Language identification by prediction by partial matching.

A text is coded as its UTF-8 bytes, all of them. For each language a variable-order context tree holds how often each
byte followed each context of up to ORDER bytes. A byte that a context hasn't seen is coded by escaping to the next
shorter context, down to the uniform distribution over all bytes; escapes get the mass of method C, and the shorter
context's distribution leaves out what the longer one has seen, so each context's probabilities add up to one. The
statistics are frozen after training: the cost of a byte depends only on the context before it.

The trees of all languages lie side by side. Each context with a byte that some language has seen there is an entry
that holds the byte's cost in every language; each context alone is an entry that holds the cost of escaping from it.
Entries are found by hash, the longest first, so that exact code lengths of whole texts take a few array operations. The
shortest code wins.

Training takes a bounded sample of the learning rows: about ROWS_PER_LANG documents of each language, chosen by a hash
of the id, of any length. No byte and no context of theirs is left out. Scoring covers every byte of every text.

Defined cases: a null text, or one without a letter, is `und` with score 0; equal codes go to the first language by
name; with no learning rows all is `und`; a language whose texts are all empty is learned as one that has seen nothing;
repeated rows are scored each; an empty table gives an empty result; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._models import fold, sample_by_class
from ._tables import table
from ._words import slices

#: The longest context, at most 7: a context and its byte are one 64-bit key.
ORDER = 3
ROWS_PER_LANG = 240
#: Bytes scored in one go, and bytes of training text counted in one go.
BLOCK = 1 << 19
PAD = b" " * ORDER


class Lookup:
    """Values by 64-bit key: open addressing in arrays, an eighth full at most."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(8 * len(keys)).bit_length())
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.at[slot] < 0)
            first = free[np.unique(slot[free], return_index=True)[1]]  # one for each free place
            self.keys[slot[first]], self.at[slot[first]] = keys[left[first]], left[first]
            stay = np.ones(len(left), bool)
            stay[first] = False
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)


    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among those it was made of, -1 where it is none."""
        slot = self._slot(keys)
        found = self.at[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.at[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return found


def byte_keys(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte but the first ORDER: it and the `order` bytes before it, as one number."""
    key = np.zeros(len(data) - ORDER, np.uint64)
    for back in range(order, -1, -1):
        key = (key << np.uint64(8)) | data[ORDER - back : len(data) - back].astype(np.uint64)
    return key


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their counts added up."""
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(at, np.concatenate(counts), len(every))


class Counts:
    """How often each byte followed each longest context, of texts that come one by one."""

    def __init__(self):
        self.keys, self.counts = [np.zeros(0, np.uint64)], [np.zeros(0)]

    def add(self, text: str) -> None:
        data = np.frombuffer(PAD + text.encode(), np.uint8)
        for at in range(0, len(data) - ORDER, BLOCK):
            found, n = np.unique(byte_keys(data[at : at + BLOCK + ORDER], ORDER), return_counts=True)
            self.keys.append(found)
            self.counts.append(n.astype(float))
        if sum(map(len, self.keys)) > 4 * len(self.keys[0]) + BLOCK:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = merged(self.keys, self.counts)
        self.keys, self.counts = [keys], [counts]
        return keys, counts


class ContextTrees:
    """Frozen context trees of several languages."""

    def __init__(self, texts: dict[str, list[str]] | dict[str, Counts]):
        self.langs = sorted(texts)
        if not texts:
            return
        longest = []
        for lang in self.langs:
            counts = texts[lang]
            if not isinstance(counts, Counts):
                counts = Counts()
                for t in texts[lang]:
                    counts.add(t)
            longest.append(counts.total())
        n = len(self.langs)
        # by order: the keys that any language has seen, and their probabilities; the contexts, and what escaping costs
        self.seen, self.costs, self.contexts, self.escapes = [], [], [], []
        for order in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            own = [merged([keys & mask], [counts]) for keys, counts in longest]
            keys = np.unique(np.concatenate([k for k, _ in own]))
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            below = self._probability(keys & (mask >> np.uint64(8)), order - 1)
            table = np.zeros((len(keys), n))
            for j, (k, c) in enumerate(own):
                table[np.searchsorted(keys, k), j] = c
            total = np.stack([np.bincount(of, table[:, j], len(contexts)) for j in range(n)], 1)
            distinct = np.stack([np.bincount(of, table[:, j] > 0, len(contexts)) for j in range(n)], 1)
            # what the shorter context gives to the bytes that this one hasn't seen
            taken = np.stack([np.bincount(of, np.where(table[:, j] > 0, below[:, j], 0), len(contexts)) for j in range(n)], 1)
            left = np.maximum(1 - taken, 0)
            # a context that has seen every byte that can follow it never escapes
            escape = np.where((left > 1e-12) & (distinct < 256), distinct, 0)
            scale = np.maximum(total + escape, 1)
            weight = np.where(total > 0, escape / scale / np.where(left > 1e-12, left, 1), 1.0)
            p = np.where(table > 0, table / scale[of], weight[of] * below)
            self.seen.append(keys)
            self.costs.append(p)
            self.contexts.append(contexts)
            self.escapes.append(weight)
            self._index(order)
        self.costs = [-np.log2(np.maximum(p, 1e-300)).astype(np.float32) for p in self.costs]
        self.escapes = [-np.log2(np.maximum(w, 1e-300)).astype(np.float32) for w in self.escapes]

    def _index(self, order: int) -> None:
        if order == 0:
            self.entry_of, self.context_of = [], []
        self.entry_of.append(Lookup(self.seen[order]))
        self.context_of.append(Lookup(self.contexts[order]))

    def _probability(self, keys: np.ndarray, order: int) -> np.ndarray:
        """The probability of each key's byte after the key's context, in every language."""
        if order < 0:
            return np.full((len(keys), len(self.langs)), 1 / 256)
        out, at = np.empty((len(keys), len(self.langs))), self.entry_of[order](keys)
        known = at >= 0
        out[known] = self.costs[order][at[known]]
        if not known.all():
            rest = keys[~known]
            c = self.context_of[order](rest >> np.uint64(8))
            shorter = self._probability(rest & np.uint64((1 << 8 * order) - 1), order - 1)
            out[~known] = np.where((c >= 0)[:, None], self.escapes[order][c], 1.0) * shorter
        return out

    def byte_costs(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Bits of each key's byte after the key's context, in every language."""
        if order < 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        at = self.entry_of[order](keys)
        out = self.costs[order][at]
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            rest = keys[unknown]
            shorter = self.byte_costs(rest & np.uint64((1 << 8 * order) - 1), order - 1)
            c = self.context_of[order](rest >> np.uint64(8))
            out[unknown] = shorter + np.where((c >= 0)[:, None], self.escapes[order][c], np.float32(0))
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language."""
        total = np.zeros((len(texts), len(self.langs)))
        block, owners, filled = [], [], 0
        for i, text in enumerate(texts):
            data = PAD + text.encode()
            for at in range(0, len(data) - ORDER, BLOCK):
                piece = data[at : at + BLOCK + ORDER]
                block.append(piece)
                owners.append(i)
                filled += len(piece)
                if filled >= BLOCK:
                    self._add(block, owners, total)
                    block, owners, filled = [], [], 0
        if block:
            self._add(block, owners, total)
        return total

    def _add(self, block: list[bytes], owners: list[int], total: np.ndarray) -> None:
        """Adds the bits of each piece, whose first ORDER bytes are context only, to its owner's."""
        keys, lengths = byte_keys(np.frombuffer(b"".join(block), np.uint8), ORDER), np.array([len(b) for b in block])
        # between two pieces lie ORDER keys that begin in one and end in the other
        stops = np.cumsum(lengths) - ORDER
        starts = stops - lengths + ORDER
        inside = np.zeros(len(keys) + 1, np.int64)
        inside[starts] += 1
        np.add.at(inside, stops, -1)
        real = np.cumsum(inside[:-1]) > 0
        bits = self.byte_costs(keys[real], ORDER)
        begins = np.cumsum(lengths - ORDER) - (lengths - ORDER)
        np.add.at(total, np.array(owners), np.add.reduceat(bits, begins, axis=0, dtype=np.float64))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict_languages(spark, docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte for each of docs. score: the share of 2 to the power of minus the code
    length, over all languages."""
    sent = spark.sparkContext.broadcast(trees)

    def predict(batches):
        model = sent.value
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                lengths = model.code_lengths(texts) if model.langs else np.zeros((len(texts), 0))
                langs, scores, rates = [], [], []
                for t, row in zip(texts, lengths, strict=True):
                    known = len(row) > 0 and has_letter(t)
                    best = int(row.argmin()) if known else -1
                    langs.append(model.langs[best] if known else "und")
                    scores.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum()) if known else 0.0)
                    rates.append(float(row[best] / len(t.encode())) if known else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, bits_per_byte double")


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> ContextTrees:
    """docs: text, lang and doc_id of the rows to learn from. The driver sees the sample, a text at a time."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample, counts = sample_by_class(usable, "lang", rows_per_lang)
    seen, taken = {lang: Counts() for lang in counts}, dict.fromkeys(counts, 0)
    for r in sample.select("lang", "text").orderBy("doc_id", "text").toLocalIterator():
        if taken[r["lang"]] < 2 * rows_per_lang:  # the share keeps about rows_per_lang; this is its stated bound
            taken[r["lang"]] += 1
            seen[r["lang"]].add(r["text"])
    return ContextTrees(seen)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = train(docs.where(fold(4) != 2).select("doc_id", "text", "lang"))
    return predict_languages(spark, docs, trees).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
