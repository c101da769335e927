"""Toxicity by a lexicon that tolerates misspelling.

The lexicon is learned from labelled rows: every lower-cased word, and every word beginning of STEM_MIN to STEM_MAX
letters, is counted by label over distinct contexts (copies of a document share their least word hash, and count once
for each). Those that stand far oftener in toxic documents than in others, and oftener than chance allows any, become
terms and stems. A list of common insults joins them.

A word is held against the lexicon by running Levenshtein automata over the terms' trie: the automaton's states and the
trie's nodes are walked together, and a branch ends as soon as its state holds no more edits. Terms of four letters or
fewer must match exactly, longer ones may miss by one edit, the longest by two; a word of four letters must be a term.
Digits and signs that stand for letters are read as these first.

Each hit is looked at in a window of WINDOW words: within quotation marks, or after a verb of saying, it counts as
quotation, else as abuse. A misspelling of a term that clean documents hardly have is one kind of hit, one of any other
term a second. A logistic model over the hits by kind (term, the two misspellings, stem; abuse, quotation), drawn
towards stated prior weights, gives the score. Lexicon and weights are learned from a bounded sample of labelled rows,
about SAMPLE_ROWS of each label; every term that passes the test is kept; scoring covers every word of every text.

Words are white-space runs of the lower-cased text. A batch's different words are looked up once.

Defined cases: a null or empty text has no hits and scores the model's base rate; without labels the stated lexicon
and prior weights hold; a document with several labels is learned from under each; repeated rows are scored each; an
empty table gives an empty result; a null id stays null;
other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._models import fold, labelled_sample
from ._tables import shared_folder, table, written
from ._words import Remembered, Split, giving_back, slices

# Insults that hold without any label.
INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "imbecile", "bastard", "asshole", "bitch")
# Signs and digits read as the letters they resemble.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
# Verbs of saying, before a quoted word.
SAYING = frozenset("said says say called calls call wrote writes word words term quote quoted quotes insult insults slur dit mot sagte wort dijo palabra".split())
STEM_MIN, STEM_MAX = 4, 8
WINDOW = 6
SAMPLE_ROWS = 6000
#: A term stands in so many distinct toxic contexts at least, and in so many times the share of them as of others.
MIN_CONTEXTS, MIN_LIFT = 4, 8.0
#: Terms that stand in this many other contexts for each toxic one at most are sure.
MAX_OTHERS = 0.02
#: near: a misspelling of a sure term; faint: of another one.
KINDS = ("term", "near", "stem", "faint")
#: Prior weights: base, then abuse and quotation of each kind, then the share of hits among words, on a log scale.
PRIOR = np.array([-4.0, 4.5, 1.0, 3.5, 0.8, 3.0, 0.8, 0.5, 0.2, 0.5])
#: Bytes of text scored in one go.
BATCH_BYTES = 4 << 20
LETTERS = r"[^\p{L}\p{N}@$!']+"
QUOTES = "\"“”„«»‘’"


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Trie:
    """Terms as nested nodes: letter -> node, and under the empty string the number of edits that the term allows."""

    def __init__(self, terms):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = edits_allowed(len(term))


class Automaton:
    """The Levenshtein automaton of a word, up to `most` edits. A state is a tuple of bit sets, one for each number of
    edits, of the places in the word that may have been reached."""

    def __init__(self, word: str, most: int):
        self.size, self.most = len(word), most
        self.at: dict[str, int] = {}
        for i, c in enumerate(word):
            self.at[c] = self.at.get(c, 0) | 1 << i
        self.full = (1 << len(word) + 1) - 1
        self.start = self._skips([1] + [0] * most)

    def _skips(self, sets: list[int]) -> tuple[int, ...]:
        for e in range(self.most):  # letters of the word that the term lacks
            sets[e + 1] |= sets[e] << 1 & self.full
        return tuple(sets)

    def step(self, state: tuple[int, ...], letter: str) -> tuple[int, ...]:
        same = self.at.get(letter, 0)
        sets = [(s & same) << 1 for s in state]
        for e in range(self.most):
            sets[e + 1] |= state[e] | state[e] << 1 & self.full  # a letter too many in the term, or another one
        return self._skips(sets)

    def edits(self, state: tuple[int, ...]) -> int | None:
        return next((e for e, s in enumerate(state) if s >> self.size & 1), None)


def nearest(word: str, trie: Trie, most: int = 2) -> int | None:
    """The fewest edits from word to a term that allows as many; None if there is none."""
    automaton = Automaton(word, most)
    best, stack = None, [(trie.root, automaton.start)]
    while stack:
        node, state = stack.pop()
        for letter, below in node.items():
            if letter == "":
                e = automaton.edits(state)
                if e is not None and e <= below and (best is None or e < best):
                    best = e
            elif any(now := automaton.step(state, letter)):
                stack.append((below, now))
    return best


class Parts:
    """A quick test that no word within reach of a term fails. Of the two halves of a term that allows one edit, or the
    three thirds of one that allows two, some part is without edit: at the word's start, at its end, or, as the middle
    third, moved by one place at most, for else two edits lie on one side of it and the other end is whole."""

    def __init__(self, terms):
        self.starts, self.ends, self.middles = set(), set(), {}
        for t in terms:
            n = len(t)
            if edits_allowed(n) == 1:
                self.starts.add(t[: n // 2])
                self.ends.add(t[n // 2 :])
            elif edits_allowed(n) == 2:
                a, b = n // 3, n - n // 3
                self.starts.add(t[:a])
                self.ends.add(t[b:])
                self.middles.setdefault((a, b), set()).add(t[a:b])
        self.start_sizes, self.end_sizes = sorted(set(map(len, self.starts))), sorted(set(map(len, self.ends)))

    def may(self, word: str) -> bool:
        starts, ends = self.starts, self.ends
        for n in self.start_sizes:
            if word[:n] in starts:
                return True
        for n in self.end_sizes:
            if word[-n:] in ends:
                return True
        for (a, b), some in self.middles.items():
            if word[a:b] in some or word[a - 1 : b - 1] in some or word[a + 1 : b + 1] in some:
                return True
        return False


#: What is stripped before and after a word; the signs that stand for letters stay, but for a closing "!".
EDGES = "\"“”„«»‘’'.,;:?()[]{}<>|*%&#=+-_~^/\\`…"


class Lexicon:
    """terms and stems, and what a raw word comes to: -1 nothing, else an index of KINDS. sure: those terms whose
    misspellings count as near; those of all others are faint."""

    def __init__(self, terms=(), stems=(), sure=()):
        self.terms, self.stems, sure = frozenset(terms) | set(INSULTS), frozenset(stems), frozenset(sure) | set(INSULTS)
        self.tries = [(k, Trie(some), Parts(some)) for k, some in ((1, sure), (3, self.terms - sure)) if some]
        self.stem_sizes = sorted(set(map(len, self.stems)))
        self.longest = max(map(len, self.terms), default=0) + 2
        self.kind = Remembered(self._kind)
        some = [parts for _, _, parts in self.tries]
        either = lambda names: "(?:" + "|".join(map(re.escape, sorted(names))) + ")"
        edge = f"[{re.escape(EDGES)}!]*"
        begins = self.stems | {t for t in self.terms if not edits_allowed(len(t))} | set().union(*(p.starts for p in some))
        others = []
        if ends := set().union(*(p.ends for p in some)):
            others.append(f"{either(ends)}{edge}$")
        if middles := set().union(*(m for p in some for m in p.middles.values())):
            others.append(either(middles))
        #: What every word holds that comes to anything: a quick test in one pass.
        self.possible = "|".join([f"^{edge}{either(begins)}", "[0-9@$!]", *others])

    def kinds(self, words: pa.Array) -> np.ndarray:
        """What each of the words comes to."""
        found = np.full(len(words), -1, np.int8)
        may = np.flatnonzero(pc.match_substring_regex(words, self.possible).to_numpy(zero_copy_only=False))
        if len(may):
            found[may] = np.fromiter(map(self.kind.__getitem__, words.take(pa.array(may)).to_pylist()), np.int8, len(may))
        return found

    def _kind(self, raw: str) -> int:
        word = raw.lstrip(EDGES).rstrip(EDGES + "!")
        if not word:
            return -1
        if word in self.terms:
            return 0
        for n in self.stem_sizes:
            if word[:n] in self.stems:
                return 2
        plain = word if word.isalpha() else word.translate(LOOKALIKES)
        n = len(plain)
        if n < 4 or n > self.longest:
            return -1
        if plain in self.terms:
            return 1
        if n > 4:
            for k, trie, parts in self.tries:
                if parts.may(plain) and nearest(plain, trie, 2 if n > 6 else 1) is not None:
                    return k
        return -1


def windows(words: list[str], hits: list[int]) -> list[bool]:
    """For each hit, whether it is quoted: an odd number of quotation marks stands open before it in the window and one
    closes after it, or a verb of saying stands just before it."""
    out = []
    for i in hits:
        before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
        own = words[i]
        opens = sum(w[0] in QUOTES for w in before if w) - sum(w.rstrip(".,;:!?")[-1:] in QUOTES and w[-1:] != "" for w in before if len(w) > 1)
        closes = any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after if w)
        inside = (own[:1] in QUOTES and (own.rstrip(".,;:!?")[-1:] in QUOTES or closes)) or (opens > 0 and (closes or own.rstrip(".,;:!?")[-1:] in QUOTES))
        said = any(w.strip(QUOTES + ".,;:!?") in SAYING for w in before[-2:])
        out.append(bool(inside or said))
    return out


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row for each text: 1, log counts of abuse and quotation of each kind, and the log share of abuse among words."""
    split = Split(texts, lower=True)
    found = np.zeros((len(split), len(PRIOR)))
    kinds = lexicon.kinds(split.words)[split.codes]
    hits = np.flatnonzero(kinds >= 0)
    if len(hits):
        owners = np.searchsorted(split.edges, hits, side="right") - 1
        begins, ends = np.maximum(split.edges[owners], hits - WINDOW), np.minimum(split.edges[owners + 1], hits + 1 + WINDOW)
        for hit, owner, a, b in zip(hits.tolist(), owners.tolist(), begins.tolist(), ends.tolist(), strict=True):
            around = split.words.take(pa.array(split.codes[a:b])).to_pylist()
            found[owner, 1 + 2 * kinds[hit] + windows(around, [hit - a])[0]] += 1
        abuse = found[:, 1:-1:2].sum(axis=1)
        found[:, -1] = np.log2(1 + 100 * abuse / np.maximum(1, split.counts))
        found[:, 1:-1] = np.log2(1 + found[:, 1:-1])
    found[:, 0] = 1
    return found


def learn_lexicon(sample: DataFrame, folder: str) -> tuple[list[str], list[str], list[str]]:
    """Terms, stems and sure terms of labelled rows (text, toxic): all that pass the test, which are fewer than the words
    of the sample."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), LETTERS), lambda w: F.length(w) >= STEM_MIN))
    docs = sample.select("toxic", words.alias("words")).where(F.size("words") > 0)
    # copies of a document share, mostly, the least hash of their words: one of them speaks for all
    docs = docs.withColumn("context", F.array_min(F.transform("words", lambda w: F.xxhash64(w)))).dropDuplicates(["toxic", "context"])
    by_word = docs.select((F.col("toxic") == 1).cast("long").alias("yes"), F.explode("words").alias("unit")).groupBy("unit").agg(F.sum("yes").alias("yes"), F.sum(1 - F.col("yes")).alias("no"))
    by_word = written(by_word, folder, "words")
    beginnings = F.transform(F.sequence(F.lit(STEM_MIN), F.least(F.lit(STEM_MAX), F.length("unit") - 1)), lambda n: F.substring("unit", F.lit(1), n))
    by_stem = by_word.where(F.length("unit") > STEM_MIN).select(F.explode(beginnings).alias("unit"), "yes", "no").groupBy("unit").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    totals = {r["toxic"]: r["count"] for r in docs.groupBy("toxic").count().collect()}
    toxic, others = totals.get(1, 0), totals.get(0, 0)
    if not toxic:
        return [], [], []
    # so many toxic contexts in a row that not one unit of as many would get there by chance; a stem, which stands for
    # words not seen, needs half as many more
    n_units = max(2, by_word.count())
    least = max(MIN_CONTEXTS, math.ceil(math.log(n_units) / -math.log(min(0.9, (toxic + 1) / (toxic + others + 2)))))
    lift = (F.col("yes") / F.lit(float(toxic))) / ((F.col("no") + 0.5) / F.lit(float(others + 1)))
    gain = F.col("yes") * F.log(lift)
    found = {}
    for kind, counts, needed in (("word", by_word, least), ("stem", by_stem, least + least // 2)):
        rows = counts.where((F.col("yes") >= needed) & (lift >= MIN_LIFT)).withColumn("gain", gain)
        found[kind] = rows.orderBy(F.col("gain").desc(), "unit").collect()
    words = {r["unit"]: r["yes"] for r in found["word"]}
    said_by: dict[str, int] = {}  # by beginning, the contexts of its most frequent word
    for w, n in words.items():
        for k in range(STEM_MIN, min(STEM_MAX, len(w)) + 1):
            said_by[w[:k]] = max(said_by.get(w[:k], 0), n)
    stems, beginnings_of_stems = set(), set()
    for r in found["stem"]:  # of stems that begin alike the one that tells most; one that is but a part of a word says no more than it
        s = r["unit"]
        begins = {s[:k] for k in range(STEM_MIN, len(s) + 1)}
        if not begins & stems and s not in beginnings_of_stems and said_by.get(s, 0) < 0.8 * r["yes"]:
            stems.add(s)
            beginnings_of_stems |= begins
    terms = [w for w in words if not any(w[:k] in stems for k in range(STEM_MIN, STEM_MAX + 1))]
    sure = {r["unit"] for r in found["word"] if r["no"] <= MAX_OTHERS * r["yes"]}
    return terms, sorted(stems), [w for w in terms if w in sure]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 2.0) -> np.ndarray:
    """Logistic weights, drawn towards PRIOR, by Newton's method with halved steps."""

    def loss(w):
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + strength / 2 * ((w - PRIOR) ** 2).sum())

    w = PRIOR.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + strength * (w - PRIOR)
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + strength * np.eye(len(w)), gradient)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    def __init__(self, lexicon: tuple[list[str], ...], weights: np.ndarray):
        self.lexicon, self.weights = Lexicon(*lexicon), weights

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(texts, self.lexicon) @ self.weights, -30, 30)))


def train(spark, docs: DataFrame, labels: DataFrame) -> tuple[tuple[list[str], ...], np.ndarray]:
    """docs (doc_id, text) and labels (doc_id, toxic); learns from rows of another fold than the first only."""
    usable = docs.where(fold(5) != 0).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample, counts = labelled_sample(usable, labels.where(fold(5) != 0), "toxic", SAMPLE_ROWS)
    folder = shared_folder(spark)
    sample = written(sample, folder, "sample")
    learned = learn_lexicon(sample, folder)
    sent = spark.sparkContext.broadcast(learned)

    def compute(batches):
        lexicon = Lexicon(*sent.value)
        for batch in batches:
            for part in slices(batch, 4096, BATCH_BYTES):
                rows = list(features(part.column("text"), lexicon))
                yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.float64()), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    got = sample.select("text", "toxic").mapInArrow(giving_back(compute), "toxic double, x array<double>").groupBy("toxic", "x").count().collect()
    x, y, n = (np.array([r[c] for r in got], float) for c in ("x", "toxic", "count"))
    if not got:
        return learned, PRIOR
    # back to the classes' own shares
    taken = {v: max(1.0, n[y == v].sum()) for v in (0, 1)}
    weight = n * np.array([counts[int(v)] / taken[int(v)] for v in y])
    return learned, fit(x, y, weight * n.sum() / weight.sum())


def score(spark, docs: DataFrame, model, name: str = "toxicity") -> DataFrame:
    """docs with a column of scores. model: what train() gives."""
    sent = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]

    def compute(batches):
        scorer = Scorer(*sent.value)
        for batch in batches:
            for part in slices(batch, 4096, BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(scorer(part.column("text")), pa.float64())], [*kept, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema) + f", `{name}` double"
    return docs.select(kept).mapInArrow(giving_back(compute), schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) as doc_id", "text")
    model = train(spark, docs, table(spark, sf_dir, "labels"))
    scored = score(spark, docs, model, "score")
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
