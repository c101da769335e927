"""Cutting texts into pieces that tokenizers treat independently, and looking each different piece up once."""

from __future__ import annotations

import ctypes
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space, stated because neither Python's nor a tokenizer library's own \s need be the same set.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space with the run that follows it: no pre-token of a byte-level tokenizer reaches over the end of one.
CHUNKS = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")


class Remembered(dict):
    """make(key) by key. Forgets all when its keys together hold most characters, so memory is bounded and results are
    the same."""

    def __init__(self, make, most: int = 4_000_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.held = make, most, longest, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            self.held += len(key) + 8
            if self.held > self.most:
                self.clear()
                self.held = len(key) + 8
            self[key] = value
        return value


def giving_back(compute):
    """compute, which makes batches of batches, so that at its end the memory it has freed goes back to the machine: a
    Python worker stays for tasks of later stages, and what it keeps would add to theirs."""

    def run(batches):
        yield from compute(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
            trim(0)

    return run


def slices(batch, rows: int = 256, size: int | None = None, column: str = "text"):
    """A record batch in short runs of rows, so that only a few texts exist as Python objects at a time. With a size,
    a run also ends once its texts hold that many bytes, one text at least."""
    if size is None:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = lengths[at - 1] if at else 0
        n = min(rows, max(1, int(np.searchsorted(lengths, before + size, side="right")) - at))
        yield batch.slice(at, n)
        at += n


class Split:
    """The words of texts: `words`, each different one once; `codes`, which of these stands at each place; `edges`,
    where each text's places begin, and the end of the last one's."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts) if lower else texts)
        coded = lists.flatten().dictionary_encode()
        self.words, codes = coded.dictionary, coded.indices.to_numpy()
        edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        empty = pc.index(self.words, "").as_py()
        if empty >= 0:  # white space at either end of a text leaves an empty word there
            real = codes != empty
            edges = np.concatenate([[0], np.cumsum(real)])[edges]
            codes = codes[real]
        self.codes, self.edges = codes, edges

    def __len__(self) -> int:
        return len(self.edges) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.edges)

    def sums(self, of_places: np.ndarray) -> np.ndarray:
        """A sum for each text over numbers that stand at its places."""
        if not len(self):
            return of_places[:0]
        # a place more, so that texts without words at the end begin somewhere
        found = np.add.reduceat(np.append(of_places, of_places.dtype.type(0)), self.edges[:-1])
        return np.where(self.counts > 0, found, 0)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs one after the other: starts[0], starts[0] + 1, ..., then those of the next run."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))
