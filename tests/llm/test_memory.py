"""What Python workers hold at most, and what they keep for later tasks."""

from __future__ import annotations

import random
import re
import tracemalloc
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from barline.llm import packing, simhash, toxicity
from barline.llm._words import giving_back


def test_joined_ids_take_little_beside_them_and_equal_the_library():
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(6)
    vocabulary = ["the", "cat", "sat.", "don't", "incomprehensibilities!", "Ünder"]
    texts = [" ".join(rng.choices(vocabulary, k=n)) for n in (1, 150_000, 70_000, 0, 300_000, 3)]
    encode = packing.WordIds(path)
    encode(pa.array(vocabulary))
    tracemalloc.start()
    ids, edges = encode(pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * 520_004  # bytes a word
    tokenizer = Tokenizer.from_file(path)
    for t, a, b in zip(texts, edges[:-1], edges[1:], strict=True):
        assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def held() -> float:
    """MB of this process without mapped files."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_workers_give_freed_memory_back():
    kept = []

    def compute(batches):
        some = [bytearray(b"x" * 100_000) for _ in range(2000)]
        kept.append(bytearray(b"x" * 100_000))  # above the others, so that these aren't given back by themselves
        yield from batches
        del some

    before = held()
    assert list(giving_back(compute)([1, 2])) == [1, 2]
    assert held() - before < 50


@pytest.mark.parametrize("module", [packing, simhash, toxicity])
def test_operators_of_the_pipeline_give_memory_back(module):
    text = Path(module.__file__).read_text()
    assert text.count("mapInArrow(") == text.count("mapInArrow(giving_back(") > 0
