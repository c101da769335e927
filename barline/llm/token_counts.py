"""Token counts by the whole-token shortcut.

Offline, each vocabulary string is encoded once: those that come out as the one token they are need never be merged
again. A text falls into chunks that begin at white space, and these into pre-tokens; a pre-token that is such a whole
token counts one, and only the others are merged. Special strings are left to the library, in the chunk they stand in.

Defined cases: a null or empty text has 0 tokens and 0 bytes; texts of any length are counted whole; repeated rows are
counted each; an empty table gives an empty result; a null id stays null;
other columns are ignored.
"""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from ._tables import table
from ._words import CHUNKS, Remembered, slices

LIMIT = 512
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def whole_tokens(tokenizer) -> set[str]:
    """The vocabulary strings that the tokenizer encodes, alone, as one token: shown by encoding each."""
    alphabet, texts = byte_alphabet(), []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            texts.append(bytes(alphabet[c] for c in token).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue  # not byte-level, or a part of a character
    return {t for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1}


def merge_ranks(vocabulary: str) -> dict[bytes, int] | None:
    """Rank by token bytes, if the merges of a .json vocabulary make their tokens in the order of ids; else None."""
    model = json.loads(Path(vocabulary).read_text())["model"]
    ids, alphabet = model["vocab"], byte_alphabet()
    made = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return None
    return {bytes(alphabet[c] for c in k): v for k, v in ids.items() if all(c in alphabet for c in k)}


class Counter:
    """Tokens of whole texts, as the tokenizers library counts them."""

    def __init__(self, path: str, whole: set[str], pattern: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = whole
        self.pre_tokens = regex.compile(pattern).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self._library
        if ranks := merge_ranks(path):  # merging by rank comes to the same tokens, with less ado for each call
            self.ordinary = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.merge = lambda pre_token: len(self.ordinary(pre_token))
        self.chunks = Remembered(self._chunk, 8_000_000)

    def _library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> int:
        whole = self.whole
        if chunk in whole:
            return 1
        if chunk[0] == " " and chunk[1:].isalpha():  # a pre-token by itself
            return self.merge(chunk)
        if any(s in chunk for s in self.special):
            return self._library(chunk)
        return sum(1 if t in whole else self.merge(t) for t in self.pre_tokens(chunk))

    def __call__(self, text: str) -> int:
        return sum(map(self.chunks.__getitem__, CHUNKS.findall(text)))


def count_tokens(spark, docs: DataFrame, vocabulary: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each of docs. vocabulary: a byte-level .json file, at the same path
    on every machine; pattern: its pre-token pattern. The whole tokens, at most the vocabulary, are sent to executors."""
    from tokenizers import Tokenizer

    whole = spark.sparkContext.broadcast(whole_tokens(Tokenizer.from_file(vocabulary)))

    def counts(batches):
        counter = Counter(vocabulary, whole.value, pattern)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = [counter(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(counts, SCHEMA)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
