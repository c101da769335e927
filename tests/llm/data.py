"""Small tables for the operators' tests."""

from __future__ import annotations

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves.
CLASHING = ("score", "size", "target", "fp", "piece", "spans", "sketch", "length", "_key", "toxic", "rank", "position", "pass", "taken")

WORDS = {
    "en": "the of and that erst anion shore wharf edly tion ing heath oner".split(),
    "fr": "le la de que éreau ouère tion elle eux ière dans mentré".split(),
    "de": "der die und ung keit schaft ächt über ein lich zwar".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def plain(n: int = 60, seed: int = 1) -> list[tuple]:
    """Documents of three languages from a source that holds half of them and a few others, with copies."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        text = sentence(rng, lang, rng.randint(5, 80))
        if i % 10 == 9:
            text = rows[i - 3][1]
        rows.append((i, text, lang, "hot" if i % 2 else f"s{i % 5}", len(text)))
    return rows


def edges() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 700}" for i in range(30_000))
    return [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, "   \n\t ", None, None, 5),
        (4, "one", "en", None, 3),
        (5, long, "en", "a", len(long)),
        (6, "x" * 50_000, None, "b", 50_000),
        (7, "same text in two rows of seven words", "en", "b", 1),
        (7, "same text in two rows of seven words", "en", "b", 1),
        (8, "Same  text in two rows of seven words", "fr", "c", 1),
        (9, "𝔘nicode 😀 text, é and   spaces too", "de", "c", 9),
        (10, "1 2 3 4 5 6 7 8 9 " * 400, None, "c", 1),
    ]


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", *(f"'{c}' AS `{c}`" for c in CLASHING))
    return df


def saved(spark, folder, rows, labels=(), extra: bool = False) -> str:
    """A directory of tables as queries read them."""
    frame(spark, rows, extra).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
