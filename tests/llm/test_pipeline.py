"""The pipeline against its stages done by brute force on a small corpus."""

from __future__ import annotations

import random

import public_tokenizers

import corpus_pipeline
from barline.llm import packing

from .data import CLASHING, edges, saved, sentence
from .test_operators import slow_base, slow_components, slow_fingerprint


def corpus() -> list[tuple]:
    rng, rows = random.Random(8), []
    for i in range(80):
        text = sentence(rng, "en", rng.randint(20, 60))
        if i % 8 == 1:
            text += " you idiot and worthless moron"
        if i % 8 == 2:
            text += f" mail jane{i}@example.com or +1 (243) 555-55{10 + i}"
        if i % 8 == 3 and i > 8:
            text = rows[i - 8][1]
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 4}", len(text)))
    return rows


def test_stages(spark, tmp_path):
    rows = corpus()
    sf_dir = saved(spark, tmp_path / "sf", rows, [(r[0], 1, int("idiot" in r[1])) for r in rows])
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / f"{k}"))
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    clean = [r for r in rows if "idiot" not in r[1]]
    assert sorted(r["doc_id"] for r in seen["toxicity"]) == [r[0] for r in clean]
    groups = slow_components([(r[0], slow_fingerprint(r[1], 5)) for r in clean])
    kept = sorted(r[0] for r, g in zip(clean, groups, strict=True) if r[0] == g)
    assert sorted(r["doc_id"] for r in seen["simhash_near_dedup"]) == kept
    texts = {r[0]: r[1] for r in rows}
    assert sorted(r["doc_id"] for r in seen["pii"]) == kept
    for r in seen["pii"]:
        assert not slow_base(r["text"]) and r["n_chars"] == len(r["text"])
        assert slow_base(texts[r["doc_id"]]) or r["text"] == texts[r["doc_id"]]
    words = {r["doc_id"]: len(r["text"].split()) for r in seen["pii"]}
    assert {r["doc_id"] for r in seen["mixing"]} <= set(kept)
    total = sum(words[r["doc_id"]] for r in seen["mixing"])
    assert abs(total - sum(words.values())) <= 60 * len({r[3] for r in rows})
    packed = seen["best_fit_packing"]
    assert sorted(r["doc_id"] for r in packed if r["piece"] == 0) == sorted(r["doc_id"] for r in seen["mixing"])


def test_run_on_edges_and_nothing(spark, tmp_path):
    for name, rows in (("edges", [*edges(), (None, "no id", None, None, None)]), ("none", [])):
        sf_dir = saved(spark, tmp_path / name, rows, [], extra=True)
        got = corpus_pipeline.run(spark, sf_dir)
        assert "sequence_id" in got.columns
        # whole documents, none more than three times
        pieces = packing.pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")).count()
        assert got.count() <= 3 * pieces


def test_stages_leave_other_columns_alone(spark, tmp_path):
    sf_dir = saved(spark, tmp_path / "sf", corpus()[:20], [], extra=True)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / f"{k}"))
        docs = spark.read.parquet(path)
        assert docs.count() and all(r[c] == c for r in docs.collect() for c in CLASHING)
