"""A corpus pipeline: rejects toxic documents, keeps one of each group of near copies, masks personal data, mixes
sources to target weights and packs what is left into sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return
the columns of docs. Any cases are those of the operators; a stage's own are in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import mixing, packing, pii, simhash, toxicity
from barline.llm._tables import ROW, drop, has_copies, shared_folder, table, with_row, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what scores as toxic. Learns from labels of documents at hand; without any, the stated lexicon holds."""
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.score(spark, docs, model, "_toxicity").where(F.col("_toxicity") < 0.5).drop("_toxicity")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, a similarity of 0.8 or more): the one of
    the smallest id, rows without an id last. Rows of equal ids but other texts are documents of their own; of rows
    that are alike in every column one stays."""
    return simhash.one_of_each(spark, docs, similarity=0.8)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind. No document goes; n_chars, where there is one, follows the text."""
    marked = pii.personal_data(docs, "_pii_spans")
    out = marked.withColumn("text", F.when(F.col("text").isNotNull(), pii.masked(F.col("text"), F.col("_pii_spans"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in training order. Texts stay whole, also that of the one
    document of a source at which its target ends. Texts without a word cost nothing and stay, at the beginning. Rows
    are told apart by all that they hold, so equal or missing ids lose none."""
    keyed = with_row(docs)
    mixed = mixing.mix(spark, keyed.select("doc_id", "source", "text", *ROW), carry=ROW)
    free = F.array(F.struct(F.lit(0).cast("long").alias("pass"), F.lit(0).cast("long").alias("words"), F.lit(0.0).alias("position")))
    order = mixed.withColumn("placings", F.when(F.col("size") == 0, free).otherwise(F.col("placings")))
    order = order.select(*ROW, F.explode("placings").alias("p")).select(*ROW, F.col("p.position").alias("_position"), F.col("p.pass").alias("_pass"))
    keys = ("_position", *ROW, "_pass")
    out = keyed.dropDuplicates(list(ROW)) if has_copies(keyed) else keyed
    return out.join(order, list(ROW)).repartitionByRange(*keys).sortWithinPartitions(*keys).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and its place there."""
    import public_tokenizers

    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Models, tokenizers and fingerprints are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written to the shared folder and read again as the next one's docs."""
    docs, folder, last = table(spark, sf_dir, "documents"), shared_folder(spark), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
        if last:
            drop(spark, f"{folder}/{last}")
        last = name
    return docs
