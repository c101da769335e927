"""Choosing bounded, documented samples of labelled rows to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, by a modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def hash_share(key: str = "doc_id") -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sample_by_class(labelled: DataFrame, label: str, rows_per_class: int) -> tuple[DataFrame, dict]:
    """Rows of each class whose hash share is below what keeps about rows_per_class of it; and the classes' counts."""
    counts = {r[label]: r["count"] for r in labelled.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, rows_per_class / n))).otherwise(share)
    return labelled.where(hash_share() < share), counts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int) -> tuple[DataFrame, dict]:
    """Rows of docs with a label 0 or 1, about rows_per_class of each; and the labels' counts.

    The sample is drawn from the labels, without any text, so that its few thousand rows meet the documents where these
    lie: the documents aren't shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", label)
    drawn, counts = sample_by_class(known, label, rows_per_class)
    bounded = drawn.orderBy(hash_share(), "doc_id", label).limit(4 * rows_per_class)
    return docs.join(F.broadcast(bounded), "doc_id"), counts
