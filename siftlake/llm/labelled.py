"""Labelled rows: the split into training and held-out documents, and a bounded training sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classifiers are fitted on at most so many labelled rows.
MAX_LABELLED = 20_000
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's decimal text is divisible by FOLDS. A null id counts as the empty text: held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_labels(labels: DataFrame, label: str, most: int = MAX_LABELLED) -> DataFrame:
    """label_id, label (0 or 1) of at most `most` training rows: those whose ids have the least hashes.

    Left out: held-out rows and null ids or labels. An id with several labels has their largest.
    """
    rows = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter("label_id is not null and label is not null").filter(~held_out(F.col("label_id")))
    rows = rows.groupBy("label_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("label_id"), "label_id").limit(most)


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that `training_labels` has a label for. labels is bounded, so it is broadcast."""
    return docs.join(F.broadcast(labels), docs["doc_id"] == labels["label_id"]).drop("label_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
