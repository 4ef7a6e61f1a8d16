"""From raw documents to token ids: toxic documents go, near duplicates go but one, repeated passages are cut,
sources are mixed to their target weights, and the texts are encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. Between stages the rows
are written as Parquet in the shared folder and read again. Stages but the last return the columns of documents.

Every stage takes nulls in any column (a null text is an empty one), texts of any length, rows that repeat id or text, and
an empty table, which gives an empty one. Columns of other names pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlake.llm.bpe import digest_documents
from siftlake.llm.mixing import mixed_rows
from siftlake.llm.near_dedup import drop_near_duplicates
from siftlake.llm.suffix_dedup import drop_repeated_passages
from siftlake.llm.toxicity import drop_toxic
from siftlake.storage import Workspace, read_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under 0.5, by a network fitted on labelled rows of docs. Empty texts stay."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the least doc_id (null is least). All empty texts are one class."""
    return drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; passages of at least 50 words that an earlier document holds are cut from text."""
    return drop_repeated_passages(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often (0 to 3 times) as the mix of sources takes them; null is a source. Reruns agree."""
    return mixed_rows(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every row. Empty texts have no ids."""
    return digest_documents(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

#: The network's decisions cannot be expressed in SQL; tests/llm holds run() against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), name)
        if at:
            work.drop(STAGES[at - 1][0])
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
