"""A training corpus in five stages, each one operator: `run(spark, sf_dir)`."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from promptledger.llm import jaccard, mixing, packing, secrets, toxicity
from promptledger.llm.queries import SHARES
from promptledger.session import use_checkpoint_dir


#: Characters in a block of the mixture.
BLOCK_CHARS = mixing.BLOCK_CHARS


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject, with all columns, whatever their names.

    Null and empty texts have the base rates of the models and stay; repeated rows stay or go together; an empty
    table stays empty.
    """
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard 0.75 or more.

    Texts without words are nobody's copy, one stays per id; of repeated rows one stays; ties go to the smallest
    id. Rows without an id stay. All columns are kept; an empty table stays empty.
    """
    return jaccard.first_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, row by row, with secrets in their texts replaced by a mark and `n_chars` set anew.

    Null texts stay null; other columns pass through; an empty table stays empty.
    """
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture, which the files they are written to keep.

    No row is dropped or repeated; null sources belong to the lane of all others, null and empty texts have length
    0, and equal rows lie where they fall. All columns but those named `mix_...` by the operator are kept; an empty
    table stays empty.
    """
    placed = mixing.mix(docs, SHARES, block_chars=BLOCK_CHARS)
    order = ["mix_slot", "mix_lane", "mix_at", "doc_id"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; bins follow the order of the rows in the files.

    The mixture wrote its rows in order, one file after the other, so a run of rows of a file has the mixture's
    shares and is packed by itself. A table that is read from no file has no order: its rows are dealt by hash. Null
    and empty texts take an end mark, repeated rows go to different bins; an empty table gives no rows.
    """
    try:
        place = docs.metadataColumn("_metadata")
        rows = docs.select("doc_id", "source", "text", place["file_name"].alias("file"), place["row_index"].alias("place"))
    except AnalysisException:
        return packing.pack(docs)
    return packing.pack(rows, order=("file", "place"))


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: Classifier, near duplicates and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`; each but the last is written to the shared folder and reread."""
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
