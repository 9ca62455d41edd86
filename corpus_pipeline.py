"""A corpus pipeline: documents to packed sequences in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. Stages but the last return
the columns of ``docs``. ``run`` writes each stage's result as Parquet into the shared folder and rereads it.
Null texts count as empty and stay; rows with a null ``doc_id`` stay until packing, which takes them, too. Empty
tables pass through; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm import decontaminate, neardup, pii, tokens, toxicity
from loglake.llm.shared import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; the model learns from the labelled ones among ``docs``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    machine = toxicity.train(docs, labels)
    return toxicity.keep_mild(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group; rows that repeat an id and its text stay once, other texts of an id stay."""
    return neardup.keep_one_of_each(docs, neardup.SHINGLE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew."""
    return pii.mask_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return tokens.pieces_digest(tokens.pack(docs, tokens.tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]
#: No SQL: a trained model decides the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; every result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", compression="zstd")
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query."""
    return run(spark, sf_dir)


def pipeline_oracle() -> dict[str, str]:
    """SQL for the pipeline, if SQL can express it."""
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
