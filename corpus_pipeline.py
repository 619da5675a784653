"""A training corpus from ``documents`` in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and is written as Parquet before the
next one reads it. All but the last return the columns of ``documents``:

1. ``quality``: rows that the quality rules reject go;
2. ``near_dedup``: one row of each near-duplicate group stays;
3. ``decontamination``: rows that hold an item of ``benchmark`` go;
4. ``secrets``: secrets are replaced in the texts, no row goes;
5. ``packing``: a row per piece of the packed sequences.

Nulls and odd rows, in every stage: a null or empty text fails the quality
rules, so none gets past the first stage; a null id, language or source is kept
as it is; of rows repeated in full near_dedup leaves one, of equal or near equal
texts the row with the least ``doc_id`` (a null id before any other); very long
texts are handled whole and only packing cuts them; extra columns are carried
through to the last stage, whatever their names; an empty ``documents`` gives an
empty result, and an empty ``benchmark`` removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontamination, packing, quality, secrets, shared, simhash, tokens


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the covariance estimate of their language and source accept."""
    return quality.accepted(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group at Jaccard 0.8 on five words."""
    return simhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window at 0.8 to an item of ``benchmark``."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean(docs, benchmark)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret in ``text`` replaced and ``n_chars`` counted again."""
    found = secrets.redacted(docs)
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of at most 4096 ids: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return packing.pack(docs, tokens.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't express the forest, the covariance steps or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name, texts=True)
        if before is not None:
            shared.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
