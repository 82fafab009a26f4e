"""The corpus pipeline: filter, remove near-duplicates, redact, mix, pack.

Each stage takes `(spark, docs, sf_dir)`, works on all that its predecessor kept, and returns
a DataFrame that is written as Parquet and read again as the next one's docs. All but the
last return the columns of `documents`.

Rows without doc_id go at the first stage; of rows that repeat a doc_id one stays at the
second. Null and empty texts fail the quality rules. Further columns are not carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import minhash, mixing, packing, personal_data, quality_rules
from panelmill.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents that pass the quality rules."""
    verdicts = quality_rules.quality_verdicts(docs, table(spark, sf, "labels"))
    return docs.join(verdicts.where("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    found = minhash.near_duplicates(docs, width=5, percent=80)
    kept = docs.join(found.where("kept").select("doc_id"), "doc_id", "left_semi")
    return kept.dropDuplicates(["doc_id"]).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return personal_data.redacted(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    copies = mixing.mixed(docs).select(F.col("doc_id").alias("id"), "copies").where("copies > 0")
    taken = docs.join(copies, F.col("doc_id") == F.col("id"))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """The pieces of all documents with their ids and their places in sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("personal_data", redact),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: Personal-data spans from the trained classifier and tokenizer ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order, applied to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
