"""The corpus pipeline: filter, deduplicate and pack the documents, one stage after another.

Each stage takes the documents its predecessor kept, with all their columns, and all but
the last give documents of the same columns; ``n_chars`` follows the text. ``run`` writes
what a stage gives as Parquet in the shared folder and reads it for the next one.

Rows that repeat doc_id and text go through the first stages alike; the near-duplicate stage
leaves one of them. A row whose doc_id or text is null goes through every stage (a null text is empty text);
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglens.llm.classifier import classify
from loglens.llm.common import rewritten
from loglens.llm.line_dedup import line_dedup
from loglens.llm.near_dedup import near_classes
from loglens.llm.packing import pack
from loglens.llm.queries import ROOT, tokenizer_file
from loglens.llm.suffix_dedup import suffix_dedup
from loglens.session import store_table

ORACLE_SQL = None  # the stages have no SQL form; tests hold them against their operators' definitions


def _without(docs: DataFrame, gone: DataFrame, name: str, key) -> DataFrame:
    """Rows of the documents whose doc_id and text are not among those to go."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col(name).alias("gone_key")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (key == F.col("gone_key"))
    return docs.join(gone, same, "left_anti")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = classify(docs, labels).filter("rejected")
    return _without(docs, judged, "text_key", F.xxhash64(_text()))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go."""
    return rewritten(docs, line_dedup(docs, texts=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, and one row of it.

    Both are decided by doc_id and text digest, so the documents are dealt by them once: of rows
    alike the one whose other columns hash least goes on (a task sends one of them), and the rows
    that stand for another document go where they arrive."""
    key = ["one_id", "one_digest"]
    copies = near_classes(docs).filter(~F.col("doc_id").eqNullSafe(F.col("class_id")))
    gone = copies.select(_name(F.col("doc_id")).alias(key[0]), F.unhex("text_digest").alias(key[1])).distinct()
    named = docs.withColumns({key[0]: _name(F.col("doc_id")), key[1]: F.unhex(F.sha2(_text(), 256))})
    rest = Window.partitionBy(*key).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    single = named.withColumn("one_place", F.row_number().over(rest)).filter("one_place = 1")
    # An anti join would sink below the window and its first cut.
    told = single.join(gone.withColumn("one_gone", F.lit(True)), key, "left").filter("one_gone IS NULL")
    return told.select(*(F.col(f"`{c}`") for c in docs.columns))


def _name(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long").cast("string"), F.lit("null"))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that an earlier place has go."""
    return rewritten(docs, suffix_dedup(docs, texts=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of ids."""
    return pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
