"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import toxicity
from lodestone.llm.common import table
from lodestone.llm.lines import without_near_lines
from lodestone.llm.minhash import near_duplicates
from lodestone.llm.packing import packed
from lodestone.llm.repeats import without_repeats
from lodestone.session import write_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, finds toxic go.  A null text stays."""
    labels = table(spark, sf_dir, "labels", F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    model = toxicity.fit(labels, docs.select(F.col("doc_id").alias("id"), "text"))
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def _with_text(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``docs`` with new texts by id and their length; a document that had a text and lost all of it goes."""
    had = docs.select("doc_id", "lang", "source", (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("had"), F.col("text").isNull().alias("none"))
    joined = had.join(texts.select("doc_id", "text"), "doc_id")
    joined = joined.where("not had or length(text) > 0").withColumn("text", F.when(~F.col("none"), F.col("text")))
    return joined.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose near-duplicate class occurs earlier are taken out; a document of which nothing new is left then goes."""
    return _with_text(docs, without_near_lines(docs).where("n_removed = 0 or n_new > 0"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    kept = near_duplicates(docs).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under 50-byte strings of earlier documents are taken out; what is no longer UTF-8 at a cut goes with them."""
    kept = F.col("kept").cast("string")
    valid = F.when(F.is_valid_utf8(kept), kept).otherwise(F.regexp_replace(F.make_valid_utf8(kept), "\ufffd", ""))
    return _with_text(docs, without_repeats(docs).select("doc_id", valid.alias("text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packed(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup),
    ("minhash near-dedup", minhash_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("packing", packing),
]

# The classifier's weights are learned, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
