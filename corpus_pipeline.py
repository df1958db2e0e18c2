"""The corpus pipeline: rate, drop repeated lines, keep one of each near-duplicate group, decontaminate, mix.

Every stage takes (spark, docs, sf_dir) and returns documents; run() writes each stage's rows to the shared folder and hands the
reread table to the next. All but the last return the columns of documents; mixing adds domain, n_tokens and epoch.
A document whose text is rewritten keeps doc_id, lang and source; n_chars follows the text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table
from tidemark.llm.decontaminate import contamination
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import WEIGHTS, mix
from tidemark.llm.ordinal_quality import graded, rate, train
from tidemark.llm.superminhash import near_duplicates


KEY = "_key"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _key: the doc_id, or for rows without one a hash of the text, so that equal texts without an id are one document."""
    return docs.withColumn(KEY, F.coalesce(F.col("doc_id"), F.xxhash64(F.lit("no id"), "text")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Keyed docs but those whose _key is a doc_id of gone."""
    return docs.join(gone.select(F.col("doc_id").alias(KEY)).distinct(), KEY, "left_anti").drop(KEY)


def by_key(docs: DataFrame) -> DataFrame:
    """What the operators read of keyed docs."""
    return docs.select(F.col(KEY).alias("doc_id"), "text")


def single(docs: DataFrame) -> DataFrame:
    """Keyed docs with one row of each (_key, text); only rows that are repeated meet in a shuffle."""
    again = docs.groupBy(KEY, F.xxhash64("text").alias("_text")).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(KEY).distinct()
    return docs.join(again, KEY, "left_anti").unionByName(docs.join(again, KEY, "left_semi").dropDuplicates([KEY, "text"]))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row's other columns as one, so that no operator's column names can clash with theirs."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"others.`{c}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is good with enough probability; the model is fitted on the graded documents of the labels table."""
    model = train(docs, graded(table(spark, sf_dir, "labels")))
    return unpacked(rate(packed(docs), model).where("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars follows a changed text."""
    out = dedup_lines(packed(docs))
    new = unpacked(out.withColumn("others", F.when(F.col("n_dropped") > 0, F.col("others").withField("n_chars", F.length("text").cast("long"))).otherwise(F.col("others"))), docs)
    return new if "n_chars" in docs.columns else unpacked(out, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one of equal rows; the rest go. Documents without an id are told apart by their texts."""
    docs = single(keyed(docs))
    return without(docs, near_duplicates(by_key(docs)).where("not kept")).select(*[f"`{c}`" for c in docs.columns if c != KEY])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    docs = keyed(docs)
    return without(docs, contamination(by_key(docs), table(spark, sf_dir, "benchmark")).where("contaminated")).select(*[f"`{c}`" for c in docs.columns if c != KEY])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mixture: rows by epoch, to the tree's target weights."""
    return mix(docs, WEIGHTS)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("decontaminated", decontaminated), ("mixed", mixed)]
ORACLE_SQL = None  # trained weights and near-duplicate verification have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
