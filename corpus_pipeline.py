"""A training corpus from raw documents: reject, dedup lines, dedup documents, mix sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstead.llm import jaccard, lines, mixing, quality
from shopstead.llm.common import stored
from shopstead.llm.queries import encoded_and_decoded

#: No stage before the last changes the columns of documents; the classifier and MinHash have no SQL.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored by the bias alone; repeated rows stay or go
    together; without labels of both classes all stay. An empty table gives an empty result."""
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; so do documents that have nothing left to read for it. Null and blank texts
    stay as they are, as do rows without doc_id; of ties the least (doc_id, line) stays; rows that repeat a doc_id and
    the text lose the same lines. An empty table gives an empty result."""
    kept = lines.dedup_lines(docs).withColumn("empty", ~F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    kept = kept.where(~(F.col("empty") & (F.col("n_dropped") > 0)))
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    cols = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return kept.select(*[cols.get(c, F.col(c)).alias(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least doc_id. Texts without words and rows
    without doc_id stay; rows that repeat a doc_id stay or go together. An empty table gives an empty result."""
    groups = jaccard.ngram_join(docs, width=5, num=80)
    gone = groups.where("doc_id != component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, to the nearest whole document. Texts without words have nothing
    to take and go, as do rows without doc_id; a null source is one of its own. An empty table gives an empty result."""
    mixed = mixing.mix(docs).where("taken > 0")
    times = mixed.select("doc_id", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).where("times > 0").groupBy("doc_id").agg(F.max("times").alias("times"))
    rows = docs.join(times, "doc_id").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the bytes they decode to; a row each, repeats too."""
    return encoded_and_decoded(docs, keep_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k + 1}")
    return docs
