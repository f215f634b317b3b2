"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Every stage works on all that the one
before it kept, and tolerates nulls in any column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayforge.llm import language_id, near_dedup, packing, quality, substring_dedup
from assayforge.llm.common import DOCUMENT_COLUMNS, checkpointed, spread

#: Least share of letters that the predicted language must have.
LANGUAGE_SHARE = 0.5
#: Least quality score that stays: what the classifier counts as good.
QUALITY = quality.GOOD


def gathered(docs: DataFrame, *parts: DataFrame) -> DataFrame:
    """The rows of all ``parts``, made from ``docs``, each in as many partitions as the rows of ``docs`` need."""
    files = spread(docs.sparkSession, docs.count())
    return reduce(DataFrame.unionByName, (p.select(*DOCUMENT_COLUMNS).coalesce(files) for p in parts))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language has at least half of their letters; ``lang``
    is the prediction. Texts that are null or have no letter go; each row is judged by its own text."""
    found = language_id.annotate(docs.select(*DOCUMENT_COLUMNS), language_id.train(docs))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE))
    return gathered(docs, kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars"))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good, each row judged by its own text;
    null and empty texts are scored like any other."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return gathered(docs, quality.annotate(docs.select(*DOCUMENT_COLUMNS), model).where(F.col("score") >= QUALITY))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class.

    Equal rows of one id stay once; of different texts with one id each stays, as
    they are one document to the operator. Rows without an id stay, null texts are
    classes of their own.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    classes = near_dedup.near_duplicates(docs).where("doc_id = class_id").select("doc_id").distinct()
    # The window needs the rows as the join deals them out, and no further exchange.
    once = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("source", "lang", "n_chars"))
    kept = docs.join(classes.hint("merge"), "doc_id", "left_semi").withColumn("once", once).where("once = 1")
    return gathered(docs, kept, docs.where("doc_id is null"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words that stand earlier; those left without words go.

    A document that loses nothing keeps its text as it is; each row gives one row at
    most, rows of one id too; null and empty texts go; rows without an id stay.
    """
    known = docs.where("doc_id is not null")
    kept = substring_dedup.remove_repeats(known, as_is=True, more=("lang", "source", "n_chars")).where("n_words > n_removed")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    out = kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))
    return gathered(docs, out, docs.where("doc_id is null"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("best_fit_packing", pack_sequences),
]

#: Learned models and alignment are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
