"""The corpus pipeline: stages from raw documents to packed training sequences.

Every stage takes a table with the columns of ``documents`` (others are not looked at) and any
number of rows, none included; all but the last return those columns. Null or empty texts and null
``lang`` or ``source`` are handled by each stage as said there; texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.durable import Scratch
from flowlens.functions.shipping import ship
from flowlens.llm.common import table
from flowlens.llm.jaccard_join import jaccard_components
from flowlens.llm.packing import pack
from flowlens.llm.quality import fit_quality, score_quality
from flowlens.llm.suffix_dedup import remove_repeats
from flowlens.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose strongest window is toxic.

    Rows are judged one by one: repeated rows alike, rows without an id like others. A text
    without words gets the share of toxic labels as its score and so stays where that is below a half.
    """
    network = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, network, COLUMNS).where("predicted = 0").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that both views together call poor.

    Rows are judged one by one, repeated rows and rows without an id included; an empty text is
    judged by its metadata and the text view's answer to no words.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at a similarity of 0.8, keep the smallest doc_id.

    Of rows with one doc_id the smallest by text, lang, source and n_chars stays. Empty texts link
    with nothing, and rows without an id stay as they are.
    """
    parts = jaccard_components(docs, width=5, percent=80)
    gone = parts.where("component_id != doc_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    first = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return kept.join(again, "doc_id", "left_anti").unionByName(first.select("doc_id", "row.*"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out every string of 50 bytes that a document of smaller doc_id has; ``n_chars`` follows the text.

    A null text becomes empty. Rows of one doc_id do not cut each other and take the smallest lang
    and source of theirs; rows without an id stay whole.
    """
    kept = remove_repeats(docs.where("doc_id IS NOT NULL"), length=50, with_text=True).select("doc_id", "text")
    known = docs.groupBy("doc_id").agg(F.min(F.struct("lang", "source")).alias("row"))
    size = F.length("text").cast("long").alias("n_chars")
    cut = kept.join(known, "doc_id").select("doc_id", "text", "row.lang", "row.source", size)
    whole = docs.where("doc_id IS NULL").withColumn("text", F.coalesce("text", F.lit("")))
    return cut.unionByName(whole.select("doc_id", "text", "lang", "source", size))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences, one row per piece.

    A null or empty text is a document of its end mark alone; repeated rows are packed each.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("packing", packing),
]

#: Models and tokenizers cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES, 1):
        before, docs = docs, stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = scratch.keep(docs)
            if number > 1:
                scratch.drop(before)
    return docs
