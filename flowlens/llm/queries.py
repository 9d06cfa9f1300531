"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.durable import Scratch
from flowlens.llm.alignment import align_tokens
from flowlens.llm.ann import nearest_neighbours
from flowlens.llm.centroids import cluster_vectors, clustering_sql
from flowlens.llm.common import table
from flowlens.llm.embedding_dedup import near_duplicate_vectors
from flowlens.llm.html_extract import extract_main_text, fit_weights
from flowlens.llm.jaccard_join import jaccard_components
from flowlens.llm.line_rules import clean_lines, line_rules_sql
from flowlens.llm.packing import pack
from flowlens.llm.piece_sampling import sample_pieces
from flowlens.llm.quality import fit_quality, score_quality
from flowlens.llm.sql import jaccard_sql, near_vectors_sql
from flowlens.llm.suffix_dedup import remove_repeats
from flowlens.llm.token_binary import read_token_file, write_token_file
from flowlens.llm.toxicity import fit_toxicity, score_toxicity

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[function.__name__] = function
    return function


@query
def op1_sentencepiece(spark, sf):
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = sample_pieces(table(spark, sf, "documents"), model, decode=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded")).alias("lossless"),
    )


@query
def op2_quality(spark, sf):
    docs = table(spark, sf, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf, "labels")))


@query
def op3_suffix_dedup(spark, sf):
    return remove_repeats(table(spark, sf, "documents"), length=50)


@query
def op4_nearest_neighbours(spark, sf):
    return nearest_neighbours(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_jaccard_join(spark, sf):
    return jaccard_components(table(spark, sf, "documents"), width=4, percent=85)


LLM_SQL["op5_jaccard_join"] = jaccard_sql(4, 85)


@query
def op6_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf, "labels")))


@query
def op7_token_binary(spark, sf):
    path = f"{Scratch(spark, 'token-file').folder}/{uuid.uuid4().hex}"
    write_token_file(table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_file(spark, path)


@query
def op8_html_extract(spark, sf):
    pages = table(spark, sf, "pages")
    return extract_main_text(pages, fit_weights(pages))


@query
def op9_packing(spark, sf):
    return pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_embedding_dedup(spark, sf):
    return near_duplicate_vectors(table(spark, sf, "embeddings"))


LLM_SQL["op10_embedding_dedup"] = near_vectors_sql(0.93)


@query
def op11_centroid_clustering(spark, sf):
    return cluster_vectors(table(spark, sf, "embeddings"))[0]


LLM_SQL["op11_centroid_clustering"] = clustering_sql()


@query
def op12_token_alignment(spark, sf):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_tokens(table(spark, sf, "documents"), *paths)[0]


@query
def op13_line_rules(spark, sf):
    return clean_lines(table(spark, sf, "documents"))


LLM_SQL["op13_line_rules"] = line_rules_sql()
