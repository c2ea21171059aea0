"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestctl.llm import (
    chat,
    decontaminate,
    html_text,
    lexical_search,
    packing,
    ppm,
    quality,
    secrets_crf,
    simhash_dedup,
    spelling,
    spotsigs,
    token_counts,
    toxicity,
)
from ingestctl.llm.common import prepare, read
from ingestctl.scratch import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    """Register under the function's name, to run with the settings the operators count on."""

    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return classes.select("doc_id", simhash_dedup.hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_crf.scan(read(spark, sf_dir, "documents"))


@query
def op3_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(read(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    places = [F.col(name).cast("long").alias(name) for name in ("start", "n_words")]
    return found.select("doc_id", "item_id", *places, "similarity")


ORACLES["op4_decontamination"] = decontaminate.SQL


@query
def op5_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(read(spark, sf_dir, "documents"))


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


ORACLES["op6_chat_format"] = chat.SQL


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), packing.public_tokenizer())


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op11_lexical_search"] = lexical_search.SQL


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a cache that is empty at first, so that every different text is encoded, once."""
    docs, cache = read(spark, sf_dir, "documents"), new_folder(spark, "token-cache")
    counted = token_counts.count_tokens(docs, token_counts.public_tokenizer(), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = spelling.spelling_variants(spelling.word_counts(read(spark, sf_dir, "documents")))
    return variants.select("word", "form", "root", "n", "n_near", "form_n")
