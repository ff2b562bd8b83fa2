"""One query for each operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm.common import table

WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_file(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmatch.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmatch.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmatch.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"), columns=["doc_id"])


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmatch.llm.gif import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmatch.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmatch.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmatch.llm.urlfilter import filter_pages

    return filter_pages(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmatch.llm.suffix import remove_earlier

    return remove_earlier(table(spark, sf_dir, "documents"), keep=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmatch.llm.substring import remove_repeated

    return remove_repeated(table(spark, sf_dir, "documents"), keep=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinmatch.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from kinmatch.llm import sharding, urlfilter

    return {"op6_sharding": sharding.oracle_sql(), "op7_url_filter": urlfilter.oracle_sql()}
