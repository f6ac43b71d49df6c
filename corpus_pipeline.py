"""A corpus pipeline of five operators: quality, near-duplicates, repeated passages, the mix, token ids.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as Parquet to the shared folder and
reads again for the next. All stages but the last give the columns of documents. Nulls, empty and long texts, repeated
rows and ties have the results that each operator's module states, and none of them stops the run: an empty text scores
like any other, is one group with other empty texts, loses no words and is never taken by the mix; rows without an id
are told apart by their texts. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelog.llm import common, mixing, pieces, quality, simhash, substrings

#: The stages' decisions rest on trained models, hashes and tokenizers that SQL lacks.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; all of them where there are no labels of some class. A null
    or empty text is judged by its statistics, repeated rows and rows without an id each for itself, extra columns stay."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id (of its rows, that with the least hash
    of its text). Null and empty texts are one group; a row without an id stays only if its group has none with one."""
    return simhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has. All rows stay; a text that loses
    nothing stays as it was, null and empty ones among them. Rows without an id count as later than all."""
    return substrings.remove_substrings(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, in training order. Texts without a word are never taken; rows
    alike in every column are taken as often as the mix takes them together."""
    return mixing.curriculum(docs).select(*docs.columns)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document of the mix, sorted in training order: that of the mix's
    files and their rows. A null text has null ids and no tokens, long texts are encoded whole, repeated rows each."""
    import public_tokenizers

    coded = pieces.encode(common.in_order(docs), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("substring", substring_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows come in training order. What a stage's operator wrote for itself goes with the stage."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with common.gathered():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return common.in_order(docs)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
