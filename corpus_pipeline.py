"""From raw documents to token ids: quality, exact copies, near copies, benchmark passages, encoding.

Each stage takes all rows that the one before kept, and all but the last return the columns of documents. A stage
decides by a unique key of its input's rows (see with_row) and takes rows by it, so texts are read once more rather than
carried through a decision. Rows without an id are judged and dropped as others are, and of rows that share an id each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.bpe_codec import encoded_digests
from lattica.llm.common import ROW, cuts_removed, free_name, materialize, remove, scratch, sized, table, with_row
from lattica.llm.decontaminate import contamination
from lattica.llm.exact_dedup import drop_duplicates
from lattica.llm.near_dedup import near_duplicates
from lattica.llm.quality import quality


def without(keyed: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of keyed whose key is not in gone's ROW, without the key."""
    other = free_name("gone_row", keyed.columns)
    gone = materialize(gone.select(F.col(ROW).alias(other)), "gone")
    return keyed.join(sized(gone), F.col(key) == F.col(other), "left_anti").drop(key)


def keyed_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of rows, and the key's name, which docs doesn't have."""
    key = free_name(ROW, docs.columns)
    return with_row(docs, name=key), key


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the quality classifier accepts."""
    docs, key = keyed_rows(docs)
    return without(docs, key, quality(docs, table(spark, sf_dir, "labels"), row_col=key).where("not accepted"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text."""
    return drop_duplicates(docs)


def keep_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class."""
    docs, key = keyed_rows(docs)
    return without(docs, key, near_duplicates(docs, row_col=key).where("not kept"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    docs, key = keyed_rows(docs)
    return without(docs, key, contamination(docs, table(spark, sf_dir, "benchmark"), row_col=key).where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as digests of ids and of what they decode to."""
    return encoded_digests(docs)


STAGES = [("quality", keep_quality), ("exact_dedup", keep_distinct), ("near_dedup", keep_apart), ("decontaminate", keep_clean), ("encode", encode)]

#: SQL can express neither the language model nor the signatures; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again as the next one's input. What a stage wrote on its way is
    deleted, and so is its input; the last one's, which the result reads, stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        with cuts_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, [before])
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
