"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ids play no part in what stays, so they
may repeat or be null, and extra columns are carried along. All but the last return the columns of docs. run() writes each
stage's rows to the shared folder before the next stage reads them, and removes what is no longer read.
"""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import bpe, decontaminate, linededup, quality, simhash
from sheaf.llm.common import checkpoint, table

#: Rows to be removed up to which their numbers are broadcast (8 bytes each).
BROADCAST_ROWS = 500_000
_ROW = "__sheaf_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """A written copy of docs with a number for each row, as ids may repeat or be null; each later read gives the same numbers."""
    return _written(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows less those whose numbers are in gone; numbers differ, so no key of a shuffle is hot."""
    gone = checkpoint(gone.select(_ROW))
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, _ROW, "left_anti").drop(_ROW)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that quality.verdicts() rejects: null, empty and short texts, repetition, and outliers of their group."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the boilerplate lines of each source taken out of the texts; every row stays. n_chars, where there is one, follows the text."""
    columns = docs.columns
    cleaned = linededup.drop_boilerplate(docs)
    return cleaned.select(*(F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: one with the least id, or any where none has an id. Null and wordless texts are one group."""
    rows = _numbered(docs)
    grouped = simhash.near_duplicates(rows.select(F.col(_ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(_ROW), "component_id")
    ranked = checkpoint(grouped.join(rows.select(_ROW, "doc_id"), _ROW))
    first = F.min_by(_ROW, F.struct(F.col("doc_id").isNull(), "doc_id", _ROW))
    stay = ranked.groupBy("component_id").agg(first.alias(_ROW)).select(_ROW)
    return _without(rows, ranked.join(stay, _ROW, "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold a window of an item of `benchmark`."""
    rows = _numbered(docs)
    found = decontaminate.contamination(rows.select(F.col(_ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(rows, found.where("size(hits) > 0").select(F.col("doc_id").alias(_ROW)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the tokens and of their bytes, a row for each of docs; a null text has no tokens."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL has neither the concentration steps, nor reachability at this size, nor the merges of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of tokens() after all stages. What the last stage reads stays in the shared folder, as the result is read from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        after = _folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(after)
        docs = spark.read.parquet(after)
        if before:
            _remove(spark, before)
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)


def _folder(spark: SparkSession, name: str) -> str:
    checkpoint(spark.range(1))  # names the shared folder where the session did not
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{name}-{uuid.uuid4().hex}"


def _written(docs: DataFrame, name: str) -> DataFrame:
    path = _folder(docs.sparkSession, name)
    docs.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
