"""Shared pieces of the training-data operators: reading tables and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import checkpoint, spread

__all__ = ["arrow_schema", "blank_words", "bucket_of", "checkpoint", "join_groups", "map_batches", "spread", "table", "texts_as_bytes"]

#: Words are split at these six bytes only (space, tab, LF, VT, FF, CR).
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a Python worker turns into Python objects at once.
ROWS_AT_ONCE = 256


def arrow_schema(ddl: str) -> pa.Schema:
    """For use on the driver; the schema then goes to the executors with the function."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Narrow map over Arrow batches. function gives columns as lists (or Arrow arrays) in schema's order."""
    target = arrow_schema(schema)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in source for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            columns = function(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

    return spread(df).mapInArrow(batches, schema)


def texts_as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def blank_words(text: Column) -> Column:
    """Words between the six blanks, as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n: the folds of the learned operators."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def join_groups(rows: DataFrame, groups: DataFrame, on: str | list[str], limit: int, weight: str = "weight", how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to groups, a row for each key, without a hot task; weight: about how many rows the key has.

    Up to limit groups are broadcast. Of more, those with over a limit-th of the weight are, which are fewer than limit;
    the rows of the others are dealt by key, each key having at most that share. rows and groups should be cheap to read twice.
    """
    bare = groups.drop(weight)
    if groups.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(bare), on, how)
    total = groups.agg(F.sum(weight)).first()[0] or 0
    heavy = groups.where(F.col(weight).cast("decimal(38,0)") * limit > F.lit(total).cast("decimal(38,0)")).drop(weight)
    keys = [on] if isinstance(on, str) else on
    others = rows.join(F.broadcast(heavy.select(*keys)), on, "left_anti").join(bare, on, how)
    return rows.join(F.broadcast(heavy), on).unionByName(others)
