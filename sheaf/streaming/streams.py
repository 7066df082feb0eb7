"""Streaming forms of the operators: arriving files, repeats, windows, sessions, and state that a newer row replaces."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sheaf.session import shared_folder

# The setting that names what keeps a stream's state, and the one that keeps it on disk.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving_texts(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """The pages' texts of arriving files (doc_id, arrived, content); the same content again within the time is passed over."""
    from sheaf.operators.documents import page_texts_of

    fresh = files.withColumn("digest", F.sha2("content", 256)).withWatermark("arrived", late).dropDuplicatesWithinWatermark(["digest"])
    return page_texts_of(fresh)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Number and sum of values by window and type."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "2 hours") -> DataFrame:
    """Stretches of a user's events with no gap that long."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def newest_by_key(changes: DataFrame) -> DataFrame:
    """(key, seq, value): after each batch, the keys whose newest value it changed. The state of a key is one number."""
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        best = None
        for batch in batches:
            top = batch.loc[batch["seq"].idxmax()]
            if best is None or top["seq"] > best["seq"]:
                best = top
        if best is not None and (before is None or best["seq"] > before):
            state.update((int(best["seq"]),))
            yield pd.DataFrame({"key": [key[0]], "seq": [best["seq"]], "value": [best["value"]]})

    return changes.groupBy("key").applyInPandasWithState(step, "key long, seq long, value double", "seq long", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a bounded stream to its end and gives its result as a table, which lies in files of the shared folder.

    Of a complete result the last one counts, of the others what each batch adds. Nothing of it goes through the driver; the
    state is kept by RocksDB, so it needn't fit the executors' memory, and goes when the stream has ended.
    """
    spark, folder = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream_{uuid.uuid4().hex}"
    out = f"{folder}/result"

    def put(rows: DataFrame, batch: int) -> None:
        # The name is the batch's own, so one that is run again replaces what it wrote before.
        rows.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={batch}")

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state"), True)
    if not files.exists(path):  # no batch
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)
