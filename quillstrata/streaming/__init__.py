"""Structured Streaming: idempotent ingestion from files, run logs, and rates over event time."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.ingest import insert_absent, run_record


def rates(events: DataFrame, by: list[str], time: str = "ts", window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events a second over sliding windows; state is dropped once the watermark has passed a window. Works on streams and tables alike."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    seconds = F.col("window.end").cast("long") - F.col("window.start").cast("long")
    return rows.groupBy(*by, F.window(time, window, slide)).agg(F.count("*").alias("n")).select(*by, F.col("window.start").alias("window_start"), "n", (F.col("n") / seconds).alias("rate"))


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", most_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).format(fmt).load(path)


def ingest_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str, job: str = "ingest", runs: str | None = None, each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Takes what is new, inserts rows with unseen keys into the Parquet table at target, and stops.

    A micro-batch is anti-joined with the table before it is appended, so a batch that is run again after a failure adds
    nothing twice; the checkpoint only moves on after a batch has been written. A run record is appended for each batch: SUCCESS
    with the latest key, or FAILED without one, after which the error is raised again and the next run begins where this one did.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark, began = batch.sparkSession, datetime.datetime.now()
        status, error, count, mark = "SUCCESS", None, 0, None
        try:
            rows = (each(batch) if each else batch).dropDuplicates(keys)
            try:
                rows = rows.join(spark.read.parquet(target).select(*keys), keys, "left_anti")
            except Exception as e:  # the first batch finds no table
                if "PATH_NOT_FOUND" not in str(e):
                    raise
            seen = rows.persist()
            try:
                count, mark = seen.agg(F.count("*"), F.max(F.col(keys[0]).cast("string"))).first()
                if count:
                    seen.select(*batch.columns if each is None else seen.columns).write.mode("append").parquet(target)
            finally:
                seen.unpersist()
        except Exception as e:
            status, error = "FAILED", str(e)
            raise
        finally:
            if runs:
                run_record(spark, job, status, mark, count, began, datetime.datetime.now(), error).coalesce(1).write.mode("append").parquet(runs)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["ingest_new", "insert_absent", "rates", "read_files"]
