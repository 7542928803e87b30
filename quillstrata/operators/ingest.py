"""Idempotent upserts, incremental slices and run records on plain Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last by order. One aggregation with map-side combining, no sort of whole groups."""
    rest = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return out.select(*keys, "_r.*").select(*rows.columns)


def upsert_last(existing: DataFrame, batch: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows of the batch replace existing rows of the same key; columns in keep stay as they exist."""
    keep = keep or []
    ranked = existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(*keys)
    for c in keep:
        ranked = ranked.withColumn(c, F.coalesce(F.max(F.when(F.col("_new") == 0, F.col(c))).over(w), F.col(c)))
    return ranked.withColumn("_rn", F.row_number().over(w.orderBy(F.desc("_new")))).where("_rn = 1").select(*existing.columns)


def insert_absent(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Existing rows, and of the batch those with new keys, the first of each by order."""
    if order:
        fresh = batch.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
    else:
        fresh = batch.dropDuplicates(keys)
    return existing.unionByName(fresh.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def pending(rows: DataFrame, done: DataFrame, keys: list[str], order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Rows without a counterpart in done; the limit counts after that."""
    out = rows.join(done.select(*keys).distinct(), keys, "left_anti")
    if limit is not None:
        out = out.orderBy(*(order or [F.col(k) for k in keys])).limit(limit)
    return out


def latest_watermark(runs: DataFrame, job: str) -> DataFrame:
    """Watermark of the job's last successful run by start."""
    return runs.where((F.col("job_name") == job) & (F.col("status") == "SUCCESS")).agg(F.max_by("watermark", "started_at").alias("watermark"))


def next_slice(rows: DataFrame, date: str, watermark: DataFrame, backfill: str, end: str, lookback: int = 0) -> DataFrame:
    """Rows from the day after the watermark (or from backfill) up to end. lookback days are read again, which upserts make harmless."""
    begin = watermark.select(F.coalesce(F.date_add(F.col("watermark").cast("date"), 1 - lookback), F.lit(backfill).cast("date")).alias("_begin"))
    return rows.crossJoin(F.broadcast(begin)).where((F.col(date) >= F.col("_begin")) & (F.col(date) <= F.lit(end).cast("date"))).drop("_begin")  # one row on the right


def run_record(spark, job: str, status: str, watermark: str | None, rows: int, started, finished, error: str | None = None) -> DataFrame:
    """A row for the run log; errors are cut to 4000 characters."""
    schema = "job_name string, watermark string, row_count long, status string, started_at timestamp, finished_at timestamp, error_msg string"
    return spark.createDataFrame([(job, watermark if status == "SUCCESS" else None, rows, status, started, finished, (error or "")[:4000] or None)], schema)


def mark_fetched(filings: DataFrame, fetched: DataFrame, at: Column, most: int = 400_000) -> DataFrame:
    """doc_text from fetched (rcept_no, text; null text: it failed), cut; every attempt is stamped, so that failures aren't tried for ever."""
    got = fetched.select("rcept_no", F.substring("text", 1, most).alias("_text"), F.lit(True).alias("_tried"))
    out = filings.join(got, "rcept_no", "left")
    out = out.withColumn("doc_text", F.coalesce("_text", "doc_text")).withColumn("doc_fetched_at", F.when(F.col("_tried"), at).otherwise(F.col("doc_fetched_at")))
    return out.select(*filings.columns)


def valid_filings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) filing list rows: all fields stripped, blank codes null, 14-digit number, 8-digit date."""
    from ..functions.text import strip

    clean = rows.select(*(strip(F.col(c)).alias(c) for c in rows.columns))
    clean = clean.withColumn("stock_code", F.nullif(F.col("stock_code"), F.lit("")))
    ok = (F.length("rcept_no") == 14) & F.col("rcept_dt").rlike(r"^\d{8}$")
    return clean.where(ok), clean.where(~F.coalesce(ok, F.lit(False)))
