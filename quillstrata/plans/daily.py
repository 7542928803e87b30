"""Daily jobs: the company master, then filings; prices; relations from documents that have none yet. Tables are Parquet folders under one root."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import chunk_documents, props, stored_triples
from ..operators.forms import parse_filings, targets
from ..operators.graph import load_graph
from ..operators.ingest import insert_absent, latest_watermark, run_record, upsert_last, valid_filings
from ..operators.vectors import encoder

CORP = "corp_code string, corp_name string, stock_code string, modify_date string, in_universe boolean"
FILING = "rcept_no string, corp_code string, corp_name string, stock_code string, report_nm string, rcept_dt string, flr_nm string, rm string, raw_json string, doc_text string, doc_fetched_at timestamp"
PRICE = "stock_code string, trade_date date, open_price long, high_price long, low_price long, close_price long, volume long, trade_value decimal(20,0), change_rate decimal(8,4)"
TRIPLE = "rcept_no string, subject_name string, predicate string, object_name string, props_json string, model string, was_cut boolean"
CHUNK = "rcept_no string, chunk_idx int, content string, embedding array<double>"
RUN = "job_name string, watermark string, row_count long, status string, started_at timestamp, finished_at timestamp, error_msg string"
# First days of a first run.
FIRST_FILINGS, FIRST_PRICES = datetime.date(2023, 1, 1), datetime.date(2021, 1, 1)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _versions(self, name: str) -> list[int]:
        """Numbers of a replaced table's whole versions; a version is whole once Spark has put its success file there."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(conf)
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        whole = [p for p in found if p.getName().startswith("v") and p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in whole)

    def read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path(name))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def path(self, name: str) -> str:
        versions = self._versions(name)
        return f"{self.root}/{name}" + (f"/v{versions[-1]}" if versions else "")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes the table's next version beside the last; readers take the last whole one, so a job that dies in between changes nothing. The one before the last is kept, older ones go."""
        versions = self._versions(name)
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{versions[-1] + 1 if versions else 1}")
        for old in versions[:-1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v{old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def since_last(store: Store, job: str, backfill: datetime.date, today: datetime.date, work: Callable[[datetime.date, datetime.date], int]) -> int | None:
    """Runs work(begin, end) for the days after the job's last success; None, and no record, where there are none. A failure is recorded without a
    watermark and raised again, so the next run begins at the same day; what it had written does no harm, as work is idempotent."""
    mark = latest_watermark(store.read("etl_run", RUN), job).first()[0]
    begin = datetime.date.fromisoformat(mark) + datetime.timedelta(1) if mark else backfill
    if begin > today:
        return None
    began, count, status, error = datetime.datetime.now(), 0, "SUCCESS", None
    try:
        count = work(begin, today)
        return count
    except Exception as e:
        status, error = "FAILED", str(e)
        raise
    finally:
        store.append("etl_run", run_record(store.spark, job, status, today.isoformat(), count, began, datetime.datetime.now(), error).coalesce(1))


def sync_companies(store: Store, master: DataFrame) -> None:
    """Names and codes of the master replace what is there; which companies are followed stays."""
    batch = master.withColumn("in_universe", F.lit(None).cast("boolean"))
    out = upsert_last(store.read("corp", CORP), batch.select("corp_code", "corp_name", "stock_code", "modify_date", "in_universe"), ["corp_code"], keep=["in_universe"])
    store.replace("corp", out.withColumn("in_universe", F.coalesce("in_universe", F.lit(False))))


def ingest_filings(store: Store, fetch: Callable[[datetime.date, datetime.date], DataFrame], today: datetime.date) -> int | None:
    """Filings by fetch(begin, end), those with new numbers; malformed rows go to a table of their own."""

    def work(begin: datetime.date, end: datetime.date) -> int:
        good, bad = valid_filings(fetch(begin, end))
        good = good.withColumns({"raw_json": F.to_json(F.struct("*")), "doc_text": F.lit(None).cast("string"), "doc_fetched_at": F.lit(None).cast("timestamp")})
        have = store.read("filing", FILING).select("rcept_no")
        fresh = good.dropDuplicates(["rcept_no"]).join(have, "rcept_no", "left_anti").select(*(c.split(" ")[0] for c in FILING.split(", "))).persist()
        try:
            count = fresh.count()
            if count:
                store.append("filing", fresh)
            if not bad.isEmpty():
                store.append("filing_rejected", bad)
            return count
        finally:
            fresh.unpersist()

    return since_last(store, "filings", FIRST_FILINGS, today, work)


#: When the jobs run, as cron lines: fixed values.
SCHEDULE = {"filings": "0 20 * * 1-5", "prices": "30 18 * * 1-5"}


def daily_filings(store: Store, master: Callable[[], DataFrame], fetch: Callable[[datetime.date, datetime.date], DataFrame], today: datetime.date) -> int | None:
    """The company master, then filings; filings wait for the next day if the master can't be had."""
    sync_companies(store, master())
    return ingest_filings(store, fetch, today)


def ingest_prices(store: Store, fetch: Callable[[datetime.date, datetime.date], tuple[DataFrame, DataFrame]], today: datetime.date) -> int | None:
    """Prices by fetch(begin, end), which gives rows and errors by code: the rows of the codes that worked are kept, then errors are raised."""

    def work(begin: datetime.date, end: datetime.date) -> int:
        rows, errors = fetch(begin, end)
        have = store.read("price_daily", PRICE)
        fresh = rows.dropDuplicates(["stock_code", "trade_date"]).join(have.select("stock_code", "trade_date"), ["stock_code", "trade_date"], "left_anti").select(*have.columns).persist()
        try:
            count = fresh.count()
            if count:
                store.append("price_daily", fresh)
        finally:
            fresh.unpersist()
        failed = [f"{r[0]}: {r[1]}" for r in errors.orderBy("stock_code").limit(20).collect()]
        if failed:
            raise RuntimeError("prices failed for " + "; ".join(failed))
        return count

    return since_last(store, "prices", FIRST_PRICES, today, work)


def extract_relations(store: Store, limit: int | None = None) -> int:
    """Relations of filings of the wanted kinds that have text and no relations yet, oldest first."""
    filings = store.read("filing", FILING).where("doc_text IS NOT NULL")
    todo = targets(filings).join(store.read("kg_triple", TRIPLE).select("rcept_no").distinct(), "rcept_no", "left_anti")
    if limit is not None:
        todo = todo.orderBy("rcept_dt", "rcept_no").limit(limit)
    found = stored_triples(parse_filings(todo)).persist()
    try:
        count = found.count()
        if count:
            store.append("kg_triple", found)
        return count
    finally:
        found.unpersist()


def load_relations(store: Store) -> tuple[int, int]:
    """The graph's tables from stored relations and followed companies: numbers of nodes and edges."""
    rows = store.read("kg_triple", TRIPLE)
    t = rows.select(F.concat_ws("|", "rcept_no", F.xxhash64(*rows.columns)).alias("triple_id"), F.col("subject_name").alias("subject"), "predicate", F.col("object_name").alias("object"), "rcept_no", props(F.col("props_json")).alias("_p")).select("*", "_p.*").drop("_p")
    nodes, edges = load_graph(t, store.read("corp", CORP))
    store.replace("graph_node", nodes)
    store.replace("graph_edge", edges)
    return store.spark.read.parquet(store.path("graph_node")).count(), store.spark.read.parquet(store.path("graph_edge")).count()


def embed_filings(store: Store, encode=None) -> int:
    """Chunks and vectors of filings that have text and no chunks yet."""
    docs = store.read("filing", FILING).where("doc_text IS NOT NULL")
    have = store.read("doc_chunk", CHUNK)
    made = chunk_documents(docs.join(have.select("rcept_no").distinct(), "rcept_no", "left_anti")).withColumn("embedding", (encode or encoder())("content")).persist()
    try:
        count = made.count()
        if count:
            store.append("doc_chunk", made)
        return count
    finally:
        made.unpersist()


__all__ = ["SCHEDULE", "Store", "daily_filings", "embed_filings", "load_relations", "extract_relations", "ingest_filings", "ingest_prices", "insert_absent", "since_last", "sync_companies"]
