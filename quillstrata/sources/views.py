"""Disclosure and market tables as views over the star schema that the engine's queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices by security: (stock_code, trade_date, close_price, volume, trade_value)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("stock_code"), F.col("l_shipdate").cast("date").alias("trade_date")).agg(
        F.max("l_extendedprice").alias("close_price"), F.sum("l_quantity").alias("volume"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("trade_value")
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings: (rcept_no of 14 digits, corp_code, report_nm, rcept_dt yyyymmdd, amount)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.lpad(F.col("o_orderkey").cast("string"), 14, "0").alias("rcept_no"), F.col("o_custkey").alias("corp_code"), F.col("o_orderpriority").alias("report_nm"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"), F.col("o_totalprice").alias("amount"))


def supply_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event relations: a supplier supplies a customer, once for each order line: (triple_id, subject, predicate, object, rcept_no, amount)."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey).join(c, o.o_custkey == c.c_custkey)
    return rows.select(F.col("s_name").alias("subject"), F.lit("SUPPLIES_TO").alias("predicate"), F.col("c_name").alias("object"), F.col("o_orderkey").alias("rcept_no"), F.col("l_linenumber").alias("line"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"), F.col("o_orderdate").alias("rcept_at"))


def state_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State relations: nations belong to regions, suppliers are officers of nations."""
    n, r, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), table(spark, sf_dir, "supplier")
    a = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("subject"), F.lit("SUBSIDIARY_OF").alias("predicate"), F.col("r_name").alias("object"), F.col("n_nationkey").cast("bigint").alias("rcept_no"))
    b = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("subject"), F.lit("OFFICER_OF").alias("predicate"), F.col("n_name").alias("object"), F.col("s_suppkey").alias("rcept_no"))
    return a.unionByName(b)


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding as doubles, label)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
