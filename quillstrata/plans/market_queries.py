"""Prices, filings, upserts and watermarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, market
from ..sources.views import filings, prices, table
from .registry import query

PRICES = """prices AS (SELECT l_suppkey AS stock_code, CAST(l_shipdate AS DATE) AS trade_date, max(l_extendedprice) AS close_price, sum(l_quantity) AS volume,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS trade_value FROM lineitem GROUP BY 1, 2)"""
FILINGS = """filings AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS rcept_no, o_custkey AS corp_code, o_orderpriority AS report_nm, strftime(o_orderdate, '%Y%m%d') AS rcept_dt, o_totalprice AS amount FROM orders)"""


def rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("price_factors", f"""WITH {PRICES},
    r AS (SELECT *, close_price / lag(close_price, 1) OVER w - 1 AS daily_ret, close_price / lag(close_price, 20) OVER w - 1 AS mom_20, close_price / lag(close_price, 60) OVER w - 1 AS mom_60 FROM prices WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date)),
    v AS (SELECT *, stddev_samp(daily_ret) OVER f AS vol_20, avg(CAST(trade_value AS DOUBLE)) OVER f AS turnover_20 FROM r WINDOW f AS (PARTITION BY stock_code ORDER BY trade_date ROWS 19 PRECEDING))
    SELECT stock_code, trade_date, close_price, round(mom_20, 6) AS mom_20, round(mom_60, 6) AS mom_60, round(vol_20, 6) AS vol_20, round(turnover_20, 2) AS turnover_20 FROM v WHERE mom_20 IS NOT NULL""")  # fmt: skip
def price_factors(spark, d):
    out = market.factors(prices(spark, d))
    return rounded(out, "mom_20", "mom_60", "vol_20").withColumn("turnover_20", F.round("turnover_20", 2)).select("stock_code", "trade_date", "close_price", "mom_20", "mom_60", "vol_20", "turnover_20")


@query("daily_returns", f"""WITH {PRICES}, r AS (SELECT stock_code, trade_date, close_price / lag(close_price) OVER w - 1 AS daily_ret, lag(close_price, 20) OVER w AS early FROM prices WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date))
    SELECT stock_code, trade_date, round(daily_ret, 6) AS daily_ret FROM r WHERE early IS NOT NULL""")  # fmt: skip
def daily_returns(spark, d):
    return rounded(market.factors(prices(spark, d)), "daily_ret").select("stock_code", "trade_date", "daily_ret")


@query("period_return", f"""WITH {PRICES} SELECT stock_code, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS days, round(arg_max(close_price, trade_date) / arg_min(close_price, trade_date) - 1, 6) AS period_return
    FROM prices WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY stock_code""")  # fmt: skip
def period_return(spark, d):
    return rounded(market.period_return(prices(spark, d), "1996-01-01", "1998-12-31"), "period_return")


@query("price_head_tail", f"""WITH {PRICES}, r AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date) AS rank, count(*) OVER (PARTITION BY stock_code) AS "of" FROM prices)
    SELECT stock_code, trade_date, close_price, rank, "of" FROM r WHERE "of" <= 250 OR rank <= 10 OR rank > "of" - 10""")  # fmt: skip
def price_head_tail(spark, d):
    return market.head_and_tail(prices(spark, d), "stock_code", "trade_date").select("stock_code", "trade_date", "close_price", "rank", "of")


@query("filings_in_period", f"""WITH {FILINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY corp_code ORDER BY rcept_dt, rcept_no) AS rank, count(*) OVER (PARTITION BY corp_code) AS "of" FROM filings WHERE rcept_dt BETWEEN '19960101' AND '19991231')
    SELECT corp_code, rcept_no, rcept_dt, report_nm, rank, "of" FROM r WHERE rank <= 30""")  # fmt: skip
def filings_in_period(spark, d):
    own = market.in_period(filings(spark, d), "rcept_dt", "19960101", "19991231")
    return market.first_of(own, "corp_code", [F.col("rcept_dt"), F.col("rcept_no")]).select("corp_code", "rcept_no", "rcept_dt", "report_nm", "rank", "of")


@query("prices_with_filings", f"""WITH {PRICES}, {FILINGS}, p AS (SELECT stock_code, count(*) AS days, max(close_price) AS highest FROM prices WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY 1),
    f AS (SELECT corp_code AS stock_code, count(*) AS n_filings, min(rcept_no) AS first_filing, CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS BIGINT) AS cents FROM filings WHERE rcept_dt BETWEEN '19970101' AND '19971231' GROUP BY 1)
    SELECT stock_code, days, highest, coalesce(n_filings, 0) AS n_filings, first_filing, coalesce(cents, 0) AS cents FROM p LEFT JOIN f USING (stock_code)""")  # fmt: skip
def prices_with_filings(spark, d):
    """Of each security the period's prices and the same company's filings of the period. Both sides are one row a company before they meet."""
    own = market.in_period(prices(spark, d), "trade_date", F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date")).groupBy("stock_code").agg(F.count("*").alias("days"), F.max("close_price").alias("highest"))
    listed = market.in_period(filings(spark, d), "rcept_dt", "19970101", "19971231").groupBy(F.col("corp_code").alias("stock_code"))
    listed = listed.agg(F.count("*").alias("n_filings"), F.min("rcept_no").alias("first_filing"), F.sum(F.round(F.col("amount") * 100).cast("bigint")).alias("cents"))
    return own.join(listed, "stock_code", "left").select("stock_code", "days", "highest", F.coalesce("n_filings", F.lit(0)).alias("n_filings"), "first_filing", F.coalesce("cents", F.lit(0)).alias("cents"))


@query("dedupe_keep_last", "SELECT l_orderkey, l_linenumber, arg_max(l_partkey, key) AS l_partkey, arg_max(l_quantity, key) AS l_quantity FROM (SELECT *, row(l_shipdate, l_partkey, l_quantity, l_extendedprice) AS key FROM lineitem) GROUP BY 1, 2")
def dedupe_keep_last(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.struct("l_shipdate", "l_partkey", "l_quantity", "l_extendedprice").alias("key"))
    return ingest.keep_last(rows, ["l_orderkey", "l_linenumber"], "key").drop("key")


@query("upsert_last_wins", """SELECT c_custkey, CASE WHEN b.k IS NOT NULL THEN 'new ' || c_name ELSE c_name END AS c_name, CASE WHEN b.k IS NOT NULL THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal, c_mktsegment
    FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') b ON k = c_custkey""")  # fmt: skip
def upsert_last_wins(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    batch = c.join(urgent, "c_custkey").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), F.round(F.col("c_acctbal") + 1, 2).alias("c_acctbal"), F.lit("changed").alias("c_mktsegment"))
    return ingest.upsert_last(c, batch, ["c_custkey"], keep=["c_mktsegment"])


@query("upsert_insert_only", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey, min(l_extendedprice) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def upsert_insert_only(spark, d):
    existing = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    batch = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"))
    return ingest.insert_absent(existing, batch, ["o_orderkey"], [F.col("o_totalprice")])


@query("insert_absent_prices", f"""WITH {PRICES} SELECT stock_code, trade_date, close_price FROM prices""")
def insert_absent_prices(spark, d):
    p = prices(spark, d).select("stock_code", "trade_date", "close_price")
    return ingest.insert_absent(p.where("trade_date < '1998-01-01'"), p, ["stock_code", "trade_date"])


@query("raw_row_json", "SELECT o_orderkey, '{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS raw_json FROM orders")
def raw_row_json(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus")).alias("raw_json"))


@query("latest_watermark", "SELECT arg_max(strftime(ts, '%Y-%m-%d'), ts) AS watermark FROM events WHERE event_type = 'purchase' AND user_id % 5 <> 0")
def latest_watermark(spark, d):
    runs = table(spark, d, "events").select(F.col("event_type").alias("job_name"), F.when(F.col("user_id") % 5 != 0, "SUCCESS").otherwise("FAILED").alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("watermark"), F.col("ts").alias("started_at"))
    return ingest.latest_watermark(runs, "purchase")


@query("incremental_slice", """WITH w AS (SELECT max(strftime(ts, '%Y-%m-%d'))::DATE AS wm FROM events WHERE user_id = 7 AND ts < TIMESTAMP '2024-01-15')
    SELECT event_id, CAST(ts AS DATE) AS day FROM events, w WHERE CAST(ts AS DATE) >= coalesce(wm + 1, DATE '2024-01-03') AND CAST(ts AS DATE) <= DATE '2024-01-20'""")  # fmt: skip
def incremental_slice(spark, d):
    e = table(spark, d, "events")
    runs = e.where("user_id = 7 AND ts < timestamp'2024-01-15'").select(F.lit("j").alias("job_name"), F.lit("SUCCESS").alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("watermark"), F.col("ts").alias("started_at"))
    return ingest.next_slice(e.select("event_id", F.col("ts").cast("date").alias("day")), "day", ingest.latest_watermark(runs, "j"), "2024-01-03", "2024-01-20")


@query("pending_anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND (o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%')")
def pending_anti_join(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderpriority").rlike("URGENT|HIGH"))
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ingest.pending(o.select("o_orderkey"), done, ["o_orderkey"])


@query("pending_limit_after_anti", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) ORDER BY o_orderdate, o_orderkey LIMIT 100")
def pending_limit_after_anti(spark, d):
    done = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return ingest.pending(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), done, ["o_orderkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 100)


@query("missing_keys", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def missing_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")))


@query("key_lookup", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49)")
def key_lookup(spark, d):
    keys = table(spark, d, "lineitem").where("l_returnflag = 'A' AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey", "s_name").join(keys, "s_suppkey", "left_semi")


@query("filing_lines", "SELECT o_orderpriority AS report_nm, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def filing_lines(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("o_orderpriority").alias("report_nm")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))


@query("document_marks", """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN left(text, 400000) END AS doc_text, l.doc_id IS NOT NULL AS tried FROM documents d LEFT JOIN labels l USING (doc_id)""")
def document_marks(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("rcept_no"), F.lit(None).cast("string").alias("doc_text"), F.lit(None).cast("timestamp").alias("doc_fetched_at"), "text")
    got = docs.join(table(spark, d, "labels").withColumnRenamed("doc_id", "rcept_no"), "rcept_no").select("rcept_no", F.when(F.col("quality") == 1, F.col("text")).alias("text"))
    out = ingest.mark_fetched(docs.drop("text"), got, F.lit("2026-01-01").cast("timestamp"))
    return out.select(F.col("rcept_no").alias("doc_id"), "doc_text", F.col("doc_fetched_at").isNotNull().alias("tried"))


FACTORS = ["daily_ret", "mom_20", "mom_60", "vol_20", "turnover_20"]


@query("factor_agreement", f"""WITH {PRICES}, r AS (SELECT *, close_price / lag(close_price, 20) OVER w - 1 AS mom_20 FROM prices WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date))
    SELECT count(*) AS n, {", ".join(f"true AS {c}_same" for c in FACTORS)} FROM r WHERE mom_20 IS NOT NULL""")  # fmt: skip
def factor_agreement(spark, d):
    """Factors by windows and by pandas: rows in both, and whether the largest relative error of each is below 10**-9."""
    rows = prices(spark, d)
    out = market.relative_error(market.factors(rows), market.factors_pandas(rows), ["stock_code", "trade_date"], FACTORS)
    return out.select("n", *((F.col(f"{c}_error") < 1e-9).alias(f"{c}_same") for c in FACTORS))


@query("pandas_factors", f"""WITH {PRICES},
    r AS (SELECT *, close_price / lag(close_price, 1) OVER w - 1 AS daily_ret, close_price / lag(close_price, 20) OVER w - 1 AS mom_20 FROM prices WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date)),
    v AS (SELECT *, stddev_samp(daily_ret) OVER f AS vol_20 FROM r WINDOW f AS (PARTITION BY stock_code ORDER BY trade_date ROWS 19 PRECEDING))
    SELECT stock_code, trade_date, round(mom_20, 6) AS mom_20, round(vol_20, 6) AS vol_20 FROM v WHERE mom_20 IS NOT NULL""")  # fmt: skip
def pandas_factors(spark, d):
    return rounded(market.factors_pandas(prices(spark, d)), "mom_20", "vol_20").select("stock_code", "trade_date", "mom_20", "vol_20")


@query("ohlcv_rename", "SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stock_code, CAST(l_shipdate AS DATE) AS trade_date, true AS no_open, CAST(floor(l_extendedprice) AS BIGINT) AS close_price, CAST(l_quantity AS BIGINT) AS volume, CASE WHEN l_linenumber <> 3 THEN CAST(l_discount AS DECIMAL(8,4)) END AS change_rate FROM lineitem")
def ohlcv_rename(spark, d):
    """A price table with Korean headers, some columns missing, some values not numbers."""
    from ..sources import clean_prices

    li = table(spark, d, "lineitem")
    raw = li.select(F.col("l_suppkey").cast("string").alias("code"), F.col("l_shipdate").alias("날짜"), F.floor("l_extendedprice").alias("종가"), F.col("l_quantity").alias("거래량"), F.when(F.col("l_linenumber") == 3, F.lit("NaN")).otherwise(F.col("l_discount").cast("string")).alias("등락률"))
    return clean_prices(raw, F.col("code")).select("stock_code", "trade_date", F.col("open_price").isNull().alias("no_open"), "close_price", "volume", "change_rate")


@query("filing_pages", "SELECT lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS rcept_no, CAST(o_custkey AS VARCHAR) AS corp_code, strftime(o_orderdate, '%Y%m%d') AS rcept_dt FROM orders WHERE o_orderkey % 11 <> 0")
def filing_pages(spark, d):
    """A paged filing list, one answer for each day and one state; days without data give nothing."""
    from ..sources import filings_from_pages

    o = table(spark, d, "orders").withColumn("ok", F.col("o_orderkey") % 11 != 0)
    row = F.struct(F.lpad(F.col("o_orderkey").cast("string"), 14, "0").alias("rcept_no"), F.col("o_custkey").cast("string").alias("corp_code"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"))
    pages = o.groupBy("o_orderdate", "ok").agg(F.collect_list(row).alias("list")).select(F.to_json(F.struct(F.when(F.col("ok"), "000").otherwise("013").alias("status"), F.lit(1).alias("total_page"), "list")).alias("body"))
    return filings_from_pages(pages).select("rcept_no", "corp_code", "rcept_dt")


@query("price_series", f"""WITH {PRICES}, r AS (SELECT *, row_number() OVER (ORDER BY trade_date) AS rank, count(*) OVER () AS "of" FROM prices WHERE stock_code = 7 AND trade_date BETWEEN DATE '1994-01-01' AND DATE '1997-12-31')
    SELECT trade_date, close_price, rank, "of", (SELECT round(arg_max(close_price, trade_date) / arg_min(close_price, trade_date) - 1, 6) FROM r) AS period_return FROM r WHERE "of" <= 250 OR rank <= 10 OR rank > "of" - 10""")  # fmt: skip
def price_series(spark, d):
    """What a client gets for one security's prices."""
    from ..api import Engine

    listed = filings(spark, d).withColumn("stock_code", F.col("corp_code").cast("string"))
    got = Engine(spark, None, prices=prices(spark, d).withColumn("stock_code", F.col("stock_code").cast("string")), filings=listed).get_price_series("7", "1994-01-01", "1997-12-31")
    total = rounded(got["summary"], "period_return").where("stock_code = '7'").select("period_return")
    return got["prices"].join(F.broadcast(total)).select("trade_date", "close_price", "rank", "of", "period_return")  # one row on the right


@query("length_between", "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) BETWEEN 1000 AND 20000")
def length_between(spark, d):
    return table(spark, d, "documents").where(F.length("text").between(1000, 20000)).select("doc_id", F.length("text").cast("bigint").alias("chars"))
