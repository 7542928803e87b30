"""Daily jobs on Parquet folders: watermarks, failures, idempotence."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstrata import sources as S
from quillstrata.plans import daily as D

DAY = datetime.date


def filings(spark, *numbers):
    cols = "rcept_no string, corp_code string, corp_name string, stock_code string, report_nm string, rcept_dt string, flr_nm string, rm string"
    return spark.createDataFrame([(n, "00000001", " 가온 ", " ", "단일판매ㆍ공급계약체결", "20260101", None, None) for n in numbers], cols)


def test_filings(spark, tmp_path):
    store, asked = D.Store(spark, str(tmp_path)), []

    def fetch(begin, end):
        asked.append((begin, end))
        return filings(spark, "20260101000001", "20260101000002", "bad")

    assert D.ingest_filings(store, fetch, DAY(2026, 1, 5)) == 2
    assert D.ingest_filings(store, fetch, DAY(2026, 1, 5)) is None
    assert D.ingest_filings(store, fetch, DAY(2026, 1, 7)) == 0
    assert asked == [(D.FIRST_FILINGS, DAY(2026, 1, 5)), (DAY(2026, 1, 6), DAY(2026, 1, 7))]
    got = store.read("filing", D.FILING)
    assert got.count() == 2 and got.where("corp_name = '가온' AND stock_code IS NULL AND raw_json LIKE '%가온%'").count() == 2
    assert spark.read.parquet(f"{tmp_path}/filing_rejected").count() == 2

    def broken(begin, end):
        raise OSError("service away")

    with pytest.raises(OSError):
        D.ingest_filings(store, broken, DAY(2026, 1, 9))
    runs = store.read("etl_run", D.RUN)
    assert runs.where("status = 'FAILED' AND watermark IS NULL AND error_msg = 'service away'").count() == 1 and runs.count() == 3
    assert D.ingest_filings(store, fetch, DAY(2026, 1, 9)) == 0 and asked[-1][0] == DAY(2026, 1, 8)


def test_companies(spark, tmp_path):
    store = D.Store(spark, str(tmp_path))
    master = lambda *rows: spark.createDataFrame(rows, "corp_code string, corp_name string, stock_code string, modify_date string")
    D.sync_companies(store, master(("00000001", "old", None, "20260101")))
    store.replace("corp", store.read("corp", D.CORP).withColumn("in_universe", F.lit(True)))
    D.sync_companies(store, master(("00000001", "new", "000010", "20260102"), ("00000002", "x", None, "20260102")))
    assert sorted((r["corp_name"], r["in_universe"]) for r in store.read("corp", D.CORP).collect()) == [("new", True), ("x", False)]


def test_filings_wait_for_the_master(spark, tmp_path):
    store, asked = D.Store(spark, str(tmp_path)), []

    def fetch(begin, end):
        asked.append(store.read("corp", D.CORP).count())
        return filings(spark, "20260101000001")

    def away():
        raise OSError("service away")

    with pytest.raises(OSError):
        D.daily_filings(store, away, fetch, DAY(2026, 1, 5))
    assert not asked and store.read("filing", D.FILING).count() == 0
    master = lambda: spark.createDataFrame([("00000001", "x", None, "20260101")], "corp_code string, corp_name string, stock_code string, modify_date string")
    assert D.daily_filings(store, master, fetch, DAY(2026, 1, 5)) == 1 and asked == [1]


def test_prices_keep_what_worked(spark, tmp_path):
    store = D.Store(spark, str(tmp_path))

    def one(code, begin, end):
        if code == "000020":
            raise OSError("no such security")
        if code == "000030":
            return pd.DataFrame()
        return pd.DataFrame({"날짜": ["2026-01-02", "2026-01-05"], "시가": [1, 2], "고가": [1, 2], "저가": [1, 2], "종가": [1, 2], "거래량": [5, float("nan")], "등락률": [0.5, float("nan")]})

    codes = spark.createDataFrame([("000010",), ("000020",), ("000030",)], "stock_code string")
    fetch = lambda a, b: S.fetch_prices(spark, codes, one, a, b, pause=0)
    for _ in range(2):
        with pytest.raises(RuntimeError, match="000020: no such security"):
            D.ingest_prices(store, fetch, DAY(2026, 1, 6))
    got = store.read("price_daily", D.PRICE).orderBy("trade_date").collect()
    assert [(r["stock_code"], str(r["trade_date"]), r["close_price"], r["volume"]) for r in got] == [("000010", "2026-01-02", 1, 5), ("000010", "2026-01-05", 2, None)]
    assert D.ingest_prices(store, lambda a, b: S.fetch_prices(spark, codes.where("stock_code <> '000020'"), one, a, b, pause=0), DAY(2026, 1, 6)) == 0


def test_relations(spark, tmp_path):
    store = D.Store(spark, str(tmp_path))
    D.ingest_filings(store, lambda a, b: filings(spark, "20260101000001", "20260101000002"), DAY(2026, 1, 5))
    text = F.when(F.col("rcept_no") == "20260101000001", "3. 계약상대\n나래").cast("string")
    store.replace("filing", store.read("filing", D.FILING).withColumn("doc_text", text))
    assert D.extract_relations(store) == 1 and D.extract_relations(store) == 0
    r = store.read("kg_triple", D.TRIPLE).first()
    assert (r["subject_name"], r["predicate"], r["object_name"], r["props_json"]) == ("가온", "SUPPLIES_TO", "나래", "{}")


def test_replaced_tables_are_whole(spark, tmp_path):
    """A version that was not finished is not read; the last but one is kept."""
    import os

    store = D.Store(spark, str(tmp_path))
    assert store.read("corp", D.CORP).count() == 0
    for k in (1, 2, 3):
        store.replace("corp", spark.range(k).selectExpr("cast(id as string) AS corp_code", "'' AS corp_name", "'' AS stock_code", "'' AS modify_date", "true AS in_universe"))
        assert store.read("corp", D.CORP).count() == k
    os.mkdir(tmp_path / "corp" / "v4")
    assert store.read("corp", D.CORP).count() == 3 and sorted(os.listdir(tmp_path / "corp")) == ["v2", "v3", "v4"]


def test_graph_and_chunks_of_stored_filings(spark, tmp_path):
    store = D.Store(spark, str(tmp_path))
    text = "3. 계약상대\n(주)나래\n계약금액(원)\n1,000"
    store.append("filing", spark.createDataFrame([(f"{k:014}", "1", "가온", "000010", "단일판매ㆍ공급계약체결", "20260101", None, None, "{}", text if k < 2 else None, None) for k in range(3)], D.FILING))
    store.append("corp", spark.createDataFrame([("1", "주식회사 가온", "000010", "x", True)], D.CORP))
    assert D.extract_relations(store) == 2 and D.extract_relations(store) == 0
    assert D.load_relations(store) == (2, 2)
    edge = spark.read.parquet(store.path("graph_edge")).first()
    assert (edge["src"], edge["dst"], int(edge["amount_krw"])) == ("가온", "나래", 1000)
    assert D.embed_filings(store) == 2 and D.embed_filings(store) == 0
