"""Upserts, graph, vectors, evaluation, market, sources, streaming and the tools."""

import datetime
import json
import zipfile
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstrata import sources as S
from quillstrata import streaming as T
from quillstrata.api import Engine, as_text, price_lines
from quillstrata.operators import evals, graph, ingest, market, vector_index, vectors


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k int, v string, flag boolean")
    new = spark.createDataFrame([(2, "B", None), (3, "C", None)], "k int, v string, flag boolean")
    assert rows(ingest.upsert_last(old, new, ["k"], keep=["flag"]), "k") == [(1, "a", True), (2, "B", False), (3, "C", None)]
    assert rows(ingest.insert_absent(old, new.union(new), ["k"]).select("k", "v"), "k") == [(1, "a"), (2, "b"), (3, "C")]


def test_factors_equal_pandas(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame([(c, datetime.date(2024, 1, 1) + datetime.timedelta(d), float(rng.integers(0 if d == 5 else 1, 100)), float(rng.integers(1, 9))) for c in "ab" for d in range(90)], columns=["stock_code", "trade_date", "close_price", "trade_value"])
    got = market.factors(spark.createDataFrame(p)).toPandas().sort_values(["stock_code", "trade_date"]).reset_index(drop=True)
    g = p.groupby("stock_code")
    with np.errstate(divide="ignore", invalid="ignore"):
        ret = (p.close_price / g.close_price.shift(1).replace(0, np.nan)) - 1
        p["mom_20"], p["mom_60"] = p.close_price / g.close_price.shift(20).replace(0, np.nan) - 1, p.close_price / g.close_price.shift(60).replace(0, np.nan) - 1
    p["vol_20"] = ret.groupby(p.stock_code).transform(lambda x: x.rolling(20, min_periods=2).std())
    p["turnover_20"] = g.trade_value.transform(lambda x: x.rolling(20, min_periods=1).mean())
    want = p[p.mom_20.notna()].reset_index(drop=True)
    assert len(got) == len(want)
    for c in ("mom_20", "mom_60", "vol_20", "turnover_20"):
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-9, atol=1e-12)


EDGES = [("e1", "A", "SUPPLIES_TO", "B", "r1"), ("e2", "C", "INVESTS_IN", "B", None), ("e3", "A", "OFFICER_OF", "A", "r3"), ("e4", "B", "SUPPLIES_TO", "D", "r4")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "eid string, src string, rel string, dst string, rcept_no string")


def test_paths(spark, edges):
    found = graph.search(edges, spark.createDataFrame([("A",)], "name string"), 2)
    assert [(r["text"], r["rcept_no"]) for r in found.collect()] == [
        ("A -[SUPPLIES_TO]-> B", "r1"),
        ("A -[OFFICER_OF]-> A -[SUPPLIES_TO]-> B", "r3"),  # nodes may come again, edges not
        ("A -[SUPPLIES_TO]-> B -[SUPPLIES_TO]-> D", "r1"),
        ("A -[SUPPLIES_TO]-> B <-[INVESTS_IN]- C", "r1"),
    ]
    back = graph.search(edges, spark.createDataFrame([("D",)], "name string"), 1)
    assert [r["text"] for r in back.collect()] == ["D <-[SUPPLIES_TO]- B"]


def test_link_takes_the_longest_names(spark):
    q = spark.createDataFrame([(1, "does Alpha Beta deal with Gam?")], "id int, question string")
    names = spark.createDataFrame([("Alpha",), ("Alpha Beta",), ("Gamma",), ("Gam",), ("G",)], "name string")
    assert [r["name"] for r in graph.mentioned(graph.link(q, names), "id").orderBy("rank").collect()] == ["Alpha Beta", "Alpha", "Gam"]


def test_edges_and_nodes(spark):
    t = spark.createDataFrame([(1, "(주)A", "SUPPLIES_TO", "B", "r1", 5), (2, "(주)A", "SUPPLIES_TO", "B", "r1", None), (3, "A", "OFFICER_OF", "B", "r2", None), (4, "A", "OFFICER_OF", "B", "r1", None)], "triple_id int, subject string, predicate string, object string, rcept_no string, amount int")
    assert rows(graph.nodes(t), "name") == [("A", ["(주)A", "A"]), ("B", ["B"])]
    assert rows(graph.event_edges(t, "triple_id", ["amount"])) == [("A", "SUPPLIES_TO", "B", "r1", 5, 2)]
    assert rows(graph.state_edges(t, ["rcept_no", "triple_id"])) == [("A", "OFFICER_OF", "B", "r1", 4, 2)]


def test_load_graph(spark):
    """Spellings meet in one node, events are kept for each filing with the last known values, states once with the first evidence; followed companies are there without relations."""
    t = [(1, "(주)A", "SUPPLIES_TO", " B  Inc.", "r1", 5, None), (2, "A", "SUPPLIES_TO", "B", "r1", None, "n"), (3, "A Co., Ltd.", "SUPPLIES_TO", "B", "r2", 7, None), (5, "A", "SUBSIDIARY_OF", "B", "r1", 9, "x"), (4, "㈜A", "SUBSIDIARY_OF", "B", "r9", None, None), (6, None, "SUPPLIES_TO", "B", "r1", 1, None)]
    triples = spark.createDataFrame(t, "triple_id int, subject string, predicate string, object string, rcept_no string, amount int, note string")
    companies = spark.createDataFrame([("1", "주식회사 A", "000010", True), ("2", "C", "000020", True), ("3", "D", None, True), ("4", "E", "000040", False)], "corp_code string, corp_name string, stock_code string, in_universe boolean")
    nodes, edges = graph.load_graph(triples, companies, props=("amount", "note"))
    assert rows(nodes.select("name", "stock_code", "in_universe", F.size("aliases")), "name") == [("A", "000010", True, 5), ("B", None, False, 2), ("C", "000020", True, 1)]
    assert rows(edges.drop("eid"), "rel", "rcept_no") == [("A", "SUBSIDIARY_OF", "B", "r9", None, None, 2), ("A", "SUPPLIES_TO", "B", "r1", 5, "n", 2), ("A", "SUPPLIES_TO", "B", "r2", 7, None, 1)]
    assert edges.select("eid").distinct().count() == 3
    found = graph.search(edges, spark.createDataFrame([("A",)], "name string"), 1)
    assert [r["text"] for r in found.collect()] == ["A -[SUPPLIES_TO]-> B", "A -[SUBSIDIARY_OF]-> B"]


def test_link_equals_brute_force(spark):
    names = ["Gam", "Ga", "Gamma Ray", "Al pha", "Alphabet", "B", "(주) 가온", "가온전선", "na"]
    asked = ["who owns gam?", "Gamma", "is Alpha there", "가온 (주)", "", "Ga", "banana"]
    bare = lambda x: "".join(c for c in x if not c.isspace() and c not in "()")
    want = {(i, n) for i, q in enumerate(asked) for n in names if len(bare(n)) >= 2 and (bare(n) in bare(q) or (len(bare(n)) >= 4 and bare(n)[:4] in bare(q)))}
    df = spark.createDataFrame(list(enumerate(asked)), "id int, question string")
    got = [(r["id"], r["name"]) for r in graph.link(df, spark.createDataFrame([(n,) for n in names], "name string")).collect()]
    assert len(got) == len(want) and set(got) == want
    assert graph.link(df, spark.createDataFrame([("B",)], "name string")).count() == 0
    assert "NestedLoop" not in graph.link(df, spark.createDataFrame([("Gamma",)], "name string"))._jdf.queryExecution().executedPlan().toString()


def test_connections_and_relations(spark):
    e = [("e1", "Alpha Co", "SUPPLIES_TO", "Hub", "r1"), ("e2", "Beta", "SUPPLIES_TO", "Hub", "r2"), ("e3", "Alpha Co", "OWNS_STAKE", "Gamma", "r3"), ("e4", "Delta", "SUPPLIES_TO", "Other", "r4")]
    edges = spark.createDataFrame(e, "eid string, src string, rel string, dst string, rcept_no string")
    engine = Engine(spark, edges, universe=spark.createDataFrame([("1", "Nobody", "x")], "stock_code string, corp_name string, sector string"))
    assert [r["text"] for r in engine.get_company_relations("Alpha", 1).collect()] == ["Alpha Co -[SUPPLIES_TO]-> Hub", "Alpha Co -[OWNS_STAKE]-> Gamma"]
    assert "Alpha Co -[SUPPLIES_TO]-> Hub <-[SUPPLIES_TO]- Beta" in [r["text"] for r in engine.find_connection("AlphaCo", "Beta").collect()]
    assert engine.find_connection("Alpha", "Delta").count() == 0
    shared = graph.shared_partners(spark.createDataFrame([(["Alpha Co", "Hub"],), (["Hub", "B eta"],), (["Alpha Co", "X"],)], "entities array<string>"), "AlphaCo", "Beta")
    assert rows(shared) == [("Hub",)]
    assert rows(engine.graph_overview())[0] == (6, "Alpha Co")  # nobody followed is in the graph
    assert as_text(engine.find_connection("Alpha", "Delta"), "text", "no connection") == "no connection"


def test_three_ways_of_searching(spark, edges):
    model = vectors.hashing_model(64)
    chunks = spark.createDataFrame([(i, "n", t, [float(x) for x in model([t])[0]]) for i, t in enumerate(["Zeta makes steel", "a bank loan"])], "chunk_id int, corp_name string, content string, embedding array<double>")
    named = edges.withColumns({c: F.concat(F.lit("Firm"), c) for c in ("src", "dst")})
    q = spark.createDataFrame([("1", "multi_hop", "whom does FirmA supply", ["FirmB"]), ("2", "single_hop", "who makes steel", ["Zeta"])], "id string, type string, question string, gold array<string>")
    got = {(r["type"], r["mode"]): (r["hit_at_k"], r["n"]) for r in Engine(spark, named, chunks).evaluate(q, 1).collect()}
    assert got == {(t, m): (x, n) for t, n, hits in (("multi_hop", 1, (0, 1, 1)), ("single_hop", 1, (1, 0, 1)), ("all", 2, (0.5, 0.5, 1))) for m, x in zip(("vector", "graph", "hybrid"), hits)}


def test_counter_rate(spark):
    s = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1, 0, 0, k), v) for k, v in enumerate([5, 9, 2, 4])] + [("b", datetime.datetime(2024, 1, 1), 3)], "k string, ts timestamp, v int")
    assert rows(evals.counter_rate(s, ["k"], "ts", "v"), "k") == [("a", 8, 3.0, 8 / 3), ("b", 0, 0.0, None)]


def test_strict_zip(spark):
    from quillstrata.functions.text import zip_strict

    df = spark.createDataFrame([([1, 2], ["a", "b"]), (None, ["a"])], "a array<int>, b array<string>")
    assert [r[0] and [tuple(x) for x in r[0]] for r in df.select(zip_strict(F.col("a"), F.col("b"), ("x", "y"))).collect()] == [[(1, "a"), (2, "b")], None]
    with pytest.raises(Exception, match="arrays of 1 and 2"):
        spark.createDataFrame([([1], ["a", "b"])], "a array<int>, b array<string>").select(zip_strict(F.col("a"), F.col("b"), ("x", "y"))).collect()


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id int, embedding array<double>").repartition(5)
    q = df.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for r in vectors.top_k(df, q, 4).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("x")).collect():
        assert [x["id"] for x in r["x"]] == list(np.argsort(-(unit @ unit[r["query_id"]]), kind="stable")[:4])


def test_encoder_gives_unit_vectors(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "t string").select(vectors.norm(vectors.encoder(16)("t")).alias("n"))
    assert [round(r[0], 6) for r in df.collect()] == [1.0, 0.0, 0.0]


def test_questions(spark):
    q = spark.createDataFrame([(1, "multi_hop", ["(주)가온", "나래"]), (2, "single_hop", ["다솜"]), (3, "single_hop", [])], "id int, type string, gold array<string>")
    e = spark.createDataFrame([(1, 0, "A -> 가 온"), (2, 0, "nothing")], "id int, pos int, text string")
    got = evals.score_questions(q, e, ["id"])
    assert rows(got.select("id", "hit", "recall"), "id") == [(1, 1, 0.5), (2, 0, 0.0), (3, 0, 0.0)]
    assert rows(evals.summarise(got), "type") == [("all", 1 / 3, 0.5 / 3, 3), ("multi_hop", 1.0, 0.5, 1), ("single_hop", 0.0, 0.0, 2)]


def test_allocation_rounds_halves_to_even(spark):
    s = spark.createDataFrame([("a", 25), ("b", 75), ("c", 900)], "k string, n long")
    assert rows(evals.allocate(s, 100, 1).select("k", "take"), "k") == [("a", 2), ("b", 8), ("c", 90)]


def test_incremental(spark):
    runs = spark.createDataFrame([("j", "SUCCESS", "2024-01-05", 1), ("j", "FAILED", None, 2), ("j", "SUCCESS", "2024-01-03", 0)], "job_name string, status string, watermark string, started_at int")
    mark = ingest.latest_watermark(runs, "j")
    days = spark.createDataFrame([(f"2024-01-{d:02}",) for d in range(1, 11)], "day string").select(F.col("day").cast("date").alias("day"))
    assert ingest.next_slice(days, "day", mark, "2023-01-01", "2024-01-08").count() == 3
    assert ingest.next_slice(days, "day", mark, "2023-01-01", "2024-01-08", lookback=2).count() == 5
    assert ingest.next_slice(days, "day", ingest.latest_watermark(runs, "other"), "2024-01-09", "2024-01-31").count() == 2


def test_valid_filings(spark):
    f = spark.createDataFrame([("20260101000001", "20260101", " "), ("2026", "20260101", "1"), ("20260101000002", "2026-01-01", None), (None, None, None)], "rcept_no string, rcept_dt string, stock_code string")
    good, bad = ingest.valid_filings(f)
    assert rows(good) == [("20260101000001", "20260101", None)] and bad.count() == 3


def test_filing_source(spark, tmp_path):
    page = lambda k: {"status": "000", "total_page": 2, "list": [{"rcept_no": f"{k:014}", "corp_code": "1", "corp_name": "가온"}]}
    (tmp_path / "p.json").write_text(json.dumps([page(1), page(2)]), encoding="utf-8")
    got = S.read_filing_list(spark, f"file:{tmp_path}/p.json", corp_codes="00000001")
    assert [r["rcept_no"] for r in got.collect()] == ["00000000000001", "00000000000002"]
    assert list(S.pages_of(lambda p: {"status": "013"}, {})) == []
    with pytest.raises(RuntimeError):
        list(S.pages_of(lambda p: {"status": "020", "message": "limit"}, {}))
    assert list(S.pages_of(lambda p: {"status": "000"}, {})) == []
    (tmp_path / "short.json").write_text(json.dumps([page(1)]), encoding="utf-8")  # says two pages, has one
    assert S.read_filing_list(spark, f"file:{tmp_path}/short.json").count() == 1
    options = {"url": "u", "begin": "20260101", "end": "20260131", "corp_codes": "1,2", "types": "I", "credential": "s", "credential_name": "crtfc", "begin_name": "bgn", "end_name": "fin", "type_name": "ty"}
    assert [p.params for p in S.FilingReader(options).partitions()] == [{"bgn": "20260101", "fin": "20260131", "crtfc": "s", "corp_code": c, "ty": "I"} for c in "12"]
    pages = spark.createDataFrame([(json.dumps(page(3)),), ('{"status":"013"}',)], "body string")
    assert [r["rcept_no"] for r in S.filings_from_pages(pages).collect()] == ["00000000000003"]


def test_retries():
    tries, waits = [], []

    def fails():
        tries.append(1)
        raise OSError("no")

    with pytest.raises(OSError):
        S.with_retries(fails, sleep=waits.append)
    assert len(tries) == 3 and waits == [1.0, 2.0]


def test_company_master(spark, tmp_path):
    rec = "<list><corp_code>{}</corp_code><corp_name>{}</corp_name><stock_code>{}</stock_code><modify_date>20260101</modify_date></list>"
    (tmp_path / "c.xml").write_text("<result>" + rec.format("00000001", "old", " ") + rec.format("00000001", "new", "000010") + rec.format("00000002", "x", " ") + "</result>", encoding="utf-8")
    assert rows(S.read_company_master(spark, f"{tmp_path}/c.xml"), "corp_code") == [("00000001", "new", "000010", "20260101"), ("00000002", "x", None, "20260101")]


def test_zipped_company_master(spark, tmp_path):
    rec = "<list><corp_code> {} </corp_code><corp_name>{}</corp_name><stock_code> </stock_code></list>"
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("C.xml", "<result>" + "".join(rec.format(f"{k % 50:08}", f"n{k}") for k in range(120)) + "</result>")
    got = {r["corp_code"]: r["corp_name"] for r in S.read_company_master(spark, f"{tmp_path}/c.zip").collect()}
    assert got == {f"{k % 50:08}": f"n{k}" for k in range(120)}
    (tmp_path / "bad.xml").write_text("<result>" + rec.format("123", "x") + "</result>", encoding="utf-8")
    with pytest.raises(Exception, match="company code of the master: 123"):
        S.read_company_master(spark, f"{tmp_path}/bad.xml").collect()


def test_documents_by_number(spark, tmp_path):
    def fetch(number):
        import io
        import zipfile as zf

        if number == "3":
            raise OSError("no answer")
        out = io.BytesIO()
        with zf.ZipFile(out, "w") as z:
            if number != "2":
                z.writestr("a.xml", "long" * 9)
                z.writestr(f"{number}.xml", "own")
        return b"<status>" if number == "4" else out.getvalue()

    got = S.fetch_documents(spark, spark.createDataFrame([(x,) for x in "1234"], "rcept_no string"), fetch, pause=0)
    assert [(r["rcept_no"], r["raw"] if r["raw"] is None else bytes(r["raw"]), r["error"]) for r in got.orderBy("rcept_no").collect()] == [("1", b"own", None), ("2", b"", None), ("3", None, "no answer"), ("4", None, "<status>")]
    good = bytearray(fetch("1"))
    at = good.index(b"own")
    good[at : at + 3] = b"xxx"
    assert S.unzipped("1", bytes(good))[0] is None and S.unzipped("1", bytes(good))[1].startswith("Bad") or S.unzipped("1", bytes(good))[1]


def test_json_and_jdbc(spark, tmp_path):
    S.write_json(spark.range(3), f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 3
    with pytest.raises(Exception, match="(?i)driver"):  # no database here: the call gets as far as looking for its driver
        S.read_jdbc(spark, "jdbc:none://x", "t", "id", 0, 9, 3)


def test_documents(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "20260101000001.zip", "w") as z:
        z.writestr("big.xml", "x" * 99)
        z.writestr("20260101000001.xml", "own")
    (tmp_path / "20260101000002.zip").write_bytes(b"<error>")
    assert [(r["rcept_no"], r["raw"] and bytes(r["raw"]), r["error"]) for r in S.read_documents(spark, str(tmp_path)).orderBy("rcept_no").collect()] == [("20260101000001", b"own", None), ("20260101000002", None, "<error>")]


def test_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text("날짜,시가,고가,저가,종가,거래량,등락률\n2026-01-02,1,2,1,2,10,NaN\n", encoding="utf-8")
    got = S.read_prices_csv(spark, f"{tmp_path}/p.csv", "5930").first()
    assert (got["stock_code"], got["close_price"], got["trade_value"], got["change_rate"]) == ("005930", 2, None, None)
    (tmp_path / "u.csv").write_text("stock_code,corp_name,sector\n5930,a,b\n", encoding="utf-8")
    assert S.read_universe(spark, f"{tmp_path}/u.csv").first()["stock_code"] == "005930"
    assert S.read_universe(spark, f"{tmp_path}/none.csv").count() == 0
    (tmp_path / "q.jsonl").write_text('{"id":"1","type":"t","question":"q","gold":["g"]}\n\n', encoding="utf-8")
    assert S.read_questions(spark, f"{tmp_path}/q.jsonl").count() == 1
    assert S.write_parquet(spark.range(7), f"{tmp_path}/out") == 7
    S.write_csv(spark.range(3), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 3


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src, out, runs = (str(tmp_path / x) for x in ("in", "out", "runs"))
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").coalesce(1).write.parquet(src)
    start = lambda name: T.ingest_new(T.read_files(spark, src, "k string, v int"), out, ["k"], str(tmp_path / name), runs=runs).awaitTermination()
    start("c1")
    spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int").coalesce(1).write.mode("append").parquet(src)
    start("c1")
    start("c2")  # all files once more
    assert rows(spark.read.parquet(out), "k") == [("a", 1), ("b", 2), ("c", 4)]
    log = spark.read.parquet(runs)
    assert log.where("status = 'SUCCESS'").count() == 3 and ingest.latest_watermark(log.where("row_count > 0"), "ingest").first()[0] == "c"

    def broken(batch):
        raise RuntimeError("bad batch")

    with pytest.raises(Exception, match="bad batch"):
        T.ingest_new(T.read_files(spark, src, "k string, v int"), out, ["k"], str(tmp_path / "c3"), runs=runs, each=broken).awaitTermination()
    assert spark.read.parquet(runs).where("status = 'FAILED' AND watermark IS NULL").count() == 1


def test_rates_as_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    q = T.rates(T.read_files(spark, f"{tmp_path}/e", events.schema), ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM rates").first()[0] == 5 * events.count()


def test_tools(spark, edges):
    prices = spark.createDataFrame([("10", datetime.date(2024, 1, d), float(d), 5.0) for d in range(1, 29)], "stock_code string, trade_date date, close_price double, volume double")
    filings = spark.createDataFrame([("000010", f"2024010{d}", f"r{d}") for d in range(1, 10)], "stock_code string, rcept_dt string, rcept_no string")
    model = vectors.hashing_model(64)
    chunks = spark.createDataFrame([(i, n, t, [float(x) for x in model([t])[0]]) for i, (n, t) in enumerate([("A corp", "steel supply deal"), ("B 100%", "bank loan"), ("B corp", "steel mill")])], "chunk_id int, corp_name string, content string, embedding array<double>")
    universe = spark.createDataFrame([("10", "A", "steel"), ("20", "Z", "bank")], "stock_code string, corp_name string, sector string")
    e = Engine(spark, edges, chunks, prices, filings, universe)
    assert rows(e.list_companies())[0] == ("000010", "A", "steel")
    assert rows(e.graph_overview()) == [(4, "A")]
    assert e.search_filings("steel supply deal", 99).first()["corp_name"] == "A corp"
    assert [r["corp_name"] for r in e.search_filings("steel", 5, "b c").collect()] == ["B corp"]
    assert e.search_filings("steel", 5, "%").count() == 1
    got = e.get_price_series("10", "2024-01-02", "2024-01-20")
    assert got["summary"].first()["period_return"] == 9.0 and got["prices"].count() == 19 and got["filings"].count() == 8
    assert "close" in as_text(price_lines(got["prices"]), "line", "none")
    with pytest.raises(ValueError, match="YYYY"):
        e.get_price_series("10", "2024/01/02", "2024-01-20")
    with pytest.raises(ValueError, match="after"):
        e.get_price_series("10", "2024-02-02", "2024-01-20")
    assert e.calls.frame(spark).where("status = 'error'").count() == 2


def test_top_k_of_many_queries_in_blocks(spark, monkeypatch):
    from quillstrata.operators import vectors

    rows = spark.range(60).selectExpr("id AS vec_id", "array(sin(id), cos(id), sin(3 * id)) AS embedding")
    queries = rows.selectExpr("vec_id AS query_id", "embedding AS query")
    whole = sorted(map(tuple, vectors.top_k(rows, queries, 3).collect()))
    monkeypatch.setattr(vectors, "QUERY_BYTES", 1000)
    assert len(whole) == 180 and sorted(map(tuple, vectors.top_k(rows, queries, 3).collect())) == whole


def test_top_k_of_odd_vectors_equals_every_pair_scored(spark, monkeypatch):
    """Nulls, lengths, zeros, tiny and huge vectors, no numbers, copies, opposite and nearly equal ones, null and repeated ids; as the expressions score them."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 5))
    made = [list(map(float, x)) for x in np.concatenate([base, base[:20], -base[:9], base[:20] * 3, base[:20] + rng.normal(size=(20, 5)) * 1e-8, base[:5] * 1e-9, base[:5] * 1e-4, base[:5] * 1e150, np.zeros((9, 5))])]
    made += [None, [], [1.0], [1.0, 2.0], [None] * 5, [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf"), 1.0, 0.0, 0.0, 0.0]] * 2
    ids = [int(x) for x in rng.permutation(len(made))]
    rows = spark.createDataFrame([(None if i == 7 else i // 2 if i > 140 else i, v) for i, v in zip(ids, made)], "vec_id int, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(list(enumerate(made)), "query_id int, query array<double>")
    plain = lambda df: Counter((r["query_id"], r["id"], repr(r["score"]), r["rank"]) for r in df.collect())
    tables = [pa.Table.from_batches(x.combine_chunks().to_batches(max_chunksize=50)) for x in (rows.select(F.col("vec_id").cast("long"), "embedding").where(f"pmod(hash(vec_id), 2) = {n}").toArrow() for n in (0, 1))]
    for k in (1, 4, 200):
        want = plain(vectors._nearest_by_any_id(rows, queries, k, "vec_id", "embedding"))
        assert plain(vectors._nearest(rows, queries, k, "vec_id", "embedding")) == want
        for first, queries_at_once in ((4, 7), (16, 512)):
            monkeypatch.setattr(vectors, "FIRST_ROWS", first)
            monkeypatch.setattr(vectors, "BLOCK_QUERIES", queries_at_once)
            best = pa.Table.from_batches([b for t in tables for b in vectors._search(iter(t.to_batches()), queries.toArrow().combine_chunks(), k)]).combine_chunks()
            assert plain(vectors._ranked(spark.createDataFrame(best), k)) == want


def test_top_k_scores_few_pairs_one_by_one(spark, monkeypatch):
    """Most of 20 M pairs are left out by blocks of products."""
    rows = spark.range(40_000).selectExpr("id AS vec_id", "transform(sequence(1, 16), x -> sin(id * x * 0.37 + x)) AS embedding").localCheckpoint()
    queries = rows.where("vec_id % 80 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    seen = []
    put = vectors._Best._put
    monkeypatch.setattr(vectors._Best, "_put", lambda self, held, *a: (seen.append(sum(len(x) for x, _ in held)), put(self, held, *a))[1])
    table = rows.toArrow().combine_chunks()
    found = list(vectors._search(iter(table.to_batches(max_chunksize=10_000)), queries.toArrow().combine_chunks(), 5))
    assert sum(seen) < 0.01 * 500 * 40_000 and sum(b.num_rows for b in found) == 2500
    assert vectors.top_k(rows, queries, 5).where("rank = 1 AND query_id = id").count() == 500


@pytest.fixture(scope="module")
def clustered(spark):
    """600 vectors around 12 centres; a third of all rows are copies of one vector; a null and one of another length."""
    rng = np.random.default_rng(3)
    around = np.repeat(rng.normal(size=(12, 16)), 50, axis=0) + 0.4 * rng.normal(size=(600, 16))
    made = [(k, [float(x) for x in v]) for k, v in enumerate(around)] + [(1000 + k, [float(x) for x in around[7]]) for k in range(300)]
    return spark.createDataFrame([*made, (5000, None), (5001, [1.0])], "vec_id long, embedding array<double>")


def test_vector_index_holds_every_row_and_finds_the_nearest(spark, clustered, tmp_path):
    queries = clustered.where("vec_id % 10 = 3 and vec_id < 600").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vector_index.build(clustered)
    assert sorted(r[0] for r in index.rows.where("cell is not null").select("vec_id").collect()) == sorted(r[0] for r in clustered.select("vec_id").collect())
    assert index.probes < len(index.centroids)
    true = {(r["query_id"], r["id"]) for r in vectors.top_k(clustered, queries, 5).collect()}
    found = vector_index.search(index, queries, 5).collect()
    assert len(found) == len(true) and len(true & {(r["query_id"], r["id"]) for r in found}) >= 0.9 * len(true)
    vector_index.save(index, str(tmp_path / "index"))
    again = vector_index.load(spark, str(tmp_path / "index"))
    assert again.probes == index.probes and sorted(map(tuple, vector_index.search(again, queries, 5).select("query_id", "id", "rank").collect())) == sorted((r["query_id"], r["id"], r["rank"]) for r in found)


def test_vector_index_filter_blocks_and_empty_tables(spark, clustered, monkeypatch):
    index = vector_index.build(clustered)
    queries = clustered.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    only = vector_index.search(index, queries, 3, where=F.col("vec_id") < 20)
    assert {r["id"] for r in only.collect()} <= set(range(20))
    whole = sorted(map(tuple, vector_index.search(index, queries, 3).collect()))
    monkeypatch.setattr(vector_index, "QUERY_BYTES", 20_000)
    assert sorted(map(tuple, vector_index.search(index, queries, 3).collect())) == whole
    none = vector_index.build(clustered.limit(0))
    assert vector_index.search(none, queries, 3).count() == 0 and vector_index.search(index, queries.limit(0), 3).count() == 0


def test_patterns_of_relations(spark):
    e = spark.createDataFrame([("p", "GUARANTEES", "s"), ("s", "SUBSIDIARY_OF", "p"), ("p", "GUARANTEES", "x"), ("y", "SUBSIDIARY_OF", "p"), ("p", "SUPPLIES_TO", "c"), ("q", "SUPPLIES_TO", "c"), ("q", "SUPPLIES_TO", "d"), ("q", "SUPPLIES_TO", "d"), ("p", "SUPPLIES_TO", "y")], "src string, rel string, dst string")
    assert rows(graph.pattern_both(e, "GUARANTEES", "SUBSIDIARY_OF", turned=True)) == [("p", "s")]
    assert rows(graph.pattern_both(e, "GUARANTEES", "SUBSIDIARY_OF")) == []
    assert rows(graph.pattern_path(e, "SUBSIDIARY_OF", "SUPPLIES_TO"), "start", "end") == [("s", "p", "c"), ("s", "p", "y"), ("y", "p", "c")]
    assert rows(graph.pattern_common(e, "SUPPLIES_TO", ["p", "q", "q"])) == [("c",)]
    assert rows(graph.pattern_common(e, "SUPPLIES_TO", ["c", "d"], incoming=True)) == [("q",)]
