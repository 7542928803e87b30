"""The six questions a client asks, as DataFrames, with texts for people."""

from __future__ import annotations

import datetime
import functools
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import code6, dashed_date, price_line, shorten
from .operators import evals as E
from .operators import graph as G
from .operators import market as M
from .operators import vectors as V

MOST_RESULTS, MOST_PRICE_ROWS, MOST_FILINGS = 20, 250, 30


@dataclass
class Calls:
    """Calls by tool and status, and their times."""

    log: list[tuple[str, str, float]] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, "tool string, status string, seconds double")


def counted(f: Callable) -> Callable:
    """Notes a call's time and whether it failed; errors go on to the caller."""

    @functools.wraps(f)
    def call(self, *args, **kwargs):
        began, status = time.perf_counter(), "error"
        try:
            out = f(self, *args, **kwargs)
            status = "ok"
            return out
        finally:
            self.calls.log.append((f.__name__, status, time.perf_counter() - began))

    return call


def a_date(x: str) -> datetime.date:
    try:
        return datetime.date.fromisoformat(x)
    except ValueError as e:
        raise ValueError(f"dates are written YYYY-MM-DD, not {x!r}") from e


class Engine:
    """Tools over nodes/edges, chunks with vectors, prices, filings and a universe; encode turns a question into a vector."""

    def __init__(self, spark: SparkSession, edges: DataFrame, chunks: DataFrame | None = None, prices: DataFrame | None = None, filings: DataFrame | None = None, universe: DataFrame | None = None, encode: Callable[[list[str]], list] = None):
        self.spark, self.edges, self.chunks, self.prices, self.filings, self.universe = spark, edges, chunks, prices, filings, universe
        self.encode = encode or V.hashing_model(64)
        self.calls = Calls()

    def _linked(self, text: str) -> DataFrame:
        names = self.edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
        q = self.spark.createDataFrame([(0, text)], "id int, question string")
        return G.mentioned(G.link(q, names), "id").select("name")

    @counted
    def list_companies(self) -> DataFrame:
        return self.universe.select(code6(F.col("stock_code")).alias("stock_code"), "corp_name", "sector").orderBy("stock_code")

    @counted
    def get_company_relations(self, company: str, hops: int = 1) -> DataFrame:
        """Evidence of one or two hops around the companies that the text names."""
        return G.search(self.edges, self._linked(company), hops).orderBy("rank", "depth", "text")

    @counted
    def find_connection(self, a: str, b: str) -> DataFrame:
        """Paths of at most two hops that hold both; without one, who deals with both."""
        evidence = G.search(self.edges, self._linked(f"{a} {b}"), 2)
        found = G.with_both(evidence, a, b).select("text", "rcept_no")
        if found.isEmpty():
            return G.shared_partners(evidence, a, b).select(F.concat(F.lit("both deal with "), "name").alias("text"), F.lit(None).cast("string").alias("rcept_no"))
        return found

    @counted
    def search_filings(self, query: str, limit: int = 5, company: str | None = None) -> DataFrame:
        """The nearest chunks (chunk_id, corp_name, content, embedding); company is matched without blanks and case, with its % and _ as themselves."""
        limit = max(1, min(MOST_RESULTS, limit))
        q = self.spark.createDataFrame([(0, [float(x) for x in self.encode([query])[0]])], "query_id int, query array<double>")
        where = None
        if company:
            name = F.lower(F.replace("corp_name", F.lit(" ")))
            where = F.contains(name, F.lit(company.replace(" ", "").lower()))
        near = V.top_k(self.chunks, q, limit, where, id_col="chunk_id")
        return near.join(self.chunks.select(F.col("chunk_id").alias("id"), "corp_name", "content"), "id").select("rank", "score", "corp_name", shorten(F.col("content")).alias("body")).orderBy("rank")

    @counted
    def get_price_series(self, stock_code: str, start: str, end: str) -> dict[str, DataFrame]:
        """prices (all, or the first and last ten of many), summary (period return), filings (the first thirty and their number)."""
        begin, stop = a_date(start), a_date(end)
        if begin > stop:
            raise ValueError("the start is after the end")
        code = stock_code.zfill(6)
        own = self.prices.where(code6(F.col("stock_code").cast("string")) == code)
        rows = M.in_period(own, "trade_date", F.lit(begin), F.lit(stop))
        listed = self.filings.where(code6(F.col("stock_code").cast("string")) == code)
        listed = M.in_period(listed, "rcept_dt", begin.strftime("%Y%m%d"), stop.strftime("%Y%m%d"))
        return {
            "prices": M.head_and_tail(rows, "stock_code", "trade_date", 10, MOST_PRICE_ROWS),
            "summary": M.period_return(own, start, end),
            "filings": M.first_of(listed, "stock_code", [F.col("rcept_dt"), F.col("rcept_no")], MOST_FILINGS).withColumn("day", dashed_date(F.col("rcept_dt"))),
        }

    def evaluate(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """(type, mode, hit_at_k, recall, n) of questions (id, type, question, gold) by vectors, by the graph, and by both."""
        names = self.edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
        seeds = G.link(questions.select("id", "question"), names).select("id", "name")
        graph = G.search_each(self.edges, seeds, "id").select("id", "pos", "text")
        vector = V.encoder_of(self.encode)
        asked = questions.select(F.col("id").alias("query_id"), vector(F.col("question")).alias("query"))
        near = V.top_k(self.chunks, asked, k, id_col="chunk_id")
        found = near.join(self.chunks.select(F.col("chunk_id").alias("id"), "content"), "id").select(F.col("query_id").alias("id"), F.col("rank").alias("pos"), F.col("content").alias("text"))
        return E.summarise(E.score_modes(questions.select("id", "type", "gold"), {"vector": found, "graph": graph}, "id"), ["type", "mode"])

    @counted
    def graph_overview(self) -> DataFrame:
        names = self.universe.select(F.col("corp_name").alias("name")) if self.universe is not None else self.spark.createDataFrame([], "name string")
        return G.overview(self.edges, names)


def as_text(found: DataFrame, column: str, nothing: str, most: int = 1000) -> str:
    """Lines for people; a sentence where there is nothing. Results of the tools are small."""
    lines = [r[0] for r in found.select(column).limit(most).collect()]
    return "\n".join(lines) if lines else nothing


def price_lines(prices: DataFrame) -> DataFrame:
    return prices.orderBy("trade_date").select(price_line(F.col("trade_date"), F.col("close_price"), F.col("volume"), F.col("change_rate") if "change_rate" in prices.columns else F.lit(None).cast("double")).alias("line"))
