"""Sources and sinks: company master, filing lists, documents, prices, universes, questions; Parquet, CSV and JSON."""

from __future__ import annotations

import io
import json
import time
import urllib.parse
import urllib.request
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import code6, strip
from ..session import checkpoints, ship

# Answers of the filing service.
OK, NO_DATA = "000", "013"
FILING = "rcept_no string, corp_code string, corp_name string, stock_code string, report_nm string, rcept_dt string, flr_nm string, rm string"
#: Korean headers of price tables and their names here.
PRICE_COLUMNS = {"날짜": "trade_date", "시가": "open_price", "고가": "high_price", "저가": "low_price", "종가": "close_price", "거래량": "volume", "거래대금": "trade_value", "등락률": "change_rate"}


def with_retries(call, attempts: int = 3, most_wait: float = 10.0, sleep=time.sleep):
    """call(), again after 1, 2, 4 ... seconds on errors; the last error is raised."""
    for k in range(attempts):
        try:
            return call()
        except OSError:
            if k == attempts - 1:
                raise
            sleep(min(most_wait, 2.0**k))


def get_bytes(url: str, params: dict, timeout: int = 30) -> bytes:
    """GET with up to three attempts; answers of errors, too, are attempts that failed."""

    def call() -> bytes:
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=timeout) as r:
            return r.read()

    return with_retries(call)


def pages_of(fetch, params: dict) -> Iterator[dict]:
    """Rows of all pages: fetch(params with page_no) gives {status, total_page, message, list}. No data, or a page without a list, gives nothing; other states are errors."""
    page, total = 1, 1
    while page <= total:
        got = fetch(params | {"page_no": page, "page_count": 100})
        if got.get("status", "") == NO_DATA:
            return
        if got.get("status", "") != OK:
            raise RuntimeError(f"filing list: {got.get('status', '')} {got.get('message', '')}")
        yield from got.get("list") or []
        total = int(got.get("total_page", 1))
        page += 1


class _Part(InputPartition):
    def __init__(self, params: dict):
        self.params = params


class FilingReader(DataSourceReader):
    """One partition for each company and filing type; pages are read within it.

    Options: url, begin, end, corp_codes and types (lists with commas); credential and credential_name, the parameter that carries it; and
    begin_name, end_name, corp_name, type_name where a service calls these parameters something else."""

    def __init__(self, options: dict):
        self.url = options["url"]
        named = lambda k, usual: options.get(f"{k}_name") or usual
        self.base = {named(k, k): options[k] for k in ("begin", "end") if k in options}
        if options.get("credential"):
            self.base[named("credential", "key")] = options["credential"]
        self.corp, self.type = named("corp", "corp_code"), named("type", "type")
        self.corps = (options.get("corp_codes") or "").split(",")
        self.types = (options.get("types") or "").split(",")

    def partitions(self) -> list[InputPartition]:
        return [_Part(self.base | ({self.corp: c} if c else {}) | ({self.type: t} if t else {})) for c in self.corps for t in self.types]

    def read(self, partition):
        names = [x.split(" ")[0] for x in FILING.split(", ")]
        if self.url.startswith("file:"):  # recorded answers: a JSON list of pages
            with open(self.url[5:], encoding="utf-8") as f:
                recorded = json.load(f)
            fetch = lambda p: recorded[p["page_no"] - 1] if p["page_no"] <= len(recorded) else {"status": NO_DATA}
        else:
            fetch = lambda p: json.loads(get_bytes(self.url, p))
        for row in pages_of(fetch, partition.params):
            yield tuple(row.get(n) for n in names)


class FilingSource(DataSource):
    """spark.read.format('filing_list').option('url', ...): a paged filing service or recorded pages."""

    @classmethod
    def name(cls) -> str:
        return "filing_list"

    def schema(self) -> str:
        return FILING

    def reader(self, schema) -> DataSourceReader:
        return FilingReader(self.options)


def read_filing_list(spark: SparkSession, url: str, **options) -> DataFrame:
    ship(spark)
    spark.dataSource.register(FilingSource)
    return spark.read.format("filing_list").option("url", url).options(**options).load()


def filings_from_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """Pages already stored as JSON text, one for each row, to filing rows; pages in other states are errors."""
    row = ", ".join(x.replace(" ", ":") for x in FILING.split(", "))
    got = pages.select(F.from_json(body, f"status string, message string, total_page int, list array<struct<{row}>>").alias("p"))
    failed = F.raise_error(F.concat(F.lit("filing list: "), F.col("p.status"), F.lit(" "), F.coalesce("p.message", F.lit(""))))
    rows = F.when(F.col("p.status") == OK, F.col("p.list")).when(F.col("p.status") == NO_DATA, F.slice("p.list", 1, 0)).otherwise(failed)
    return got.select(F.explode(rows).alias("f")).select("f.*")


def _records(raw: bytes) -> Iterator[tuple]:
    """The master's records, from XML or a zip archive whose first member is it."""
    if raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            raw = z.read(z.namelist()[0])
    for _, el in ElementTree.iterparse(io.BytesIO(raw)):
        if el.tag == "list":
            yield tuple(el.findtext(c) for c in ("corp_code", "corp_name", "stock_code", "modify_date"))
            el.clear()


def read_company_master(spark: SparkSession, path: str) -> DataFrame:
    """Company master, XML or zipped XML; blank codes are null, of several records of one company the last in the file counts. Company codes that aren't 8 characters long are an error."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in part.itertuples(index=False):
                rows = [(name, at, *r) for at, r in enumerate(_records(content))]
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[k : k + 10_000], columns=["path", "at", "corp_code", "corp_name", "stock_code", "modify_date"])

    rows = files.mapInPandas(parse, "path string, at long, corp_code string, corp_name string, stock_code string, modify_date string")
    rows = rows.select("path", "at", *(strip(F.col(c)).alias(c) for c in ("corp_code", "corp_name", "stock_code", "modify_date")))
    rows = rows.withColumns({"stock_code": F.nullif(F.col("stock_code"), F.lit("")), "corp_code": F.coalesce("corp_code", F.lit(""))})
    last = rows.groupBy("corp_code").agg(F.max_by(F.struct("corp_name", "stock_code", "modify_date"), F.struct("path", "at")).alias("r"))
    code = F.when(F.length("corp_code") == 8, F.col("corp_code")).otherwise(F.raise_error(F.concat(F.lit("company code of the master: "), "corp_code")))
    return last.select(code.alias("corp_code"), "r.*")


def unzipped(number: str, content: bytes) -> tuple[bytes | None, str | None]:
    """(document, error) of an archive: the member that begins with the number, else the largest; none gives an empty document. What can't be read gives its reason, or its first 300 bytes."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            own = [i for i in z.infolist() if i.filename.startswith(number)] or sorted(z.infolist(), key=lambda i: -i.file_size)
            return (z.read(own[0]) if own else b""), None
    except zipfile.BadZipFile:
        return None, content[:300].decode("utf-8", "replace")
    except (ValueError, RuntimeError, NotImplementedError, EOFError, OSError, zlib.error) as e:  # damaged, encrypted or unknown members
        return None, f"{type(e).__name__}: {e}"


_DOCUMENT = "rcept_no string, raw binary, error string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Zipped documents to (rcept_no, raw, error); the number is in the archive's name. Archives that can't be read give a row with an error."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([0-9A-Za-z_]+)\.[^./]*$", 1).alias("rcept_no"), "content")

    def unzip(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(n, *unzipped(n, c)) for n, c in part.itertuples(index=False)], columns=["rcept_no", "raw", "error"])

    return files.mapInPandas(unzip, _DOCUMENT)


def document_service(url: str, credential: str, credential_name: str = "key", number_name: str = "rcept_no") -> Callable[[str], bytes]:
    """fetch(number) of a service that gives one document's archive."""
    return lambda number: get_bytes(url, {credential_name: credential, number_name: number})


def fetch_documents(spark: SparkSession, numbers: DataFrame, fetch: Callable[[str], bytes], pause: float = 0.2) -> DataFrame:
    """(rcept_no, raw, error) of the numbers (rcept_no), by fetch(number). A document that fails gives a row with an error and the others go on.

    Calls run on the executors, one after another within a partition, and once only: what they gave is checkpointed."""
    ship(spark)
    checkpoints(spark)

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for number in part["rcept_no"]:
                try:
                    row = (number, *unzipped(number, fetch(number)))
                except Exception as e:
                    row = (number, None, str(e) or type(e).__name__)
                yield pd.DataFrame([row], columns=["rcept_no", "raw", "error"])
                time.sleep(pause)

    return numbers.select("rcept_no").mapInPandas(call, _DOCUMENT).checkpoint()


def clean_prices(raw: DataFrame, stock_code: str | Column) -> DataFrame:
    """Price tables with Korean headers: renamed, whole numbers as such, NaN as null; missing optional columns are null."""
    out = raw.withColumnsRenamed({k: v for k, v in PRICE_COLUMNS.items() if k in raw.columns})
    number = lambda c, t: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).cast(t).alias(c) if c in out.columns else F.lit(None).cast(t).alias(c)
    code = F.lit(stock_code) if isinstance(stock_code, str) else stock_code
    return out.select(code6(code).alias("stock_code"), F.col("trade_date").cast("date").alias("trade_date"), *(number(c, "long") for c in ("open_price", "high_price", "low_price", "close_price", "volume")), number("trade_value", "decimal(20,0)"), number("change_rate", "decimal(8,4)"))


def read_prices_csv(spark: SparkSession, path: str, stock_code: str) -> DataFrame:
    return clean_prices(spark.read.option("header", True).csv(path), stock_code)


def fetch_prices(spark: SparkSession, codes: DataFrame, fetch, begin, end, pause: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(prices, errors) of many securities: fetch(code, begin, end) gives a table with Korean or standard headers, empty where there is nothing. A security that fails is reported and the others go on.

    Calls run on the executors, one after another within a partition, `pause` seconds apart, and once only: what they gave is checkpointed."""
    ship(spark)
    checkpoints(spark)
    names = [PRICE_COLUMNS[k] for k in PRICE_COLUMNS]

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for code in part["stock_code"]:
                try:
                    got = fetch(code, begin, end).rename(columns=PRICE_COLUMNS)
                    got = got.reindex(columns=names).assign(stock_code=code, error=None)
                    got["trade_date"] = got["trade_date"].astype(str)
                    yield got[["stock_code", "error", *names]]
                except Exception as e:
                    yield pd.DataFrame([[code, str(e) or type(e).__name__, *[None] * len(names)]], columns=["stock_code", "error", *names])
                time.sleep(pause)

    schema = "stock_code string, error string, trade_date string, " + ", ".join(f"{n} double" for n in names[1:])
    raw = codes.select("stock_code").mapInPandas(call, schema).checkpoint()
    return clean_prices(raw.where("error IS NULL").drop("error"), F.col("stock_code")), raw.where("error IS NOT NULL").select("stock_code", "error")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Universe CSV (stock_code, corp_name, sector), codes of six digits; an absent file gives no rows."""
    schema = "stock_code string, corp_name string, sector string"
    try:
        rows = spark.read.schema(schema).option("header", True).csv(path)
        return rows.withColumn("stock_code", code6(F.col("stock_code")))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions from JSON lines; blank lines are skipped."""
    return spark.read.schema("id string, type string, question string, gold array<string>, why string").json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower, upper, parts: int, fetch: int = 10_000, **options) -> DataFrame:
    """A JDBC table in `parts` ranges of a column, so that more than one executor reads it."""
    own = {"url": url, "dbtable": table, "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(parts), "fetchsize": str(fetch)}
    return spark.read.format("jdbc").options(**own, **options).load()


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> int:
    """Overwrites path and tells how many rows were written, from the write itself."""
    from pyspark.sql import Observation

    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)
    return seen.get["n"]


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for small results."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
