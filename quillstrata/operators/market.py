"""Price factors and period figures with window functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHORT, LONG, AVERAGED = 20, 60, 20


def factors(prices: DataFrame, code: str = "stock_code", date: str = "trade_date", close: str = "close_price", value: str = "trade_value") -> DataFrame:
    """daily_ret, mom_20, mom_60, vol_20 (sample deviation of daily returns) and turnover_20; rows without mom_20 are dropped.

    One exchange by code and one sort serve all five. Prices of zero give nulls. Frames count rows, that is trading days."""
    w = W.partitionBy(code).orderBy(date)
    frame = w.rowsBetween(1 - AVERAGED, 0)
    change = lambda k: F.try_divide(F.col(close).cast("double"), F.lag(close, k).over(w).cast("double")) - 1
    out = prices.withColumn("daily_ret", change(1)).withColumns({f"mom_{SHORT}": change(SHORT), f"mom_{LONG}": change(LONG)})
    out = out.withColumns({f"vol_{AVERAGED}": F.stddev_samp("daily_ret").over(frame), f"turnover_{AVERAGED}": F.avg(F.col(value).cast("double")).over(frame)})
    return out.na.drop(subset=[f"mom_{SHORT}"])


def factors_pandas(prices: DataFrame, code: str = "stock_code", date: str = "trade_date", close: str = "close_price", value: str = "trade_value") -> DataFrame:
    """(code, date, daily_ret, mom_20, mom_60, vol_20, turnover_20) of the same rows as factors, by pandas within each security; to hold the two against each other."""
    names = ["daily_ret", f"mom_{SHORT}", f"mom_{LONG}", f"vol_{AVERAGED}", f"turnover_{AVERAGED}"]

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(date)
        price = part[close].astype(float)
        change = lambda k: price / price.shift(k).replace(0, np.nan) - 1
        out = part[[code, date]].assign(**dict(zip(names, (change(1), change(SHORT), change(LONG), change(1).rolling(AVERAGED, min_periods=2).std(), part[value].astype(float).rolling(AVERAGED, min_periods=1).mean()))))
        return out[out[names[1]].notna()]

    kinds = dict(prices.dtypes)
    return prices.select(code, date, close, value).groupBy(code).applyInPandas(work, f"{code} {kinds[code]}, {date} {kinds[date]}, " + ", ".join(f"{n} double" for n in names))


def in_period(df: DataFrame, date: str, begin, end) -> DataFrame:
    return df.where(F.col(date).between(begin, end))


def period_return(prices: DataFrame, begin, end, code: str = "stock_code", date: str = "trade_date", close: str = "close_price") -> DataFrame:
    """Return from the first to the last trading day in the period, 0 where the first close is 0: one aggregation, no sort."""
    rows = in_period(prices, date, F.lit(begin).cast("date"), F.lit(end).cast("date"))
    first, last = F.min_by(close, date), F.max_by(close, date)
    return rows.groupBy(code).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("days"), F.coalesce(F.try_divide(last, F.nullif(first, F.lit(0.0))) - 1, F.lit(0.0)).alias("period_return"))


def head_and_tail(rows: DataFrame, by: str, order: str, each: int = 10, over: int = 250) -> DataFrame:
    """All rows of small groups; of groups with more than `over` rows the first and last `each`. With rank and group size."""
    w = W.partitionBy(by).orderBy(order)
    out = rows.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn("of", F.count("*").over(W.partitionBy(by)))
    return out.where((F.col("of") <= over) | (F.col("rank") <= each) | (F.col("rank") > F.col("of") - each))


def first_of(rows: DataFrame, by: str, order: list[Column], most: int = 30) -> DataFrame:
    """The first `most` rows of each group, with rank and group size."""
    out = rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("bigint")).withColumn("of", F.count("*").over(W.partitionBy(by)))
    return out.where(F.col("rank") <= most)


def relative_error(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows in both, and the largest relative error of each column, nulls read as 0."""
    j = a.select(*keys, *(F.col(c).alias(f"{c}_a") for c in columns)).join(b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in columns)), keys)
    x = lambda c, s: F.coalesce(F.col(f"{c}_{s}"), F.lit(0.0))
    return j.agg(F.count("*").alias("n"), *(F.max(F.abs(x(c, "a") - x(c, "b")) / F.greatest(F.abs(x(c, "b")), F.lit(1e-12))).alias(f"{c}_error") for c in columns))
