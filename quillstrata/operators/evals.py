"""Retrieval and extraction quality, histograms and quantiles, stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import match_key

# Upper bounds of histogram buckets, of seconds and of numbers of results.
LATENCY_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
RESULT_BUCKETS = [0.0, 1.0, 3.0, 5.0, 10.0, 25.0, 50.0, 100.0]


def haystack_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)[\s()·,.]+", ""))


def score_questions(questions: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """questions (*by, type, gold array) with hit, recall and matched, given evidence (*by, pos, text)."""
    hay = evidence.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("_text"))
    out = questions.join(hay, by, "left").withColumn("_hay", haystack_key(F.coalesce("_text", F.lit(""))))
    matched = F.filter("gold", lambda g: (match_key(g) != "") & F.contains(F.col("_hay"), match_key(g)))
    out = out.withColumn("matched", matched)
    recall = F.when(F.size("gold") > 0, F.size("matched") / F.size("gold")).otherwise(0.0)
    return out.withColumn("hit", (F.size("matched") > 0).cast("int")).withColumn("recall", recall).drop("_text", "_hay")


def score_modes(questions: DataFrame, evidence: dict[str, DataFrame], by: str) -> DataFrame:
    """score_questions for each way of searching, as rows with its name in mode; besides those given (by, pos, text), 'hybrid' takes graph evidence, then vector evidence."""
    ways = evidence | ({"hybrid": evidence["graph"].unionByName(evidence["vector"].withColumn("pos", F.col("pos") + (1 << 30)))} if {"graph", "vector"} <= evidence.keys() else {})
    rows = [e.select(by, F.lit(mode).alias("mode"), F.col("pos").cast("long").alias("pos"), "text") for mode, e in ways.items()]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    asked = questions.withColumn("mode", F.explode(F.array(*map(F.lit, ways))))
    return score_questions(asked, every, [by, "mode"])


def summarise(scored: DataFrame, by: str | list[str] = "type") -> DataFrame:
    """Mean hit, mean recall and number of questions, by type (and what else is in by) and over all types (type 'all')."""
    by = [by] if isinstance(by, str) else by
    figures = (F.avg("hit").alias("hit_at_k"), F.avg("recall").alias("recall"), F.count("*").alias("n"))
    whole = scored.withColumn(by[0], F.lit("all")).groupBy(*by).agg(*figures)
    return scored.groupBy(*by).agg(*figures).unionByName(whole)


def histogram(rows: DataFrame, value: str, by: list[str], bounds: list[float]) -> DataFrame:
    """Cumulative buckets: (*by, le, n), with le infinite for all."""
    counts = rows.groupBy(*by).agg(*(F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)), F.count(value).alias("all_"))
    buckets = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("all_").alias("n")))
    return counts.select(*by, F.explode(buckets).alias("_b")).select(*by, "_b.le", "_b.n")


def throughput(done: DataFrame, by: list[str], time: str) -> DataFrame:
    """(*by, n, seconds, per_second, ms_each, of_best) of units of work and when each was done, over the span that they took; of_best compares with the fastest."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    out = done.groupBy(*by).agg(F.count("*").alias("n"), ((F.max(t) - F.min(t)) / 1e6).alias("seconds"))
    out = out.withColumns({"per_second": F.try_divide(F.col("n").cast("double"), F.col("seconds")), "ms_each": 1000 * F.col("seconds") / F.col("n")})
    return out.withColumn("of_best", F.col("per_second") / F.max("per_second").over(W.partitionBy()))  # one row for each kind of work


def counter_rate(samples: DataFrame, by: list[str], time: str, value: str, order: str | None = None) -> DataFrame:
    """(*by, increase, seconds, rate) of a counter's samples; a value below the one before means that the counter began anew at 0. order: what samples are sorted by, else time."""
    w = W.partitionBy(*by).orderBy(order or time)
    before = F.lag(value).over(w)
    step = F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    rows = samples.select(*by, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), step.alias("_step"))
    out = rows.groupBy(*by).agg(F.coalesce(F.sum("_step"), F.lit(0)).alias("increase"), ((F.max("_t") - F.min("_t")) / 1e6).alias("seconds"))
    return out.withColumn("rate", F.try_divide(F.col("increase").cast("double"), F.col("seconds")))


def bucket_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """Quantile by straight lines within buckets, as monitoring systems do; the last finite bound where it falls beyond."""
    w = W.partitionBy(*by).orderBy("le")
    rows = buckets.withColumn("_low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_before", F.coalesce(F.lag("n").over(w), F.lit(0)))
    rows = rows.withColumn("_rank", F.max("n").over(W.partitionBy(*by)) * q).where("n >= _rank AND _rank > 0")
    first = rows.groupBy(*by).agg(F.min_by(F.struct("le", "n", "_low", "_before", "_rank"), "le").alias("x"))
    x = F.col("x")
    line = x["_low"] + (x["le"] - x["_low"]) * F.try_divide(x["_rank"] - x["_before"], (x["n"] - x["_before"]).cast("double"))
    return first.select(*by, F.when(x["le"] == float("inf"), x["_low"]).otherwise(F.coalesce(line, x["le"])).alias("quantile"))


def allocate(strata: DataFrame, target: int, least: int, n: str = "n") -> DataFrame:
    """Sample sizes by share, at least `least` and at most all; halves round to even."""
    total = F.sum(n).over(W.partitionBy())  # one row for each stratum
    return strata.withColumn("take", F.least(F.col(n), F.greatest(F.lit(least), F.bround(F.col(n) * target / total).cast("bigint"))))


def sample_strata(rows: DataFrame, strata: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Of each stratum the first `take` rows in a seeded order."""
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return ranked.join(F.broadcast(strata.select(by, "take")), by).where("_rn <= take").drop("_rn", "take")  # a row for each stratum


def weighted_precision(judged: DataFrame, population: DataFrame, by: str, label: str) -> DataFrame:
    """Precision of each stratum weighted by the stratum's size in the population."""
    each = judged.groupBy(by).agg(F.avg(F.col(label).cast("double")).alias("p"))
    return each.join(population, by).agg(F.try_divide(F.sum(F.col("p") * F.col("n")), F.sum("n")).alias("precision"))


def error_rates(judged: DataFrame, segment: str, label: str) -> DataFrame:
    return judged.groupBy(segment).agg(F.count("*").alias("n"), F.avg(1 - F.col(label).cast("double")).alias("error_rate"))
