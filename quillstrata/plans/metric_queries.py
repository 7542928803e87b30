"""Histograms, quantiles, rates, samples and precision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evals as E
from ..sources.views import table
from .registry import query

BOUNDS = E.RESULT_BUCKETS
BUCKETS = "h AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (SELECT unnest([0.0, 1.0, 3.0, 5.0, 10.0, 25.0, 50.0, 100.0, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2)"


def buckets(spark, d):
    return E.histogram(table(spark, d, "events"), "value", ["event_type"], BOUNDS)


@query("latency_histogram", f"WITH {BUCKETS} SELECT event_type, CAST(le AS DOUBLE) AS le, n FROM h")
def latency_histogram(spark, d):
    return buckets(spark, d)


@query("bucket_quantile", f"""WITH {BUCKETS}, l AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS before, max(n) OVER (PARTITION BY event_type) * 0.95 AS rank FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le)),
    f AS (SELECT event_type, arg_min(row(le, n, low, before, rank), le) AS x FROM (SELECT event_type, CAST(le AS DOUBLE) AS le, n, CAST(low AS DOUBLE) AS low, before, CAST(rank AS DOUBLE) AS rank FROM l) WHERE n >= rank AND rank > 0 GROUP BY 1)
    SELECT event_type, round(CASE WHEN x[1] = 'inf'::DOUBLE THEN x[3] ELSE x[3] + (x[1] - x[3]) * (x[5] - x[4]) / (x[2] - x[4]) END, 6) AS quantile FROM f""")  # fmt: skip
def bucket_quantile(spark, d):
    return E.bucket_quantile(buckets(spark, d), ["event_type"], 0.95).withColumn("quantile", F.round("quantile", 6))


@query("exact_p95", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def exact_p95(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("calls_by_status", "SELECT event_type AS tool, CASE WHEN user_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS n, round(sum(CAST(round(value * 100) AS BIGINT)) / 100.0 / greatest(count(*), 0.001), 6) AS mean_value FROM events GROUP BY 1, 2")
def calls_by_status(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("tool"), F.when(F.col("user_id") % 7 == 0, "error").otherwise("ok").alias("status"))
    return e.agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100.0 / F.greatest(F.count("*"), F.lit(0.001)), 6).alias("mean_value"))


@query("rate_5m", """SELECT event_type, w AS window_start, count(*) AS n, round(count(*) / 300.0, 6) AS rate FROM (SELECT event_type, unnest([time_bucket(INTERVAL 15 SECOND, ts) - INTERVAL 15 SECOND * k FOR k IN range(0, 20)]) AS w, ts FROM events) GROUP BY 1, 2""")
def rate_5m(spark, d):
    """The streaming operator on a table: windows of five minutes, one every 15 seconds."""
    from ..streaming import rates

    out = rates(table(spark, d, "events"), ["event_type"], slide="15 seconds")
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("rate", 6).alias("rate"))


@query("counter_rate", """WITH s AS (SELECT event_type, ts, event_id % 5000 AS v, lag(event_id % 5000) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events),
    t AS (SELECT event_type, sum(CASE WHEN v < b THEN v ELSE v - b END) AS increase, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS seconds FROM s GROUP BY 1)
    SELECT event_type, CAST(increase AS BIGINT) AS increase, round(increase / seconds, 6) AS rate FROM t""")  # fmt: skip
def counter_rate(spark, d):
    """A counter that begins anew now and then."""
    samples = table(spark, d, "events").select("event_type", F.struct("ts", "event_id").alias("at"), "ts", (F.col("event_id") % 5000).alias("v"))
    out = E.counter_rate(samples, ["event_type"], "ts", "v", order="at")
    return out.select("event_type", "increase", F.round("rate", 6).alias("rate"))


@query("error_rate_by_segment", "SELECT source, count(*) AS n, round(avg(1.0 - quality), 6) AS error_rate FROM documents JOIN labels USING (doc_id) GROUP BY source")
def error_rate_by_segment(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return E.error_rates(j, "source", "quality").withColumn("error_rate", F.round("error_rate", 6))


STRATA = "s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), a AS (SELECT lang, n, least(n, greatest(20, CAST(round_even(n * 200 / sum(n) OVER (), 0) AS BIGINT))) AS take FROM s)"


def strata(spark, d):
    return E.allocate(table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), 200, 20)


@query("stratified_alloc", f"WITH {STRATA} SELECT lang, n, CAST(take AS BIGINT) AS take FROM a")
def stratified_alloc(spark, d):
    return strata(spark, d)


@query("stratified_sample", f"WITH {STRATA}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 7919 + 42) % 100003, doc_id) AS rn FROM documents) SELECT doc_id, lang FROM r JOIN a USING (lang) WHERE rn <= take")
def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return E.sample_strata(docs, strata(spark, d), "lang", [(F.col("doc_id") * 7919 + 42) % 100003, F.col("doc_id")]).select("doc_id", "lang")


@query("weighted_precision", "WITH j AS (SELECT lang, avg(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT round(sum(p * n) / sum(n), 6) AS precision FROM j JOIN n USING (lang)")
def weighted_precision(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    judged = docs.join(table(spark, d, "labels"), "doc_id")
    return E.weighted_precision(judged, docs.groupBy("lang").agg(F.count("*").alias("n")), "lang", "quality").withColumn("precision", F.round("precision", 6))


@query("throughput", """WITH t AS (SELECT event_type, count(*) AS n, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS seconds FROM events GROUP BY 1), r AS (SELECT *, n / nullif(seconds, 0) AS per_second, 1000 * seconds / n AS ms_each FROM t)
    SELECT event_type, n, round(per_second, 6) AS per_second, round(ms_each, 6) AS ms_each, round(per_second / max(per_second) OVER (), 6) AS of_best FROM r""")  # fmt: skip
def throughput(spark, d):
    return E.throughput(table(spark, d, "events"), ["event_type"], "ts").select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("per_second", "ms_each", "of_best")))


@query("fold_counters", "SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS parsed, count(*) FILTER (WHERE quality IS NULL) AS misses FROM documents LEFT JOIN labels USING (doc_id)")
def fold_counters(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("parsed"), F.count_if(F.col("quality").isNull()).alias("misses"))


@query("note_distribution", "SELECT p_type AS note, count(*) AS n FROM part GROUP BY 1")
def note_distribution(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("note")).agg(F.count("*").alias("n"))
