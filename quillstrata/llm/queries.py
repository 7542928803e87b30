"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import contamination
from .exactdedup import exact_duplicates
from .langid import identify
from .linededup import dedup_lines
from .lmscore import score_corpus
from .packing import pack
from .pii import pseudonymise
from .simhash import simhash_components
from .toxicity import toxicity
from .urlfilter import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=2048, end_id=0, keep_ids=False)


def remainder(by: int) -> Column:
    """crc32 of doc_id as text, modulo by; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % by


#: From this score on a document counts as toxic.
TOXIC_FROM = 0.7


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"), learn=remainder(3) != 1)
    return scored.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= TOXIC_FROM).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), min_chars=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"), train=remainder(7) != 2)


#: The key of the pseudonyms: the session's spark.quillstrata.secret (Spark hides settings of such names in its logs), else one for trials.
SECRET, TRIAL_KEY = "spark.quillstrata.secret", "quillstrata2026"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=spark.conf.get(SECRET, TRIAL_KEY))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, learn=F.coalesce(remainder(5) != 0, F.lit(True)))
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


#: (verdict, host and path prefix)
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "score", F.concat_ws(" ", "words").alias("words"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_lm_score": op6_lm_score,
    "op7_pii": op7_pii,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_exact_dedup": op10_exact_dedup,
}

#: DuckDB's ASCII lower-casing.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op4_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, n, line, {_LOWER.format(r"regexp_replace(line, '^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$', '', 'g')")} AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)),
        repeated AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        marked AS (SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.first AS gone FROM lines l LEFT JOIN repeated r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op5_decontamination": """
        WITH d AS (SELECT doc_id, regexp_extract_all(LOWTEXT, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(LOWTEXT, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
        bw AS (SELECT DISTINCT item, least(13, len(words)) AS n, array_to_string(words[k : k + least(13, len(words)) - 1], ' ') AS win
               FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS k FROM b WHERE len(words) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, k, array_to_string(words[k : k + n - 1], ' ') AS win
               FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, sizes WHERE len(words) >= n)),
        hits AS (SELECT doc_id, k, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
        spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(len(words), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(words), 0) AS contaminated
        FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)""".replace("LOWTEXT", _LOWER.format("text")),
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\x0c\r]', '', 'g')) AS text_sha256 FROM documents),
        w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
}
