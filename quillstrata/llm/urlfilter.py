r"""URL filtering: rules first, then segmented host and path words scored by multinomial naive Bayes.

Host: after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; path: from there up to `?`, `#` or the end. A null url, or one without
`://`, has neither. A rule (verdict, host, path prefix) fits its host and all its subdomains if the path starts with its prefix; of fitting rules the
longest text wins, of equally long ones the first in the list.

Every other url is judged by its words. Runs of letters of host (without the last label) and path are cut by a unigram Viterbi: a word costs its
negative log probability, and unknown stretches cost a fixed amount and more for each letter. The unigrams are the words of the pages' own text
(`html_col` without its tags), all of them, and the seed words, which get a small count where the text lacks them. A run meets
only the words that it contains, by a join of its pieces of up to LONGEST letters with the counted words, so there is no dictionary to broadcast.

No url comes labelled. A url is taken as unwanted if one of its host's words is a seed; seeds of less than LEAST_INSIDE letters count only where they stand
alone between other signs. From all different urls the classifier learns what else stands in unwanted hosts and paths; counts, odds and sums are aggregations over
words, without a sample. A url is blocked from a posterior of `block_from` on.

Null or malformed urls are allowed with score 0; so are all where no url is unwanted. Repeated rows get equal verdicts. Columns other than id, url and html are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare

# Words of unwanted hosts.
SEEDS = (
    "adult ads adserver bet bets betting bingo bonus casino cialis clickbait dating escort forex gambling hack jackpot "
    "keygen loan loans lottery malware nude payday phishing pharmacy pill pills poker porn replica roulette sex slots "
    "spam sportsbook spyware torrent tracker track viagra virus warez win winner xxx"
).split()
#: Words that seeds stand with; they only help to cut names.
PLAIN = "blog buy cash cheap click deal deals fast free game games get best home live luck mail money news now offer online page play shop site store top web world www".split()
#: Letters of the longest word, and of the shortest seed that counts within a longer run.
LONGEST, LEAST_INSIDE = 24, 4
#: Letters at which a run's pieces begin that are made at a time; longer runs give several rows.
PART = 1000
#: Cost of an unknown stretch, and of each of its letters.
UNKNOWN_COST, LETTER_COST = 12.0, 2.2
#: Of so many words one is a seed, for each seed that the text lacks.
SEED_SHARE = 20_000


def viterbi(run: str, cost: dict[str, float]) -> list[str]:
    """The cheapest way to cut a run into known words and unknown stretches; of equally cheap ones the one whose last piece is longest, then the one before it.

    An unknown stretch is grown letter by letter, so the work is in proportion to LONGEST times the run's length."""
    n = len(run)
    best, back = [0.0, *[math.inf] * n], [0] * (n + 1)
    open_, since = math.inf, 0  # the cheapest unknown stretch that may go on
    for end in range(1, n + 1):
        if best[end - 1] + UNKNOWN_COST < open_:
            open_, since = best[end - 1] + UNKNOWN_COST, end - 1
        open_ += LETTER_COST
        best[end], back[end] = open_, since
        for start in range(max(0, end - LONGEST), end):
            c = cost.get(run[start:end])
            if c is not None and best[start] + c < best[end]:
                best[end], back[end] = best[start] + c, start
    words, end = [], n
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def unigrams(pages: DataFrame, html_col: str) -> DataFrame:
    """(w, cost) of the words of at least two letters in the pages' text, and of the seeds."""
    text = F.lower(F.regexp_replace(F.col(html_col).cast("string"), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " "))
    found = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("w")).where(F.length("w").between(2, LONGEST))
    counts = cut(found.groupBy("w").agg(F.count("*").alias("n")))
    total = (counts.agg(F.sum("n")).first()[0] or 0) + SEED_SHARE
    own = pages.sparkSession.createDataFrame([(w, total // SEED_SHARE) for w in (*SEEDS, *PLAIN)], "w string, n long")
    return counts.unionByName(own).groupBy("w").agg(F.max("n").alias("n")).select("w", (-F.log(F.col("n") / total)).alias("cost"))


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """Different runs (run) to (run, words); words: (w, cost)."""
    # a run is named by its hash, so that long ones are not repeated for every word; two runs of one hash would share words, and a word that a run lacks does no harm
    rid = F.xxhash64("run").alias("rid")
    parts_ = F.transform(F.sequence(F.lit(1), F.length("run"), F.lit(PART)), lambda at: F.substring("run", at, F.lit(PART + LONGEST - 1)))
    each = runs.where(F.length("run") > 1).select(rid, F.explode(parts_).alias("part")).where(F.length("part") > 1)
    at = F.sequence(F.lit(1), F.length("part") - 1)
    pieces = F.flatten(F.transform(at, lambda k: F.transform(F.sequence(F.lit(2), F.least(F.lit(LONGEST), F.length("part") - k + 1)), lambda m: F.substring("part", k, m))))
    known = each.select("rid", F.explode(F.array_distinct(pieces)).alias("w")).join(words, "w")
    known = known.groupBy("rid").agg(F.collect_set(F.struct("w", "cost")).alias("known"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [viterbi(run, {x["w"]: x["cost"] for x in have or ()}) for run, have in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["run", "words"])

    return cut(runs.select("run", rid).join(known, "rid", "left").select("run", "known").mapInArrow(work, "run string, words array<string>"))


def parts(url) -> tuple:
    """(host, path) columns of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host, path, rules: list[tuple[str, str]]):
    """The fitting rule's text and verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in sorted(range(len(rules)), key=lambda k: (len(rules[k][1]), -k)):
        kind, rule = rules[k]
        at, _, prefix = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + prefix)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def runs_of(host: Column, path: Column) -> Column:
    """The runs of letters of a url, in order: (side: h or p, run)."""
    labels = F.split(host, r"\.")
    labels = F.when(F.size(labels) > 1, F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))).otherwise(labels)
    side = lambda text, s: F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), lambda r: F.struct(F.lit(s).alias("side"), r.alias("run")))
    return F.concat(side(F.array_join(labels, "."), "h"), side(F.lower(path), "p"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block_from: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, words) for every row; rules: (verdict, 'host/path prefix')."""
    prepare(pages.sparkSession)
    host, path = parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = cut(rows.where("host <> ''").select("host", "path").distinct().withColumn("u", F.monotonically_increasing_id()))
    each = urls.select("u", F.posexplode(runs_of(F.col("host"), F.col("path"))).alias("at", "r")).select("u", "at", "r.*")
    cuts = segmented(each.select("run").distinct(), unigrams(pages, html_col))
    each = each.join(cuts, "run")
    seed = F.array(*map(F.lit, SEEDS))
    seeded = (F.col("side") == "h") & F.exists("words", lambda w: F.array_contains(seed, w) & ((F.length(w) >= LEAST_INSIDE) | (F.length(w) == F.length("run"))))
    marked = F.transform("words", lambda w: F.concat(F.col("side"), F.lit(":"), w))
    found = cut(each.groupBy("u").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", marked.alias("words")))), lambda x: x["words"])).alias("words"), F.max(seeded).cast("int").alias("y")))
    n = urls.agg(F.count("*")).first()[0]
    bad = found.agg(F.sum("y")).first()[0] or 0
    terms = found.select("u", "y", F.explode("words").alias("w"))
    counts = cut(terms.groupBy("w").agg(F.sum(1 - F.col("y")).alias("c0"), F.sum("y").alias("c1")), few=True)
    t = counts.agg(F.count("*").alias("v"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).first()
    totals = [(t[c] or 0) + 0.5 * (t["v"] + 1) for c in ("c0", "c1")]
    odds = counts.select("w", (F.log((F.col("c1") + 0.5) / totals[1]) - F.log((F.col("c0") + 0.5) / totals[0])).alias("odds"))
    prior = math.log((bad + 0.5) / (n - bad + 0.5))
    sums = terms.join(odds, "w").groupBy("u").agg(F.sum("odds").alias("odds"))
    posterior = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.coalesce("odds", F.lit(0.0)) + prior)))) if bad else F.lit(0.0)
    judged = cut(urls.join(found.select("u", "words"), "u", "left").join(sums, "u", "left").select("host", "path", posterior.alias("score"), "words"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    score = F.coalesce("score", F.lit(0.0))
    own = F.when(score >= block_from, "block").otherwise("allow")
    out = rows.join(judged, ["host", "path"], "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), score.alias("score"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))
