r"""Language identification by error-correcting output codes.

Every learned language has a codeword: all ways to part up to five languages in two, or, for more, drawn columns of which the set with
the largest least distance is taken. For each bit a binary classifier over letter trigrams (word edges included) is trained: the
log-odds of a trigram in the languages whose codeword has the bit against the rest. A document's margin for a bit is the mean
log-odds of all its trigrams, in units of the bit's spread on the sample. Decoding sums for each language the logistic losses of its bits, each weighted by how
well its classifier does on the sample, and takes the language of least loss. The score is the share of exp(-SHARP * loss); documents whose two best languages'
losses are near are marked ambiguous.

Training takes at most `most_rows` rows of each language and about `most_sample` of all (but 20 of each at least), of at most `most_chars` code points, chosen by a hash of id
and text; every learned language can be predicted. Predictions read whole texts. Letters outside a-z share 34 codes, so languages whose scripts have many letters are told
apart by these codes' trigrams only. The prediction is `und`, with score 0, where the text is null or has no letter. With one language all others get score 1; with
none every prediction is `und`. Repeated rows get equal predictions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import blocks, prepare
from .letters import codes

UNKNOWN = "und"
TRIGRAMS = 1 << 18
BLOCK = 1 << 20
SHARP = 2.0
#: Least difference of two languages' losses, as a share of the bits' weights, that is not ambiguous.
AMBIGUOUS = 0.05
#: Most bits of a codeword.
MOST_BITS = 31


def codewords(n: int) -> np.ndarray:
    """+1/-1, a row for each of n languages."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        return np.array([[1 if k == 0 or (col >> (k - 1)) & 1 else -1 for col in range(2 ** (n - 1) - 1)] for k in range(n)], np.int8)
    rng = np.random.default_rng(3)
    bits = min(MOST_BITS, max(15, int(10 * np.log2(n))))
    best, far = None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if (np.abs(m.sum(0)) == n).any():
            continue
        gap = int(((m[:, None] != m[None]).sum(2) + bits * np.eye(n, dtype=int)).min())
        if gap > far:
            best, far = m, gap
    return best


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of every letter trigram of all texts, and its text; runs of other signs count as one edge."""
    code, ends = codes(texts, False)
    doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    stay = np.r_[True, (code[1:] != 0) | (code[:-1] != 0) | (doc[1:] != doc[:-1])] if len(code) else np.zeros(0, bool)
    code, doc = code[stay].astype(np.int64), doc[stay]
    if len(code) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.r_[0, code[:-1]], np.r_[code[1:], 0]
    before[np.r_[True, doc[1:] != doc[:-1]]] = 0
    on = code != 0
    return ((before << 12) | (code << 6) | after)[on], doc[on]


class Codes:
    """Trained bit classifiers and their decoding."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        n = len(self.langs)
        self.words = codewords(n).astype(float)
        if n < 2:
            return
        lang = np.array([self.langs.index(x) for x in langs])
        counts = np.zeros((n, TRIGRAMS))
        parts = [(texts[a : a + 200], lang[a : a + 200]) for a in range(0, len(texts), 200)]
        for some, y in parts:
            idx, doc = trigrams(some)
            counts += np.bincount(y[doc] * TRIGRAMS + idx, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * (1 << 14))  # every language counts the same
        self.odds = np.stack([np.log(share[self.words[:, b] > 0].mean(0)) - np.log(share[self.words[:, b] < 0].mean(0)) for b in range(self.words.shape[1])], 1).astype(np.float32)
        self.middle, self.spread, self.weight = np.zeros(self.odds.shape[1]), np.ones(self.odds.shape[1]), np.ones(self.odds.shape[1])
        raw = np.concatenate([self.margins(some) for some, _ in parts])
        for b in range(raw.shape[1]):
            y = self.words[lang, b]
            high, low = raw[y > 0, b], raw[y < 0, b]
            self.middle[b] = (high.mean() + low.mean()) / 2 if len(high) and len(low) else 0.0
            self.spread[b] = max(1e-6, (high.mean() - low.mean()) / 2) if len(high) and len(low) else 1.0
            right = ((raw[:, b] - self.middle[b]) * y > 0).mean()
            self.weight[b] = np.log((right + 0.01) / (1.01 - right)) if right > 0.5 else 0.0
        self.weight /= max(1e-9, self.weight.sum())

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log-odds of each bit over a text's trigrams, in units of the bit's spread."""
        idx, doc = trigrams(texts)
        total = np.zeros((len(texts), self.odds.shape[1]))
        n = np.bincount(doc, minlength=len(texts))
        if len(idx):
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            total[doc[first]] = np.add.reduceat(self.odds[idx], first, dtype=np.float64)
        return (total / np.maximum(1, n)[:, None] - self.middle) / self.spread

    def decode(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous, of texts that have a letter."""
        n = len(self.langs)
        if n < 2:
            return self.langs * len(texts) or [UNKNOWN] * len(texts), np.full(len(texts), float(n)), np.zeros(len(texts), bool)
        m = np.clip(self.margins(texts), -4, 4)
        loss = (np.log1p(np.exp(-3 * m[:, None, :] * self.words[None])) * self.weight).sum(2)
        near = np.exp(-SHARP * (loss - loss.min(1, keepdims=True)))
        best, order = loss.argmin(1), np.sort(loss, 1)
        return [self.langs[k] for k in best], near[np.arange(len(texts)), best] / near.sum(1), order[:, 1] - order[:, 0] < AMBIGUOUS


def train(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, most_rows: int, most_chars: int, most_sample: int) -> Codes:
    """Two scans, however many languages there are: their counts, then the rows whose hash is below a bound that lets through about twice most_rows of each language, of which the first most_rows count."""
    known = docs.where(learn & F.col(lang_col).isNotNull() & (F.length(text_col) <= most_chars)).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("h"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # a row for each language
    if not counts:
        return Codes([], [])
    most_rows = min(most_rows, max(20, most_sample // len(counts)))
    bounds = [(r["lang"], int(-(2**63) + min(1.0, 2 * most_rows / r["n"]) * (2**64 - 1025))) for r in counts]
    few = docs.sparkSession.createDataFrame(bounds, "lang string, bound long")
    rows = known.join(F.broadcast(few), "lang").where("h <= bound").select("lang", "h", "text")
    by: dict[str, list] = {}
    for r in sorted(rows.limit(4 * most_rows * len(counts)).collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        by.setdefault(r["lang"], []).append(r["text"])
    texts = [t for lang in sorted(by) for t in by[lang][:most_rows]]
    return Codes(texts, [lang for lang in sorted(by) for _ in by[lang][:most_rows]])


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 1000, most_chars: int = 20_000, most_sample: int = 20_000) -> DataFrame:
    """docs with lang_pred, lang_score and lang_ambiguous; columns of these names are replaced. learn: the rows whose language may be learnt from."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop("lang_pred", "lang_score", "lang_ambiguous")
    shared = spark.sparkContext.broadcast(train(docs, learn, id_col, text_col, lang_col, most_rows, most_chars, most_sample))
    at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_col, BLOCK):
            texts = pc.fill_null(b.column(at).cast(pa.string()), "").to_pylist()
            lang, score, close = shared.value.decode(texts)
            bare = pc.invert(pc.match_substring_regex(pa.array(texts), r"\p{L}")).to_numpy(zero_copy_only=False)
            lang = [UNKNOWN if none else x for x, none in zip(lang, bare)]
            score, close = np.where(bare, 0.0, score), np.where(bare, False, close)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], [*b.schema.names, "lang_pred", "lang_score", "lang_ambiguous"])

    return docs.mapInArrow(predict, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_ambiguous", BooleanType())]))
