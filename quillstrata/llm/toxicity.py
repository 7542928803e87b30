"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums over all subsequences of three and of four letters (word edges count as letters) the product of their weights
in both words, DECAY to the number of letters skipped, for as many skipped letters as SKIPS allows. Words are read without
the signs inside them, digits and signs that look like letters as those letters, and runs of three or more single letters as one
word, so that gapped, spaced and inserted-character spellings come near the plain one.

Training takes a bounded sample of labelled documents (`most_toxic`, `most_clean` rows of `most_chars` code points at most, chosen by a
hash of the id). Labels belong to documents, so sentences are trained on as multiple instances: every toxic document gives the
sentences of its most suspicious words, every clean document the sentences with the words that come nearest; after each round the choice is
made anew. A sentence is represented by its most suspicious word. Landmarks are words of the first round; a word's Nystroem features are its
kernel values with the landmarks times the inverse root of the landmarks' kernel matrix, and a linear SVM is
trained on them by dual coordinate descent. Since the kernel has an explicit, finite feature map, the trained machine is
folded into one table of subsequence weights, with the very same scores; the table has a fixed size and is broadcast.
A document's score is a logistic function of its highest-scored word. Its place is set on a held third of the sample, with a machine trained on the rest.

Null and blank texts score like a document with no suspicious word. Without labels of both kinds the score is 0. Repeated rows get equal
scores. A label row with a null id or null label is not used; an id with several labels counts as toxic if one of them says so.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix64, prepare
from .letters import FIRST_EDGE, LAST_EDGE, codes

DECAY = 0.6
#: Letters that a subsequence of three, or of four, may skip.
SKIPS = {3: 2, 4: 2}
TABLE_BITS = 20
LANDMARKS = 384
#: Most suspicious words of which copies with a letter put in are trained on, too.
MISSPELT = 300
ROUNDS = 4
#: Bytes of text scored at a time.
BLOCK = 1 << 20


def _offsets() -> list[tuple[tuple[int, ...], float]]:
    out = []
    for size, skips in SKIPS.items():
        def grow(at: tuple[int, ...], left: int) -> None:
            if len(at) == size:
                out.append((at, DECAY ** (at[-1] - size + 1)))
                return
            for gap in range(left + 1):
                grow((*at, at[-1] + 1 + gap), left - gap)
        grow((0,), skips)
    return out


OFFSETS = _offsets()


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different words of the texts: their codes with edges, each code's word; for all word occurrences the word and the text; the words' hashes."""
    code, ends = codes(texts, True)
    if len(code) > 2:  # of a letter written more than twice in a row two stay
        stay = np.r_[True, True, (code[2:] != code[1:-1]) | (code[2:] != code[:-2]) | (code[2:] == 0)]
        code, ends = code[stay], np.cumsum(stay)[ends - 1]
    edge = np.diff(np.r_[0, (code != 0).astype(np.int8), 0])
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    doc = np.searchsorted(ends, starts, "right")
    single = stops - starts == 1
    runs = np.diff(np.r_[0, single.astype(np.int8), 0])
    first, last = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1)
    glued = np.zeros(len(starts), bool)  # this word goes on where the one before it ended
    for a, b in zip(first, last):
        if b - a >= 3:
            glued[a + 1 : b] = doc[a + 1 : b] == doc[a : b - 1]
    letters = code != 0
    word_of = np.cumsum(~glued) - 1
    lengths = np.bincount(word_of, stops - starts).astype(np.int64)
    flat = code[letters].astype(np.uint64)
    begin = np.cumsum(lengths) - lengths
    nth = np.arange(len(flat)) - np.repeat(begin, lengths)
    h = mix64(np.add.reduceat(mix64(flat * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64)), begin))
    known, one, back = np.unique(h, return_index=True, return_inverse=True)
    size = lengths[one]
    at = np.cumsum(size + 2) - size - 2
    own = np.repeat(np.arange(len(one)), size + 2)
    out = np.full(len(own), LAST_EDGE, np.int64)
    out[at] = FIRST_EDGE
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at + 1, size) + place] = flat[np.repeat(begin[one], size) + place]
    return out, own, back, doc[~glued], known


def sample_words(texts: list[str], each: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words of many texts, codes and words of codes, and the different (text, word); worked out for some texts at a time to spare memory."""
    codes_, sizes, hashes, pairs = [], [], [], []
    for at in range(0, len(texts), each):
        code, own, back, doc, known = words(texts[at : at + each])
        if not len(back):
            continue
        codes_.append(code.astype(np.uint8))
        sizes.append(np.bincount(own).astype(np.int64))
        pairs.append(np.unique(np.stack([doc + at, back + sum(map(len, hashes))], 1), axis=0))
        hashes.append(known)
    if not codes_:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros((0, 2), np.int64)
    code, size, pair = np.concatenate(codes_), np.concatenate(sizes), np.concatenate(pairs)
    _, one, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    begin = (np.cumsum(size) - size)[one]
    size = size[one]
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return code[np.repeat(begin, size) + place].astype(np.int64), np.repeat(np.arange(len(one)), size), np.stack([pair[:, 0], back[pair[:, 1]]], 1)


def subsequences(code: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(places of first letters, table index, weight) for each way to skip letters."""
    mask = np.uint64((1 << TABLE_BITS) - 1)
    for at, weight in OFFSETS:
        span = at[-1]
        if len(code) <= span:
            continue
        ok = np.flatnonzero(own[: len(own) - span] == own[span:])
        key = np.full(len(ok), len(at), np.uint64)
        for a in at:
            key = key * np.uint64(64) + code[ok + a].astype(np.uint64)
        yield ok, ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & mask).astype(np.int64), weight


def norms(code: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(n)
    for at, weight in OFFSETS:
        span = at[-1]
        if len(code) > span:
            ok = own[: len(own) - span] == own[span:]
            total += weight**2 * np.bincount(own[: len(own) - span][ok], minlength=n)
    return np.sqrt(np.maximum(total, 1e-9))


def score_words(code: np.ndarray, own: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    total = np.zeros(n)
    for ok, idx, weight in subsequences(code, own):
        total += weight * np.bincount(own[ok], table[idx], n)
    return total / norms(code, own, n)


def best_words(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The highest word score of each text; NO_WORD without a word."""
    out = np.full(len(texts), NO_WORD)
    code, own, back, doc, _ = words(texts)
    if len(back):
        np.maximum.at(out, doc, score_words(code, own, int(own[-1]) + 1, table)[back])
    return out


NO_WORD = -3.0
#: Documents of each kind that a held part of the sample needs.
LEAST_HELD = 100
#: The score that parts toxic from clean, the slope of the logistic curve there, and the width over which errors are smoothed.
AT, STEEP, SMOOTH = 0.7, 4.0, 0.12


def _rows(code: np.ndarray, own: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse kernel features of the chosen words: row, table index, value; rows have about unit length."""
    row_of = np.full(int(own[-1]) + 1, -1)
    row_of[use] = np.arange(len(use))
    size = norms(code, own, len(row_of))
    r, c, v = [], [], []
    for ok, idx, weight in subsequences(code, own):
        row = row_of[own[ok]]
        on = row >= 0
        r.append(row[on])
        c.append(idx[on])
        v.append(weight / size[own[ok][on]])
    return np.concatenate(r), np.concatenate(c), np.concatenate(v)


def misspelt(code: np.ndarray, own: np.ndarray, use: np.ndarray, each: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """`each` copies of the chosen words with a random letter put in somewhere between first and last letter."""
    ends = np.searchsorted(own, np.arange(int(own[-1]) + 2))
    out, of = [], []
    for w in use:
        letters = code[ends[w] : ends[w + 1]]
        for _ in range(each if len(letters) >= 6 else 0):
            out.append(np.insert(letters, rng.integers(2, len(letters) - 1), rng.integers(1, 27)))
            of.append(np.full(len(letters) + 1, len(of)))
    return (np.concatenate(out), np.concatenate(of)) if out else (code[:0], own[:0])


def train_svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, sweeps: int = 12) -> np.ndarray:
    """Linear SVM (hinge loss, own cost for each row) by dual coordinate descent; the last column of z is the bias."""
    w, alpha = np.zeros(z.shape[1]), np.zeros(len(z))
    sizes = (z**2).sum(1)
    rng = np.random.default_rng(7)
    for _ in range(sweeps):
        for k in rng.permutation(len(z)):
            new = min(cost[k], max(0.0, alpha[k] + (1 - y[k] * (z[k] @ w)) / sizes[k]))
            if new != alpha[k]:
                w += (new - alpha[k]) * y[k] * z[k]
                alpha[k] = new
    return w


def lift(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int, prior: float = 3.0) -> np.ndarray:
    """Log-odds of toxic documents among those that have something, against all; drawn to 0 where few have it."""
    share = n_bad / (n_bad + n_good)
    q = (bad + prior * share) / (bad + good + prior)
    return np.log(q / (1 - q)) - np.log(share / (1 - share))


class Machine:
    """Trained on texts and their labels (1 toxic)."""

    def __init__(self, texts: list[str], toxic: list[int], held: float = 1 / 3):
        """held: share of the sample on which a machine trained on the rest is tried, to set the threshold; 0 to set it on the training sample."""
        self.table = np.zeros(1 << TABLE_BITS)
        self.slope, self.shift, self.able = 1.0, 0.0, False
        y = np.array(toxic)
        if not len(texts) or y.min() == y.max():
            return
        best = self._fit(texts, y)
        if held and min((y == 1).sum(), (y == 0).sum()) >= LEAST_HELD:
            out, rng = np.zeros(len(y), bool), np.random.default_rng(13)
            for label in (0, 1):
                rows = rng.permutation(np.flatnonzero(y == label))
                out[rows[: int(len(rows) * held)]] = True
            rest = Machine([texts[k] for k in np.flatnonzero(~out)], y[~out].tolist(), held=0)
            tried = np.flatnonzero(out)
            best = np.concatenate([best_words([texts[k] for k in tried[at : at + 200]], rest.table) for at in range(0, len(tried), 200)])
            y = y[out]
        self._calibrate(best, y)

    def _fit(self, texts: list[str], y: np.ndarray) -> np.ndarray:
        """Fills the table; gives each text's highest word score. What it works with is freed when it returns."""
        code, own, pair = sample_words(texts)  # each word once for each document
        if not len(pair):
            return np.full(len(texts), NO_WORD)
        self.able = True
        n = int(own[-1]) + 1
        bad = y[pair[:, 0]] == 1
        in_bad, in_good = np.bincount(pair[bad, 1], minlength=n), np.bincount(pair[~bad, 1], minlength=n)
        # the first choice: subsequences without a gap of four letters that clean documents lack
        n_bad, n_good = max(1, (y == 1).sum()), max(1, (y == 0).sum())
        seen = {0: np.zeros(1 << TABLE_BITS), 1: np.zeros(1 << TABLE_BITS)}
        firm = [(ok, idx) for (ok, idx, weight), (at, _) in zip(subsequences(code, own), [o for o in OFFSETS if len(code) > o[0][-1]]) if at == (0, 1, 2, 3)]
        for ok, idx in firm:
            for label, count in ((1, in_bad), (0, in_good)):
                seen[label] += np.bincount(idx, (count > 0)[own[ok]] * count[own[ok]], 1 << TABLE_BITS)
        odds = lift(seen[1], seen[0], n_bad, n_good)
        value, parts = np.zeros(n), np.zeros(n)
        for ok, idx in firm:
            value += np.bincount(own[ok], odds[idx], n)
            parts += np.bincount(own[ok], minlength=n)
        value = value / np.maximum(1, parts) + lift(in_bad, in_good, n_bad, n_good)
        rng = np.random.default_rng(11)
        marks = root = None
        for _ in range(ROUNDS):
            bad_words, weight = self._choose(pair[bad], value, 2)
            good_words, _ = self._choose(pair[~bad], value, 4)
            clean = np.flatnonzero(in_good > 0)
            some = rng.choice(clean, min(len(clean), 3000), replace=False) if len(clean) else clean
            frequent = np.argsort(-in_good, kind="stable")[:2000]
            good_words = np.unique(np.r_[good_words[:4000], some, frequent[in_good[frequent] > 0]])
            keep = (in_good[bad_words] == 0) & (in_bad[bad_words] > 0)
            bad_words, weight = bad_words[keep][:4000], weight[keep][:4000]
            if not len(bad_words) or not len(good_words):
                break
            use = np.r_[bad_words, good_words]
            label = np.r_[np.ones(len(bad_words)), -np.ones(len(good_words))]
            r, c, v = _rows(code, own, use)
            odd, odd_own = misspelt(code, own, bad_words[:MISSPELT], 3, rng)
            if len(odd):
                r2, c2, v2 = _rows(odd, odd_own, np.arange(int(odd_own[-1]) + 1))
                r, c, v = np.r_[r, r2 + len(use)], np.r_[c, c2], np.r_[v, v2]
                label = np.r_[label, np.ones(int(odd_own[-1]) + 1)]
            total = len(label)
            if marks is None:
                half = LANDMARKS // 2
                chosen = np.unique(np.r_[np.arange(min(half, len(bad_words))), len(bad_words) + rng.choice(len(good_words), min(half, len(good_words)), replace=False)])
                nth = np.full(total, -1)
                nth[chosen] = np.arange(len(chosen))
                own_mark = nth[r] >= 0
                used = np.unique(c[own_mark])
                place = np.full(1 << TABLE_BITS, -1)
                place[used] = np.arange(len(used))
                marks = np.zeros((len(chosen), len(used)))
                np.add.at(marks, (nth[r[own_mark]], place[c[own_mark]]), v[own_mark])
                e, q = np.linalg.eigh(marks @ marks.T)
                fine = e > 1e-6 * e[-1]
                root = q[:, fine] / np.sqrt(e[fine])
            on = place[c] >= 0
            kernel = np.zeros((total, marks.shape[0]))
            order = np.argsort(r, kind="stable")
            order = order[on[order]]
            for lo in range(0, total, 256):  # rows by rows, to keep dense blocks small
                part = order[np.searchsorted(r[order], lo) : np.searchsorted(r[order], lo + 256)]
                dense = np.zeros((min(256, total - lo), len(used)))
                np.add.at(dense, (r[part] - lo, place[c[part]]), v[part])
                kernel[lo : lo + 256] = dense @ marks.T
            z = np.c_[kernel @ root, np.full(total, 0.3)]
            cost = np.r_[np.minimum(4.0, weight), np.full(len(good_words), 2.0), np.full(total - len(use), 0.5)]
            w = train_svm(z, label, cost)
            self.table = np.zeros(1 << TABLE_BITS)
            self.table[used] = marks.T @ (root @ w[:-1])
            value = score_words(code, own, n, self.table)
        best = np.full(len(texts), NO_WORD)
        np.maximum.at(best, pair[:, 0], value[pair[:, 1]])
        return best

    @staticmethod
    def _choose(pair: np.ndarray, value: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
        """The `each` most suspicious words of every document: words by suspicion, and in how many documents each was chosen."""
        order = np.lexsort((-value[pair[:, 1]], pair[:, 0]))
        doc = pair[order, 0]
        nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
        found, n = np.unique(pair[order[nth < each], 1], return_counts=True)
        order = np.lexsort((found, -value[found]))
        return found[order], n[order].astype(float)

    def _calibrate(self, best: np.ndarray, y: np.ndarray) -> None:
        """A logistic curve that is AT where the smoothed errors are least, the shares of both kinds that go wrong weighted 3 to 2 for the clean ones."""
        cuts = np.linspace(best.min() - 0.1, best.max() + 0.1, 801)
        over = lambda part: (1 / (1 + np.exp(-np.clip((part[None] - cuts[:, None]) / SMOOTH, -50, 50)))).mean(1)
        wrong = 0.4 * (1 - over(best[y == 1])) + 0.6 * over(best[y == 0])
        cut = float(cuts[wrong <= wrong.min() + 1e-6].mean())
        self.slope = STEEP
        self.shift = float(np.log(AT / (1 - AT)) - self.slope * cut)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.able:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-(self.slope * best_words(texts, self.table) + self.shift)))


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, most_toxic: int, most_clean: int, most_chars: int) -> Machine:
    """Fits the machine on a bounded sample, in one task: at most (most_toxic + most_clean) * most_chars code points come together there, and only ids and the fitted table to the driver."""
    known = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("int").alias("y")).where(F.col(id_col).isNotNull() & F.col("y").isNotNull() & learn)
    known = known.groupBy(id_col).agg(F.max("y").alias("y"))
    chosen = []
    for y, most in ((1, most_toxic), (0, most_clean)):
        chosen += [(r[0], y) for r in known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(most).select(id_col).collect()]
    if not chosen:
        return Machine([], [])
    few = docs.sparkSession.createDataFrame(chosen, f"{id_col} long, _y int")
    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text")).where(F.length("_text") <= most_chars)
    rows = texts.join(F.broadcast(few), id_col).dropDuplicates([id_col]).select(id_col, "_text", "_y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        m = Machine([text for _, text, _ in sample], [y for *_, y in sample])
        kinds = (pa.bool_(), pa.float64(), pa.float64(), pa.binary())
        give_back()  # this worker goes on to score texts beside others
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((m.able, m.slope, m.shift, m.table.tobytes()), kinds)], ["able", "slope", "shift", "weights"])

    made, out = rows.repartition(1).mapInArrow(work, "able boolean, slope double, shift double, weights binary").collect(), Machine([], [])
    if made:
        out.able, out.slope, out.shift, out.table = made[0]["able"], made[0]["slope"], made[0]["shift"], np.frombuffer(made[0]["weights"], np.float64)
    return out


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 800, most_clean: int = 1200, most_chars: int = 20_000, out_col: str = "toxicity") -> DataFrame:
    """docs with out_col, the score from 0 to 1; a column of that name is replaced. learn: which ids' labels may be learnt from, as a condition on id_col."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels, learn, id_col, text_col, label_col, most_toxic, most_clean, most_chars))
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_col, BLOCK):
            found = shared.value.scores(pc.fill_null(b.column(at).cast(pa.string()), "").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, out_col])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(out_col, DoubleType())]))
