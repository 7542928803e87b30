r"""Language-model scores from a log-frequency Bloom filter.

Tokens are the words `[^\x20\x09-\x0D]+` of a text after lower-casing A-Z, then one end. Training counts cover every token and every pair of
neighbours of all training texts. A task sorts the 64-bit hashes of its tokens and pairs, counts them and sends each owner of a
hash range (a segment) its part; owners add the counts up. Tokens count as equal when their 64-bit hashes are (among 10**8 different tokens
the chance of any collision is 3 in 10**4); pairs are told apart by 40 bits and those of the segment, 48 to 56 together.

The model is a log-frequency Bloom filter: a count c is quantised to the level 1 + floor(log(c) / log(LOG_BASE)), and a token
or pair of level q is inserted q times, as (hash, 1) to (hash, q). A lookup probes (hash, 1), (hash, 2), ... until one is
absent. All counted tokens and pairs are in it, from a count of 1 on: an owner fills the slice of its segment and gives it BITS_EACH bits for an insertion,
so the filter grows with the input. Slices are broadcast, `most_bytes` of them at a time; where there are more, the texts are
passed over as many times, and every pass adds the levels of the tokens and pairs whose slices it has. log10 of the interpolated probability

    p(w | v) = a(v) * count(v w) / count(v) + (1 - a(v)) * (count(w) + 1) / (N + V + 1)

is summed over the text; a count is the middle of its level. The weight a(v) depends on v's level alone. The weights are fitted by
expectation-maximisation on all training texts, leaving each occurrence itself out (a count less one): what an occurrence adds depends on its
three levels only, so one scan counts the occurrences of each combination (LEVELS**3 at most) and the rounds run on these numbers.

base_score needs exact counts. The HEAD most frequent tokens' counts are broadcast as two sorted arrays (16 MB at most);
rarer tokens, of which each has a small count, go to their segment's owner to be looked up, in bulk.

Null and empty texts have the end token alone. Repeated rows count and are scored as often as they are there. Rows whose train
is null are trained on. Without training rows N and V are 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import END, blocks, cut, mix64, prepare, scan_parts, text_bytes, token_hashes

LOG_BASE = 1.5
LEVELS = 88
#: Bits of a slice for each insertion, and how many of them an insertion sets, all in one word of 64.
BITS_EACH, HASHES = 10, 4
#: Bytes of the filter that are broadcast at a time.
MOST_BYTES = 192 << 20
#: Tokens whose exact counts are broadcast.
HEAD = 1_000_000
#: Tokens that a task gathers before it counts them.
GATHER = 1_500_000
#: Bytes of text hashed at a time.
BLOCK = 1 << 20
#: Least weight of pairs; the filter takes about one in fifty for more often seen than it is, and no weight shall rest on these.
LEAST_WEIGHT = 0.03
START = np.uint64(0x51ED270B9F7C3A15)
#: Low bytes kept of a token's and of a pair's hash, besides the segment.
BYTES = (7, 5)

_BOUNDS = LOG_BASE ** np.arange(LEVELS)
#: The middle of the whole counts of each level; 0 for level 0.
_MIDDLE = np.r_[0.0, (np.ceil(_BOUNDS) + np.maximum(np.ceil(_BOUNDS), np.ceil(_BOUNDS * LOG_BASE) - 1)) / 2][:LEVELS]


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts; 0 for a count of 0."""
    return np.minimum(np.searchsorted(_BOUNDS, counts, "right"), LEVELS - 1)


def kept(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Hashes without the bits that are not stored: what stays is the segment (the `bits` high ones) and BYTES low bytes."""
    low = (1 << 8 * BYTES[kind]) - 1
    return h & np.uint64(low | (((1 << bits) - 1) << (64 - bits)))


def pairs(h: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """The kept hash of each token together with what stands before it."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(counts)[:-1]] = START
    before[:1] = START
    return kept(mix64(before * np.uint64(0x9E3779B97F4A7C15) + (h ^ np.uint64(0x5851F42D4C957F2D))), 1, bits)


def _low(h: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :n])


def _high(seg: int, low: bytes, n: int, bits: int) -> np.ndarray:
    """Kept hashes again, from their segment and low bytes."""
    raw = np.zeros((len(low) // n, 8), np.uint8)
    raw[:, :n] = np.frombuffer(low, np.uint8).reshape(-1, n)
    h = raw.view("<u8").ravel()
    return (h & np.uint64((1 << (64 - bits)) - 1)) | np.uint64(seg << (64 - bits))


def _segments(h: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Sorted hashes by segment."""
    seg = (h >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.r_[0, np.flatnonzero(np.diff(seg)) + 1, len(h)] if len(h) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(seg[a]), slice(int(a), int(b))


# --- the filter ---


def _marks(h: np.ndarray, level: int, words: np.uint64 | np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each (hash, level) its word in a slice of `words` words, and its HASHES bits in the word."""
    x = mix64(h + np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return ((x >> np.uint64(32)) * words) >> np.uint64(32), [(x >> np.uint64(6 * k)) & np.uint64(63) for k in range(HASHES)]


def fill(h: np.ndarray, level: np.ndarray) -> bytes:
    """The slice of a segment's hashes and their levels, in 64-bit words."""
    words = -(-int(level.sum()) * BITS_EACH // 64)
    on = np.zeros(words * 64, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        word, bits = _marks(h[level >= q], q, np.uint64(words))
        for b in bits:
            on[(word << np.uint64(6)) + b] = 1
    return np.packbits(on, bitorder="little").tobytes()


class Filter:
    """Slices by segment; a segment without a slice has no members."""

    def __init__(self, bits: int, sizes: dict[int, int]):
        """sizes: bytes of the slices to come, by segment."""
        self.bits = bits
        self.words, self.start = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        at = 0
        for seg, size in sizes.items():
            self.words[seg], self.start[seg] = size // 8, at
            at += size // 8
        self.data = np.zeros(at, "<u8")

    def put(self, seg: int, x: bytes) -> None:
        at = int(self.start[seg])
        self.data[at : at + len(x) // 8] = np.frombuffer(x, "<u8")

    def level(self, h: np.ndarray) -> np.ndarray:
        """Probes levels 1, 2, ... until one is absent."""
        out = np.zeros(len(h), np.uint8)
        seg = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at = np.flatnonzero(self.words[seg])
        h, words, start = h[at], self.words[seg[at]], self.start[seg[at]]
        for q in range(1, LEVELS):
            if not len(at):
                break
            word, bits = _marks(h, q, words)
            mask = np.uint64(1) << bits[0]
            for b in bits[1:]:
                mask |= np.uint64(1) << b
            on = np.flatnonzero((self.data[start + word] & mask) == mask)
            at, h, words, start = at[on], h[on], words[on], start[on]
            out[at] = q
        return out


# --- counting ---


def _gathered(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held: tuple[list, list] = ([], [])

    def give() -> pa.RecordBatch:
        rows = []
        for kind in (0, 1):
            h, n = np.unique(np.concatenate(held[kind]), return_counts=True)
            held[kind].clear()
            low, n = _low(h, BYTES[kind]), n.astype("<u4")
            rows += [(kind, s, low[at].tobytes(), n[at].tobytes()) for s, at in _segments(h, bits)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["kind", "seg", "low", "n"])

    for b in blocks(batches, "text", BLOCK):
        h, counts = token_hashes(text_bytes(b.column("text")), end=True)
        held[0].append(kept(h, 0, bits))
        held[1].append(pairs(h, counts, bits))
        if sum(map(len, held[0])) >= GATHER:
            yield give()
    if held[0]:
        yield give()


def _added(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted by kind and segment, one segment at a time: its slice and statistics; tokens keep their counts."""
    at, held = None, []

    def fold() -> tuple[np.ndarray, np.ndarray]:
        h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[first], np.add.reduceat(n, first)

    def out() -> pa.RecordBatch:
        kind, seg = at
        h, n = fold()
        level = levels(n)
        low, exact = (b"", b"") if kind else (_low(h, BYTES[0]).tobytes(), n.astype("<i8").tobytes())
        row = (kind, seg, low, exact, fill(h, level), len(h), int(n.sum()), np.bincount(level, minlength=LEVELS).tolist())
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["kind", "seg", "low", "n", "slice", "distinct", "total", "hist"])

    for b in batches:
        for kind, seg, low, n in zip(*(c.to_pylist() for c in b.columns)):
            if (kind, seg) != at:
                if at is not None:
                    yield out()
                at, held = (kind, seg), []
            held.append((_high(seg, low, BYTES[kind], bits), np.frombuffer(n, "<u4").astype(np.int64)))
            if len(held) > 1 and sum(len(x[0]) for x in held[1:]) > max(1 << 20, len(held[0][0])):
                held = [fold()]
    if at is not None:
        yield out()


def counted(train: DataFrame, bits: int) -> DataFrame:
    """(kind 0 token or 1 pair, seg, low and n: the tokens' counts, slice, distinct, total, hist) by segment, of a DataFrame of text."""
    sent = train.mapInArrow(lambda it: _gathered(it, bits), "kind int, seg int, low binary, n binary")
    dealt = sent.repartition(2 * scan_parts(train.sparkSession), "kind", "seg").sortWithinPartitions("kind", "seg")
    return cut(dealt.mapInArrow(lambda it: _added(it, bits), "kind int, seg int, low binary, n binary, slice binary, distinct long, total long, hist array<long>"))


class Counts:
    """What a pass over the texts needs: the pass's slices, and the frequent tokens' exact counts."""

    def __init__(self, counts: DataFrame, bits: int):
        stats = counts.groupBy("kind").agg(F.sum("distinct").alias("v"), F.sum("total").alias("n"), *(F.sum(F.get("hist", F.lit(k))).alias(f"h{k}") for k in range(LEVELS))).where("kind = 0").collect()
        hist = np.array([stats[0][f"h{i}"] for i in range(LEVELS)]) if stats else np.zeros(LEVELS, np.int64)
        self.bits = bits
        self.n, self.v = (stats[0]["n"], stats[0]["v"]) if stats else (0, 0)
        from_top = np.r_[np.cumsum(hist[::-1])[::-1], 0]
        head_level = int(np.flatnonzero(from_top <= HEAD)[0])
        least = self.head_least = 1 if head_level <= 1 else int(np.ceil(_BOUNDS[head_level - 1]))

        def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for seg, low, n in zip(*(c.to_pylist() for c in b.columns)):
                    h, n = _high(seg, low, BYTES[0], bits), np.frombuffer(n, "<i8")
                    use = n >= least
                    yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([h[use].tobytes()], pa.binary()), pa.array([n[use].tobytes()], pa.binary())], ["seg", "h", "n"])

        rows = sorted(counts.where("kind = 0").select("seg", "low", "n").mapInArrow(heads, "seg int, h binary, n binary").collect())
        self.head = np.concatenate([np.frombuffer(r["h"], "<u8") for r in rows]) if rows else np.zeros(0, np.uint64)
        self.head_n = np.concatenate([np.frombuffer(r["n"], "<i8") for r in rows]) if rows else np.zeros(0, np.int64)
        self.filters: list[Filter] = []

    def passes(self, counts: DataFrame, most_bytes: int) -> list[list[tuple[int, int, int]]]:
        """(kind, segment, bytes of its slice) in runs, each of at most most_bytes, or of one slice; the whole filter is in them."""
        out, held = [[]], 0
        for row in sorted(tuple(r) for r in counts.select("kind", "seg", F.length("slice")).collect()):  # 2 ** (bits + 1) rows at most
            if out[-1] and held + row[2] > most_bytes:
                out.append([])
                held = 0
            out[-1].append(row)
            held += row[2]
        return out

    def load(self, counts: DataFrame, run: list[tuple[int, int, int]]) -> Counts:
        """Takes the slices of a run; they come one part after another, so that the driver holds them once."""
        self.filters = [Filter(self.bits, {s: n for k, s, n in run if k == kind}) for kind in (0, 1)]
        if run:
            at = F.struct("kind", "seg")
            first, last = (F.struct(F.lit(x[0]).alias("kind"), F.lit(x[1]).alias("seg")) for x in (run[0], run[-1]))
            for r in counts.where((at >= first) & (at <= last)).select("kind", "seg", "slice").coalesce(16).toLocalIterator():
                self.filters[r["kind"]].put(r["seg"], r["slice"])
        return self

    def head_count(self, h: np.ndarray) -> np.ndarray:
        """Exact counts; 0 where the head doesn't have it."""
        if not len(self.head):
            return np.zeros(len(h), np.int64)
        at = np.searchsorted(self.head, h)
        at[at == len(self.head)] = 0
        return np.where(self.head[at] == h, self.head_n[at], 0)


# --- the weights and the probabilities ---


def cells(tokens: np.ndarray, pair: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """Each occurrence's combination of levels: of what stands before it, its own and the pair's, as one number. end: the level of the end token; every text's start is as frequent."""
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[np.r_[0, np.cumsum(counts)[:-1]]] = end
    return (before * LEVELS + tokens) * LEVELS + pair


def fit(cell: np.ndarray, times: np.ndarray, n: int, v: int, rounds: int = 20) -> np.ndarray:
    """The weights of pairs by the level of what stands before, from the combinations of levels and how often they occur."""
    weight = np.full(LEVELS, 0.1)
    if not len(cell):
        return weight
    before, token, pair = _MIDDLE[cell // LEVELS**2], _MIDDLE[cell // LEVELS % LEVELS], _MIDDLE[cell % LEVELS]
    single = np.maximum(token, 1.0) / (n + v)
    double = np.minimum(1.0, np.maximum(pair - 1, 0.0) / np.maximum(before - 1, 1.0))
    group = cell // LEVELS**2
    total = np.bincount(group, times, LEVELS) + 20.0
    for _ in range(rounds):
        a = weight[group]
        weight = np.maximum(LEAST_WEIGHT, np.bincount(group, times * a * double / (a * double + (1 - a) * single), LEVELS) / total)
    return weight


def log_probs(cell: np.ndarray, weight: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 p of each combination of levels."""
    before, token, pair = _MIDDLE[cell // LEVELS**2], _MIDDLE[cell // LEVELS % LEVELS], _MIDDLE[cell % LEVELS]
    a = weight[cell // LEVELS**2]
    return np.log10(a * np.minimum(1.0, pair / np.maximum(before, 1.0)) + (1 - a) * (token + 1) / (n + v + 1))


# --- scanning ---

_PROBED = "id long, held_out boolean, text string, tokens binary, pairs binary"
_FOUND = "row long, id long, held_out boolean, n_tokens long, n_known long, logs double, tokens binary, pairs binary, seg int, asked binary, asking binary"


def _binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One value for each text, of one byte for each of its tokens."""
    ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.astype(np.uint8).tobytes())])


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def _levels_of(b: pa.RecordBatch, m: Counts, h: np.ndarray, u: np.ndarray, back: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of a block's tokens and pairs, with those that earlier passes found. u[back] is h."""
    tokens = m.filters[0].level(kept(u, 0, m.bits))[back]
    pu, pback = np.unique(pairs(h, counts, m.bits), return_inverse=True)
    pair = m.filters[1].level(pu)[pback]
    if "tokens" in b.schema.names:
        tokens, pair = tokens + _bytes(b.column("tokens")), pair + _bytes(b.column("pairs"))
    return tokens, pair


def _probed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "text", BLOCK):
        h, counts = token_hashes(text_bytes(b.column("text")), end=True)
        u, back = np.unique(h, return_inverse=True)
        both = _levels_of(b, shared.value, h, u, back, counts)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), b.column("text"), *(_binaries(x, counts) for x in both)], [x.split(" ")[0] for x in _PROBED.split(", ")])


def _found(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The last pass: a row for each text, and rows of rarer tokens that ask for their exact counts."""
    m = shared.value
    row = TaskContext.get().partitionId() << 33
    names = [x.split(" ")[0] for x in _FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
    for b in blocks(batches, "text", BLOCK):
        h, counts = token_hashes(text_bytes(b.column("text")), end=True)
        u, back = np.unique(h, return_inverse=True)
        c = m.head_count(u)
        doc = np.repeat(np.arange(b.num_rows), counts)
        logs = np.bincount(doc, np.log10(c + 1.0)[back], b.num_rows)
        known = np.bincount(doc, (c > 0)[back], b.num_rows).astype(np.int64)
        rows = row + np.arange(b.num_rows)
        row += b.num_rows
        both = (_binaries(x, counts) for x in _levels_of(b, m, h, u, back, counts))
        yield pa.RecordBatch.from_arrays([pa.array(rows), b.column("id"), b.column("held_out"), pa.array(counts.astype(np.int64)), pa.array(known), pa.array(logs), *both, *(pa.nulls(b.num_rows, k) for k in kinds[8:])], names)
        if m.head_least > 1 and (miss := (c == 0)[back]).any():
            t, r = h[miss], rows[doc[miss]]
            order = np.argsort(t, kind="stable")
            t, r = t[order].astype("<u8"), r[order].astype("<i8")
            parts = [(s, t[at].tobytes(), r[at].tobytes()) for s, at in _segments(t, m.bits)]
            cols = [pa.nulls(len(parts), k) for k in kinds[:8]] + [pa.array(x, k) for x, k in zip(zip(*parts), kinds[8:])]
            yield pa.RecordBatch.from_arrays(cols, names)


def _counted_cells(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LEVELS**3, np.int64)
    for b in batches:
        if b.num_rows:
            cell = cells(_bytes(b.column("tokens")), _bytes(b.column("pairs")), b.column("n_tokens").to_numpy(), end)
            total += np.bincount(cell, minlength=LEVELS**3)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "times"])


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    end, logp = shared.value
    for b in batches:
        counts = b.column("n_tokens").to_numpy()
        cell = cells(_bytes(b.column("tokens")), _bytes(b.column("pairs")), counts, end) if b.num_rows else np.zeros(0, np.int64)
        score = np.add.reduceat(logp[cell], np.r_[0, np.cumsum(counts)[:-1]]) if b.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(score, pa.float64())], [*b.schema.names[:6], "score"])


def _looked_up(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A segment's counts come before the tokens that ask for them."""
    at, h, n = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for b in batches:
        for seg, asks, keys, values in zip(*(c.to_pylist() for c in b.columns)):
            if seg != at:
                at, h, n = seg, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if not asks:
                h, n = _high(seg, keys, BYTES[0], bits), np.frombuffer(values, "<i8")
                continue
            if not len(h):
                continue
            t, rows = np.frombuffer(keys, "<u8"), np.frombuffer(values, "<i8")
            k = np.searchsorted(h, t)
            k[k == len(h)] = 0
            hit = h[k] == t
            if hit.any():
                own, back = np.unique(rows[hit], return_inverse=True)
                c = n[k[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(back, np.log10(c + 1.0))), pa.array(np.bincount(back).astype(np.int64))], ["row", "more_logs", "more_known"])


def score_corpus(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; train: which rows to learn from; most_bytes: of the filter, to be broadcast at a time."""
    spark = docs.sparkSession
    prepare(spark)
    bits = min(16, max(8, int(np.ceil(np.log2(4 * scan_parts(spark))))))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (~F.coalesce(train, F.lit(True))).alias("held_out"))
    counts = counted(rows.where("not held_out").select("text"), bits)
    model = Counts(counts, bits)
    n, v = model.n, model.v
    runs = model.passes(counts, most_bytes)
    for k, run in enumerate(runs):
        shared = spark.sparkContext.broadcast(model.load(counts, run))
        model.filters = []
        closing = k == len(runs) - 1
        rows = cut(rows.mapInArrow(lambda it, s=shared, f=_found if closing else _probed: f(it, s), _FOUND if closing else _PROBED))
        shared.unpersist()
    found = rows.where("seg IS NULL").select("row", "id", "held_out", "n_tokens", "n_known", "logs", "tokens", "pairs")
    end = int(levels(model.head_count(np.array([END])))[0])
    seen = found.where("NOT held_out").mapInArrow(lambda it: _counted_cells(it, end), "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times")).collect()  # LEVELS**3 rows at most
    cell, times = np.array([r["cell"] for r in seen], np.int64), np.array([r["times"] for r in seen], np.int64)
    table = spark.sparkContext.broadcast((end, log_probs(np.arange(LEVELS**3), fit(cell, times, n, v), n, v)))
    out = found.mapInArrow(lambda it: _scored(it, table), "row long, id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    if model.head_least > 1:
        asks = rows.where("seg IS NOT NULL").select("seg", F.lit(1).alias("asks"), "asked", "asking")
        have = counts.where("kind = 0").select("seg", F.lit(0).alias("asks"), "low", "n")
        dealt = have.union(asks).repartition(scan_parts(spark), "seg").sortWithinPartitions("seg", "asks")
        more = dealt.mapInArrow(lambda it: _looked_up(it, bits), "row long, more_logs double, more_known long").groupBy("row").agg(F.sum("more_logs").alias("more_logs"), F.sum("more_known").alias("more_known"))
        out = out.join(more, "row", "left")
    else:
        out = out.withColumns({"more_logs": F.lit(0.0), "more_known": F.lit(0).cast("long")})
    return out.select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1.0))).alias("base_score"),
        "score",
    )
