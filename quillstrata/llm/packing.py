"""Packing documents into training sequences: patterns of few lengths, fitted by non-negative least squares.

Every document becomes token ids and a closing id; only longer documents than a sequence are cut, into pieces of full length of which
the first may be shorter. The lengths' histogram (at most `capacity` counts, however many documents there are) is all that the driver
sees. There it enumerates patterns of one to four lengths that fill a sequence, fits their repeat counts to the
histogram by non-negative least squares, rounds them down to what is there, and packs what remains best-fit decreasing, whole runs of
equal lengths at a time. The plan is a list of (lengths, repeats) whose size depends on `capacity` alone; workers get it and
place the r-th piece of a length in the r-th slot for that length. Ranks come from counts by partition and length, not from a global sort.

Null text is empty: a document of the closing id alone. Repeated rows are packed as often as they are there. Null ids stay null. Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, prepare


@lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str | None):
    """text to its ids, as numpy.uint32, as the tokenizers library gives them with add_special_tokens=False: strings of added tokens become these tokens' ids.

    tokenizer: file of that library; ranks: the same vocabulary for tiktoken, which is several times as fast, or None."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    if ranks is None:
        return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added = {x.content: k for k, x in t.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in table.items() if v not in added.values()}, special_tokens=added)
    return lambda text: fast.encode_to_numpy(text, allowed_special="all")


def default_files() -> dict:
    import public_tokenizers as p

    return {"tokenizer": p.path("byte_bpe_50k.json"), "ranks": p.path("byte_bpe_50k.tiktoken")}


def _pieces(batches: Iterator[pa.RecordBatch], files: dict, end_id: int, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, seen, part = encoder(**files), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * keep_ids]
    for b in batches:
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), pc.fill_null(b.column(1), "").to_pylist()):
            ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
            first = (len(ids) - 1) % capacity + 1
            for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                own = ids[start : start + capacity if k else first]
                rows.append((doc, k, start, len(own), zlib.crc32(own), part, int(seen[len(own)]), *[own.astype(np.int32)] * keep_ids))
                seen[len(own)] += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * keep_ids])


# --- the plan, on the driver, from a histogram of bounded size ---


def patterns(have: np.ndarray, capacity: int, waste: int) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths that the histogram has, filling a sequence but for `waste` tokens at most."""
    present = np.flatnonzero(have[:capacity])
    present = present[present > 0]
    if not len(present):
        return []
    fit = np.full(capacity + 1, 0)  # largest present length up to each room
    fit[present] = present
    fit = np.maximum.accumulate(fit)
    found: set[tuple[int, ...]] = set()
    for a in present[::-1]:
        room = capacity - a
        b = fit[room]
        if b and room - b <= waste:
            found.add(tuple(sorted((int(a), int(b)), reverse=True)))
        for share in (2, 3, 4):
            b = fit[min(a, max(1, room * (share - 1) // share))] if room > 1 else 0
            c = fit[room - b] if b else 0
            if c and room - b - c <= waste:
                found.add(tuple(sorted((int(a), int(b), int(c)), reverse=True)))
            elif c and (d := fit[room - b - c]) and room - b - c - d <= waste:
                found.add(tuple(sorted((int(a), int(b), int(c), int(d)), reverse=True)))
    return sorted(found, reverse=True)


def fit_counts(pats: list[tuple[int, ...]], have: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares |A x - have| by coordinate descent; a column of A counts a pattern's lengths."""
    left, x = have.astype(float), np.zeros(len(pats))
    columns = [np.unique(p, return_counts=True) for p in pats]
    for _ in range(sweeps):
        moved = 0.0
        for k, (rows, n) in enumerate(columns):
            step = max(-x[k], float(left[rows] @ n) / float(n @ n))
            if step:
                x[k] += step
                left[rows] -= step * n
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def best_fit(have: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing on a histogram, runs of equal lengths at a time: ([(length, times)], sequences)."""
    open_: list[list] = [[] for _ in range(capacity + 1)]  # by room: [lengths, sequences]
    for length in np.flatnonzero(have)[::-1]:
        length, left = int(length), int(have[length])
        room = length
        while left and room <= capacity:
            if not open_[room]:
                room += 1
                continue
            lengths, count = open_[room].pop()
            use = min(count, left)
            if use < count:
                open_[room].append((lengths, count - use))
            open_[room - length].append(([*lengths, (length, 1)], use))
            left -= use
            room = max(length, room - length) if room - length >= length else room
        each = capacity // length
        if left >= each:
            open_[capacity - each * length].append(([(length, each)], left // each))
        if left % each:
            open_[capacity - left % each * length].append(([(length, left % each)], 1))
    return [g for groups in open_ for g in groups]


def plan(have: np.ndarray, capacity: int, waste: int = 0) -> list[tuple[list[tuple[int, int]], int]]:
    """Histogram of lengths (index: length) to ([(length, times)], sequences); every piece has exactly one slot."""
    left = have.astype(np.int64).copy()
    out = []
    if left[capacity]:
        out.append(([(capacity, 1)], int(left[capacity])))
        left[capacity] = 0
    pats = patterns(left, capacity, waste)
    for p, x in zip(pats, fit_counts(pats, left)):
        rows, n = np.unique(p, return_counts=True)
        times = int(min(int(x), (left[rows] // n).min()))
        if times > 0:
            left[rows] -= times * n
            out.append(([(int(r), int(c)) for r, c in zip(rows, n)][::-1], times))
    return out + best_fit(left, capacity)


class Slots:
    """The plan as sorted arrays: the r-th piece of a length to its sequence and offset."""

    def __init__(self, groups: list[tuple[list[tuple[int, int]], int]], capacity: int):
        given = np.zeros(capacity + 1, np.int64)
        rows, base = [], 0
        for lengths, count in groups:
            offset = 0
            for length, times in lengths:
                rows.append(((length << 44) + int(given[length]), base, times, offset))
                given[length] += times * count
                offset += times * length
            base += count
        rows.sort()
        self.key, self.base, self.times, self.offset = np.array(rows or [(0, 0, 1, 0)], np.int64).T
        self.sequences = base

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 44) + rank
        at = np.searchsorted(self.key, key, "right") - 1
        r = key - self.key[at]
        return self.base[at] + r // self.times[at], self.offset[at] + r % self.times[at] * length


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, files: dict | None = None, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) and, with keep_ids, ids: the piece's token ids."""
    spark = docs.sparkSession
    prepare(spark)
    files = files or default_files()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * keep_ids
    pieces = cut(rows.mapInArrow(lambda it: _pieces(it, files, end_id, capacity, keep_ids), schema))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    have = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        have[r["length"]] = r["n"]
    slots = spark.sparkContext.broadcast(Slots(plan(have, capacity), capacity))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(counts, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = slots.value.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), pa.array(seq), pa.array(off)], [*out, "sequence_id", "offset"])

    return ranked.select(*out, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long")
