"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint has 64 bits, the majority bits of the XXH64 hashes of its word shingles. Two fingerprints link
at `max_bits` or fewer differing bits; the operator returns for each document the smallest document id of its connected
component.

The search works on distinct fingerprints, so exact copies cost one row. A pivot table holds for each fingerprint its
Hamming distances to PIVOTS fixed reference fingerprints, one byte each. By the triangle inequality two fingerprints
within `max_bits` have distances within `max_bits` to every pivot: pairs whose largest coordinate difference is more are
discarded, and what survives is verified by XOR and bit count. To meet, pairs are dealt by pigeonhole keys: of
`max_bits`+2 blocks of bits at least two agree, so every pair of blocks is one key; beyond some 10**8 fingerprints
there are more and smaller blocks, of which more must agree, so that pairs by chance stay few. Any number of blocks finds all
links. Keys with very many fingerprints are cut into slots, and every pair of slots meets in one tile, so no task holds a whole hot key. A tile
gives the spanning forest of its links, never all pairs; distributed star rounds join the forests.

Null and blank texts have fingerprint zero and link like others. Repeated rows give repeated result rows. A null id is
ignored when the smallest id is sought; the component of documents that all lack ids is null. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, prepare, scan_parts, text_bytes

PIVOTS = 16
#: Fingerprints that a slot of a hot key holds on average; a tile holds two slots.
SLOT = 1024
#: Shingles hashed at a time, so that a very long text needs little memory.
SPAN = 1 << 18
#: Pairs that are tested in the time that one more row for a key takes; sets the number of blocks.
PAIRS_A_ROW = 32
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANE = np.arange(8, dtype=np.int64) * 256


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    lanes = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8) + _LANE
    seen = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _BITS).ravel()


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of 64-bit hashes; 0 without one."""
    return _majority(sum((_ones(hashes[at : at + SPAN]) for at in range(0, len(hashes), SPAN)), np.zeros(64, np.int64)), len(hashes))


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The 64-bit SimHash of a UTF-8 text; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SPAN):
        part = words[at : at + SPAN + shingle - 1]
        if len(part) <= shingle:
            hashes = np.array([digest(b" ".join(part), 42)], np.uint64)
        else:
            m = len(part) - shingle + 1
            hashes = np.fromiter((digest(x, 42) for x in map(b" ".join, zip(*(part[k:] for k in range(shingle))))), np.uint64, m)
        ones += _ones(hashes)
    return _majority(ones, n)


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t, shingle) for t in text_bytes(b.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp: signed 64 bits) of every row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """n fixed reference fingerprints, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(b"pivot %d" % k, 7)).astype(np.int64)) for k in range(n)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def blocks_for(n: int, max_bits: int) -> int:
    """The number of bit blocks, of max_bits+2 to max_bits+5, with the least rows and expected pairs for n fingerprints."""

    def work(blocks: int) -> float:
        agree = blocks - max_bits
        return comb(blocks, agree) * (1 + n / 2 ** (64 * agree / blocks) / PAIRS_A_ROW)

    return min(range(max_bits + 2, max_bits + 6), key=work)


def masks(max_bits: int, blocks: int | None = None) -> list[int]:
    """Masks of which at least one has no differing bit, for any two fingerprints with at most max_bits differing bits."""
    n = blocks or max_bits + 2
    cuts = [round(64 * k / n) for k in range(n + 1)]
    own = [sum(1 << b for b in range(cuts[k], cuts[k + 1])) for k in range(n)]
    return [_signed(sum(x)) for x in combinations(own, n - max_bits)]


def _forest(g: np.ndarray, fp: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by tile g: (row, root row) of the links within tiles."""
    left, right = [], []
    k, idx = 1, np.flatnonzero(g[:-1] == g[1:])
    half = table.shape[1] // 2
    while idx.size:
        i, j = idx, idx + k
        for part in (slice(0, half), slice(half, None)):
            near = (np.abs(table[i, part] - table[j, part]) <= max_bits).all(1)
            i, j = i[near], j[near]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
        left.append(i[near])
        right.append(j[near])
        k += 1
        idx = idx[idx + k < len(g)]
        idx = idx[g[idx] == g[idx + k]]
    root = np.arange(len(g))
    if not left:
        return root[:0], root[:0]
    i, j = np.concatenate(left), np.concatenate(right)
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    moved = np.flatnonzero(root != np.arange(len(g)))
    return moved, root[moved]


def _links(batches: Iterator[pa.RecordBatch], max_bits: int, hold: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; a tile is worked on when all of it is there."""
    kept: list[pa.RecordBatch] = []

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        g, fp = t.column("tile").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        table = np.stack([t.column("near").to_numpy(), t.column("far").to_numpy()], 1).view(np.uint8).astype(np.int16)
        row, root = _forest(g, fp, table, max_bits)
        a, b = fp[row].view(np.int64), fp[root].view(np.int64)
        pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        if sum(x.num_rows for x in kept) < hold:
            continue
        t = pa.Table.from_batches(kept)
        g = t.column("tile").to_numpy()
        whole = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
        if whole:
            yield from work(t.slice(0, whole))
            kept = t.slice(whole).to_batches()
    if kept:
        yield from work(pa.Table.from_batches(kept))


def links(prints: DataFrame, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp) to forest edges (a, b): their components are those of all links. blocks: bit blocks for the keys; by the number of fingerprints if None."""
    spark = prints.sparkSession
    blocks = blocks or blocks_for(prints.count(), max_bits)
    p = pivots()
    packed = [sum((F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(x))).cast("long"), 8 * k) for k, x in enumerate(p[at + 1 : at + 8], 1)), F.bit_count(F.col("fp").bitwiseXOR(F.lit(p[at]))).cast("long")) for at in (0, 8)]
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks(max_bits, blocks))))
    rows = prints.select("fp", packed[0].alias("near"), packed[1].alias("far"), F.explode(keys).alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > 2 * SLOT).select("key", F.ceil(F.col("count") / SLOT).cast("long").alias("slots"))
    rows = rows.join(hot, "key", "left").withColumn("slots", F.coalesce("slots", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("fp"), F.col("slots"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    tile = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(tile.alias("tile"), "fp", "near", "far").repartition(scan_parts(spark), "tile").sortWithinPartitions("tile")
    return rows.mapInArrow(lambda it: _links(it, max_bits), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id, class_size: rows with this very fingerprint) for every row of docs."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("class_size")), few=True)
    roots = components(links(classes.select("fp"), max_bits))
    classes = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", "class_size", F.coalesce("root", "fp").alias("root"))
    # cut, so that the join has an exchange on either side and Spark can split a giant component
    smallest = cut(classes.groupBy("root").agg(F.min("first_id").alias("component_id")), few=True)
    classes = classes.join(smallest, "root").select("fp", "component_id", "class_size")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")
