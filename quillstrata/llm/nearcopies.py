"""Near copies by SimHash with pivots, MinHash and the Jaccard similarity of five-word shingles.

A document's set holds the 48-bit hashes of its different shingles, the words split and lower-cased as in `token_hashes`; a text
of fewer words is one shingle. Two documents link when their sets have `similarity` or more of their union in common, which is
counted exactly; of each connected component the smallest document id stays.

Equal sets cost one row. Sets meet in two ways. Each has a SimHash fingerprint, the majority bits of its shingles; `simhash.links` finds the fingerprints at NEAR_BITS or fewer differing bits by block keys,
the table of their distances to pivots, and an XOR. As fingerprints of sets at a similarity of 0.8 differ by 10 bits on average, that finds the nearest only; so sets that agree in one of BANDS keys, each of WIDTH
MinHash minimums, meet too: at similarity 0.8 a pair misses all keys with a chance of 4 in 10**4, at 0.85 of 2 in 10**6; nothing else is approximate. Sets that meet,
joined through the smallest of them, form groups, so every pair that meets is in one group. A set is sent to its group, once for a
group of up to SLOT sets or SLOT_BYTES; larger groups are cut into slots, and every pair of slots meets in one tile. In a tile a
search goes from set to set over those not reached yet, so many near copies of one text cost little more than their number.

Null and blank texts have the empty set and link to each other. Rows without an id stay and link others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, components, cut, mix64, prepare, scan_parts, text_bytes, token_hashes, without
from .simhash import fingerprint_of, links

BANDS, WIDTH = 20, 5
#: Differing bits of fingerprints up to which sets meet.
NEAR_BITS = 4
#: Sets, and bytes of them, that a slot of a large group holds on average; a tile holds two slots.
SLOT, SLOT_BYTES = 1024, 8 << 20
BLOCK = 1 << 20
#: Shingles whose minimums are taken at a time.
SPAN = 1 << 12
#: Bytes up to which the rows that meet others are broadcast to the sets.
SMALL = 48 << 20
_RNG = np.random.default_rng(20261126)
_FACTORS = _RNG.integers(1, 2**63, BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _RNG.integers(1, 2**63, BANDS * WIDTH, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SETS = "row long, doc_id long, h long, n int, fp long, keys array<long>, grams binary"


def _mixed(parts: Iterator[np.ndarray]) -> np.ndarray:
    acc = None
    for h in parts:
        acc = mix64(h + _STEP) if acc is None else mix64(acc * _STEP + h)
    return acc


def shingle_sets(texts: list[bytes], shingle: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct 48-bit shingle hashes."""
    h, counts = token_hashes(texts)
    at = np.r_[0, np.cumsum(counts)]
    m = max(0, len(h) - shingle + 1)
    every = _mixed(h[k : k + m] for k in range(shingle)) if m else h[:0]
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= shingle:
            own = every[a : b - shingle + 1]
        elif b > a:
            own = _mixed(h[k : k + 1] for k in range(a, b))
        else:
            own = h[:0]
        yield np.unique(own >> np.uint64(16))


def band_keys(grams: np.ndarray) -> np.ndarray:
    """BANDS keys of WIDTH minimums each, as signed longs."""
    least = np.full(BANDS * WIDTH, np.uint64(2**64 - 1))
    for at in range(0, len(grams), SPAN):
        x = grams[None, at : at + SPAN] * _FACTORS[:, None] + _ADDED[:, None]
        np.minimum(least, x.min(1), out=least)
    least = least.reshape(BANDS, WIDTH)
    return _mixed([np.arange(BANDS, dtype=np.uint64), *(least[:, k] for k in range(WIDTH))]).view(np.int64)


def _pack(grams: np.ndarray) -> bytes:
    return np.ascontiguousarray(grams.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for b in blocks(batches, "text", BLOCK):
        h, n, fp, keys, packed = [], [], [], [], []
        for grams in shingle_sets(text_bytes(b.column("text")), shingle):
            packed.append(_pack(grams))
            h.append(xxhash.xxh64_intdigest(packed[-1], 42))
            n.append(len(grams))
            fp.append(fingerprint_of(mix64(grams)))
            keys.append(band_keys(grams) if len(grams) else np.zeros(0, np.int64))
        where = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
        cols = [pa.array(row + np.arange(b.num_rows)), b.column("doc_id"), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.ListArray.from_arrays(where, pa.array(np.concatenate(keys))), pa.array(packed, pa.binary())]
        row += b.num_rows
        yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "h", "n", "fp", "keys", "grams"])


def _reached(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Forest edges (place, place) of the components of sets that have `similarity` of their union in common; no set is empty."""
    sizes = np.array([len(x) for x in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat = flat.astype(np.int32)
    at = np.r_[0, np.cumsum(sizes)]
    left = np.arange(len(sets))
    mark = np.zeros(len(names), np.int32)
    rest, starts = flat, at[:-1]  # shingles of the sets not reached yet, and where each begins
    while len(left):
        queue, seen = [int(left[0])], np.ones(len(left), bool)
        seen[0] = False
        while True:
            if not seen.all():
                rest = rest[np.repeat(seen, sizes[left])]
                left = left[seen]
                starts = np.r_[0, np.cumsum(sizes[left])][:-1]
            if not queue or not len(left):
                break
            u = queue.pop()
            own = flat[at[u] : at[u + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[rest], starts)
            mark[own] = 0
            near = common >= similarity * (sizes[left] + sizes[u] - common) - 1e-9
            for v in left[near].tolist():
                yield u, v
                queue.append(v)
            seen = ~near


def _links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; a tile is worked on when all of it is there."""
    at, h, sets = None, [], []

    def work() -> pa.RecordBatch:
        found = [(h[a], h[b]) for a, b in _reached(sets, similarity)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for b in batches:
        for tile, one, grams in zip(*(c.to_pylist() for c in b.columns)):
            if tile != at:
                if len(h) > 1:
                    yield work()
                at, h, sets = tile, [], []
            h.append(one)
            sets.append(_unpack(grams))
    if len(h) > 1:
        yield work()


def print_links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between sets whose fingerprints are the same or differ by NEAR_BITS or fewer bits; their components are those of all such pairs."""
    sets = classes.where("n > 0").select("h", "fp")
    # cut, so that the joins have an exchange on either side and Spark can split the sets of a common fingerprint
    prints = cut(sets.groupBy("fp").agg(F.min("h").alias("m")), few=True)
    same = sets.join(prints, "fp").where("h <> m").select(F.col("h").alias("a"), F.col("m").alias("b"))
    a, b = (prints.select(F.col("fp").alias(x), F.col("m").alias(f"m{x}")) for x in "ab")
    return same.union(links(prints.select("fp"), NEAR_BITS).join(a, "a").join(b, "b").select("ma", "mb"))


def near_links(rows: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Forest edges (a, b) of the different sets that link; rows: one of them for each class has its set."""
    spark = rows.sparkSession
    keyed = classes.where("n > 0").select("h", F.explode("keys").alias("key"))
    # cut, so that the join has an exchange on either side and Spark can split the rows of a common key
    least = cut(keyed.groupBy("key").agg(F.min("h").alias("m"), F.count("*").alias("c")).where("c > 1").select("key", "m"), few=True)
    groups = components(keyed.join(least, "key").where("h <> m").select(F.col("h").alias("a"), F.col("m").alias("b")).union(print_links(classes)))
    groups = groups.union(groups.select("root", "root").distinct())  # components leaves the smallest node of each out
    groups = cut(groups.join(classes.select(F.col("h").alias("node"), "n", F.col("first_row").alias("row")), "node").select("row", "root", "n"), few=True)
    size = groups.groupBy("root").agg(F.count("*").alias("c"), F.sum(F.col("n") * 6).alias("bytes"))
    slots = F.ceil(F.greatest(F.col("c") / SLOT, F.col("bytes") / SLOT_BYTES)).cast("long")
    large = size.where((F.col("c") > 2 * SLOT) | (F.col("bytes") > 2 * SLOT_BYTES)).select("root", slots.alias("slots"))
    groups = groups.drop("n").join(large, "root", "left").withColumn("slots", F.coalesce("slots", F.lit(1).cast("long")))
    if groups.count() * 24 <= SMALL:
        groups = F.broadcast(groups)
    sent = rows.select("row", "h", "grams").join(groups, "row")
    sent = sent.withColumn("own", F.pmod(F.xxhash64("h"), F.col("slots"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    tile = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    sent = sent.select(tile.alias("tile"), "h", "grams").repartition(scan_parts(spark), "tile").sortWithinPartitions("tile")
    return sent.mapInArrow(lambda it: _links(it, similarity), "a long, b long")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs whose id is their component's smallest; rows without an id stay."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(texts.mapInArrow(lambda it: _sets(it, shingle), _SETS))
    classes = cut(rows.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("first_row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), few=True)
    roots = components(near_links(rows, classes, similarity))
    classes = classes.join(roots, classes.h == roots.node, "left").select("h", "first_id", F.coalesce("root", "h").alias("root"))
    # cut, so that the join has an exchange on either side and Spark can split a giant component
    smallest = cut(classes.groupBy("root").agg(F.min("first_id").alias("component_id")), few=True)
    kept = classes.join(smallest, "root").select("h", "component_id")
    gone = rows.select("h", "doc_id").join(kept, "h").where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return without(docs, gone, id_col)
