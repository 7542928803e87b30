"""What several corpus operators share: cutting lineage, Arrow scans, token hashing and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoints, ship

#: Documents of one Arrow batch handed to Python; keeps a worker's memory at some MB however large a partition is.
BATCH_ROWS = 1000
#: Bytes of text that a worker gathers before it works on them.
BLOCK_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches; this package for the workers; a checkpoint folder: the cluster's spark.checkpoint.dir, or one of our own where it is unset."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)
    checkpoints(spark)


def cut(df: DataFrame, few: bool = False) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there; a lost executor costs a read, not the lineage.

    few: in at most four files for each core of the cluster, for narrow tables that many small partitions made. Not for
    what Python made: a task would run the Python of all the partitions that it unites at once, and see one partition number for all."""
    prepare(df.sparkSession)
    if few:
        df = df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scan_parts(spark: SparkSession) -> int:
    """Partitions to deal keyed work to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each; a longer single text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


#: Bytes of ids that are broadcast; more are brought together with the rows by a shuffle.
IDS_BYTES = 48 << 20


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is among gone (one column, id_col). Few ids are broadcast, so that no text moves."""
    gone = cut(gone)
    few = gone.agg(F.sum(F.length(F.col(id_col).cast("string")) + 24)).first()[0] or 0
    return docs.join(F.broadcast(gone) if few <= IDS_BYTES else gone, id_col, "left_anti")


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared checkpoint folder, and read from there; unlike a checkpoint it can be read by column. The folder is the cluster's to empty."""
    prepare(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- token hashes without a Python object for each token ---

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _R), np.full(size, _R_INV)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def token_hashes(texts: list[bytes], end: bool = False) -> tuple[np.ndarray, np.ndarray]:
    r"""64-bit hashes of the tokens `[^\x20\x09-\x0D]+` of all texts after lower-casing A-Z, and the number of tokens of each text. With end, each text closes with one END token."""
    joined = b"\n".join(texts)
    raw = _LOWER[np.frombuffer(joined, np.uint8)]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    h = mix64((sums[stops] - sums[starts]) * down[starts])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if end:
        h = np.insert(h, np.cumsum(counts), END)
        counts = counts + 1
    return h, counts


#: Hash of the token that closes every text.
END = np.uint64(0x0123456789ABCDEF)


# --- connected components ---


def _marks(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) to (node, root): root is the smallest node that can be reached; nodes without an edge to another node are left out.

    Alternating large-star and small-star rounds. A round is two aggregations with map-side partial minimums, each
    joined back to the edges, so a node of very high degree is dealt out by Spark's skew join and no
    neighbourhood is ever gathered in one place. Every round is checkpointed; only two numbers come to the driver.
    A node of high degree is the smaller end of its edges after the first round, so only the large-star join can be uneven.
    """
    star = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), few=True)
    before = _marks(star)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # cut, so that the join has an exchange on either side and Spark can split the rows of a node of high degree
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), few=True)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        star = cut(small.distinct(), few=True)
        now = _marks(star)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return star.select(F.col("a").alias("node"), F.col("b").alias("root"))


# --- a set of bit positions whose size is bounded ---

#: log2 of the positions: no such set takes more than 2**POSITION_BITS / 8 bytes (128 MB), whatever the input.
POSITION_BITS = 30
SEGMENT_BITS = 22
SEGMENT_BYTES = 1 << (SEGMENT_BITS - 3)


class Positions:
    """Members of 0 ... 2**POSITION_BITS-1, as a sorted array while that is smaller, else as a bitmap; made to be broadcast."""

    def __init__(self, segments: list[tuple[int, bytes]]):
        """segments: as by_segment or as_bytes give them."""
        self.sorted = self.bitmap = None
        if sum(len(x) for _, x in segments) * 8 < 1 << POSITION_BITS and not any(len(x) == SEGMENT_BYTES for _, x in segments):
            parts = [np.frombuffer(x, "<u4") + np.uint32(s << SEGMENT_BITS) for s, x in sorted(segments)]
            self.sorted = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        else:
            self.bitmap = np.zeros(1 << (POSITION_BITS - 3), np.uint8)
            for s, x in segments:
                if len(x) != SEGMENT_BYTES:
                    bits = np.zeros(1 << SEGMENT_BITS, np.uint8)
                    bits[np.frombuffer(x, "<u4")] = 1
                    x = np.packbits(bits, bitorder="little").tobytes()
                self.bitmap[s * SEGMENT_BYTES : (s + 1) * SEGMENT_BYTES] = np.frombuffer(x, np.uint8)

    def has(self, pos: np.ndarray) -> np.ndarray:
        pos = pos.astype(np.uint32)
        if self.sorted is None:
            return (self.bitmap[pos >> np.uint32(3)] >> (pos & np.uint32(7)).astype(np.uint8)) & 1 != 0
        if not len(self.sorted):
            return np.zeros(len(pos), bool)
        at = np.searchsorted(self.sorted, pos)
        at[at == len(self.sorted)] = 0
        return self.sorted[at] == pos


def by_segment(pos: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Sorted distinct positions as (segment, little-endian 32-bit places in it)."""
    seg = pos >> SEGMENT_BITS
    cuts = np.flatnonzero(np.diff(seg)) + 1 if len(seg) else []
    for part in np.split(pos, cuts) if len(seg) else []:
        yield int(part[0]) >> SEGMENT_BITS, (part & ((1 << SEGMENT_BITS) - 1)).astype("<u4").tobytes()


def as_bytes(members: np.ndarray) -> bytes:
    """A segment's members (booleans) as their 32-bit places, or as a bitmap of SEGMENT_BYTES if that isn't longer."""
    places = np.flatnonzero(members)
    return places.astype("<u4").tobytes() if 4 * len(places) < SEGMENT_BYTES else np.packbits(members, bitorder="little").tobytes()


def hit_twice(parts: DataFrame) -> Positions:
    """parts (seg int, once binary, twice binary) to the positions that some row has twice or that two rows have once.

    Each segment's two bitmaps, once-seen and twice-seen, live in one task (8 MB unpacked); of the twice-seen places at most
    2**POSITION_BITS / 8 bytes (128 MB) come to the driver, as a task gives a dense segment as a bitmap.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one, two = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([as_bytes(two)], pa.binary())], ["seg", "places"])

        for b in batches:
            for seg, once, twice in zip(*(c.to_pylist() for c in b.columns)):
                if seg != at:
                    if at is not None:
                        yield out()
                    at, one, two = seg, np.zeros(1 << SEGMENT_BITS, bool), np.zeros(1 << SEGMENT_BITS, bool)
                once, twice = np.frombuffer(once, "<u4"), np.frombuffer(twice, "<u4")
                two[once[one[once]]] = True
                one[once] = True
                one[twice] = True
                two[twice] = True
        if at is not None:
            yield out()

    n = scan_parts(parts.sparkSession)
    found = parts.repartition(n, "seg").sortWithinPartitions("seg").mapInArrow(merge, "seg int, places binary")
    return Positions([(r["seg"], bytes(r["places"])) for r in found.where("length(places) > 0").collect()])


#: Stands for a missing document id where ids are compared: it comes after all others.
NO_ID = 2**63 - 1
