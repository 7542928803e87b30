r"""Line dedup with two Bloom filters, one for hashes seen once and one for hashes seen twice.

A text is split at \n; a line's key is the line stripped of `[\x20\x09-\x0D]` and lower-cased in A-Z. Keys of at
least `min_chars` code points that two or more documents hold lose all their lines but those in the document of the smallest id.

First scan: every document gives two filter positions for each of its distinct keys; a partition merges its own, and owners of filter
segments merge the partitions' into the once-seen and the twice-seen filter. Only the twice-seen filter is broadcast; it
has at most 2**30 bits (128 MB), a bound that does not depend on the input: with more lines it only lets more of them
through. Second scan: lines whose positions are all in the twice-seen filter are suspects. Suspects alone are
shuffled, as (key, id), to be confirmed on the key itself and to choose the first document; the least and greatest id of a key suffice and
are combined before the shuffle, so a line that a third of all documents hold is no hot spot. The lines to drop
return to their documents by id. The second scan is made twice, for the choice and for the lines to drop, so that
suspects need neither files nor disk; nothing but the filter is worked out before the result is asked for.

Null or empty text is one empty line. A null id comes after all ids; rows with one id count as one document. Input columns other than
id and text are kept; columns named as out_cols are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, POSITION_BITS, by_segment, fresh, hit_twice, prepare, text_bytes

STRIP = b" \t\n\x0b\x0c\r"
#: Hashes that a partition gathers before it gives away its filter positions.
GATHER = 1 << 20


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def keys_of(text: bytes, min_chars: int) -> set[bytes]:
    """The distinct keys of a text that are long enough."""
    return {k for k in (x.strip(STRIP) for x in text.lower().split(b"\n")) if long_enough(k, min_chars)}


def _positions(h: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << POSITION_BITS) - 1)
    return [(h & mask).astype(np.int64), ((h >> np.uint64(33)) & mask).astype(np.int64)]


def _seen(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    held: list[int] = []

    def give() -> pa.RecordBatch:
        pos, n = np.unique(np.concatenate(_positions(np.array(held, np.uint64))), return_counts=True)
        once, twice = dict(by_segment(pos[n == 1])), dict(by_segment(pos[n > 1]))
        segs = sorted(once.keys() | twice.keys())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(segs, pa.int32()), pa.array([once.get(s, b"") for s in segs], pa.binary()), pa.array([twice.get(s, b"") for s in segs], pa.binary())], ["seg", "once", "twice"])

    for b in batches:
        for t in text_bytes(b.column(0)):
            held.extend(map(xxhash.xxh64_intdigest, keys_of(t, min_chars)))
        if len(held) >= GATHER:
            yield give()
    if held:
        yield give()


def _suspects(batches: Iterator[pa.RecordBatch], min_chars: int, twice) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, rows = [], []
        for k, t in enumerate(text_bytes(b.column(1))):
            own = keys_of(t, min_chars)
            keys += own
            rows += [k] * len(own)
        if not keys:
            continue
        one, two = _positions(np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)))
        hit = twice.value.has(one)
        hit[hit] = twice.value.has(two[hit])
        at = np.flatnonzero(hit)
        if len(at):
            ids = b.column(0).take(pa.array(np.array(rows)[at]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([keys[x] for x in at], pa.binary())], ["id", "key"])


def _kept(text: bytes, drop: set[bytes]) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    stay = [x for x in lines if x.strip(STRIP).lower() not in drop] if drop else lines
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, out_cols: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with repeated lines taken out of the text, and, named out_cols, the number of lines before and of lines dropped."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(*(c for c in out_cols if c in docs.columns))
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    twice = spark.sparkContext.broadcast(hit_twice(text.mapInArrow(lambda it: _seen(it, min_chars), "seg int, once binary, twice binary")))
    numbered = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))

    def suspects() -> DataFrame:
        return numbered.mapInArrow(lambda it: _suspects(it, min_chars, twice), "id long, key binary")

    # the joins below have a second column, so that what comes grouped by the first one is dealt anew and Spark can split the rows of a hot line, or of no id, on the other side
    repeated = suspects().groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("key", F.xxhash64("key").alias("h"), "first")
    own, twin, drop = fresh(docs, "_id"), fresh(docs, "_twin"), fresh(docs, "_drop")
    drops = suspects().withColumn("h", F.xxhash64("key")).join(repeated, ["key", "h"]).where("id <> first").groupBy(F.col("id").alias(own)).agg(F.collect_set("key").alias(drop))
    keyed = docs.withColumn(own, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    joined = keyed.withColumn(twin, F.xxhash64(own)).join(drops.withColumn(twin, F.xxhash64(own)), [own, twin], "left").select(*docs.columns, drop)
    schema = T.StructType([*(f if f.name != text_col else T.StructField(text_col, T.StringType()) for f in docs.schema.fields), *(T.StructField(c, T.LongType()) for c in out_cols)])
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_kept(t, set(d or ())) for t, d in zip(text_bytes(b.column(at)), b.column(b.num_columns - 1).to_pylist())]
            columns = list(b.columns[:-1])
            columns[at] = pa.array([x[0] for x in found], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], schema.names)

    return joined.mapInArrow(apply, schema)
