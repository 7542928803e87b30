r"""Exact dedup by an exchange of Golomb-coded fingerprints.

Two texts are equal when identical after deleting every `[\x20\x09-\x0D]`. Of equal texts the row with the most code points, then the
smallest id, stays.

First scan: SHA-256 of every normalised text; the narrow table (id, code points, digest) is checkpointed. A partition sorts the distinct
48-bit heads of its digests, cuts them by owner (a range of fingerprints) and sends each owner a Golomb-Rice
code of the differences. An owner decodes what it got, finds fingerprints that it got more than once or that a sender marks as
repeated at home, and answers with one bitmap for each sender. The senders' suspects form a bounded set
(at most 128 MB, beyond which it only lets more through) that is broadcast for the second scan: only suspects'
texts are shuffled, combined within each task first, and grouped by the normalised bytes themselves. Groups go back to
the narrow table by digest; a group that holds a third of all rows is dealt out by Spark's skew join.

Null text counts as empty. A null id comes after all ids. Repeated rows count in group_size, and every row that has
the id and length of the row that stays is marked kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, POSITION_BITS, by_segment, cut, hit_twice, prepare, scan_parts, text_bytes

DELETE = b" \t\n\x0b\x0c\r"
HEAD_BITS = 48
#: Bytes of suspects' texts that a task combines before it sends them.
HOLD_BYTES = 32 << 20


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned values: count and Rice parameter, unary quotients, then remainders, of the differences."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, float(values[-1]) / n * 0.69))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.array([n, k, len(unary)], "<u4").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    if not code:
        return np.zeros(0, np.uint64)
    n, k, m = np.frombuffer(code[:12], "<u4").astype(int)
    stop = 12 + (m + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code[12:stop], np.uint8))[:m])
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        rest = np.unpackbits(np.frombuffer(code[stop:], np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
        gaps += (rest << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = text_bytes(b.column(1))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(t.decode("utf-8", "replace")) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.translate(None, DELETE)).digest() for t in texts], pa.binary())], ["id", "points", "sha"]
        )


def heads(digests: list[bytes]) -> np.ndarray:
    """The first HEAD_BITS bits of the digests."""
    return np.frombuffer(b"".join(x[:8] for x in digests), ">u8").astype(np.uint64) >> np.uint64(64 - HEAD_BITS)


def _send(batches: Iterator[pa.RecordBatch], owners: int) -> Iterator[pa.RecordBatch]:
    found = [heads(b.column(0).to_pylist()) for b in batches if b.num_rows]
    if not found:
        return
    h, n = np.unique(np.concatenate(found), return_counts=True)
    to = ((h >> np.uint64(16)) * np.uint64(owners) >> np.uint64(HEAD_BITS - 16)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(to)) + 1
    sender, rows = TaskContext.get().partitionId(), []
    for part, count, owner in zip(np.split(h, cuts), np.split(n, cuts), to[np.r_[0, cuts]]):
        rows.append((sender, int(owner), golomb_encode(part), np.packbits(count > 1).tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["sender", "owner", "code", "again"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by owner; one owner's codes are held at a time; there are four owners for each shuffle partition."""
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        got = [(s, o, golomb_decode(c), np.unpackbits(np.frombuffer(a, np.uint8)).astype(bool)) for s, o, c, a in held]
        h, n = np.unique(np.concatenate([v for _, _, v, _ in got]), return_counts=True)
        many = h[n > 1]
        bits = [np.packbits(np.isin(v, many) | a[: len(v)]).tobytes() for _, _, v, a in got]
        cols = [pa.array([x[0] for x in got], pa.int32()), pa.array([x[1] for x in got], pa.int32()), pa.array(bits, pa.binary())]
        held.clear()
        return pa.RecordBatch.from_arrays(cols, ["sender", "owner", "bits"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[0][1] != row[1]:
                yield out()
            held.append(row)
    if held:
        yield out()


def _suspect_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for code, bits in zip(*(c.to_pylist() for c in b.columns)):
            h = golomb_decode(code)
            h = h[np.unpackbits(np.frombuffer(bits, np.uint8))[: len(h)].astype(bool)]
            rows = list(by_segment(np.unique((h >> np.uint64(HEAD_BITS - POSITION_BITS)).astype(np.int64))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([b""] * len(rows), pa.binary()), pa.array([x[1] for x in rows], pa.binary())], ["seg", "once", "twice"])


def _texts(batches: Iterator[pa.RecordBatch], suspect) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list] = {}
    size = 0
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

    def out() -> pa.RecordBatch:
        rows = [(norm, sha, points, last, n) for norm, (sha, points, last, n) in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["norm", "sha", "points", "minus_id", "n"])

    for b in batches:
        texts = text_bytes(b.column(1))
        norms = [t.translate(None, DELETE) for t in texts]
        shas = [hashlib.sha256(x).digest() for x in norms]
        hit = suspect.value.has(heads(shas) >> np.uint64(HEAD_BITS - POSITION_BITS)) if shas else []
        ids = b.column(0).to_pylist()
        for k in np.flatnonzero(hit):
            rank = (len(texts[k].decode("utf-8", "replace")), -ids[k])
            old = held.get(norms[k])
            if old is None:
                held[norms[k]] = [shas[k], *rank, 1]
                size += len(norms[k])
            else:
                old[1:3] = max((old[1], old[2]), rank)
                old[3] += 1
        if size > HOLD_BYTES:
            yield out()
            size = 0
    if held:
        yield out()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    narrow = cut(rows.mapInArrow(_digests, "id long, points long, sha binary"))
    owners = 4 * scan_parts(spark)
    sent = cut(narrow.select("sha").mapInArrow(lambda it: _send(it, owners), "sender int, owner int, code binary, again binary"))
    answers = sent.repartition(scan_parts(spark), "owner").sortWithinPartitions("owner").mapInArrow(_answer, "sender int, owner int, bits binary")
    marked = sent.join(answers, ["sender", "owner"]).select("code", "bits").mapInArrow(_suspect_places, "seg int, once binary, twice binary")
    suspect = spark.sparkContext.broadcast(hit_twice(marked))
    texts = rows.mapInArrow(lambda it: _texts(it, suspect), "norm binary, sha binary, points long, minus_id long, n long")
    groups = texts.groupBy("sha", "norm").agg(F.max(F.struct("points", "minus_id")).alias("best"), F.sum("n").alias("n")).where("n > 1")
    groups = groups.select("sha", (-F.col("best.minus_id")).alias("keep"), F.col("best.points").alias("keep_points"), "n")
    out = narrow.join(groups, "sha", "left")
    known = lambda c: F.when(c != NO_ID, c)
    return out.select(
        known(F.col("id")).alias("doc_id"),
        known(F.coalesce("keep", "id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce((F.col("id") == F.col("keep")) & (F.col("points") == F.col("keep_points")), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
