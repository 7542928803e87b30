"""Vectors as array columns: cosine, exact top-k, normalising, a hashing encoder, hybrid evidence."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegralType, LongType, StructField, StructType

from ..session import ship

#: Bytes of queries that go to every task at once.
QUERY_BYTES = 64 << 20
#: Rows and queries of a block of scores, as a core's cache takes them; the first block of a task is smaller.
BLOCK_ROWS, BLOCK_QUERIES, FIRST_ROWS = 8192, 512, 512
#: Pairs that are scored exactly, and that are held until then, at a time.
EXACT_PAIRS, HELD_PAIRS = 1 << 15, 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, floor: float = 1e-12) -> Column:
    size = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / size)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k nearest of each query (query_id, query) by cosine, exactly.

    Queries go to every task, beyond QUERY_BYTES in blocks by their id, each against all rows; a task keeps its own k best of a query before anything is shuffled.
    What scores null (a null vector, one with a null in it, or one of another length than the query) ranks last; of equal scores the smaller id goes first."""
    rows = vectors if where is None else vectors.where(where)
    near = _nearest if isinstance(rows.schema[id_col].dataType, IntegralType) else _nearest_by_any_id
    size = queries.agg(F.sum(F.size("query") * 8 + 32)).first()[0] or 0
    if size <= QUERY_BYTES:
        return near(rows, queries, k, id_col, vec)
    blocks = -(-5 * size // (4 * QUERY_BYTES))  # a quarter more, as hashed blocks are uneven
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (near(rows, queries.where(block == b), k, id_col, vec) for b in range(blocks)))


def _ranked(best: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.col("id"))).cast("bigint")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def _nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vec: str) -> DataFrame:
    ship(rows.sparkSession)
    sc = rows.sparkSession.sparkContext
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).toArrow()
    if not asked.num_rows:
        return _nearest_by_any_id(rows, queries, k, id_col, vec)
    shared = sc.broadcast(asked.combine_chunks())
    given = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    made = StructType([queries.schema["query_id"], StructField("id", LongType()), StructField("score", DoubleType())])
    # a task returns k rows of each query, so there are no more tasks than keep the cores busy
    found = given.coalesce(2 * sc.defaultParallelism).mapInArrow(lambda it: _search(it, shared.value, k), made)
    return _ranked(found.withColumn("id", F.col("id").cast(rows.schema[id_col].dataType)), k)


def _nearest_by_any_id(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vec: str) -> DataFrame:
    """For ids that are no whole numbers: every pair is scored by expressions."""
    q = queries.agg(F.collect_list(F.struct("query_id", "query")).alias("_qs"))
    near = rows.join(F.broadcast(q)).select(F.col(id_col).alias("id"), F.col(vec).alias("_v"), F.spark_partition_id().alias("_part"), F.explode("_qs").alias("_q"))
    scored = near.select(F.col("_q.query_id").alias("query_id"), "id", "_part", cosine(F.col("_v"), F.col("_q.query")).alias("score"))
    best = scored.withColumn("_rn", F.row_number().over(W.partitionBy("query_id", "_part").orderBy(F.desc("score"), F.col("id")))).where(F.col("_rn") <= k)
    return _ranked(best.drop("_part", "_rn"), k)


def _by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the places of its vectors, and these as a matrix; vectors that are null or have a null in them are left out."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()  # without null vectors
    at = np.r_[0, np.cumsum(np.maximum(sizes, 0))]
    if flat.null_count:
        nulls = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]
        sizes[nulls[at[1:]] > nulls[at[:-1]]] = -1
    flat = flat.to_numpy(zero_copy_only=False)
    own = {n: np.flatnonzero(sizes == n) for n in np.unique(sizes[sizes >= 0]).tolist()}
    return {n: (x, flat[at[x][:, None] + np.arange(n)]) for n, x in own.items()}


def _sums(rows: np.ndarray) -> np.ndarray:
    """The sum of each row, added up in the order of `dot`."""
    return np.cumsum(rows, axis=1)[:, -1] + 0.0 if rows.shape[1] else np.zeros(len(rows))


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(norm, unit vectors of four bytes, odd): odd ones are too small, too large or no numbers, and have no unit vector."""
    norm = np.sqrt(_sums(v * v))
    odd = ~((norm == 0) | ((norm >= 1e-6) & (norm <= 1e100)))
    size = np.where(odd | (norm == 0), 1, norm)
    return norm, np.where(odd[:, None], 0, v / size[:, None]).astype(np.float32), odd


def _ranks(group: np.ndarray) -> np.ndarray:
    """The place of each row in its group; groups are in order."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))


class _Best:
    """The k best rows so far of queries of one length.

    Products of unit vectors of four bytes show which pairs can be among them: for n dimensions they are less than (n + 8) * 2**-24 from the cosine, so a
    pair that lies `off` below the query's k-th best is out. All others are scored as in `cosine`; pairs with an odd vector always are. Nothing is left out by chance."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k, self.seen = queries, k, 0
        self.norm, self.unit, self.odd = _units(queries)
        self.off = (queries.shape[1] + 16) * 2.0**-23
        self.n = np.zeros(len(queries), np.int64)
        self.score, self.id, self.valid = np.zeros((len(queries), k)), np.zeros((len(queries), k), np.int64), np.ones((len(queries), k), bool)
        self.unscored = np.zeros((2, 0), np.int64)  # (valid, id) of the k first rows that score null

    def miss(self, valid: np.ndarray, ids: np.ndarray) -> None:
        if len(ids):
            both = np.concatenate([self.unscored, np.stack([valid, ids])], axis=1)
            self.unscored = both[:, np.lexsort((both[1], both[0]))[: self.k]]

    def add(self, v: np.ndarray, valid: np.ndarray, ids: np.ndarray) -> None:
        at = 0
        while at < len(v):
            part = slice(at, at + min(BLOCK_ROWS, max(FIRST_ROWS, 2 * self.seen)))
            self._block(v[part], valid[part], ids[part])
            self.seen += len(ids[part])
            at = part.stop

    def _block(self, v: np.ndarray, valid: np.ndarray, ids: np.ndarray) -> None:
        if v.shape[1]:  # of equal rows the k that rank first
            _, same = np.unique(np.ascontiguousarray(v).view(f"V{8 * v.shape[1]}").ravel(), return_inverse=True)
            order = np.lexsort((ids, valid, same))
            first = order[_ranks(same[order]) < self.k]
            v, valid, ids = v[first], valid[first], ids[first]
        norm, unit, odd = _units(v)
        held, n_held = [], 0
        for at in range(0, len(self.queries), BLOCK_QUERIES):
            part = slice(at, at + BLOCK_QUERIES)
            near = self.unit[part] @ unit.T
            full = self.n[part] == self.k
            low = np.where(full, self.score[part, -1] - self.off, -np.inf)
            low[np.isnan(low)] = np.inf  # only what is no number either can come before
            if not full.all() and len(v) - odd.sum() >= self.k:
                near[:, odd] = -np.inf
                low[~full] = np.partition(near[~full], -self.k, axis=1)[:, -self.k] - 2 * self.off
            near[:, odd] = np.inf
            near[self.odd[part]] = np.inf
            hit = (near >= low.astype(np.float32)[:, None]).ravel()
            if len(hit) % 8:
                pairs = np.flatnonzero(hit)
            else:  # eight at a time, as few are set
                pairs = (np.flatnonzero(hit.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
                pairs = pairs[hit[pairs]]
            held.append((pairs // len(v) + at, pairs % len(v)))
            n_held += len(pairs)
            if n_held >= HELD_PAIRS:
                self._put(held, v, norm, valid, ids)
                held, n_held = [], 0
        self._put(held, v, norm, valid, ids)

    def _put(self, held: list[tuple[np.ndarray, np.ndarray]], v: np.ndarray, norm: np.ndarray, valid: np.ndarray, ids: np.ndarray) -> None:
        """Scores the pairs (query, row) and puts them among the best."""
        if not sum(len(x) for x, _ in held):
            return
        q, r = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        score = np.empty(len(q))
        for at in range(0, len(q), EXACT_PAIRS):
            a, b = q[at : at + EXACT_PAIRS], r[at : at + EXACT_PAIRS]
            score[at : at + EXACT_PAIRS] = _sums(self.queries[a] * v[b]) / np.maximum(self.norm[a] * norm[b], 1e-12)
        some = ~((self.n[q] == self.k) & (score < self.score[q, -1]))
        q, r, score = q[some], r[some], score[some]
        old = np.unique(q)
        own, place = np.nonzero(np.arange(self.k) < self.n[old][:, None])
        own = old[own]
        group, score = np.r_[q, own], np.r_[score, self.score[own, place]]
        valid, ids = np.r_[valid[r], self.valid[own, place]], np.r_[ids[r], self.id[own, place]]
        order = np.lexsort((ids, valid, np.where(np.isnan(score), -np.inf, -score), group))
        rank = _ranks(group[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        group = group[order]
        self.score[group, rank], self.valid[group, rank], self.id[group, rank] = score[order], valid[order], ids[order]
        np.maximum.at(self.n, group, rank + 1)

    def found(self) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
        """(query, id, score), the k best of each."""
        for at in range(0, len(self.queries), 1 << 14):
            n = self.n[at : at + (1 << 14)]
            q, place = np.nonzero(np.arange(self.k) < n[:, None])
            q += at
            yield q, pa.array(self.id[q, place], mask=~self.valid[q, place]), pa.array(self.score[q, place])
            q, place = np.nonzero(np.arange(self.unscored.shape[1]) < self.k - n[:, None])
            yield q + at, pa.array(self.unscored[1, place], mask=self.unscored[0, place] == 0), pa.nulls(len(q), pa.float64())


def _search(batches: Iterator[pa.RecordBatch], asked: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of these rows for each query."""
    np.seterr(all="ignore")
    names, vectors = (asked.column(x).chunk(0) for x in ("query_id", "query"))
    groups = {n: (own, _Best(q, k)) for n, (own, q) in _by_length(vectors).items()}
    rest = np.setdiff1d(np.arange(len(names)), np.concatenate([np.zeros(0, np.int64), *(own for own, _ in groups.values())]))
    groups[-1] = rest, _Best(np.zeros((len(rest), 0)), k)
    for b in batches:
        ids, rows = b.column(0), _by_length(b.column(1))
        valid, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        for n, (_, best) in groups.items():
            other = np.ones(len(ids), bool)
            if n in rows:
                at, v = rows[n]
                other[at] = False
                best.add(v, valid[at], ids[at])
            best.miss(valid[other], ids[other])
    for own, best in groups.values():
        for q, near, score in best.found():
            yield pa.RecordBatch.from_arrays([names.take(pa.array(own[q])), near, score], ["query_id", "id", "score"])


def hashing_model(dims: int):
    """Stands in where no model is at hand: unit vectors of hashed words."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[k, h % dims] += 1.0 if h & 0x80000000 else -1.0
        return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-12)

    return encode


def encoder(dims: int = 64, load: Callable = hashing_model, batch: int = 32):
    """A pandas UDF from text to unit vectors; load(dims) gives the model, once for each worker task, and is called with `batch` texts at a time."""

    ship()

    @F.pandas_udf(ArrayType(DoubleType()))
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load(dims)
        for texts in parts:
            plain = texts.fillna("").tolist()
            vectors = [list(v) for at in range(0, len(plain), batch) for v in model(plain[at : at + batch])]
            yield pd.Series(vectors, dtype=object)

    return encode


def encoder_of(model: Callable[[list[str]], list]):
    """A pandas UDF from text to vectors, of a model that is at hand already."""
    return encoder(0, lambda _: model)


def hybrid(graph: DataFrame, vector: DataFrame) -> DataFrame:
    """Graph evidence, then vector evidence, in their own orders: (axis, pos, text)."""
    return graph.select(F.lit(0).alias("axis"), "pos", "text").unionByName(vector.select(F.lit(1).alias("axis"), "pos", "text"))
