"""An approximate index of vectors by cells around centroids, beside the exact scan of `vectors.top_k`.

Centroids come from a bounded sample (at most SAMPLE_ROWS rows and SAMPLE_BYTES), but every row of the table gets a cell. A search compares a query with
the rows of its `probes` nearest cells. How many those are is measured when the index is built: the least number that holds `aim` of the
neighbours that sample rows have among the sample. Rows never move in a search: queries are broadcast, in blocks of a checked size, so a cell that holds a third of
all rows is no hot spot. A stored index is partitioned by cell, and cells that no query asks for are not read.

A null vector, or one of another length than the centroids, lies in the cell of the zero vector and scores null, as in the exact scan; an empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .vectors import QUERY_BYTES, cosine

#: Bounds of the sample that centroids and probes are fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 16384, 32 << 20
#: Rows of the sample that each cell has on average, at least.
CELL_ROWS = 16
#: Sample rows that serve as queries when the probes are measured.
TRIALS = 256


@dataclass
class Index:
    """rows: the table with a column `cell`; centroids: a unit vector for each cell; probes: cells that a query looks into."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """Unit vectors as rows; zeros for what is null or has another length."""
    out = np.zeros((len(vectors), dims), np.float32)
    for k, v in enumerate(vectors):
        if v is not None and len(v) == dims:
            out[k] = np.nan_to_num(np.asarray(v, np.float32))
    return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-12)


def _sample(vectors: DataFrame, id_col: str, vec: str) -> np.ndarray:
    """Rows by a hash of their id, about as many as the bounds allow, never more."""
    row = vectors.agg(F.count(vec).alias("n"), F.max(F.size(vec)).alias("dims")).first()
    dims = row["dims"] or 0
    if not row["n"] or dims < 1:
        return np.zeros((0, 1), np.float32)
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * dims)))
    some = vectors.where(F.col(vec).isNotNull())
    if row["n"] > most:
        some = some.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < int((1 << 40) * most / row["n"]))
    found = some.select(F.transform(vec, lambda x: x.cast("float")).alias("v")).limit(most).toPandas()
    return _matrix(found["v"], dims)


def _cells(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centroids by spherical k-means; an empty cell moves to the row that is farthest from its own."""
    rng = np.random.default_rng(5)
    at = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        near = sample @ at.T
        own = near.argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(near.max(1), kind="stable")[: len(empty)]]
        at = sums / np.maximum(np.sqrt((sums**2).sum(1, keepdims=True)), 1e-12)
    return at


def _probes(sample: np.ndarray, centroids: np.ndarray, k: int, aim: float) -> int:
    """The least number of cells that hold `aim` of the k nearest sample rows of TRIALS of them."""
    asked = sample[np.random.default_rng(6).permutation(len(sample))[:TRIALS]]
    score = asked @ sample.T
    near = np.argsort(-score, axis=1, kind="stable")[:, 1 : k + 1]  # without the row itself
    if not near.size:
        return len(centroids)
    own = (sample @ centroids.T).argmax(1)
    place = np.empty((len(asked), len(centroids)), np.int64)
    np.put_along_axis(place, np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), np.arange(len(centroids))[None], axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))]) + 1


def nearest_cells(vec: Column, centroids: np.ndarray, n: int) -> Column:
    """The n cells whose centroids are nearest to each vector, nearest first."""
    ship()
    shared = SparkSession.active().sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def cells(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = shared.value
        for vectors in parts:
            near = _matrix(vectors, at.shape[1]) @ at.T
            yield pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)), dtype=object)

    return cells(vec)


def build(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", k: int = 5, aim: float = 0.97) -> Index:
    """An index of all rows: about the root of their number of cells, as far as the sample can tell them apart."""
    sample = _sample(vectors, id_col, vec)
    if not len(sample):
        return Index(vectors.withColumn("cell", F.lit(0)), np.zeros((1, sample.shape[1]), np.float32), 1)
    centroids = _cells(sample, int(np.clip(np.sqrt(vectors.count()), 1, max(1, len(sample) // CELL_ROWS))))
    return Index(vectors.withColumn("cell", nearest_cells(F.col(vec), centroids, 1)[0]), centroids, _probes(sample, centroids, k, aim))


def save(index: Index, path: str) -> None:
    """Rows by cell, and the centroids beside them."""
    index.rows.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark = index.rows.sparkSession
    made = [(c, [float(x) for x in v], index.probes) for c, v in enumerate(index.centroids)]
    spark.createDataFrame(made, "cell int, centroid array<float>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def load(spark: SparkSession, path: str) -> Index:
    made = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return Index(spark.read.parquet(f"{path}/rows"), np.array([r["centroid"] for r in made], np.float32), made[0]["probes"])


def search(index: Index, queries: DataFrame, k: int = 5, where: Column | None = None, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): of each query (query_id, query) the k nearest rows by cosine in its cells. Rows that `where` leaves out are left out before they are ranked."""
    rows = index.rows if where is None else index.rows.where(where)
    asked = queries.select("query_id", "query", F.explode(nearest_cells(F.col("query"), index.centroids, index.probes)).alias("cell"))
    size = (queries.agg(F.sum(F.size("query") * 8 + 48)).first()[0] or 0) * index.probes
    blocks = 1 if size <= QUERY_BYTES else -(-5 * size // (4 * QUERY_BYTES))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    order = [F.desc("score"), F.col("id")]

    def some(part: DataFrame) -> DataFrame:
        near = rows.join(F.broadcast(part), "cell").select("query_id", F.col(id_col).alias("id"), cosine(F.col(vec), F.col("query")).alias("score"), F.spark_partition_id().alias("_part"))
        return near.withColumn("_rn", F.row_number().over(W.partitionBy("query_id", "_part").orderBy(*order))).where(F.col("_rn") <= k)

    best = reduce(DataFrame.unionByName, (some(asked if blocks == 1 else asked.where(block == b)) for b in range(blocks)))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("bigint")).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")
