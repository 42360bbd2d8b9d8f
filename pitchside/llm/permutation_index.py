"""Approximate nearest neighbours by a permutation index.

PIVOTS vectors, a sample taken by a hash of their ids, order every vector: its prefix is the list
of its nearest PREFIX pivots. Each shard of the index keeps an inverted file of pivots, with the
vectors that have the pivot in their prefix and its place there. A query reads the postings of its
own nearest ASKED pivots only, sums the footrule distance (the difference of places; a missing pivot
counts as place PREFIX), and the nearest FRACTION of the shard by that distance (ten times k at least)
are compared exactly, by the cosine in double precision. The best of all shards are the answer.

Equal vectors are one entry of the index with their least k + 1 ids, so a group of copies costs one
comparison and no answer is lost. Queries go to shards in blocks; the query set is a stated part of
the rows. Only the pivots, PIVOTS vectors at most, are broadcast.

Vectors that are null, zero, hold null or non-finite parts, or whose length is not the commonest
one take no part; an empty table has no answers. Rows with one id are separate vectors, but never
answer a query of the same id. Rows without an id take no part. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchside.llm.common import cut, table

PIVOTS = 512
PREFIX = 256
ASKED = 64
FRACTION = 0.15
K = 5
#: Vectors of a shard and queries of a block, about.
SHARD_ROWS = 8_192
BLOCK_ROWS = 1_024


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v (doubles) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(
        "id is not null and v is not null and size(v) > 0"
        " and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        " and exists(v, x -> x <> 0)"
    )
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    d = lengths.first()
    return rows.where(F.size("v") == F.lit(d["d"] if d else 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def prefixes(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each unit vector, nearest first (ties to the first pivot)."""
    n = min(PREFIX, len(pivots))
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :n].astype(np.int16)


class Shard:
    """Vectors with their inverted file."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray):
        self.vectors, self.unit = x, unit(x)
        order = prefixes(self.unit, pivots)
        self.length = order.shape[1]
        by_pivot = np.argsort(order.ravel(), kind="stable")
        rows, places = np.divmod(by_pivot, self.length)
        ends = np.cumsum(np.bincount(order.ravel(), minlength=len(pivots)))
        self.postings = [
            (rows[a:b], places[a:b].astype(np.int32)) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)
        ]

    def footrule(self, prefix: np.ndarray) -> np.ndarray:
        """Distance of each vector's order to the first places of a query's."""
        prefix = prefix[:ASKED]
        # a vector without any of the query's pivots is as far as all of them missing
        total = np.full(len(self.unit), int((self.length - np.arange(len(prefix))).sum()), np.int32)
        for place, pivot in enumerate(prefix):
            rows, places = self.postings[pivot]
            total[rows] += np.abs(places - place) - (self.length - place)
        return total

    def nearest(self, query: np.ndarray, prefix: np.ndarray, k: int, fraction: float) -> tuple[np.ndarray, np.ndarray]:
        """The candidates for a unit vector, and their cosines."""
        n = max(10 * k, int(np.ceil(fraction * len(self.unit))))
        far = self.footrule(prefix)
        near = np.argpartition(far, n)[:n] if n < len(far) else np.arange(len(far))
        return near, self.unit[near] @ query


def search(vectors: DataFrame, is_query, k: int = K, fraction: float = FRACTION) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each usable vector for which is_query holds."""
    spark = vectors.sparkSession
    rows = cut(usable(vectors))
    sample = rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(PIVOTS).toPandas()
    pivots = unit(np.array(sample["v"].to_list(), float)) if len(sample) else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(pivots)

    # the least k + 1 ids of each distinct vector: aggregated in two steps, so copies meet sorted
    place = Window.partitionBy("v", "salt").orderBy("id")
    some = (
        rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= k + 1)
        .select("id", "v")
    )
    entries = cut(
        some.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    )
    shards = max(1, -(-entries.count() // SHARD_ROWS))
    queries = cut(rows.where(is_query(F.col("id"))))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[i : i + BLOCK_ROWS]
                x = np.array(part["v"].to_list(), float)
                yield pd.DataFrame({"ids": [part["id"].to_numpy().tobytes()], "vectors": [x.tobytes()]})

    def entry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"ids": [i.tobytes() for i in pdf["ids"]], "vectors": [v.tobytes() for v in pdf["v"]]})

    # a stated query set against all rows, in blocks: a shard's entries come before the blocks
    asked = (
        queries.repartition(int(blocks), F.xxhash64("id"))
        .mapInPandas(block, "ids binary, vectors binary")
        .select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "ids", "vectors")
    )
    kept = entries.mapInPandas(entry, "ids binary, vectors binary").select(
        F.pmod(F.xxhash64("vectors"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "ids", "vectors"
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, ids, vectors = None, None, [], []
        for batch in batches:
            for s, kind, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != number:
                    number, shard, ids, vectors = s, None, [], []
                if kind == 0:
                    ids.append(np.frombuffer(i, np.int64).tolist())
                    vectors.append(v)
                elif ids:
                    if shard is None:
                        shard = Shard(np.frombuffer(b"".join(vectors), float).reshape(len(ids), -1), shared.value)
                    yield _answers(shard, ids, np.frombuffer(i, np.int64), v, shared.value, k, fraction)

    got = (
        kept.unionByName(asked)
        .repartition(int(shards), "shard")
        .sortWithinPartitions("shard", "kind")
        .mapInArrow(answer, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        got.distinct()
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _answers(shard: Shard, ids: list, q_ids: np.ndarray, q_bytes: bytes, pivots: np.ndarray, k: int, fraction: float) -> pa.RecordBatch:
    """The best of a shard for each query of a block, scored by the original vectors."""
    found = []
    original = np.frombuffer(q_bytes, float).reshape(len(q_ids), -1)
    units = unit(original)
    for q_id, vector, one, prefix in zip(q_ids.tolist(), original, units, prefixes(units, pivots), strict=True):
        near, score = shard.nearest(one, prefix, k, fraction)
        m = min(len(near), k + 1)
        least = -np.partition(-score, m - 1)[m - 1]
        best = near[score >= least - 1e-12]  # with ties
        rows = sorted((-cosine(vector, shard.vectors[j]), i) for j in best for i in ids[j] if i != q_id)
        found += [(q_id, i, -s) for s, i in rows[:k]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f[0] for f in found], pa.int64()),
            pa.array([f[1] for f in found], pa.int64()),
            pa.array([f[2] for f in found], pa.float64()),
        ],
        ["query_id", "vec_id", "score"],
    )


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in double precision; parts are scaled first so that no square overflows."""
    top_a, top_b = np.abs(a).max(), np.abs(b).max()
    a, b = a / top_a, b / top_b
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


QUERIES = {"op9_permutation_index": op9}
