"""Nearest neighbours by a permutation index: vectors as orders of their nearest pivots.

Pivots are vectors of the table itself. A vector is represented by its PREFIX nearest pivots in order of nearness, and posted,
with the place it gives the pivot, in the inverted file of each. A query walks the inverted files of its own nearest pivots,
which gives the footrule distance of its order to that of every vector met; the nearest by footrule are scored exactly.

The measure is the inner product. Vectors get one more coordinate that brings all to the length of the longest, so that a
larger product is a smaller distance; a query's is 0. The index is cut into shards by a hash of the rows, each with inverted
files of its own in one task, and queries into blocks, so that neither a group of copies nor a table of any size meets in one
task; a shard returns a bounded list for each query.

Vectors that are null, empty, zero, or hold null or non-finite components take no part. Vectors of another length than most
(the shortest of the most frequent ones) take no part either, as they have no inner product with the others. Rows of equal
vec_id and vector count once; rows without a vec_id are found last among ties, and ask nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

#: The pivots are a sample of the distinct vectors, those of smallest hash: twice the root of the number of rows, within these
#: bounds and PIVOT_BYTES. Every row is indexed.
FEWEST_PIVOTS, MOST_PIVOTS, PIVOT_BYTES = 1_024, 4_096, 32 << 20
#: Pivots that stand for a vector.
PREFIX = 64
#: The share of a shard that is scored exactly: the nearest by footrule. Recall hangs on it: 0.95 or more on the test tables.
DEPTH = 1 / 5
#: Rows of a shard, and queries of a block.
SHARD_ROWS, BLOCK_ROWS = 8_192, 4_096
LAST = np.iinfo(np.int64).max


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v, key): rows that take part, each once; v has doubles."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("v IS NOT NULL AND size(v) > 0")
    rows = rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    rows = rows.withColumn("key", F.xxhash64("vec_id", "v"))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).select("size")
    rows = rows.join(F.broadcast(size), F.size("v") == F.col("size")).drop("size")
    return rows.groupBy("key", "vec_id", "v").agg(F.lit(1).alias("one")).drop("one")


def pivots_of(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """The pivots, a row each: distinct vectors of smallest hash."""
    most = min(MOST_PIVOTS, max(FEWEST_PIVOTS, round(2 * n**0.5)), max(PREFIX, PIVOT_BYTES // (8 * width)))
    h = F.xxhash64(F.lit("pivot"), "v")
    sample = rows.groupBy(h.alias("h"), F.xxhash64("v").alias("h2")).agg(F.first("v").alias("v")).orderBy("h", "h2").limit(most)
    return np.array([r["v"] for r in sample.select("v").collect()], dtype=np.float64).reshape(-1, width)


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that brings each to the length of the longest, all divided by that."""
    v = vectors / longest
    return np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1)))[:, None]], axis=1)


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The prefix nearest pivots of each vector, the nearest first; ties go to the smaller index."""
    near = vectors @ pivots.T
    k = min(prefix, near.shape[1])
    if k == near.shape[1]:
        return np.argsort(-near, axis=1, kind="stable").astype(np.int16)
    edge = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
    first = np.argsort(near < edge, axis=1, kind="stable")  # those at or above the edge, by index
    width = int((near >= edge).sum(axis=1).max())
    first = first[:, :width]
    held = np.take_along_axis(near, first, axis=1)
    held[np.take_along_axis(near < edge, first, axis=1)] = -np.inf
    return np.take_along_axis(first, np.argsort(-held, axis=1, kind="stable")[:, :k], axis=1).astype(np.int16)


class InvertedFiles:
    """For each pivot, the vectors of one shard that have it in their orders, and the weight of its place: the first weighs most.

    Two orders share, for a pivot of both, the smaller of its two weights; the footrule distance of two orders (a pivot that
    is missing stands behind the last) is their length times one more, less twice the sum of what they share.
    """

    def __init__(self, order: np.ndarray, n_pivots: int):
        self.rows, self.prefix = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.row = (by // self.prefix).astype(np.int32)
        self.weight = (self.prefix - by % self.prefix).astype(np.int16)
        self.start = np.searchsorted(flat[by], np.arange(n_pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """The distance of one order to that of every row."""
        shared = np.zeros(self.rows, dtype=np.int32)
        for place, pivot in enumerate(order):
            a, b = self.start[pivot], self.start[pivot + 1]
            shared[self.row[a:b]] += np.minimum(self.weight[a:b], self.prefix - place)
        return self.prefix * (self.prefix + 1) - 2 * shared


def _matrix(column: pa.ChunkedArray, width: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def search(rows: DataFrame, asks: DataFrame, k: int = 20, depth: float = DEPTH, prefix: int = PREFIX, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of asks among rows, but for those of its own id.

    rows and asks: as usable() gives them, asks being some of rows. Nearest first, ties to smaller vec_id. A query of which
    fewer than k candidates exist gets all of them.
    """
    facts = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    n, width, longest = facts[0], facts[1] or 1, facts[2] or 1.0
    pivots = lengthened(pivots_of(rows, n, width), longest)
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asks.count() // block_rows))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_024):
                batch = whole.slice(at, 1_024)
                if not batch.num_rows:
                    continue
                v = np.asarray(pc.list_flatten(batch.column("v"))).reshape(-1, width)
                asking = np.asarray(batch.column("asking"))
                long = lengthened(v, longest)
                long[asking, -1] = 0
                order = orders(long, pivots, prefix)
                cols = {c: batch.column(c) for c in ("vec_id", "key")}
                yield pa.record_batch(cols | {"v": pa.array([x.tobytes() for x in v], pa.binary()), "places": pa.array([x.tobytes() for x in order], pa.binary())})

    form = "vec_id long, key long, v binary, places binary"
    posted = rows.withColumn("asking", F.lit(False)).mapInArrow(ordered, form).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    posted = posted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asks.withColumn("asking", F.lit(True)).mapInArrow(ordered, form).withColumn("of_block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("of_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def scored(held: pa.Table, queries: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "query": [], "vec_id": [], "score": []}
        if held.num_rows and queries.num_rows:
            held = held.sort_by([("vec_id", "ascending"), ("key", "ascending")])
            ids, v = held.column("vec_id").combine_chunks(), _matrix(held.column("v"), width)
            files = InvertedFiles(_matrix(held.column("places"), min(prefix, len(pivots)), np.int16), len(pivots))
            numbers = np.asarray(ids.fill_null(LAST))
            near = min(len(v), max(k + 1, int(np.ceil(depth * len(v)))))
            places = np.arange(len(v))
            asking = zip(queries.column("vec_id").to_pylist(), queries.column("key").to_pylist(), _matrix(queries.column("v"), width), _matrix(queries.column("places"), files.prefix, np.int16), strict=True)
            for query_id, key, q, order in asking:
                far = files.footrule(order).astype(np.int64) * len(v) + places  # ties to the smaller vec_id
                far[numbers == query_id] = LAST
                best = np.sort(np.argpartition(far, near - 1)[:near])
                best = best[far[best] < LAST]
                score = (v[best] * q).sum(axis=1)
                top = np.argsort(-score, kind="stable")[:k]
                found["query_id"] += [query_id] * len(top)
                found["query"] += [key] * len(top)
                found["vec_id"] += ids.take(pa.array(best[top])).to_pylist()
                found["score"] += score[top].tolist()
        return pa.table({c: pa.array(x, pa.float64() if c == "score" else pa.int64()) for c, x in found.items()})

    grouped = posted.groupBy("shard", "block").cogroup(asked.groupBy("of_shard", "of_block"))
    lists = grouped.applyInArrow(scored, "query_id long, query long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(usable(table(spark, sf_dir, "embeddings")))
    return search(rows, rows.where("vec_id % 20 = 0"))
