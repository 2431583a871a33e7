"""Exact top-k by inner product with a three-phase uniform threshold.

A vector's dimensions are dealt into lists; the score of a pair is the sum of its partial scores. First every task gathers, for
each query, the best entries of each of its local lists with their totals; the k-th best total known is a lower bound of the
k-th best score. This cutoff, shared out evenly over the lists above their smallest entries, is sent along with the
queries: a pair under the threshold in every list cannot reach it. The tasks then collect the entries at or over the threshold, drop
those whose upper bound misses the cutoff, and add up the missing partial scores of the rest. Queries are read in blocks from a
written stage, so a task holds its own vectors, one block of queries and one matrix of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohorta.llm.text import file_system, picked
from kohorta.session import scratch_path

QUERY_BLOCK, VECTOR_BLOCK, VECTORS_AT_ONCE = 512, 4096, 100_000
NOTHING = -(1 << 62)


def _matrix(lists, dims):
    """Integer vectors as rows; shorter ones are filled with zeros."""
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values[offsets[0]: offsets[-1]]
    return out


def _exact(a, b):
    """Integer inner products of all rows; through doubles where these hold every sum exactly."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 1 << 53 else a @ b.T


def _vectors(batches, dims):
    """The vectors of a partition, some at once."""
    ids, parts, n = [], [], 0
    for batch in batches:
        ids.append(batch.column("vec_id").to_numpy())
        parts.append(_matrix(batch.column("vector"), dims))
        n += batch.num_rows
        if n >= VECTORS_AT_ONCE:
            yield np.concatenate(ids), np.concatenate(parts)
            ids, parts, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(parts)


def _queries(path, columns):
    import pyarrow.dataset as ds

    system, plain = file_system(path)
    for batch in ds.dataset(plain, filesystem=system, format="parquet").to_batches(columns=columns, batch_size=QUERY_BLOCK):
        if batch.num_rows:
            yield batch


def _cuts(dims, lists):
    edges = np.linspace(0, dims, lists + 1).astype(int)
    return list(zip(edges[:-1], edges[1:]))


def _gather(path, dims, lists, k):
    """Phase one: per query and local list the k largest entries with their totals, and the smallest entry."""
    def run(batches):
        for ids, vectors in _vectors(batches, dims):
            for block in _queries(path, ["query_id", "vector"]):
                own, queries = block.column("query_id").to_numpy(), _matrix(block.column("vector"), dims)
                best = [[(np.zeros((len(own), 0), np.int64),) * 3, np.full(len(own), -NOTHING)] for _ in range(lists)]
                for at in range(0, len(ids), VECTOR_BLOCK):
                    some, chunk = ids[at: at + VECTOR_BLOCK], vectors[at: at + VECTOR_BLOCK]
                    partial = [_exact(queries[:, a:b], chunk[:, a:b]) for a, b in _cuts(dims, lists)]
                    total, self_ = sum(partial), own[:, None] == some
                    for state, p in zip(best, partial):
                        state[1] = np.minimum(state[1], np.where(self_, -NOTHING, p).min(axis=1, initial=-NOTHING))
                        masked = np.where(self_, NOTHING, p)
                        top = np.argpartition(-masked, min(k, masked.shape[1]) - 1, axis=1)[:, :k]
                        fresh = [np.take_along_axis(masked, top, 1), np.broadcast_to(some, masked.shape)[
                            np.arange(len(own))[:, None], top], np.take_along_axis(total, top, 1)]
                        joined = [np.concatenate(x, axis=1) for x in zip(state[0], fresh)]
                        kept = np.argsort(-joined[0], axis=1, kind="stable")[:, :k]
                        state[0] = tuple(np.take_along_axis(x, kept, 1) for x in joined)
                for number, ((entry, vec, total), least) in enumerate(best):
                    row, column = np.nonzero(entry > NOTHING)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[row]), pa.array(np.full(len(row), number, np.int32)), pa.array(vec[row, column]),
                         pa.array(total[row, column]), pa.array(least[row])], ["query_id", "list", "vec_id", "total", "least"])
    return run


def _resolve(path, dims, lists):
    """Phases two and three: entries over the threshold of some list, pruned by their upper bounds, with exact totals."""
    def run(batches):
        for ids, vectors in _vectors(batches, dims):
            for block in _queries(path, ["query_id", "vector", "cutoff", "least"]):
                own, queries = block.column("query_id").to_numpy(), _matrix(block.column("vector"), dims)
                cutoff, least = block.column("cutoff").to_numpy(), _matrix(block.column("least"), lists)
                share = -((least.sum(axis=1) - cutoff) // lists)  # rounded up: lists * (share - 1) stays under the rest
                limits = least + np.maximum(share, 0)[:, None]
                for at in range(0, len(ids), VECTOR_BLOCK):
                    some, chunk = ids[at: at + VECTOR_BLOCK], vectors[at: at + VECTOR_BLOCK]
                    partial = [_exact(queries[:, a:b], chunk[:, a:b]) for a, b in _cuts(dims, lists)]
                    seen = [p >= limits[:, i: i + 1] for i, p in enumerate(partial)]
                    upper = sum(np.where(s, p, limits[:, i: i + 1]) for i, (s, p) in enumerate(zip(seen, partial)))
                    row, column = np.nonzero(np.logical_or.reduce(seen) & (upper >= cutoff[:, None]) & (own[:, None] != some))
                    score = sum(p[row, column] for p in partial)
                    enough = score >= cutoff[row]
                    yield pa.RecordBatch.from_arrays([pa.array(own[row][enough]), pa.array(some[column][enough]),
                                                      pa.array(score[enough])], ["query_id", "vec_id", "score"])
    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, lists: int = 2) -> DataFrame:
    """The k vectors with the largest scores for each query row: (query_id, rank, vec_id, score), ties to the smaller vec_id.

    vectors has vec_id and embedding; components become floor(scale * x), a score is the integer inner product, and ``is_query``
    selects the queries by vec_id. A row without vec_id, or whose embedding is missing, empty or holds a missing or
    non-finite component, takes no part; a query is not compared with rows of its own vec_id; repeated rows of a vec_id count once,
    with their largest score; shorter vectors count as filled with zeros. Queries with fewer than k others return
    all. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = picked(vectors, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("bigint"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    points = rows.where("vec_id is not null and size(embedding) > 0").where(~odd).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("vector"))
    result = "query_id long, rank int, vec_id long, score long"
    dims = points.agg(F.max(F.size("vector"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], result)
    first, second = scratch_path(spark, "queries"), scratch_path(spark, "cutoffs")
    queries = points.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    queries.write.parquet(first)
    local = points.mapInArrow(_gather(first, dims, lists, k), "query_id long, list int, vec_id long, total long, least long")
    path = scratch_path(spark, "local-lists")
    local.write.parquet(path)
    local = spark.read.schema(local.schema).parquet(path)
    least = local.groupBy("query_id", "list").agg(F.min("least").alias("least"))
    least = least.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("list", "least"))),
                                                      lambda x: x["least"]).alias("least"))
    known = local.groupBy("query_id", "vec_id").agg(F.max("total").alias("total"))
    order = Window.partitionBy("query_id").orderBy(F.col("total").desc(), "vec_id")
    cutoff = known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == k, F.min("total")).alias("cutoff"))
    sent = spark.read.schema(queries.schema).parquet(first).join(cutoff, "query_id").join(least, "query_id")
    sent.withColumn("cutoff", F.coalesce("cutoff", F.aggregate("least", F.lit(0).cast("bigint"), lambda a, x: a + x))
                    ).write.parquet(second)
    found = points.mapInArrow(_resolve(second, dims, lists), "query_id long, vec_id long, score long").groupBy(
        "query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
