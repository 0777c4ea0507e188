"""Operator 10, approximate nearest neighbours: cross-polytope hashing with multiprobe tables and exact reranking.

A table of the index turns unit vectors by a pseudo-rotation, three rounds of random signs and a fast Hadamard transform, and puts each vector into the
bucket of the signed axis nearest to it. A query goes in each table to the ``PROBES`` buckets of the axes nearest to it. What it meets there is ranked
exactly, by cosines in double precision. With the defaults, measured recall at 5 against brute force on random 64-dimensional vectors, the hardest case,
is above 0.97; a structured table gives more.

Buckets are dealt out in blocks of at most about ``BLOCK`` vectors by ``QUERIES`` queries, so a vector that a third of all rows are near to fills many
blocks, not one task. Queries that meet fewer than k vectors are compared with all of them. Only the sizes of buckets, at most tables times twice the
dimension for each dimension, come to the driver. The coded vectors are written to the shared folder.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null vec_id, take no part; rows that repeat a
vec_id count once, with the least of their vectors; vectors of other dimensions than the query's are no candidates; ties go to the smaller vec_id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltgrain.llm.common import Scratch

TABLES, PROBES, BLOCK, QUERIES = 8, 12, 8192, 4096
FOUND = "query_id bigint, vec_id bigint, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, scaled to keep lengths; rows of a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Unit vectors as one table turns them, in the next power of two dimensions."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    signs = np.random.default_rng([size, table]).choice([-1.0, 1.0], (3, size))
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for row in signs:
        y = hadamard(y * row)
    return y


def nearest_axes(y: np.ndarray, n: int) -> np.ndarray:
    """The n signed axes nearest to each row, nearest first: 2 * axis, and 1 more for its negative."""
    both = np.stack([y, -y], axis=2).reshape(len(y), 2 * y.shape[1])
    n = min(n, both.shape[1])
    some = np.argpartition(-both, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(both, some, 1), axis=1, kind="stable"), 1)


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _coded(vectors: DataFrame, tables: int, probes: int, is_query: Column) -> DataFrame:
    """vec_id, vector, dim, is_query, codes (a bucket in each table) and, of queries, axes (the buckets to probe, table by table)."""
    kind = vectors.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column(1))
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                asks = np.flatnonzero(part.column(3).to_numpy(zero_copy_only=False))
                codes, axes = np.empty((len(x), tables), np.int32), []
                for t in range(tables):
                    y = rotated(x, t)
                    codes[:, t] = nearest_axes(y, 1)[:, 0]
                    axes.append(nearest_axes(y[asks], probes).astype(np.int32))
                probed: list = [None] * len(x)
                for i, k in enumerate(asks):
                    probed[k] = [a[i].tolist() for a in axes]
                columns = [*part.columns, pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array(probed, pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "dim", "is_query", "codes", "axes"])

    source = vectors.select("vec_id", "vector", F.size("vector").alias("dim"), is_query.alias("is_query"))
    return source.mapInArrow(run, f"vec_id bigint, vector {kind}, dim int, is_query boolean, codes array<int>, axes array<array<int>>")


def _best(k: int):
    """What finds the k nearest of the left side's vectors for each vector of the right side."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            ids, x = left.column("vec_id").to_numpy(), _matrix(left.column("vector"))
            asked, q = right.column("vec_id").to_numpy(), _matrix(right.column("vector"))
            # Scaled by powers of two, which changes no cosine, so that no square overflows or vanishes.
            x = x * 2.0 ** -np.frexp(np.abs(x).max(1, keepdims=True))[1]
            q = q * 2.0 ** -np.frexp(np.abs(q).max(1, keepdims=True))[1]
            lengths, q_lengths = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
            unit = (x / lengths[:, None]).T.copy()
            for first in range(0, len(q), 64):
                rough = (q[first : first + 64] / q_lengths[first : first + 64, None]) @ unit
                for i, row in enumerate(rough, first):
                    row[ids == asked[i]] = -np.inf
                    least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    some = np.flatnonzero((row >= least - 1e-9) & (row > -np.inf))
                    # Pair by pair, so that equal vectors have equal scores, and in the order of the components.
                    exact = (x[some] * q[i]).sum(1) / (lengths[some] * q_lengths[i])
                    order = np.lexsort((ids[some], -exact))[:k]
                    out.append((np.full(len(order), asked[i]), ids[some][order], exact[order]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES, probes: int = PROBES, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest vectors found for each row for which is_query (over its vec_id) holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    clean = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector")).filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    clean = clean.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    coded = scratch.table(_coded(clean, tables, probes, is_query), "coded")
    queries = spark.read.schema(coded.schema).parquet(scratch.path("coded")).filter("is_query")  # apart from coded, for it meets itself
    held = coded.select("dim", "vec_id", F.posexplode("codes").alias("tab", "bucket"))
    sizes = held.groupBy("dim", "tab", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asked = queries.select("dim", "vec_id", F.posexplode("axes").alias("tab", "axes")).select("dim", "vec_id", "tab", F.explode("axes").alias("bucket"))
    demand = asked.groupBy("dim", "tab", "bucket").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("askers"))
    plan = sizes.join(demand, ["dim", "tab", "bucket"]).select("dim", "tab", "bucket", "blocks", "askers")
    plan = F.broadcast(spark.createDataFrame(plan.collect(), plan.schema))  # at most tables * twice the dimension rows for each dimension
    keys = ["dim", "tab", "bucket", "block", "asker"]

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = coded.select("dim", "vec_id", "vector", F.posexplode("codes").alias("tab", "bucket")).join(plan, ["dim", "tab", "bucket"])
    left = left.withColumn("block", own("blocks")).withColumn("asker", every("askers")).select(*keys, "vec_id", "vector")
    right = queries.select("dim", "vec_id", "vector", F.posexplode("axes").alias("tab", "axes")).select("dim", "vec_id", "vector", "tab", F.explode("axes").alias("bucket"))
    right = right.join(plan, ["dim", "tab", "bucket"]).withColumn("asker", own("askers")).withColumn("block", every("blocks")).select(*keys, "vec_id", "vector")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k), FOUND)
    found = scratch.table(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    others = coded.groupBy("dim").agg((F.count("*") - 1).alias("others"))
    short = queries.join(counts, F.col("vec_id") == F.col("query_id"), "left").join(F.broadcast(others), "dim").filter(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), "others"))
    short = scratch.table(short.select("dim", "vec_id", "vector", F.ceil((F.col("others") + 1) / BLOCK).cast("int").alias("blocks")), "short")
    n_short = short.count()
    if n_short:
        askers = -(-n_short // QUERIES)
        every_row = coded.join(F.broadcast(others), "dim").withColumn("blocks", F.ceil((F.col("others") + 1) / BLOCK).cast("int"))
        left = every_row.withColumn("block", own("blocks")).withColumn("asker", F.explode(F.sequence(F.lit(0), F.lit(askers - 1)))).select("dim", "block", "asker", "vec_id", "vector")
        right = short.withColumn("asker", F.pmod(F.xxhash64("vec_id"), F.lit(askers)).cast("int")).withColumn("block", every("blocks")).select("dim", "block", "asker", "vec_id", "vector")
        more = left.groupBy("dim", "block", "asker").cogroup(right.groupBy("dim", "block", "asker")).applyInArrow(_best(k), FOUND)
        found = found.unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
