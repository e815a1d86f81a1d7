"""Exact top-k inner-product search with a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stage

#: Pivots; vectors of an annulus (a block of the index), of a group of annuli, and queries of a group.
PIVOTS, ANNULUS, GROUP, QUERIES = 32, 1024, 1 << 16, 2048
#: Components up to this size give inner products that a long and a double hold exactly.
EXACT = 1 << 20

BLOCKS = "dim int, pivot int, low double, high double, most double, ids binary, vectors binary"
HITS = "query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): vectors of floor(scale * x); those that are null or hold null or non-finite components are left out."""
    rows = pick(vectors, id=id_col, v=vector_col).filter("id is not null and v is not null")
    rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.coalesce(fine, F.lit(False))).select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def keyed(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Adds the nearest pivot and the distance to it."""
    for batch in batches:
        column = batch.column("v")
        dims = column.value_lengths().to_numpy(zero_copy_only=False)
        pivot, reach = np.zeros(len(dims), dtype=np.int32), np.zeros(len(dims))
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            if dim:
                away = distances(matrix(column.take(pa.array(rows)), dim), pivots[dim])
                pivot[rows], reach[rows] = away.argmin(axis=1), away.min(axis=1)
        yield batch.append_column("dim", pa.array(dims.astype(np.int32))).append_column("pivot", pa.array(pivot)).append_column("reach", pa.array(reach))


def annuli(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Cuts vectors sorted by dimension, pivot and distance into blocks of at most `size`."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    for batch in batches:
        dim, pivot = batch.column("dim").to_numpy(), batch.column("pivot").to_numpy()
        reach, ids = batch.column("reach").to_numpy(), batch.column("id").to_numpy()
        new = np.flatnonzero(np.diff(dim, prepend=-1) | np.diff(pivot, prepend=-1))
        out = []
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(dim)], strict=True):
            for k in range(a, b, size):
                stop = min(b, k + size)
                values = batch.column("v").slice(k, stop - k).flatten().to_numpy(zero_copy_only=False).astype("<i8")
                norm = np.sqrt((values.reshape(stop - k, -1).astype(np.float64) ** 2).sum(axis=1).max()) if len(values) else 0.0
                out.append((int(dim[a]), int(pivot[a]), float(reach[k]), float(reach[stop - 1]), float(norm), ids[k:stop].astype("<i8").tobytes(), values.tobytes()))
        yield pa.RecordBatch.from_pydict({n: [row[i] for row in out] for i, n in enumerate(names)}, schema=pa.schema([("dim", pa.int32()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("most", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())]))


def inner(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors; beyond what a long holds, the nearest long."""
    if max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0)) <= EXACT and queries.shape[1] <= 1 << 12:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search(index: pa.Table, queries: pa.Table, pivots: dict[int, np.ndarray], k: int) -> pa.Table:
    """The k best of a group of annuli for each query of a group.

    With the query at distance d of a pivot and the annulus at low..high, the triangle inequality
    keeps every vector x of it at least t = max(d - high, low - d, 0) from the query q, so q.x is at
    most (|q|^2 + |x|^2 - t^2) / 2 and at most q.p + |q| high. Annuli are opened best bound first; a query
    is done when its k-th score beats the bounds of all that are left.
    """
    out_query, out_vec, out_score = [], [], []
    if not index.num_rows or not queries.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    dim = index.column("dim")[0].as_py()
    ids = queries.column("id").to_numpy()
    q = queries.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), dim)
    qf = q.astype(np.float64)
    norm = np.sqrt((qf**2).sum(axis=1))
    blocks = index.drop_columns(["ids", "vectors"]).to_pandas()
    p = pivots[dim][blocks["pivot"]] if dim else np.zeros((len(blocks), 0))
    away = distances(qf, p)
    low, high, most = (blocks[c].to_numpy() for c in ("low", "high", "most"))
    gap = np.maximum(np.maximum(away - high, low - away), 0)
    bound = np.minimum((norm[:, None] ** 2 + most**2 - gap**2) / 2, qf @ p.T + norm[:, None] * high) 
    bound += 1e-6 * (1 + norm[:, None] * most) + 1e-11 * (norm[:, None] ** 2 + most**2 + away**2 + high**2)  # rounding
    best_score = np.full((len(ids), k), np.iinfo(np.int64).min)
    best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
    found = np.zeros(len(ids), dtype=np.int64)
    for block in np.argsort(-bound.max(axis=0), kind="stable").tolist():
        rows = np.flatnonzero((found < k) | (bound[:, block] >= best_score[:, -1]))
        if not len(rows):
            continue
        vec_ids = np.frombuffer(index.column("ids")[block].as_py(), dtype="<i8")
        vectors = np.frombuffer(index.column("vectors")[block].as_py(), dtype="<i8").reshape(len(vec_ids), dim)
        score = inner(q[rows], vectors)
        own = vec_ids[None, :] == ids[rows, None]
        scores = np.concatenate([best_score[rows], np.where(own, np.iinfo(np.int64).min, score)], axis=1)
        names = np.concatenate([best_id[rows], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(vec_ids, score.shape))], axis=1)
        order = np.lexsort((names, ~scores), axis=1)[:, :k]  # ~x: descending, without overflow
        best_score[rows], best_id[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
        found[rows] = np.minimum(k, found[rows] + (~own).sum(axis=1))
    for j in range(k):
        real = found > j
        out_query.append(ids[real])
        out_vec.append(best_id[real, j])
        out_score.append(best_score[real, j])
    return pa.table({"query_id": np.concatenate(out_query), "vec_id": np.concatenate(out_vec), "score": np.concatenate(out_score)})


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: int = 256,
    pivots: int = PIVOTS,
) -> DataFrame:
    """The k highest scores of each query among all other rows: query_id, rank (from 1), vec_id, score.

    Vectors become whole numbers floor(scale * x); the score is their inner product, ties go to the smaller
    id. is_query says which rows are queries, in terms of `id`.

    The index keys each vector by the nearest of at most `pivots` pivots (the vectors of the smallest id
    hashes, a sample of that size and the only thing fitted) and its distance, range-partitions and
    sorts by that, and cuts annuli of ANNULUS vectors. Groups of annuli meet groups of queries, each pair in a
    task of its own; `search` stops by the triangle inequality. Equal vectors are indexed once with their
    k + 1 smallest ids, the only ones that can be answers, chosen before the shuffle.

    Vectors that are null or hold null or non-finite components take no part; nor do null ids. Vectors of
    another length than the query's aren't compared; empty ones score 0 with each other. Rows that repeat an id
    with one vector count once; with different vectors each is a candidate of its own and a query id has
    one answer, of its first vector in array order. Components and scores beyond a long become the nearest long. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col, scale)
    same = Window.partitionBy("v").orderBy("id")
    few = stage(rows.distinct().withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).drop("n"))
    chosen: dict[int, list] = {}
    sizes = {r["dim"]: r["count"] for r in few.groupBy(F.size("v").alias("dim")).count().collect()}
    for dim in sizes:
        sample = few.filter(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(pivots)
        found = [r["v"] for r in sample.collect()]
        chosen[dim] = np.array(found, dtype=np.float64).reshape(len(found), dim)

    key_schema = few.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", dim int, pivot int, reach double"
    with_key = few.mapInArrow(lambda batches: keyed(batches, chosen), key_schema)
    parts = max(1, -(-sum(sizes.values()) // GROUP))
    ordered = with_key.repartitionByRange(max(parts, spark.sparkContext.defaultParallelism), "dim", "pivot", "reach", "id").sortWithinPartitions("dim", "pivot", "reach", "id")
    index = stage(ordered.mapInArrow(lambda batches: annuli(batches, ANNULUS), BLOCKS))
    index = index.withColumn("i", F.pmod(F.xxhash64("ids"), F.lit(parts)))

    first = Window.partitionBy("id").orderBy("v")
    queries = rows.filter(is_query).distinct().withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    queries = queries.withColumn("dim", F.size("v"))
    groups = max(1, -(-queries.count() // QUERIES))
    queries = queries.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(groups)))
    left = index.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("j", F.col("j").cast("long"))
    right = queries.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("i", F.col("i").cast("long"))
    hits = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInArrow(
        lambda index, queries: search(index, queries, chosen, k), HITS
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
