"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector is rotated at random and kept as the signs of its components, packed into bits, with one correction scalar:
the inner product a of the vector and its code. The inner product with a query is estimated as b/a, where b is that of
code and query, and lies within `spread` * sqrt((1 - a^2) / (a^2 (d - 1))) of it except with a small probability. Only
vectors whose upper bound reaches the k-th best lower bound are compared exactly, in double precision.

The query set meets all vectors in blocks: vectors and queries are each dealt into blocks of bounded size, a task holds one
block of both, and only the k best of a block leave it. Both sides' copies grow with the other side's number of blocks.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of different lengths
don't meet. Rows that repeat an id are queries and candidates each; only a query's own row is no candidate of it. Rows without
an id are candidates. Ties go to the smaller id, null last. With fewer candidates than k, all are returned. Components near the
limits of doubles neither overflow nor vanish. Extra columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcella.llm.common import stored
from parcella.llm.vectors import matrix, rotation, unit, usable

VECTORS, QUERIES = 4096, 2048
OUT = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def encode(rows: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of rotated unit rows, and the correction scalars."""
    turned = rows @ rotation(rows.shape[1], seed).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(rows.shape[1])


def estimate(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray, seed: int) -> np.ndarray:
    """Estimated inner products, vectors by queries."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32)
    turned = (queries @ rotation(dim, seed).T).astype(np.float32).T
    return (2 * (signs @ turned) - turned.sum(axis=0)) / np.float32(np.sqrt(dim)) / scalars[:, None].astype(np.float32)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component, which changes no digit of a cosine but keeps squares in range."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def cosine(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    vectors, query = scaled(vectors), scaled(query[None])[0]
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def _block(k: int, spread: float, seed: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return OUT.empty_table()
        rows, ids, v = vectors.column("row").to_numpy(), vectors.column("id").to_numpy(zero_copy_only=False), matrix(vectors.column("vector"))
        asked, names, q = queries.column("row").to_numpy(), queries.column("id"), matrix(queries.column("vector"))
        unnamed = vectors.column("id").is_null().to_numpy(zero_copy_only=False)
        ids = np.where(unnamed, 0, ids).astype(np.int64)
        codes, scalars = encode(unit(v), seed)
        guess = estimate(codes, scalars, unit(q), seed)
        bound = spread * np.sqrt(np.maximum(0, 1 - scalars**2) / (scalars**2 * max(1, v.shape[1] - 1))) + 1e-5
        found: list[tuple] = []
        for j in range(len(asked)):
            others = np.nonzero(rows != asked[j])[0]
            lower = guess[others, j] - bound[others]
            if len(others) > k:
                least = np.partition(lower, len(lower) - k)[len(lower) - k]
                others = others[guess[others, j] + bound[others] >= least]
            score = cosine(v[others], q[j])
            best = np.lexsort((ids[others], unnamed[others], -score))[:k]
            some = others[best]
            found.append((np.full(len(best), asked[j]), [names[j].as_py()] * len(best), pa.array(ids[some], mask=unnamed[some]).to_pylist(), score[best]))
        columns = [np.concatenate([x[0] for x in found]), [i for x in found for i in x[1]], [i for x in found for i in x[2]], np.concatenate([x[3] for x in found])]
        return pa.table([pa.array(c, t) for c, t in zip(columns, OUT.types)], schema=OUT)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, spread: float = 4.0, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine for each row where is_query holds."""
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asked")).where(usable(F.col("vector")))
    # numbered once and written: a row is told from its equals by its number
    clean = stored(clean.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "onebit")
    counts = clean.agg(F.count("*"), F.count(F.when(F.col("asked"), 1))).first()
    parts, asks = max(1, -(-counts[0] // VECTORS)), max(1, -(-counts[1] // QUERIES))
    left = clean.select("row", "id", "vector", "dim", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("ask"))
    right = clean.where("asked").select("row", "id", "vector", "dim", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("row"), F.lit(asks)).cast("int").alias("ask"))
    keys = ["dim", "part", "ask"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block(k, spread, seed), "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
