"""Embedding near-dedup by iterative quantisation.

Rotations are learned on a bounded sample so that the signs of the rotated, centred vectors are balanced codes with
little quantisation error. Cutting the codes of several rotations into substrings of `bits` bits gives a multi-index:
vectors meet in the buckets of equal substrings, and pairs that meet are reranked by the cosine of the original vectors in
double precision. The number of tables follows from `recall`, the share of pairs at exactly the threshold that is to be
found; more similar pairs are found more surely. Centring widens the angle of a pair, the more the nearer its vectors are
to the centre; the tables are counted for the angles that the sample's vectors have after it. The substrings' length grows
with the number of vectors, so that buckets don't.

Equal vectors collapse to a class first. Rows alone in their bucket leave before vectors move. Buckets over CELL rows are
dealt into pairs of chunks. A pair counts in the first table where it meets, so that links are counted where they are
found; only counts and spanning edges leave a task, never all pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and form a component of
their own. Vectors of different lengths don't link. Repeated rows are linked like any equal vectors; rows that
repeat an id with different vectors are different ones. A null id never names a component unless all its rows have none: then that
is null, and no row of it is kept by name. Extra columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcella.llm.common import stored
from parcella.llm.components import components
from parcella.llm.simhash import _forest
from parcella.llm.vectors import matrix, rotation, unit, usable

#: Vectors that the rotations are learned on at most, and rows of a chunk of a large bucket.
SAMPLE, CELL = 20_000, 1024
#: Tables up to which codes are of centred vectors.
MOST = 1024
OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def learn(sample: np.ndarray, count: int, centred: bool = True, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """The centre of unit vectors (zero if not centred) and count rotations after principal components (dim x dim each)."""
    centre = sample.mean(axis=0) if centred else np.zeros(sample.shape[1])
    _, axes = np.linalg.eigh(np.cov(sample.T, bias=True).reshape(sample.shape[1], -1))
    v = (sample - centre) @ axes
    turns = []
    for seed in range(count):
        r = rotation(v.shape[1], seed)
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        turns.append(axes @ r)
    return centre, np.stack(turns)


def tables_for(n: int, threshold: float, recall: float, spread: dict[int, np.ndarray] | None = None) -> tuple[int, int, set[int]]:
    """Bits of a substring and number of tables for n vectors, and the lengths to be centred.

    spread: by length, the squared distances of unit vectors from their centre. Vectors at distance r and at the threshold's
    angle have 2 r^2 (1 - cosine after centring) = 2 (1 - threshold). A length whose vectors lie so close to their centre
    that it would take over MOST tables isn't centred: its angles stay as they are, and its buckets are fuller.
    """
    plain = np.array([1 - math.acos(threshold) / math.pi])
    agree = {d: np.maximum(1 - np.arccos(np.clip(1 - (1 - threshold) / np.maximum(r, 1e-12), -1, 1)) / math.pi, 1e-3) for d, r in (spread or {}).items()}

    def length() -> int:
        """At least what 20 bits say before centring: bits of wider angles say more each."""
        typical = float(np.log(np.concatenate([*agree.values(), plain])).mean())
        return max(math.ceil(20 * math.log(plain[0]) / min(math.log(plain[0]), typical)), math.ceil(math.log2(max(2, n))) + 4)

    def needed(one: np.ndarray, bits: int) -> int:
        apart, low, high = np.log1p(-(one**bits)), 0, 1
        while high <= MOST << 20 and (-np.expm1(high * apart)).mean() < recall:
            low, high = high, high * 2
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if (-np.expm1(mid * apart)).mean() >= recall else (mid, high)
        return high

    bits = length()
    # longer substrings for many vectors take more tables even before centring
    agree = {d: one for d, one in agree.items() if needed(one, bits) <= max(MOST, needed(plain, bits))}
    bits = length()
    return bits, max(needed(one, bits) for one in [*agree.values(), plain]), set(agree)


def _codes(models: dict[int, tuple[np.ndarray, np.ndarray]], bits: int, tables: int):
    def model(dim: int) -> tuple[np.ndarray, np.ndarray]:
        if dim not in models:  # a length that the sample doesn't hold
            models[dim] = np.zeros(dim), np.stack([rotation(dim, s) for s in range(-(-bits * tables // dim))])
        return models[dim]

    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("vector").value_lengths())
            keys = np.zeros((b.num_rows, tables), np.int64)
            for dim in np.unique(dims):
                rows = np.nonzero(dims == dim)[0]
                centre, turns = model(int(dim))
                x = unit(matrix(b.column("vector").take(pa.array(rows)))) - centre
                signs = np.concatenate([x @ t > 0 for t in turns], axis=1)[:, : bits * tables]
                keys[rows] = signs.reshape(len(rows), tables, bits) @ weights
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * tables
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "rows", "vector")), pa.ListArray.from_arrays(offsets, keys.ravel())], names=["id", "rows", "vector", "keys"])

    return run


def _linked(v: np.ndarray, u: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, near: np.ndarray) -> np.ndarray:
    """Whether pairs link; near has their products of unit vectors. Close calls are taken on the original vectors."""
    yes = near >= threshold
    close = np.nonzero(np.abs(near - threshold) < 1e-9)[0]
    if len(close):
        a, b = v[i[close]], v[j[close]]
        yes[close] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))) >= threshold
    return yes


def _rerank(threshold: float):
    def cells(ids: np.ndarray, rows: np.ndarray, v: np.ndarray, keys: np.ndarray, table: np.ndarray, first: np.ndarray, same: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
        n, u = len(ids), unit(v)
        ends = np.searchsorted(cell, cell, side="right")
        left = np.where(first, ends - np.arange(n) - 1, 0)
        labels, degree = np.arange(n), np.zeros(n, np.int64)

        def keep(i: np.ndarray, j: np.ndarray, near: np.ndarray) -> None:
            yes = _linked(v, u, i, j, threshold, near)
            yes &= same[i] | (first[i] != first[j])  # pairs of one chunk count in its own cell
            i, j = i[yes], j[yes]
            met = keys[i] == keys[j]
            yes = met.any(axis=1) & (met.argmax(axis=1) == table[i])  # the first table in which they meet
            i, j = i[yes], j[yes]
            np.add.at(degree, i, rows[j])
            np.add.at(degree, j, rows[i])
            _forest(labels, i, j)

        starts = np.unique(np.searchsorted(cell, cell))
        sizes = ends[starts] - starts
        for s, size in zip(starts[sizes > 32], sizes[sizes > 32]):
            for a in range(s, s + int(first[s : s + size].sum()), 512):
                e = min(a + 512, s + int(first[s : s + size].sum()))
                near = u[a:e] @ u[a : s + size].T
                i, j = np.nonzero(near >= threshold - 1e-9)
                fwd = j > i
                i, j = i[fwd], j[fwd]
                for p in range(0, len(i), 1 << 15):
                    x, y = i[p : p + (1 << 15)], j[p : p + (1 << 15)]
                    keep(x + a, y + a, near[x, y])
        small = np.isin(np.searchsorted(cell, cell), starts[sizes <= 32])
        for d in range(1, 32):
            i = np.nonzero(small & (left >= d))[0]
            if not len(i):
                break
            keep(i, i + d, (u[i] * u[i + d]).sum(axis=1))
        at = np.nonzero(labels != np.arange(n))[0]
        some = np.nonzero(degree)[0]
        none = np.zeros(len(at), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[at], ids[some]])), pa.array(np.concatenate([ids[labels[at]], ids[some]])), pa.array(np.concatenate([none, degree[some]]))], schema=OUT
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < 4 * CELL:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            cell = whole.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if cut:
                yield from by_length(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
            rows = whole.num_rows - cut
        if held:
            yield from by_length(pa.Table.from_batches(held).combine_chunks())

    def by_length(t: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = np.asarray(t.column("vector").combine_chunks().value_lengths())
        for dim in np.unique(dims):
            part = t.filter(pa.array(dims == dim))
            num = lambda c: part.column(c).to_numpy()
            keys = np.asarray(part.column("keys").combine_chunks().flatten()).reshape(part.num_rows, -1)
            yield cells(num("id"), num("rows"), matrix(part.column("vector")), keys, num("table"), np.asarray(num("first"), bool), np.asarray(num("same"), bool), num("cell"))

    return run


def near_dedup(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.95, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), named by id_col: one row per row of vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = rows.where(usable(F.col("vector")))
    # a class is named by its place in the table, written once: ids may repeat or be null, and hashes may meet
    classes = good.groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "itqclasses")
    n = classes.count()
    models: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    seen = [np.asarray(r[0]) for r in classes.orderBy(F.xxhash64("vector"), "vector").limit(sample).select("vector").collect()]
    known = {dim: unit(np.stack([v for v in seen if len(v) == dim])) for dim in {len(v) for v in seen}}
    bits, tables, centred = tables_for(n, threshold, recall, {dim: ((u - u.mean(axis=0)) ** 2).sum(axis=1) for dim, u in known.items()})
    for dim, u in known.items():
        models[dim] = learn(u, -(-bits * tables // dim), dim in centred)
    coded = stored(classes.select("id", "rows", "vector").mapInArrow(_codes(models, bits, tables), "id long, rows long, vector array<double>, keys array<long>"), "itqcodes")
    keyed = coded.select("id", F.size("vector").alias("dim"), F.posexplode("keys").alias("table", "key"))
    bucket = ["dim", "table", "key"]
    sizes = keyed.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    crowded = keyed.join(sizes, bucket).withColumn("chunks", F.ceil(F.col("size") / CELL).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    dealt = crowded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "id", "table", (F.col("chunk") <= F.col("other")).alias("first"), (F.col("chunk") == F.col("other")).alias("same"), F.xxhash64(*bucket, F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell")
    )
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = dealt.join(coded, "id").repartition(parts, "cell").sortWithinPartitions("cell", F.col("first").desc())
    found = stored(full.select("id", "rows", "vector", "keys", "table", "first", "same", "cell").mapInArrow(_rerank(threshold), "a long, b long, links long"), "itqlinks")
    degree = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    groups = components(found.where("links = 0").select("a", "b")).withColumnRenamed("node", "id")
    linked = classes.join(degree, "id", "left").join(groups, "id", "left").withColumn("root", F.coalesce("component", "id"))
    # of a component, the smallest id that any of its rows has
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select(F.col("vector").alias("v"), (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    joined = rows.join(named, rows["vector"] == named["v"], "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


#: DuckDB: all pairs by brute force, and components by reachability.
SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b, b.vec_id FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
reach(a, b, vec_id) AS (SELECT r, r, vec_id FROM v UNION SELECT x.a, l.b, l.vec_id FROM reach x JOIN links l ON x.b = l.a),
least AS (SELECT a, min(vec_id) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, coalesce(v.vec_id = l.component_id, false) AS kept
FROM v JOIN least l ON l.a = v.r LEFT JOIN counts c ON c.a = v.r
"""
