"""SimHash near-dedup with bit-sliced comparison.

Every text gets a 64-bit fingerprint: a bit is 1 if it is set in over half of the hashes of the text's word shingles.
Fingerprints at most `radius` bits apart link; a document's group is its connected component.

Plan at scale: equal fingerprints collapse first, so exact copies cost one row. The bits are cut into radius+2 blocks; two
fingerprints within the radius agree on at least two of them, so every link lies in a bucket of some pair of blocks
(ten tables of 25-26 bit keys for radius 3). Rows alone in their bucket leave before Python sees them. Buckets over
CELL rows are dealt into pairs of chunks, so no task holds more than two chunks of one, whatever the skew. Inside a
bucket, distances are found by the bit-sliced counters of bitslice.py, and a spanning forest leaves the task rather
than all pairs.

Cases: a null or empty text, or one of white space only, has fingerprint zero, and such documents link with each other
like any others. A text of fewer words than a shingle has one shingle, the whole sequence. Repeated rows keep one row
each. A null doc_id never is a component_id unless its whole group has none. Columns other than the id and the text
don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcella.llm.bitslice import near_pairs
from parcella.llm.common import stored, with_arrow_batches
from parcella.llm.components import components

#: Rows of a chunk of a large bucket.
CELL = 2048
#: Shingles hashed at once: bounds memory on very long texts.
PIECE = 1 << 15


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    starts, at = [], 0
    for t in tokens:
        starts.append(at)
        at += len(t) + 1
    n = max(1, len(tokens) - words + 1)
    ends = [s - 1 for s in starts[words:]] + [len(joined)]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for a in range(0, n, PIECE):
        raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[a : min(a + PIECE, n)], ends[a : a + PIECE])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles whose 64-bit hashes are given, repeats included; zero for none."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), PIECE):
        raw = hashes[a : a + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of docs; fp is the fingerprint as a signed long."""
    with_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def bucket_keys(fp, radius: int):
    """The keys of a fingerprint: an array of longs, a table's number above the bits of its two blocks."""
    count = radius + 2
    sizes = [64 // count + (i < 64 % count) for i in range(count)]
    offsets = [sum(sizes[:i]) for i in range(count)]
    block = [F.shiftrightunsigned(fp, o).bitwiseAND(F.lit((1 << s) - 1)) for o, s in zip(offsets, sizes)]
    pairs = [(i, j) for i in range(count) for j in range(i + 1, count)]
    return F.array(*[F.shiftleft(F.lit(t).cast("long"), 56).bitwiseOR(F.shiftleft(block[i], sizes[j])).bitwiseOR(block[j]) for t, (i, j) in enumerate(pairs)])


def _forest(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins i with j in labels, where every row points to the first row of its set."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _compare(radius: int):
    def cells(fp: np.ndarray, first: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of whole cells, sorted by cell and within it by chunk."""
        end = np.searchsorted(cell, cell, side="right")
        left = np.where(first, end - np.arange(len(cell)) - 1, 0)
        labels = np.arange(len(cell))
        for i, j in near_pairs(fp.view(np.uint64), left, radius):
            _forest(labels, i, j)
        linked = np.nonzero(labels != np.arange(len(cell)))[0]
        return fp[linked], fp[labels[linked]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for b in batches:
            held.append(tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            rows += b.num_rows
            if rows < 4 * CELL:
                continue
            fp, first, cell = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if cut:
                a, c = cells(fp[:cut], first[:cut], cell[:cut])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])
            held = [(fp[cut:], first[cut:], cell[cut:])]
            rows = len(fp) - cut
        if held:
            a, c = cells(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): a spanning set of the links between the distinct fingerprints of column fp."""
    keyed = distinct.select("fp", F.explode(bucket_keys(F.col("fp"), radius)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    crowded = keyed.join(sizes, "key").withColumn("chunks", F.ceil(F.col("rows") / CELL).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    dealt = crowded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "fp",
        (F.col("chunk") <= F.col("other")).alias("first"),
        F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"),
    )
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a cell's name is a hash: should two names fall together, more rows are compared, and no link is lost or false
    together = dealt.repartition(n, "cell").sortWithinPartitions("cell", F.col("first").desc())
    return together.mapInArrow(_compare(radius), "a long, b long")


def near_dedup(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): the group of every row of docs; component is the smallest id reachable by links."""
    fps = stored(fingerprints(docs, words, seed, id_col, text_col), "simhash")
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(classes.select("fp"), radius))
    grouped = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component"))
    named = grouped.join(smallest, "root").select("fp", "component")
    return fps.join(named, "fp").select("id", "fp", "component")


def hex_digits(fp):
    """A signed long as 16 lowercase hex digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
