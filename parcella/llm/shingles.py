"""Near copies by SimHash links, and by an exact set-similarity join of word shingles for the links that fingerprints lose.

A text's set holds the hashes of its shingles of `words` words (A-Z lowered, words parted by the six ASCII spaces; a text of
fewer words is one shingle). Texts whose sets have a Jaccard similarity of `threshold` or more link; a document's group is
its connected component.

1. Equal sets collapse to one node. The shingles' SimHash fingerprints meet by the bit-sliced comparison of simhash.py; what it
   links are candidates.
2. Shingles are counted by hash bucket (a table of RARITY entries, whatever the corpus), and a set is put in order of its
   buckets' counts, rarest first, so that texts don't meet by what many of them share.
3. Two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each: no link is missed. The sizes and the
   shared shingle's positions bound the overlap.
4. The texts that share a prefix shingle are first held against one of them, the group's least node. Texts that this or
   SimHash puts in one component need no further link between them; only those of different components meet, so a large group
   of near copies doesn't emit its pairs.
5. Parity bits of the sets, one a shingle or more, bound their difference. Jaccard is verified on the whole sets of the pairs that are left, SimHash's
   too; they are made again from the candidates' texts only.

Texts are read thrice and stay where they are: what the steps above keep is named by two 64-bit hashes of a whole row, and only
candidates, repeated rows and rows to be removed (found by a bounded table of hashes) are shuffled with their texts.

Cases: null and empty texts, and those of white space only, have the empty set and are one group. Repeated rows are in one
group. Ids don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcella.llm.common import passing, stored, with_arrow_batches
from parcella.llm.components import components
from parcella.llm.linededup import _marked
from parcella.llm.simhash import links, majority

THRESHOLD, WORDS, RARITY = 0.8, 5, 1 << 17
#: Differing bits up to which SimHash links.
RADIUS = 3


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's shingles, in order and with repeats: mixed from the hashes of their words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    w = np.frombuffer(b"".join(map(xxhash.xxh64_digest, tokens)), np.uint64)
    if not len(w):
        return w
    n = max(1, len(w) - words + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(words, len(w))):
        h += w[k : k + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _different(hashes: np.ndarray) -> np.ndarray:
    s = np.sort(hashes)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    return _different(shingle_hashes(text, words))


def rarity(docs: DataFrame, words: int, text_col: str) -> np.ndarray:
    """For every bucket of shingle hashes the size class of its count over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RARITY, np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(counts, (shingle_set(t.as_py(), words) & np.uint64(RARITY - 1)).view(np.int64), 1)
        some = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["b", "c"])

    counts = docs.select(text_col).mapInArrow(run, "b long, c long").groupBy("b").agg(F.sum("c").alias("c")).toArrow()  # RARITY rows at most
    b, c = counts["b"].to_numpy(), counts["c"].to_numpy()
    classes = np.zeros(RARITY, np.uint8)
    classes[b] = np.clip(np.ceil(2 * np.log2(c / (2 * max(1.0, c.sum() / RARITY)))), 0, 120)
    return classes


def _named(docs: DataFrame) -> DataFrame:
    """docs with r1 and r2, hashes of the whole row; nulls count."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    of = lambda seed: F.xxhash64(F.lit(seed), *(c.isNull() for c in columns), *columns)
    return docs.select("*", of(1).alias("__r1"), of(2).alias("__r2"))


def keyed(docs: DataFrame, threshold: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """(r1, r2, id, node, n, prefix, bits, fp) of every row: a digest of its text's set, the set's size, prefix shingles and parity bits, and the SimHash fingerprint."""
    with_arrow_batches(docs.sparkSession)
    classes = rarity(docs, words, text_col)
    lists = pa.list_(pa.int64())

    def long(values: list[int]) -> pa.Array:
        return pa.array(np.array(values, np.uint64).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, prefixes, parities, prints = [], [], [], [], []
            for t in b.column(3):
                hashes = shingle_hashes(t.as_py(), words)
                s = _different(hashes)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), len(s)))
                sizes.append(len(s))
                first = np.lexsort((s, classes[(s & np.uint64(RARITY - 1)).view(np.int64)]))[: len(s) - math.ceil(len(s) * threshold - 1e-9) + 1]
                prefixes.append(s[first].view(np.int64))
                size = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64  # of twice the length halves fold into one
                odd = np.bincount((s >> np.uint64(40) & np.uint64(size - 1)).view(np.int64), minlength=size) & 1
                parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                prints.append(majority(hashes))
            more = [long(nodes), pa.array(np.array(sizes, np.int32)), pa.array(prefixes, lists), pa.array(parities, lists), long(prints)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *more], names=["r1", "r2", "id", "node", "n", "prefix", "bits", "fp"])

    src = _named(docs).select(F.col("__r1").alias("r1"), F.col("__r2").alias("r2"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "r1 long, r2 long, id long, node long, n int, prefix array<long>, bits array<long>, fp long")


def _fits(x: Column, y: Column, threshold: float) -> Column:
    """Whether two sets may be similar enough whose first shared shingle this is, by their sizes and its positions: all that
    they share is from there on. Sets that share others before it meet by the first of them."""
    need = F.ceil((x["n"] + y["n"]) * (threshold / (1 + threshold)) - 1e-9)
    return (F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * threshold - 1e-9) & (F.least(x["n"] - x["pos"], y["n"] - y["pos"]) >= need)


def _may(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (a, b) of nodes whose sizes and parity bits allow the similarity."""
    for end in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}")), end)
    k = F.least(F.size("bits_a"), F.size("bits_b"))
    part = lambda x, i: F.get(x, i).bitwiseXOR(F.coalesce(F.get(x, i + k), F.lit(0).cast("long")))
    differ = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0), lambda n, i: n + F.bit_count(part("bits_a", i).bitwiseXOR(part("bits_b", i))))
    sizes = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9
    # sizes apart by more than a factor of two fail anyway, whatever their bits say
    return pairs.where(sizes).where((differ <= (F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold)) + 1e-9)).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, words: int, text_col: str) -> DataFrame:
    """Those of pairs (a, b) of nodes whose sets are similar enough."""
    pairs = stored(_may(pairs.distinct(), nodes, threshold), "shinglepairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ends = ends.join(nodes.select("node", F.col("row.r1").alias("__r1"), F.col("row.r2").alias("__r2")), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    texts = _marked(_named(docs).select("__r1", "__r2", F.col(text_col).alias("text")), ends, "__r1").where("__may")
    some = texts.join(ends, ["__r1", "__r2"]).groupBy("node").agg(F.min("text").alias("text"))
    sets = stored(some.mapInArrow(run, "node long, s array<long>"), "shinglesets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return stored(both.where(common >= F.lit(threshold) * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"), "shinglelinks")


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that SimHash links: those of one fingerprint with its least node, and the least nodes of linked fingerprints."""
    classes = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    within = nodes.join(classes, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    of = lambda end, name: classes.select(F.col("fp").alias(end), F.col("least").alias(name))
    across = links(classes.select("fp"), RADIUS).join(of("a", "x"), "a").join(of("b", "y"), "b")
    return within.unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(r1, r2, id, group) of every row of docs: hashes of the row, its id, and what rows of one group share."""
    rows = stored(keyed(docs, threshold, words, id_col, text_col), "shinglerows")
    nodes = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.min("fp").alias("fp"), F.min(F.struct("r1", "r2")).alias("row"))
    nodes = stored(nodes, "shinglenodes")
    tokens = nodes.select(F.posexplode("prefix").alias("pos", "token"), "node", "n")
    whole = tokens.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = stored(tokens.join(whole, "token").select("token", "rows", F.struct("node", "n", "pos").alias("y")), "shingletokens")
    others = shared.join(shared.groupBy("token").agg(F.min("y").alias("lead")), "token").where(F.col("y.node") != F.col("lead.node"))
    shapes = nodes.select("node", "n", "bits", "row")
    led = others.where(_fits(F.col("lead"), F.col("y"), threshold)).select(F.col("lead.node").alias("a"), F.col("y.node").alias("b"))
    near = _verified(_by_simhash(nodes.select("node", "fp")).unionByName(led), shapes, docs, threshold, words, text_col)
    found = components(near)
    rest = others.where("rows > 2").select("token", "y", F.col("y.node").alias("node")).join(found, "node", "left").select("token", "y", F.coalesce("component", "node").alias("label"))
    apart = rest.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    rest = stored(rest.join(apart, "token"), "shinglerest")
    pairs = rest.select("token", F.col("y").alias("x"), F.col("label").alias("other")).join(rest, "token")
    pairs = pairs.where((F.col("x.node") < F.col("y.node")) & (F.col("other") != F.col("label")) & _fits(F.col("x"), F.col("y"), threshold)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    groups = components(near.unionByName(_verified(pairs, shapes, docs, threshold, words, text_col)))
    return rows.select("r1", "r2", "id", "node").join(groups, "node", "left").select("r1", "r2", "id", F.coalesce("component", "node").alias("group"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group the row of smallest id, null after others; of several such rows that with the least hash, once."""
    with passing(docs.sparkSession):
        rows = near_copies(docs, threshold, words, id_col, text_col)
        alike = rows.groupBy("group", "id", "r1", "r2").agg(F.count("*").alias("copies"))
        place = lambda: F.struct(F.col("id").isNull().alias("none"), "id", "r1", "r2")
        first = alike.groupBy("group").agg(F.min(place()).alias("first"))
        decided = alike.join(first, "group").select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), place().eqNullSafe(F.col("first")).alias("__first"), "copies")
        special = stored(decided.where("not __first or copies > 1").drop("copies"), "shinglegone", keep=True)
    marked = _marked(_named(docs), special, "__r1")
    some = marked.where("__may").join(special, ["__r1", "__r2"], "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = some.where("__first").dropDuplicates(["__r1", "__r2"]).select(*columns)
    return marked.where("not __may").select(*columns).unionByName(some.where("__first is null").select(*columns)).unionByName(once)
