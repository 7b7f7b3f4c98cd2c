"""Line dedup: an exact set-similarity join of lines, of which later matches are removed.

A line is a text's piece between line feeds, its tokens the distinct words (parted by the six ASCII spaces, so that
tabs part them and a CR before the line feed belongs to none), in lower case. A line with at
least `min_words` tokens is removed if an earlier one, by (id, line number), has a Jaccard similarity of `threshold`
or more. What is removed again matches lines after it, so the decision about a line depends on the lines before it only
and not on any order of work.

Native DataFrame operations throughout:
1. Words are counted by hash bucket (a table of RARITY entries, whatever the corpus, that plans refer to as a subquery), and every line's tokens are put in
   order of their bucket's count, rarest first. The join is exact under any fixed order; a good one makes it cheap.
2. Equal lines are one node, named by a hash of the line as it stands, so that finding the lines of a name takes no lower case; lines
   that differ in case or spaces only are nodes of equal tokens. Nodes may share a name: every pair is verified on words, so that
   costs time at most.
3. Two lines of similarity t share a token among the first n - ceil(t n) + 1 of each, of the shorter even among the first
   n - ceil(2t/(1+t) n) + 1. Nodes meet by such prefix tokens;
   very long lines share SHARED tokens of a prefix that is as much longer. The positional filter bounds the overlap from
   the places of the shared token (which implies the length filter), and
   parity bits of the token sets (128 for lines of over LONG words) bound their difference.
4. Jaccard is verified on 64-bit hashes of the words. A node's likeliest partner, by shared prefix tokens, comes first; only nodes that it
   doesn't decide have their other partners verified.
Tokens that would make more than GROUP * GROUP pairs, or whose bucket is WARM times as full as the mean, don't emit pairs: their nodes
are first held against the token's LEADERS earliest. In a group of near copies this decides nearly all, and only the
undecided meet the rest. No task gathers a token's nodes for that.

Cases: null and empty texts, and lines without words, have nothing to match and stay as they are. An equal line twice in one text is a
later match too. Rows that repeat an id are one document: a line doesn't count as later than one with the same id and number. A null
id is ordered first, and rows without an id count as one document. Extra columns pass through; names used inside don't clash
with them. A table of no rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcella.llm.common import passing, stored

THRESHOLD, MIN_WORDS = 0.8, 1
#: The spaces within a line that aren't blanks.
SPACES = "\t\x0b\x0c\r"
#: Entries of the table of word counts by hash bucket, and of tables of hashes of the rows that take part in a join.
RARITY, INVOLVED = 1 << 18, 1 << 18
#: Bits of a token's hash below its bucket's size class.
HASH = 54
GROUP, WARM, LEADERS = 512, 64, 8
#: Lines of more words have 64 parity bits more. Pairs of lines of more than VERY_LONG share SHARED prefix tokens at least.
LONG, VERY_LONG, SHARED = 64, 128, 3
IN_LAMBDAS = "spark.sql.analyzer.allowSubqueryExpressionsInLambdasOrHigherOrderFunctions"
#: Bytes of removed lines' numbers up to which they are sent to the documents; more meet them in a shuffled join.
SENT = 64 << 20


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _blanked(text: Column) -> tuple[Column, Column]:
    """Whether there are other spaces within a line than blanks, and the text with blanks for them."""
    out, some = text, F.lit(False)
    for space in SPACES:
        out, some = F.replace(out, F.lit(space), F.lit(" ")), some | F.contains(text, F.lit(space))
    return some, out


def prepared(text: Column) -> Column:
    """Lower case, and blanks for the other spaces within a line."""
    some, out = _blanked(text)
    return F.when(some, F.lower(out)).otherwise(F.lower(text))  # looking for a space is much cheaper than replacing none


def name(line: Column) -> tuple[Column, Column]:
    """Two hashes of a line; the first names a node, both a class of equal lines."""
    return F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, line_no, line, h1, h2) of the lines with a word; line is as it stands in the text."""
    text = F.col(text_col)
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    # trimming the left end is enough to tell, and the right one would visit every character
    return rows.where(F.ltrim("line", F.lit(" " + SPACES)) != "").select("*", *name(F.col("line")))


def rarity(docs: DataFrame, text_col: str) -> tuple[Column, tuple[int, int]]:
    """For every bucket of word hashes a class from 0 to 15, the logarithm of its words' count over all texts to that of a
    sixteenth of the mean, shifted to its place in a key, as a scalar subquery of an array (see class_of): plans are kept as
    strings, literals included, but the value of a subquery isn't. And the classes from which a bucket is WARM times as full
    as the mean, and from which it may have more than GROUP words."""
    some, out = _blanked(F.col(text_col))
    # lower case is cheap where there is ASCII only, which holds for more lines than texts
    lines = docs.select(F.explode(F.split(F.when(some, out).otherwise(F.col(text_col)), "\n", -1)).alias("line"))
    words = lines.select(F.explode(F.split(F.lower("line"), " ", -1)).alias("w"))
    # four counts a row keep the rows within the 2^16 of the fast table of generated code
    part = lambda k: F.count(F.when(F.shiftright("h", 16).bitwiseAND(F.lit(3)) == k, 1)).alias(f"c{k}")
    counts = words.select(F.xxhash64("w").bitwiseAND(F.lit(RARITY - 1)).alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(RARITY // 4 - 1)).alias("b")).agg(*map(part, range(4))).toArrow()
    table = np.zeros((4, RARITY // 4), int)
    for k in range(4):
        table[k, counts["b"].to_numpy()] = counts[f"c{k}"].to_numpy()
    mean = max(1.0, table.sum() / RARITY)
    of = lambda c: np.clip(np.ceil(np.log2(16 * (c + 1) / mean)), 0, 15).astype(np.int8)
    classes = docs.sparkSession.createDataFrame(pa.table({"classes": pa.array([of(table).ravel().astype(np.int64) << HASH], pa.list_(pa.int64()))}), "classes array<bigint>")
    return stored(classes, "lineclasses").scalar(), (int(of(WARM * mean)), int(of(GROUP)))


def class_of(classes: Column, h: Column) -> Column:
    """The class of the bucket of a word's hash, above HASH bits. Not null, so that arrays of keys are sorted as plain numbers."""
    return F.coalesce(classes[h.bitwiseAND(F.lit(RARITY - 1))], F.lit(0).cast("long"))


@contextmanager
def _subqueries_in_lambdas(spark: SparkSession) -> Iterator[None]:
    """Lets lambdas refer to a subquery of no outer columns, which Spark runs before the tasks begin; frames are analysed as they are made."""
    before = spark.conf.get(IN_LAMBDAS, "false")
    spark.conf.set(IN_LAMBDAS, "true")
    try:
        yield
    finally:
        spark.conf.set(IN_LAMBDAS, before)


def _shared(n: Column) -> Column:
    """How many prefix tokens a line has in common with any similar one, if prefixes are as much longer."""
    return F.when(n > VERY_LONG, SHARED).otherwise(1)


def nodes(docs: DataFrame, classes: Column | None, threshold: float, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, n, prefix, bits, more): of each different line its name, size, prefix tokens in order of rarity, and parity bits."""

    def key(h: Column) -> Column:
        return class_of(classes, h).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH))

    def parity(keys: Column | str) -> Column:
        return F.coalesce(F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(_bit(k.bitwiseAND(F.lit(63))))), F.lit(0))

    # lambdas aren't compiled, nor what they are given, but what is exploded is: an array of one takes the sets of hashes
    # and the sort out of lambdas, and classes are looked up once for each different word of a line
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("line", " ", -1), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    rows = lines_of(docs, id_col, text_col).select("h1", prepared(F.col("line")).alias("line")).select("h1", F.explode(F.array(hashes)).alias("keys"))
    with _subqueries_in_lambdas(docs.sparkSession):
        rows = rows.select("h1", F.explode(F.array(F.sort_array(F.transform("keys", key) if classes is not None else "keys"))).alias("keys"))
    n = F.size("keys")
    size = (n - F.ceil(n * threshold - 1e-9) + _shared(n)).cast("int")
    # of a long line either half tells about half the words
    more = F.when(n > LONG, parity(F.filter("keys", lambda k: k.bitwiseAND(F.lit(64)) != 0))).otherwise(F.lit(0).cast("long"))
    shaped = rows.where(n >= min_words).select("h1", n.alias("n"), F.slice("keys", 1, size).alias("prefix"), parity("keys").alias("all"), more.alias("more"))
    return shaped.select("h1", "n", "prefix", F.col("all").bitwiseXOR(F.col("more")).alias("bits"), "more").distinct()


def _fits(a: str, b: str, threshold: float) -> Column:
    """Whether two nodes that share a prefix token may be similar enough; left is what a node has from that token on."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    same = (F.col(f"{a}.n") > LONG) == (F.col(f"{b}.n") > LONG)
    # bits of a long and a short line are not of the same words, but all of them together are
    bits = lambda x: F.when(same, F.col(f"{x}.bits")).otherwise(F.col(f"{x}.bits").bitwiseXOR(F.col(f"{x}.more")))
    differ = F.bit_count(bits(a).bitwiseXOR(bits(b))) + F.when(same, F.bit_count(F.col(f"{a}.more").bitwiseXOR(F.col(f"{b}.more")))).otherwise(0)
    # the first shared token leaves all of the overlap, the next one less, and so on
    return (F.least(f"{a}.left", f"{b}.left") >= n * (threshold / (1 + threshold)) - 1e-9 - (_shared(F.least(f"{a}.n", f"{b}.n")) - 1)) & (differ <= n * ((1 - threshold) / (1 + threshold)) + 1e-9)


def candidates(docs: DataFrame, threshold: float, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs of names that share a prefix token and may match (a < b, n of the shorter, no token), and the nodes of tokens that many share (token, a, n, left, bits, more)."""
    classes, (hot, full) = rarity(docs, text_col)
    found = nodes(docs, classes, threshold, min_words, id_col, text_col)

    def tokens(rows: DataFrame) -> DataFrame:
        # an outer explode keeps the optimizer from asking first whether there is a prefix, which would compute it twice
        out = rows.select(F.posexplode_outer("prefix").alias("pos", "token"), "h1", "n", "bits", "more")
        # what a join would infer is said here, so that all uses below share one shuffle
        return out.select("token", "h1", "n", (F.col("n") - F.col("pos")).alias("left"), "bits", "more").where("token is not null and left is not null")

    warm = F.shiftright("token", HASH) >= hot
    dealt = tokens(found).where(~warm).repartition("token")
    # the last token of a prefix is of its fullest bucket: few nodes are looked through again
    warmed = tokens(found.where(F.when(F.spark_partition_id() >= 0, F.shiftright(F.get("prefix", F.size("prefix") - 1), HASH) >= hot))).where(warm)
    # what _fits asks of the shorter line, y, whatever the other; as the optimizer can't move it, both sides share one shuffle
    early = F.col("left") >= F.col("n") * (2 * threshold / (1 + threshold)) - 1e-9 - (_shared(F.col("n")) - 1)
    by_token = Window.partitionBy("token")
    # both counts in one projection are one pass over the rows
    both = {"rows": F.count("*").over(by_token), "early": F.count(F.when(early, 1)).over(by_token)}
    counts = lambda rows: rows.withColumns(both).withColumn("made", F.col("rows") * F.col("early")).drop("early")
    counted = counts(dealt)
    # tokens of a bucket of few words can't make so many pairs; their rows needn't be sorted once more to tell
    open_ = F.shiftright("token", HASH) >= full
    some = counted.where((F.col("rows") > 1) & (F.col("made") >= 1) & ((F.col("made") <= GROUP * GROUP) | ~open_))
    longer = (F.col("x.n") > F.col("y.n")) & (F.col("x.h1") != F.col("y.h1")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.h1") < F.col("y.h1"))
    met = some.alias("x").join(dealt.where(F.when(F.spark_partition_id() >= 0, early)).alias("y"), (F.col("x.token") == F.col("y.token")) & longer & _fits("x", "y", threshold))
    none = lambda kind: F.lit(None).cast(kind)
    pairs = met.select(none("long").alias("token"), F.least("x.h1", "y.h1").alias("a"), F.greatest("x.h1", "y.h1").alias("b"), F.col("y.n"), none("int").alias("left"), none("long").alias("bits"), none("long").alias("more"))
    many = counts(dealt.where(F.when(F.spark_partition_id() >= 0, open_))).where(F.col("made") > GROUP * GROUP).drop("rows", "made").unionByName(warmed)
    return pairs.unionByName(many.select("token", F.col("h1").alias("a"), none("long").alias("b"), "n", "left", "bits", "more"))


def _marked(rows: DataFrame, some: DataFrame, *keys: str) -> DataFrame:
    """rows with __may: whether their keys can be among those of some, by a bounded table of hashes."""
    slot, flag = F.pmod(F.xxhash64(*keys), F.lit(INVOLVED)), _bit(F.pmod(F.xxhash64(*keys, F.lit(7)), F.lit(64)))
    table = some.groupBy(slot.alias("__slot")).agg(F.bit_or(flag).alias("__flags"))  # INVOLVED rows at most
    return rows.join(F.broadcast(table), slot == F.col("__slot"), "left").withColumn("__may", F.coalesce(F.col("__flags").bitwiseAND(flag) != 0, F.lit(False))).drop("__slot", "__flags")


def _hashes(line: Column) -> Column:
    """The hashes of a line's different words."""
    return F.array_distinct(F.array_remove(F.transform(F.split(line, " ", -1), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def _placed(found: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line's (id, text_hash, line_no, h1, h2), and the prepared line for those whose name may be in found, by a bounded table of hashes."""
    names = found.select(F.col("a").alias("h1")).unionByName(found.where("b is not null").select(F.col("b").alias("h1")))
    lines = _marked(lines_of(docs, id_col, text_col), names, "h1")
    return lines.select("id", "text_hash", "line_no", "h1", "h2", F.when(F.col("__may"), prepared(F.col("line"))).alias("line"))


def _verified(pairs: DataFrame, ends: DataFrame, threshold: float) -> DataFrame:
    """(h1, h2) of the later ones (y) of pairs (x1, x2, y1, y2) of classes that are similar enough, by 64-bit hashes of words."""
    asked = pairs  # a table: what the second round of the loop marks needs no join of the first
    for end in "xy":
        sets = _marked(ends, asked.select(F.col(f"{end}1").alias("h1")), "h1").where("__may")
        pairs = pairs.join(sets.select(F.col("h1").alias(f"{end}1"), F.col("h2").alias(f"{end}2"), F.col("line").alias(f"{end}_line")), [f"{end}1", f"{end}2"])
    both = pairs.select("y1", "y2", F.explode(F.array(F.struct(*(_hashes(F.col(f"{e}_line")).alias(e) for e in "xy")))).alias("w"))
    sized = both.select("y1", "y2", F.size(F.array_intersect("w.x", "w.y")).alias("common"), (F.size("w.x") + F.size("w.y")).alias("sum"))
    return sized.where(F.col("common") >= F.lit(threshold) * (F.col("sum") - F.col("common")) - 1e-9).select(F.col("y1").alias("h1"), F.col("y2").alias("h2")).distinct()


def _later(pairs: DataFrame, ends: DataFrame, threshold: float) -> DataFrame:
    """(h1, h2) of classes that match an earlier one by some of pairs (a, b, shared) of names."""
    at = ends.select("h1", "h2", "at")
    for end in "ab":
        pairs = pairs.join(at.select(F.col("h1").alias(end), F.struct("at", F.col("h1").alias("n1"), F.col("h2").alias("n2")).alias(f"{end}_at")), end)
    x, y = F.least("a_at", "b_at"), F.greatest("a_at", "b_at")
    placed = stored(pairs.where(~F.col("a_at.at").eqNullSafe(F.col("b_at.at"))).select(x["n1"].alias("x1"), x["n2"].alias("x2"), y["n1"].alias("y1"), y["n2"].alias("y2"), "shared"), "linepairs")
    # written, as _verified reads what it is given once for each end and once more
    best = stored(placed.groupBy("y1", "y2").agg(F.max(F.struct("shared", "x1", "x2")).alias("m")).select("m.x1", "m.x2", "y1", "y2"), "linebest")
    sure = stored(_verified(best, ends, threshold), "linenear")
    rest = placed.join(sure.select(F.col("h1").alias("y1"), F.col("h2").alias("y2")), ["y1", "y2"], "left_anti").join(best, ["x1", "x2", "y1", "y2"], "left_anti")
    rest = stored(rest.select("x1", "x2", "y1", "y2"), "linerest")
    return sure.unionByName(stored(_verified(rest, ends, threshold), "linenear"))


def _paired(xs: DataFrame, ys: DataFrame, threshold: float) -> DataFrame:
    """Pairs of names (a, b, shared) of earlier nodes xs and later nodes ys that share a token."""
    met = xs.alias("x").join(ys.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.at") < F.col("y.at")) & _fits("x", "y", threshold))
    return met.select(F.col("x.h1").alias("a"), F.col("y.h1").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))


def _led(many: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of tokens that many share, (token, h1, n, left, bits, more), with their first place, and each token's LEADERS earliest."""
    placed = stored(many.join(ends.groupBy("h1").agg(F.min("at").alias("at")), "h1"), "linemany")
    turn = F.row_number().over(Window.partitionBy("token").orderBy("at", "h1"))
    return placed, stored(placed.withColumn("turn", turn).where(F.col("turn") <= LEADERS).drop("turn"), "lineleaders")


def _undecided(placed: DataFrame, leaders: DataFrame, ends: DataFrame, near: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes beyond a token's leaders, of which the later one has not matched yet."""
    # classes that share a name are decided one by one: a name is left out only if none of its classes is open
    still = ends.select("h1", "h2").join(near, ["h1", "h2"], "left_anti").select("h1").distinct()
    last = leaders.groupBy("token").agg(F.max(F.struct("at", "h1")).alias("last"), F.count("*").alias("n_leaders")).where(F.col("n_leaders") == LEADERS)
    others = placed.join(last.select("token", "last"), "token").where(F.struct("at", "h1") > F.col("last")).drop("last")
    return _paired(others, others.join(still, "h1", "left_semi"), threshold)


def later_matches(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, line_no) of the lines to be removed."""
    found = stored(candidates(docs, threshold, min_words, id_col, text_col), "linefound")
    # lines that share a token which many nodes have meet by that one alone
    pairs = found.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("n").alias("n")).where(F.col("shared") >= _shared(F.col("n"))).drop("n")
    pairs, many = stored(pairs, "linepairs"), found.where("b is null").select("token", F.col("a").alias("h1"), "n", "left", "bits", "more")
    found = pairs.select("a", "b").unionByName(many.select(F.col("h1").alias("a"), F.lit(None).cast("long").alias("b")))
    lines = stored(_placed(found, docs, id_col, text_col), "linenames")
    ends = stored(lines.where("line is not null").groupBy("h1", "h2").agg(F.min(F.struct("id", "line_no")).alias("at"), F.min("line").alias("line")), "lineends")
    if many.isEmpty():
        near = _later(pairs, ends, threshold)
    else:
        placed, leaders = _led(many, ends)
        near = _later(pairs.unionByName(_paired(leaders, placed, threshold)), ends, threshold)
        near = near.unionByName(_later(_undecided(placed, leaders, ends, near, threshold), ends, threshold))
    if min_words > 1:
        few = nodes(docs, None, threshold, 1, id_col, text_col).where(F.col("n") < min_words).select("h1")
        lines = lines.join(few, "h1", "left_anti")
    classes = lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "line_no")).alias("at"), F.count("*").alias("rows"))
    decided = classes.join(near.distinct().withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("rows > 1 or near").select("h1", "h2", "at", F.coalesce("near", F.lit(False)).alias("near"))
    decided = stored(decided, "linedecided")
    lines = _marked(lines.select("id", "text_hash", "line_no", "h1", "h2"), decided, "h1").where("__may").drop("__may")
    return lines.join(decided, ["h1", "h2"]).where(F.col("near") | (F.struct("id", "line_no") > F.col("at"))).select("id", "text_hash", "line_no")


def dedup(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """docs without later matches among the lines of text_col; removed_col, if named, counts the lines removed."""
    with passing(docs.sparkSession):
        gone = later_matches(docs, threshold, min_words, id_col, text_col).groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set("line_no").alias("__gone"))
        gone = stored(gone, "linegone", keep=True)
    # as rows of a hash table: a header, both keys and the numbers
    size = gone.agg(F.sum(64 + 4 * F.size("__gone").cast("long"))).first()[0] or 0
    hashed = docs.withColumn("__text", F.xxhash64(text_col))
    if size <= SENT:
        some, rest, gone = hashed, None, F.broadcast(gone)
    else:
        marked = _marked(hashed, gone.select(F.col("__id").alias(id_col), F.col("__hash").alias("__text")), id_col, "__text")
        some, rest = marked.where("__may").drop("__may"), marked.where("not __may").drop("__may")
    split = F.split(F.col(text_col), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))
    joined = some.join(gone, some[id_col].eqNullSafe(gone["__id"]) & (some["__text"] == gone["__hash"]), "left")
    joined = joined.select("*", F.explode(F.array(F.when(F.col("__gone").isNotNull(), F.struct(split.alias("lines"), left.alias("kept"))))).alias("__kept"))
    if removed_col:
        joined = joined.withColumn("__removed", F.coalesce(F.size("__kept.lines") - F.size("__kept.kept"), F.lit(0)).cast("long"))
        joined = joined.withColumn("__removed", F.when(F.col("__kept").isNull(), 0).otherwise(F.col("__removed")))
        rest = rest if rest is None else rest.withColumn("__removed", F.lit(0).cast("long"))
    pieces = F.transform("__kept.kept", lambda k: F.get(F.col("__kept.lines"), k))
    joined = joined.withColumn(text_col, F.when(F.col("__kept").isNull(), F.col(text_col)).otherwise(F.array_join(pieces, "\n")))
    out = [*(F.col(f"`{c}`") for c in docs.columns), *([F.col("__removed").alias(removed_col)] if removed_col else [])]
    return joined.select(*out).unionByName(rest.select(*out)) if rest is not None else joined.select(*out)


#: DuckDB: the same join by exact word counts, and what is left of every text.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln
  FROM documents WHERE text IS NOT NULL),
sets AS (
  SELECT doc_id, ln, line,
         list_sort(list_distinct(list_filter(string_split(translate(lower(line), chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda x: x <> ''))) AS words
  FROM lines),
long_enough AS (SELECT *, len(words) AS n FROM sets WHERE len(words) >= 1),
firsts AS (SELECT words, any_value(n) AS n, min({'doc_id': doc_id, 'ln': ln}) AS place FROM long_enough GROUP BY words),
tokens AS (SELECT place, n, unnest(words) AS w FROM firsts),
counts AS (SELECT w, count(*) AS c FROM tokens GROUP BY w),
ordered AS (SELECT t.place, t.n, t.w, row_number() OVER (PARTITION BY t.place ORDER BY c.c, t.w) AS pos FROM tokens t JOIN counts c USING (w)),
prefixes AS (SELECT * FROM ordered WHERE pos <= n - ceil(n * 0.8 - 1e-9) + 1),
pairs AS (
  SELECT DISTINCT x.place AS x, y.place AS y FROM prefixes x JOIN prefixes y ON x.w = y.w AND x.place < y.place
  WHERE least(x.n, y.n) >= greatest(x.n, y.n) * 0.8 - 1e-9),
near AS (
  SELECT DISTINCT p.y FROM pairs p JOIN firsts a ON a.place = p.x JOIN firsts b ON b.place = p.y
  WHERE len(list_intersect(a.words, b.words)) >= 0.8 * (a.n + b.n - len(list_intersect(a.words, b.words))) - 1e-9),
gone AS (
  SELECT s.doc_id, s.ln FROM long_enough s JOIN firsts f ON s.words = f.words
  WHERE {'doc_id': s.doc_id, 'ln': s.ln} > f.place OR f.place IN (SELECT y FROM near)),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (g.ln IS NULL) AS text, count(g.ln) AS removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.ln = g.ln GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.removed, 0)::BIGINT AS lines_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(k.text, ''))::BIGINT END AS chars_kept,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
