"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns. Prefix sums of turn tokens place every turn on a line that is ruled at
multiples of the window's room: turns that lie within one cell share a window, and a turn that crosses a rule has one of
its own, so beside a turn that is longer than the room by itself, only an oversized system turn makes a window exceed its budget: the room
is a quarter of the budget at least, and the system turn is shown whole whatever its size. Every window begins with the conversation's
system turn, if its first turn is one, and repeats up to `history_turns` turns before it within `history_tokens` tokens.
Assistant turns of the window itself are targets, given as spans of the formatted text; repeated ones are masked.

A turn is written as <|im_start|>, role, line feed, text, <|im_end|>, line feed. In roles and texts a backslash is doubled
and <| becomes <\\|, so that no text can hold a control string; a role's line feeds become a backslash and a semicolon. Both are undone exactly.

Native DataFrame operations throughout. Prefix sums, order and history are found within blocks of BLOCK turn numbers and
carried between blocks by per-block rows, so a conversation with a third of all rows is many tasks' work.

Cases: a null role or text is empty. Turns are ordered by turn (null first), then role, then text, so ties and repeated rows
have a defined order and all stay. A null conv_id is a conversation. An empty text costs the tokens of its frame. Columns
other than these four don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcella.llm.common import word_count

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 512, 2, 128
#: Tokens that a turn's frame costs, and turn numbers of a block.
FRAME, BLOCK = 4, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undoes escape and, for roles, line feeds: between doubled backslashes, a single one only marks what follows."""
    part = lambda x: F.replace(F.replace(x, F.lit("\\|"), F.lit("|")), F.lit("\\;"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def _turns(rows: DataFrame) -> DataFrame:
    """Each turn with its place and tokens before it in the conversation, the conversation's system turn, and its history."""
    base = rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tokens", word_count(F.col("text")) + FRAME).withColumn("block", F.floor(F.col("turn") / BLOCK))
    order = ("turn", "role", "text")
    inside = Window.partitionBy("conv", "block").orderBy(*order)
    placed = (
        base.withColumn("turn_of", F.struct("role", "text", "tokens"))
        .withColumn("pos", F.row_number().over(inside))
        .withColumn("upto", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("last", F.row_number().over(Window.partitionBy("conv", "block").orderBy(*(F.col(c).desc() for c in order))))
        .withColumn("near", F.collect_list("turn_of").over(inside.rowsBetween(-HISTORY_TURNS, -1)))
    )
    ends = placed.where((F.col("last") <= HISTORY_TURNS) | (F.col("pos") == 1)).groupBy("conv", "block").agg(
        F.max("upto").alias("sum"),
        F.max("pos").alias("count"),
        F.max(F.when(F.col("pos") == 1, F.col("turn_of"))).alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("last") <= HISTORY_TURNS, F.struct("pos", "turn_of")))).alias("tail"),
    )
    blocks = Window.partitionBy("conv").orderBy("block")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("conv").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("count_before"),
        F.first("head").over(blocks.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("head"),
        F.flatten(F.collect_list(F.transform("tail", lambda t: t["turn_of"])).over(blocks.rowsBetween(-HISTORY_TURNS, -1))).alias("back"),
    )
    joined = placed.join(carried, placed["conv"].eqNullSafe(carried["c"]) & placed["block"].eqNullSafe(carried["b"]))
    past = F.concat("back", "near")
    number = F.col("count_before") + F.col("pos")
    system = F.when(F.col("head.role") == "system", F.col("head"))
    # the system turn is no part of the history: every window has it anyway
    reach = F.least(F.lit(HISTORY_TURNS), F.size(past), F.greatest(F.lit(0), number - F.when(system.isNull(), 1).otherwise(2))).cast("int")
    history = F.slice(past, F.size(past) - reach + 1, reach)
    return joined.select("conv", number.alias("number"), "role", "text", "tokens", (F.col("sum_before") + F.col("upto")).alias("end"), system.alias("system"), history.alias("history"))


def _within(history: Column) -> Column:
    """The last turns of a history that fit into its tokens."""
    total = lambda a, k: F.aggregate(F.slice(a, k, HISTORY_TURNS), F.lit(0).cast("long"), lambda s, t: s + t["tokens"])
    return F.filter(history, lambda t, i: total(history, i + 1) <= HISTORY_TOKENS)


def _render(t: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\;")), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))


def windows(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(conv_id, window, formatted, spans, repeated): spans are the targets' start (from 0) and length in code points of
    formatted, and repeated is how many turns at its beginning earlier windows have shown."""
    turns = _turns(rows)
    lead = F.coalesce(F.col("system.tokens"), F.lit(0))
    room = F.greatest(F.lit(budget // 4), budget - HISTORY_TOKENS - lead)
    fresh = turns.withColumn("is_system", (F.col("number") == 1) & F.col("system").isNotNull())
    start, end = F.col("end") - F.col("tokens") - lead, F.col("end") - lead
    first, last = F.floor(start / room), F.floor((end - 1) / room)
    cell = F.when(F.col("is_system"), F.lit(0)).otherwise(F.when(first == last, first * 2).otherwise(first * 2 + 1))
    grouped = fresh.withColumn("cell", cell).groupBy("conv", "cell").agg(
        F.array_sort(F.collect_list(F.struct("number", "role", "text", "is_system"))).alias("own"), F.min(F.struct("number", "history", "system")).alias("lead")
    )
    # a window's first turn alone tells its history; the window that holds the system turn repeats nothing
    none = F.slice(F.col("lead.history"), 1, 0)
    opening = F.when(F.col("lead.number") == 1, none).otherwise(F.concat(F.when(F.col("lead.system").isNull(), none).otherwise(F.array("lead.system")), _within(F.col("lead.history"))))
    shaped = grouped.withColumn("opening", opening)
    text = F.concat(F.array_join(F.transform("opening", _render), ""), F.array_join(F.transform("own", _render), ""))
    prefix = F.length(F.array_join(F.transform("opening", _render), ""))
    walk = F.aggregate(
        "own",
        F.struct(prefix.alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(_render(t))).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(s["spans"], F.array(F.struct((s["at"] + len(START) + len("assistant") + 1).alias("start"), F.length(escape(t["text"])).alias("length")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return shaped.select(F.col("conv").alias("conv_id"), F.col("cell").alias("window"), text.alias("formatted"), walk.alias("spans"), F.size("opening").alias("repeated"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The windows with turns, the roles and texts that they show for the first time, and targets, the texts under the spans."""
    pieces = F.filter(F.split(F.col("formatted"), r"<\|im_end\|>\n", -1), lambda p: F.startswith(p, F.lit(START)))
    new = F.slice(pieces, F.col("repeated") + 1, F.greatest(F.lit(0), F.size(pieces) - F.col("repeated")))
    bare = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    turn = lambda p: F.struct(unescape(F.substring_index(bare(p), "\n", 1)).alias("role"), unescape(F.substring(bare(p), F.length(F.substring_index(bare(p), "\n", 1)) + 2, F.length(p))).alias("text"))
    targets = F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("turns", F.transform(new, turn)).withColumn("targets", targets)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows read back: numbers and digests of turns and targets. The digests are defined over a
    conversation's whole text, which therefore meets in one row."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = read_back(formatted).select("conv_id", "window", F.size("turns").alias("n"), said.alias("said"), F.array_join("targets", "").alias("loss"), F.length("formatted").cast("long").alias("chars"))
    whole = per.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("parts"), F.sum("chars").alias("formatted_chars"))
    joined = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("said").cast("binary"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )


#: DuckDB: the digests from the rows themselves, and the windows' lengths from prefix sums.
SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
t AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\;')) + 24 AS shown,
         row_number() OVER w AS number
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (
  SELECT *, sum(tokens) OVER w AS upto, first(role) OVER w = 'system' AS has_system,
         first(tokens) OVER w AS head_tokens, first(shown) OVER w AS head_shown,
         lag(tokens, 1) OVER w AS t1, lag(tokens, 2) OVER w AS t2, lag(shown, 1) OVER w AS s1, lag(shown, 2) OVER w AS s2
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY number)),
r AS (
  SELECT *, CASE WHEN has_system THEN head_tokens ELSE 0 END AS lead FROM s),
c AS (SELECT *, greatest(128, 512 - 128 - lead) AS room, upto - tokens - lead AS a, upto - lead AS e FROM r),
w AS (
  SELECT *, CASE WHEN has_system AND number = 1 THEN 0 WHEN a // room = (e - 1) // room THEN a // room * 2 ELSE a // room * 2 + 1 END AS cell,
         CASE WHEN t1 IS NOT NULL AND NOT (has_system AND number <= 2) AND t1 <= 128 THEN s1 ELSE 0 END
         + CASE WHEN t2 IS NOT NULL AND NOT (has_system AND number <= 3) AND t1 + t2 <= 128 THEN s2 ELSE 0 END AS back
  FROM c),
g AS (
  SELECT conv_id, cell, sum(shown) + CASE WHEN min(number) = 1 THEN 0 ELSE arg_min(back, number) + CASE WHEN any_value(has_system) THEN any_value(head_shown) ELSE 0 END END AS chars
  FROM w GROUP BY conv_id, cell),
f AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM g GROUP BY conv_id),
d AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY number)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY number) FILTER (role = 'assistant'), '') AS loss
  FROM t GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""
