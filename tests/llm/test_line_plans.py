"""What line dedup puts into plans, which the driver keeps as strings."""

from __future__ import annotations

from parcella.llm import linededup


def test_plans_dont_hold_the_table_of_word_counts(spark):
    df = spark.createDataFrame([(1, "a b c d\ne f g"), (2, "a b c d\nh")], "doc_id long, text string")
    found = linededup.candidates(df, 0.8, 1, "doc_id", "text")
    assert found.where("b is not null").count() == 0  # equal lines are one node
    assert len(found._jdf.queryExecution().toString()) < linededup.RARITY
    before = spark.conf.get(linededup.IN_LAMBDAS, None)
    assert linededup.nodes(df, linededup.rarity(df, "text")[0], 0.8, 1, "doc_id", "text").count() == 3
    assert spark.conf.get(linededup.IN_LAMBDAS, None) == before


def test_keys_are_made_distinct_and_sorted_outside_of_lambdas(spark):
    df = spark.createDataFrame([(1, "a  b a c \n b"), (2, "a b\n" + " ".join(f"w{i}" for i in range(200)))], "doc_id long, text string")
    found = linededup.nodes(df, linededup.rarity(df, "text")[0], 0.8, 1, "doc_id", "text")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array(sort_array(transform(keys" in plan and "explode(array(array_remove(array_distinct(" in plan
    assert "inline(" not in plan and "cast((lambda" not in plan.split("sort_array")[1].split("explode")[0]
    rows = sorted(found.collect(), key=lambda r: r["n"])
    assert [(r["n"], len(r["prefix"])) for r in rows] == [(1, 1), (2, 1), (3, 1), (200, 43)]
    assert all(r["prefix"] == sorted(set(r["prefix"])) for r in rows)
    assert [bin(r["bits"] % 2**64).count("1") for r in rows[:1]] == [1] and rows[3]["more"] != 0


def test_rows_of_tokens_are_counted_in_one_pass(spark):
    """Both uses of the counts: pairs, and tokens that many nodes share."""
    df = spark.createDataFrame([(1, "a b c d\ne f g"), (2, "a b c d\nh")], "doc_id long, text string")
    plan = linededup.candidates(df, 0.8, 1, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2


def test_pairs_are_joined_once_to_be_verified(spark):
    """Which lines the second join needs is told from the pairs as given, not from the first join."""
    pairs = spark.createDataFrame([(1, 1, 2, 2), (1, 1, 3, 3)], "x1 long, x2 int, y1 long, y2 int")
    ends = spark.createDataFrame([(1, 1, "a b c d e"), (2, 2, "a b c e d"), (3, 3, "a b c")], "h1 long, h2 int, line string")
    later = linededup._verified(pairs, ends, 0.8)
    assert later._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 4
    assert [tuple(r) for r in later.collect()] == [(2, 2)]


def test_nodes_of_full_buckets_are_taken_whole(spark):
    """A token whose bucket is WARM times as full as the mean makes no pairs itself; all of its nodes are kept, and only its rows."""
    df = spark.createDataFrame([(i, f"zz\nzz u{i} v{i} w{i}") for i in range(40)] + [(99, "zz " * 400)], "doc_id long, text string")
    found = linededup.candidates(df, 0.8, 1, "doc_id", "text").where("b is null")
    classes, (hot, _) = linededup.rarity(df, "text")
    want = linededup.nodes(df, classes, 0.8, 1, "doc_id", "text").collect()
    want = sorted((k, r["h1"], r["n"], r["n"] - i, r["bits"]) for r in want for i, k in enumerate(r["prefix"]) if k >> linededup.HASH >= hot)
    assert sorted((r["token"], r["a"], r["n"], r["left"], r["bits"]) for r in found.collect()) == want and want
