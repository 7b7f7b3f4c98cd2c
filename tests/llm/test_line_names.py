"""Line dedup's names of lines, which take the line as it stands."""

from __future__ import annotations

import re

from parcella.llm import linededup


def test_texts_are_not_lower_cased_to_name_their_lines(spark):
    df = spark.createDataFrame([(1, "a b c\nd e"), (2, "A b c")], "doc_id long, text string")
    plan = linededup.lines_of(df, "doc_id", "text").select("h1")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "split(text" in plan and "lower(" not in plan and "contains(" not in plan


def test_lines_that_differ_in_case_or_spaces_only_match(spark):
    rows = [(1, "The\nthe Old mill\n \t\x0b\x0c\r\nÄrger im Amt"), (2, "THE\nthe\r\nThe\told  MILL \nÄRGER IM AMT\r\nStraße"), (3, "\r\nnew words here\nthe old mill\nSTRASSE"), (4, "NEW\x0cWORDS\x0bHERE\nstraße\n")]
    lines = [(i, k, set(re.findall(r"[^\x20\x09-\x0D]+", x.lower()))) for i, t in rows for k, x in enumerate(t.split("\n"))]
    gone = {b[:2] for b in lines for a in lines if a[:2] < b[:2] and a[2] and b[2] and len(a[2] & b[2]) >= 0.8 * len(a[2] | b[2])}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["id"], r["line_no"]) for r in linededup.later_matches(df).collect()} == gone
    assert gone == {(2, 0), (2, 1), (2, 2), (2, 3), (3, 2), (4, 0), (4, 1)}
    few = linededup.later_matches(df, min_words=2)
    assert {(r["id"], r["line_no"]) for r in few.collect()} == {(2, 2), (2, 3), (3, 2), (4, 0)}
