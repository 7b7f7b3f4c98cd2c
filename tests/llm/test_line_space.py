"""Line dedup where words are parted by other white space than blanks."""

from __future__ import annotations

import re

from parcella.llm import linededup


def brute(rows):
    lines = [(i, k, line, set(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))) for i, t in rows for k, line in enumerate(t.split("\n"))]
    gone = {(b[0], b[1]) for b in lines for a in lines if (a[0], a[1]) < (b[0], b[1]) and min(len(a[3]), len(b[3])) >= 1 and len(a[3] & b[3]) >= 0.8 * len(a[3] | b[3])}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_tabs_part_words_and_a_cr_belongs_to_none(spark):
    rows = [
        (1, "a1\tb1\tc1\td1\te1\tf1\nu v w x y z\r\nlast line"),
        (2, "A1\tb1\tc1\td1\te1\tf1\nkept"),
        (3, "a1 b1 c1 d1 e1 f1\r\nu v w x y z\nkept\r"),
        (4, "p\x0bq\x0cr\ts t u\r\nother"),
        (5, "p q r s t u\nother"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(df).collect()}
    assert got == brute(rows)
    assert got[2] == "kept" and got[3] == "" and got[5] == ""
