from __future__ import annotations

import hashlib

from parcella.plans.queries import QUERIES


def test_the_digests_of_all_documents_are_checked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    now = {r["doc_id"]: None if r["text"] is None else hashlib.sha256(r["text"].encode()).hexdigest() for r in docs}
    recorded = [(i + 1, d) for i, d in now.items()] + [(0, now[0])] * (0 in now)
    want = sorted(repr((i, d, now.get(i))) for i, d in recorded if d != now.get(i))
    got = sorted(repr(tuple(r)) for r in QUERIES["source_hash_check"](spark, "/root/testdata/sf0.001").collect())
    assert got == want and len(want) > len(docs) // 2
