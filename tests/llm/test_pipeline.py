from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage makes of the small documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [("documents", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "t")
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs.collect()))
    return dict(out)


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps["toxicity"]}
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i not in kept for i, t in labels.items() if t == 1) >= 0.5 * sum(labels.values())
    whole = {r["doc_id"]: tuple(r) for r in steps["documents"]}
    assert all(tuple(r) == whole[r["doc_id"]] for r in steps["toxicity"])


def test_later_lines_go(steps):
    from tests.llm.test_operators import brute_lines

    want = brute_lines(sorted((r["doc_id"], r["text"]) for r in steps["toxicity"]))
    assert {r["doc_id"]: r["text"] for r in steps["line dedup"]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in steps["line dedup"])


def test_one_of_each_group_stays(steps):
    from tests.llm.test_operators import brute_fingerprint

    prints = {r["doc_id"]: brute_fingerprint(r["text"], 5) for r in steps["line dedup"]}
    group = {i: i for i in prints}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in steps["simhash near-dedup"]) == sorted({root(i) for i in ids})


def test_documents_are_taken_up_to_three_times(steps):
    before = {r["doc_id"]: r["text"] for r in steps["simhash near-dedup"]}
    taken = [r["doc_id"] for r in steps["mixing"]]
    assert all(before[r["doc_id"]] == r["text"] for r in steps["mixing"])
    assert max(map(taken.count, set(taken))) <= 3


def test_encoding_equals_the_library(steps):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in steps["mixing"]}
    assert len(steps["byte-level bpe"]) == len(steps["mixing"])
    for r in steps["byte-level bpe"]:
        want = library.encode_ordinary(text[r["doc_id"]])
        assert r["round_trip"] and list(r["ids"]) == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_stages_take_null_ids_null_and_empty_texts_and_extra_columns(spark):
    rows = [(None, "one two three four five six seven", "a"), (None, "quite another text that nobody else has written here", "a"), (4, "first text of the id four, with words of its own", "b"), (4, "second text of that id, which says something different", "b"), (5, None, "a"), (6, "", None), (7, " \t ", "b")]
    df = spark.createDataFrame([(i, t, "en", s, len(t or ""), 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, node long")
    lines = corpus_pipeline.without_repeated_lines(spark, df, "")
    kept = corpus_pipeline.one_of_near_copies(spark, lines, "")
    assert lines.columns == kept.columns == corpus_pipeline.COLUMNS and lines.count() == len(rows)
    got = sorted((r["text"] or "").strip() for r in kept.collect())
    assert got == sorted({(t or "").strip() for _, t, _ in rows})
    assert corpus_pipeline.without_repeated_lines(spark, df.limit(0), "").count() == 0
