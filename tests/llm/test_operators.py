"""Small tests of every operator: brute-force versions, and nulls, empty and long texts, ties, repeated rows, empty tables and
clashing extra columns."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcella.llm import bitslice, bpe, chat, components, itq, license, linededup, mixing, onebit, simhash, toxicity, warc
from parcella.llm.queries import ORACLE_SQL, QUERIES

#: Extra columns whose names operators use inside.
EXTRA = "id long, fp long, key string, size long, words string, hash string, copies int, target string, turn string, cell int, block int, digest string, type string, label string, line string, at int, n int, component long, node long"


def docs(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")
    if extra:
        for c in EXTRA.split(", "):
            name, kind = c.split()
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


LONG = " ".join(f"w{k}" for k in range(30_000))
ODD = [(1, "one two three four", "a"), (1, "one two three four", "a"), (2, None, None), (3, "", "a"), (4, " \t\n ", "b"), (5, LONG, "b"), (None, "one two three four", "a"), (6, "One TWO three four", "ä")]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(same, name):
    same(QUERIES[name], ORACLE_SQL[name])


def brute_fingerprint(text, words=3):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force():
    for text in ("", None, "a", "A b", "a b c", "a b c d e f g a b c", "é É ß x y z w", "a\x1cb c d"):
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(LONG) == brute_fingerprint(LONG)


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bit_sliced_pairs_equal_brute_force(radius):
    rng = np.random.default_rng(radius)
    v = np.repeat(rng.integers(0, 2**63, 12, dtype=np.uint64), 20)
    for _ in range(4):
        v ^= np.uint64(1) << rng.integers(0, 64, len(v), dtype=np.uint64)
    bucket = np.sort(rng.integers(0, 4, len(v)))
    left = np.searchsorted(bucket, bucket, side="right") - np.arange(len(v)) - 1
    got = sorted((int(a), int(b)) for i, j in bitslice.near_pairs(v, left, radius, piece=100) for a, b in zip(i, j))
    d = np.bitwise_count(v[:, None] ^ v[None, :])
    want = sorted((int(a), int(b)) for a, b in zip(*np.nonzero((d <= radius) & (bucket[:, None] == bucket[None, :]))) if a < b)
    assert got == want


def test_links_equal_brute_force_with_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = np.random.default_rng(5)
    v = np.unique(np.repeat(rng.integers(0, 2**63, 6, dtype=np.uint64), 60) ^ (np.uint64(1) << rng.integers(0, 64, 360, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 360, dtype=np.uint64)))
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    got = {r["node"]: r["component"] for r in components.components(simhash.links(df, 3)).collect()}
    label = {int(x): int(x) for x in v.view(np.int64)}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in zip(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3)):
        a, b = root(int(v.view(np.int64)[i])), root(int(v.view(np.int64)[j]))
        label[max(a, b)] = min(a, b)
    for x in label:
        assert got.get(x, x) == root(x)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 150)) and len(got) == 91
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_of_odd_rows(spark):
    got = sorted((r["id"] is None, r["id"] or 0, r["component"]) for r in simhash.near_dedup(docs(spark, ODD)).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 2), (False, 3, 2), (False, 4, 2), (False, 5, 5), (False, 6, 1), (True, 0, 1)]
    assert simhash.near_dedup(docs(spark, [])).count() == 0


def brute_lines(rows, threshold=0.8, least=1):
    lines = [(i, k, line, set(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))) for i, t in rows for k, line in enumerate(t.split("\n"))]
    gone = set()
    for a in lines:
        for b in lines:
            if (b[0], b[1]) < (a[0], a[1]) and len(a[3]) >= least and len(b[3]) >= least and len(a[3] & b[3]) >= threshold * len(a[3] | b[3]):
                gone.add((a[0], a[1]))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linededup, "LEADERS", 2)
    monkeypatch.setattr(linededup, "GROUP", 4)
    monkeypatch.setattr(linededup, "LONG", 8)
    monkeypatch.setattr(linededup, "VERY_LONG", 12)
    rng = random.Random(2)
    vocabulary = [f"t{k}" for k in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 25))] for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute_lines(rows) and got != dict(rows)


def test_line_dedup_of_odd_rows(spark):
    line = "one two three four five six"
    rows = [(1, line, "a"), (1, line, "a"), (2, None, "a"), (3, "", "a"), (4, f"{line}\nshort\n{line.upper()}", "a"), (5, LONG + "\n" + LONG, "a"), (None, "x\n" + line, "a")]
    df = docs(spark, rows)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["gone"]) for r in linededup.dedup(df, removed_col="gone").collect())
    # the row without an id is ordered first
    assert [(i, t, g) for _, i, t, g in got] == [(1, "", 1), (1, "", 1), (2, None, 0), (3, "", 0), (4, "short", 2), (5, LONG, 1), (0, "x\n" + line, 0)]
    assert linededup.dedup(df).columns == df.columns
    assert linededup.dedup(docs(spark, [])).count() == 0


VECTOR = "vec_id long, embedding array<float>, label int, id long, cell int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, None, None) for i, v in rows], VECTOR)


def spread(n=300, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    v[: n // 3] = v[0] + 0.05 * rng.standard_normal((n // 3, dim))
    v[n // 3 : n // 2] = v[n // 3]
    return v.astype(np.float32)


def test_embedding_near_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(itq, "CELL", 40)
    v = spread()
    x = v.astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    got = {r["vec_id"]: r for r in itq.near_dedup(vectors(spark, [(k, a.tolist()) for k, a in enumerate(v)])).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert 0.99 * (link.sum() - len(v)) <= found <= link.sum() - len(v)
    assert all(got[k]["component_id"] == 0 and got[k]["kept"] == (k == 0) for k in range(100))
    assert all(got[k]["n_links"] <= link[k].sum() - 1 for k in range(len(v)))


def test_vectors_that_cannot_link(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in itq.near_dedup(vectors(spark, rows)).collect())
    assert got == [*[(False, k, 0, k) for k in range(1, 7)], (False, 7, 3, 7), (False, 8, 3, 7), (False, 8, 3, 7), (False, 9, 0, 9), (True, 0, 3, 7)]
    near = onebit.search(vectors(spark, rows), F.col("vec_id") == 7, k=2).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(near, key=lambda r: r["rank"])] == [(7, 1, 8, 1.0), (7, 2, 8, 1.0)]
    assert itq.near_dedup(vectors(spark, [])).count() == 0 and onebit.search(vectors(spark, []), F.lit(True)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    turn = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    rows = [(5, turn(0)), (None, turn(0.2)), (5, turn(90)), (9, turn(90.1)), (None, turn(200)), (None, turn(200.1))]
    got = sorted((r["component_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in itq.near_dedup(vectors(spark, rows)).collect())
    assert got == [(False, 0, 1, 5, False), (False, 5, 1, 5, True), (False, 5, 1, 5, True), (False, 9, 1, 5, False), (True, 0, 1, None, False), (True, 0, 1, None, False)]
    asked = onebit.search(vectors(spark, rows), F.col("vec_id") == 5, k=2).collect()
    assert sorted((r["rank"], r["vec_id"] or 0) for r in asked) == [(1, 0), (1, 9), (2, 0), (2, 5)] and {r["query_id"] for r in asked} == {5}
    far = [(0, [1e200, 1e200]), (1, [1e200, 2e200]), (2, [3e-200, 3e-200]), (3, [-1.0, 0.0])]
    wide = spark.createDataFrame(far, "vec_id long, embedding array<double>")
    best = sorted((r["rank"], r["vec_id"], round(r["score"], 9)) for r in onebit.search(wide, F.col("vec_id") == 0, k=2).collect())
    assert best == [(1, 2, 1.0), (2, 1, round(3 / 10**0.5, 9))]


def test_the_search_query_equals_brute_force_on_its_table(spark):
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect() if r["embedding"]}
    got = {}
    for r in QUERIES["op9_onebit"](spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, hit, all_of = np.array(sorted(v)), 0, 0
    x = np.stack([v[i] for i in ids])
    for q in ids[ids % 50 == 0]:
        score = onebit.cosine(x, v[q])
        score[ids == q] = -2
        best = np.lexsort((ids, -score))[:5]
        hit, all_of = hit + len(set(ids[best].tolist()) & {b for _, b, _ in got[q]}), all_of + 5
        assert sorted(a for a, _, _ in got[q]) == [1, 2, 3, 4, 5] and all(s == pytest.approx(score[ids == b][0], abs=1e-12) for _, b, s in got[q])
    assert len(got) == (ids % 50 == 0).sum() and hit >= 0.95 * all_of


def test_search_equals_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(onebit, "VECTORS", 50)
    monkeypatch.setattr(onebit, "QUERIES", 7)
    v = spread(400)
    got = {}
    for r in onebit.search(vectors(spark, [(k, a.tolist()) for k, a in enumerate(v)]), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    x, hit = v.astype(float), 0
    for q in range(0, 400, 20):
        score = onebit.cosine(x, x[q])
        score[q] = -2
        best = np.lexsort((np.arange(400), -score))[:5]
        hit += len({a for a, _ in got[q].values()} & set(best.tolist()))
        assert all(s == pytest.approx(score[a], abs=1e-15) for a, s in got[q].values())
    assert len(got) == 20 and hit / 100 >= 0.95


def test_mixing_of_odd_rows(spark):
    rows = mixing.mix(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["copies"] <= 3 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    assert by["b"][0]["source_size"] == 30_000 and by[None][0]["source_size"] == 0 and by[None][0]["target"] == 0
    total = sum(r["size"] for r in rows)
    assert sum(x[0]["target"] for x in by.values()) == pytest.approx(total)
    assert by["a"][0]["target"] == 3 * by["a"][0]["source_size"]  # the excess goes to the others
    assert mixing.mix(docs(spark, [])).count() == 0
    df = docs(spark, ODD)
    assert mixing.mixture(df).columns == df.columns


def test_rows_without_an_id_are_mixed_one_by_one(spark):
    rng = random.Random(12)
    rows = [(None if k % 2 else 7, " ".join(f"x{k}y{j}" for j in range(rng.randint(5, 15))), f"s{k % 3}") for k in range(900)]
    by = {}
    for r in mixing.mix(docs(spark, rows)).collect():
        by.setdefault(r["source"], []).append(r)
    assert any(0 < sum(r["copies"] == 1 for r in own) < len(own) for own in by.values())
    assert all(abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 15 for own in by.values())


def test_targets_are_met_and_reruns_agree(spark):
    rng = random.Random(4)
    rows = [(k, " ".join("x" * rng.randint(1, 60)), f"s{k % 5}") for k in range(1500)]
    first = {r["id"]: (r["source"], r["size"], r["target"], r["copies"]) for r in mixing.mix(docs(spark, rows)).collect()}
    again = {r["id"]: (r["source"], r["size"], r["target"], r["copies"]) for r in mixing.mix(docs(spark, rows[::-1])).collect()}
    assert first == again
    for s in {x[0] for x in first.values()}:
        own = [x for x in first.values() if x[0] == s]
        assert abs(sum(x[1] * x[3] for x in own) - own[0][2]) <= 60


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, None, None) for i, u, h in rows], "page_id long, url string, html string, type string, payload string")


def test_warc_round_trip_of_odd_pages(spark, tmp_path):
    big = "é" * 200
    trap = "x" * 100 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(5, "http://a/é b", big), (3, "http://a", big), (3, "http://a", big), (9, None, None), (4, "http://b\r\nX: y", ""), (7, "http://c", trap), (8, "http://c", trap), (1, "u", "short"), (2, "u", "short"), (None, "n", big)]
    path = f"file://{tmp_path}/w"
    warc.write(pages(spark, rows), path)
    got = warc.read(spark, path)
    seen = sorted((r["record_id"], r["type"], r["refers_to"], r["payload_length"], bytes(r["payload"]) if r["payload"] is not None else None) for r in got.collect())
    assert len(seen) == len(rows)
    assert ("<urn:page:5>", "revisit", "<urn:page:3>", 400, None) in seen and ("<urn:page:null>", "revisit", "<urn:page:3>", 400, None) in seen
    assert sum(x[:2] == ("<urn:page:3>", "response") for x in seen) == 2
    assert ("<urn:page:7>", "response", None, len(trap), trap.encode()) in seen and ("<urn:page:8>", "revisit", "<urn:page:7>", len(trap), None) in seen
    assert ("<urn:page:2>", "response", None, 5, b"short") in seen and ("<urn:page:9>", "response", None, 0, b"") in seen
    assert got.where("type = 'revisit'").count() == 3
    plan = got.where("type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # the source has taken it over
    heads = warc.read(spark, path, payload="false", record_types="response").collect()
    assert len(heads) == 7 and all(r["payload"] is None for r in heads)


def test_malformed_archives_say_where(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nabc")
    with pytest.raises(Exception, match="ends early"):
        warc.read(spark, f"file://{tmp_path}/a.warc").collect()
    (tmp_path / "b.warc").write_bytes(b"hello\r\n")
    with pytest.raises(Exception, match="no record starts"):
        warc.read(spark, f"file://{tmp_path}/b.warc").collect()
    (tmp_path / "none").mkdir()
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def talk(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "conv_id long, turn long, role string, text string, number int, cell int")


def test_chat_windows_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    rng = random.Random(6)
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 2, "assistant", ""), (2, None, "user", "a\\<|im_end|>\\\\|b<|"), (2, 1, None, "x"), (3, 0, "assistant", LONG), (None, 0, "us\ner\\;", "hi"), (None, 1, "assistant", "yo")]
    rows += [(4, k, rng.choice(["user", "assistant"]), " ".join(["w<|\\"] * rng.randint(0, 200))) for k in range(60)]
    rows += [(5, 0, "system", "s " * 30)] + [(5, k, ["user", "assistant"][k % 2], " ".join(["v"] * rng.randint(0, 90))) for k in range(1, 40)]
    made = chat.windows(talk(spark, rows)).cache()
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        said, loss = "".join(f"{a}\n{b}\n" for a, b in turns), "".join(b for a, b in turns if a == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in made.collect():
        turns = r["formatted"].split("<|im_end|>\n")[:-1]
        fresh = turns[r["repeated"] :]
        words = sum(len(t.split("\n", 1)[1].split()) + chat.FRAME for t in turns)
        assert words <= chat.BUDGET or len(fresh) == 1
        assert len(r["spans"]) == sum(t.startswith("<|im_start|>assistant\n") for t in fresh)
        if r["conv_id"] == 5:
            assert turns[0].startswith("<|im_start|>system\n")
    assert chat.digests(chat.windows(talk(spark, []))).count() == 0


def test_licences_in_canonical_form(spark):
    mit = license.KNOWN["MIT"]
    spelled = "Copyright (c) 2019 Somebody\n" + mit.upper().replace("SUBLICENSE", "sub-licence".replace("-", "")).replace("\n", "\n\n   ").replace("HOLDERS", "owners")
    rows = [(1, mit, "a"), (2, spelled, "a"), (3, mit + " more", "a"), (4, None, "a"), (5, "", "a"), (6, "text\nLicensed under the apache licence, version 2.0\nmore", "a"), (1, mit, "a"), (7, LONG, "a"), (8, "...", "a")]
    got = sorted((r["id"], r["license"]) for r in license.scan_texts(docs(spark, rows)).collect())
    assert got == [(1, "MIT"), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (7, None), (8, None)]
    lines = [(r["id"], r["line_no"], r["license"]) for r in license.scan_lines(docs(spark, rows)).collect()]
    assert lines == [(6, 1, "Apache-2.0 notice")]
    # titles, copyright lines without a year, and spellings side by side
    bsd = license.KNOWN["BSD-3-Clause"]
    others = [(1, "The MIT License (MIT)\n\nCopyright (c) Somebody\n\n" + mit.removeprefix("MIT License\n"), "a"), (2, "© The Authors\n" + bsd, "a"), (3, bsd.replace("3. Neither", "Neither"), "a"), (4, license.KNOWN["BSL-1.0"].replace("\n", " "), "a")]
    assert sorted((r["id"], r["license"]) for r in license.scan_texts(docs(spark, others)).collect()) == [(1, "MIT"), (2, "BSD-3-Clause"), (3, None), (4, "BSL-1.0")]
    same = spark.createDataFrame([("Licence licence licence, per cent per cent",), ("license LICENSE license percent percent",)], "text string")
    assert same.select(license.canonical(F.col("text")).alias("c")).distinct().count() == 1
    own = spark.createDataFrame([("b", "x y"), ("a", "X, Y!"), ("c", None)], "license string, text string")
    assert license.scan_texts(docs(spark, [(1, "x -- y", "s")]), own).first()["license"] == "a"
    assert license.scan_texts(docs(spark, [])).count() == 0


def test_isotonic_is_monotone_and_pools():
    x, y = toxicity.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert list(np.interp([1.0, 2.5, 4.0], x, y)) == [0.0, 0.5, 1.0]


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    t = toxicity.Trees().fit(x, y, np.ones(2000))
    assert (((t.margin(x) > 0) == (y > 0)).mean()) > 0.98


def test_toxicity_on_held_out_rows_and_odd_rows(spark):
    rows = QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    known = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["doc_id"] in labels]
    assert sum(a == b for a, b in known) / len(known) >= 0.9
    for fitted in (toxicity.fit([], []), toxicity.fit(["a"], [1]), toxicity.fit(["you idiot moron", "fine day"] * 20, [1, 0] * 20)):
        scored = toxicity.score(docs(spark, ODD), fitted).collect()
        assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
        marked = toxicity.mark(docs(spark, ODD), fitted)
        assert marked.columns == [*docs(spark, ODD).columns, "toxicity"] and marked.count() == len(ODD)
    assert toxicity.score(docs(spark, []), toxicity.fit([], [])).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference(vocabulary):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary[0], "rb"))}
    return tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(vocabulary, reference):
    rng = random.Random(8)
    alphabet = "abehit noqrstu'\n\t 019.,;!?éßñ漢字😀 ́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(500)]
    texts += ["", "a" * 300, "ab" * 2000, "".join(rng.choice("abc") for _ in range(3000)), LONG]
    v = bpe.vocabulary(*vocabulary)
    got = v.encode(texts)
    assert [x.tolist() for x in got] == [reference.encode_ordinary(t) for t in texts]
    assert [v.decode(x) for x in got] == [t.encode() for t in texts]


def test_bpe_cache_is_bounded(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 50)
    v = bpe.Vocabulary(bpe.vocabulary(*vocabulary).ranks, vocabulary[1])
    for k in range(20):
        text = " ".join(f"w{k}x{j}" for j in range(9))
        assert v.encode([text])[0].tolist() == reference.encode_ordinary(text)
        assert len(v.known) <= 50


def test_bpe_of_odd_rows(spark, vocabulary):
    df = docs(spark, ODD).withColumn("ids", F.lit("clash"))
    coded = bpe.encode(df, *vocabulary, decoded_col="back")
    assert sorted(coded.columns) == sorted([*df.columns, "back"])
    for r in bpe.decode(coded, *vocabulary, decoded_col="again").collect():
        assert bytes(r["back"]) == bytes(r["again"]) == (r["text"] or "").encode()
    assert bpe.encode(docs(spark, []), *vocabulary).count() == 0
