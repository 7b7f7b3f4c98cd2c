"""Near copies against brute-force Jaccard, and what the pipeline's stage keeps."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from parcella.llm import shingles, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    """The least place of each text's group, and the links."""
    sets, label, links = [brute_set(t) for t in texts], list(range(len(texts))), []
    for a in range(len(texts)):
        for b in range(a):
            if not (sets[a] or sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
                links.append((b, a))
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label, links


def edited(seed=3, count=160):
    rng = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 300))] for _ in range(12)]
    texts = [None, "", " \t"]
    for _ in range(count):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 1 + len(words) // 40)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(rng.choice([" ", "\t"]).join(words))
    return texts


def kept(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    return corpus_pipeline.one_of_near_copies(spark, df, "").collect()


def test_near_copies_equal_brute_force(spark):
    texts = edited()
    label, links = brute_groups(texts)
    far = [(a, b) for a, b in links if (simhash.fingerprint(texts[a], 5) ^ simhash.fingerprint(texts[b], 5)).bit_count() > 3]
    assert len(far) > 20  # links that fingerprints 3 bits apart don't show
    assert sorted(r["doc_id"] for r in kept(spark, enumerate(texts))) == sorted(set(label))


def test_near_copies_in_the_small_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in df.collect())
    label, _ = brute_groups([t for _, t in rows])
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, df, "").collect()) == sorted(rows[k][0] for k in set(label))


def test_rows_without_an_id_or_with_one_id_stay_if_their_texts_differ(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(None, a), (None, b), (None, a), (1, b), (2, c), (2, a.upper() + " end"), (2, " ".join(f"d{k}" for k in range(30)))]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in kept(spark, rows))
    # an id goes before none; of the two copies of a without one and the near copy with id 2, that with an id stays
    assert got == sorted([(1, b), (2, c), (2, rows[5][1]), (2, rows[6][1])])
    assert len(kept(spark, [(None, a), (None, b), (None, c)])) == 3
