"""Recall of embedding near-dedup for vectors that share a direction."""

from __future__ import annotations

import numpy as np
import pytest

from parcella.llm import itq


@pytest.mark.parametrize("mean", [0.0, 1.5, 4.0])
def test_links_near_the_threshold_are_found_whatever_the_mean(spark, mean):
    rng = np.random.default_rng(1)
    noise = 0.31 * (1 + mean**2) ** 0.5 / 8
    v = np.repeat(rng.standard_normal((200, 64)) / 8, 10, axis=0) + noise * rng.standard_normal((2000, 64))
    v[:, 0] += mean
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    if mean < 4:
        assert ((u @ u.T)[near] < 0.92).mean() > 0.3
    df = spark.createDataFrame([(k, a.tolist()) for k, a in enumerate(v)], "vec_id long, embedding array<double>")
    found = sum(r["n_links"] for r in itq.near_dedup(df).collect())
    assert 0.9 * near.sum() <= found <= near.sum()
