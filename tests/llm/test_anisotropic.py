"""Embedding near duplicates where vectors share a direction, and of several lengths."""

import numpy as np
import pytest
from test_embeddings import brute

from factorloom.llm import embeddings


@pytest.mark.parametrize("common", [0.0, 1.0, 1.8])
def test_recall_with_a_common_mean(spark, common):
    """Planted pairs at cosines of 0.93 and a little more."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(unit(rng.normal(size=(400, 64))) + common * unit(rng.normal(size=64)))
    away = rng.normal(size=base.shape)
    away = unit(away - (away * base).sum(axis=1)[:, None] * base)
    cosine = rng.uniform(0.931, 0.95, 400)[:, None]
    near = cosine * base + np.sqrt(1 - cosine**2) * away
    rows = [(k, 0, x.tolist()) for k, x in enumerate(np.concatenate([base, near]))]
    want = {r[0]: r[1] for r in brute(rows)}
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.995 * sum(want.values()) > 0


def test_every_length_is_coded(spark):
    rng = np.random.default_rng(7)
    rows = [(1000 * d + 2 * k + s, k % 2, (b + s * 0.1 * rng.normal(size=d)).tolist()) for d in (8, 64, 100) for k, b in enumerate(rng.normal(size=(20, d))) for s in (0, 1)]
    got = sorted((tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()), key=str)
    assert got == brute(rows)
