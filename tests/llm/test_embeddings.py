"""Embedding near duplicates against brute force."""

import math
from itertools import combinations

import numpy as np
import pytest

from factorloom.llm import embeddings


def brute(rows, least=0.93):
    ok = {}
    for k, (_, label, v) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=float)
            ok[k] = (label, x / np.linalg.norm(x))
    links = {k: {q for q in ok if q != k and ok[q][0] == ok[k][0] and len(ok[q][1]) == len(ok[k][1]) and float(ok[k][1] @ ok[q][1]) >= least} for k in ok}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for q in links.get(todo.pop(), ()):
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        ids = [rows[q][0] for q in seen if rows[q][0] is not None]
        first = min(ids, default=None)
        out.append((i, len(links.get(k, ())), first, i == first))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 64))
    rows = []
    for k in range(30):
        for _ in range(6):
            rows.append((len(rows), k % 3, [float(np.float32(x)) for x in base[k] + rng.normal(size=64) * 0.15]))
    rows += [(len(rows) + k, 1, rows[0][2]) for k in range(5)] + [(400 + k, 0, rows[0][2]) for k in range(7)]
    rows += [(500, 0, None), (501, 0, [0.0] * 64), (502, 0, [float("nan")] * 64), (503, 0, [None] * 64), (504, None, rows[0][2]), (505, 0, [1.0]), (None, 0, rows[0][2]), (rows[3]), (506, 0, [float("inf")] * 64), (507, 0, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS node", "'x' AS code", "2 AS id", "3 AS n")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("noise", [0.2, 0.3, 0.37])
def test_recall(spark, noise):
    """Links near the threshold, where codes miss most: at least nine in ten are found, and none that is not there."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(250, 64))
    rows = [(2 * k + s, 0, (b + s * noise * rng.normal(size=64)).tolist()) for k, b in enumerate(base) for s in (0, 1)]
    want = {r[0]: r[1] for r in brute(rows)}
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 0


def test_blocks_do_not_change_links(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1, 64)) + 0.05 * rng.normal(size=(300, 64))
    mean, projection = embeddings.learn(rng.normal(size=(500, 64)))
    rows = [("a", k, int(c), 1, v.tolist()) for k, (v, c) in enumerate(zip(x, embeddings.codes(x, mean, projection), strict=True))]
    nodes = spark.createDataFrame(rows, "label string, node long, code long, n long, vector array<double>")
    found = [sorted(map(tuple, embeddings.links(nodes, 0.93, 11, block).groupBy("node").sum("links").collect())) for block in (16, 2048)]
    assert found[0] == found[1] and sum(n for _, n in found[0]) > 0


def test_tables_cover_the_radius():
    for rows in (10, 10**4, 10**7, 10**10):
        plan = embeddings.tables(rows)
        assert sorted(b for p, _ in plan for b in p) == list(range(64)) and sum(r + 1 for _, r in plan) > embeddings.RADIUS


def test_codes_meet_once_in_a_table():
    rng = np.random.default_rng(2)
    for half in (0, 1, 2):
        balls = np.array([sum(1 << b for b in c) for k in range(half + 1) for c in combinations(range(9), k)], dtype=np.uint64)
        a, b = (x.ravel() for x in np.meshgrid(balls, balls))
        for d in range(2 * half + 2):
            apart = np.uint64(sum(1 << int(k) for k in rng.permutation(9)[:d]))
            met = (a ^ b) == apart
            assert embeddings._first_meeting(a[met], b[met]).sum() == (d <= 2 * half)


def test_tables_of_each_radius_find_all_links(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 64))
    x = np.vstack([base, base + 0.3 * rng.normal(size=base.shape)])
    code = embeddings.codes(x, *embeddings.learn(rng.normal(size=(500, 64))))
    nodes = spark.createDataFrame([("a", k, int(c), k % 3 + 1, v.tolist()) for k, (v, c) in enumerate(zip(x, code, strict=True))], "label string, node long, code long, n long, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near, n = unit @ unit.T >= 0.93, np.arange(len(x)) % 3 + 1
    np.fill_diagonal(near, False)
    want = {k: int(c) for k, c in enumerate(near @ n) if c}
    for radius in (11, 16, 22):
        got = {r["node"]: r["links"] for r in embeddings.links(nodes, 0.93, radius).groupBy("node").sum("links").withColumnRenamed("sum(links)", "links").collect() if r["links"]}
        close = np.bitwise_count(code.view(np.uint64)[:, None] ^ code.view(np.uint64)[None]) <= radius
        assert all(got.get(k, 0) >= c for k, c in enumerate((near & close) @ n)) and all(got[k] <= want[k] for k in got)
