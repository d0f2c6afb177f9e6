"""Repeated strings against brute force."""

import random

import numpy as np

from factorloom.llm import suffixes

W = suffixes.WIDTH


def brute(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in raw:
        for p in range(len(b) - W + 1):
            if i is not None:
                least[b[p : p + W]] = min(least.get(b[p : p + W], i), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - W + 1):
            if i is not None and least[b[p : p + W]] < i:
                gone[p : p + W] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


def texts(rng):
    vocabulary = ["of", "the", "and", "thé", "x", "wording", "in", "on\n", "ß"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 60))) for _ in range(12)]
    rows = []
    for k in range(90):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6))]
        t = " ".join(parts)
        if rng.random() < 0.3 and len(t) > 5:
            cut = rng.randrange(len(t))
            t = t[:cut] + "#" + t[cut:]
        rows.append((k * 3, t))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = texts(rng)
    rows += [(1000 + k, rows[k][1]) for k in range(10)] + [(-5, rows[20][1]), (7, "a" * 700), (8, "a" * 300 + "b" * 60), (9, "ab" * 200), (10, "ab" * 40 + "\x00" * 80), (11, "\x00" * 120), (12, "a" * 49), (13, "a" * 50)]
    rows += [(None, rows[0][1]), (None, None), (2001, None), (2002, ""), (2003, "short"), rows[5], (rows[6][0], rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS run", "'x' AS same", "3 AS n_bytes")
    want = brute(rows)
    for run_bytes, entries in ((1 << 20, 200_000), (1500, 20)):
        out = suffixes.deduplicate(df.repartition(3), run_bytes=run_bytes, entries_in_range=entries)
        got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()), key=str)
        assert got == want
    assert suffixes.deduplicate(df.where("false")).count() == 0


def test_merge_and_front_coding():
    rng = random.Random(2)
    for _ in range(60):
        streams = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 9))]
        prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        known = [[0] + [prefix(a, b) for a, b in zip(s, s[1:], strict=False)] for s in streams]
        order, shared = suffixes.merged(streams, [k[: len(s)] for k, s in zip(known, streams, strict=True)])
        at = [0] * len(streams)
        out = []
        for s in order:
            out.append(streams[s][at[s]])
            at[s] += 1
        assert out == sorted(x for s in streams for x in s)
        assert shared == [0] * bool(out) + [prefix(a, b) for a, b in zip(out, out[1:], strict=False)]
    run = suffixes.Run(np.array([4, 9]), [b"some text that is long enough to hold a few windows of fifty bytes", b"some text that is long enough to hold a few windows of fifty bytes and more"])
    key, doc, shared, first = suffixes.front_decoded(suffixes.front_coded(run.key, run.least, 17))
    assert (key == run.key).all() and (doc == run.least).all() and (shared == suffixes.common_prefixes(run.key)).all() and first == 17


def test_pieces_do_not_show(monkeypatch):
    rng = random.Random(4)
    t = [bytes(rng.choice(b"ab ") for _ in range(n)) for n in (300, 49, 700, 50, 120)] + [b"a" * 300]
    want = suffixes.anchors(t)
    for size in (1, 37, 250):
        monkeypatch.setattr(suffixes, "_CHUNK", size)
        assert all((a == b).all() for a, b in zip(want, suffixes.anchors(t), strict=True))


def test_every_string_has_one_anchor():
    rng = random.Random(3)
    t = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (30, 50, 400, 0, 51)]
    raw, at, low, high = suffixes.anchors(t)
    starts = [p for a, b in zip(low, high, strict=True) for p in range(a, b + 1)]
    assert len(starts) == len(set(starts)) == sum(max(0, len(x) - W + 1) for x in t)
    assert all(a <= q <= a + W - suffixes.SEED and b <= q for a, b, q in zip(high - (high - low), high, at, strict=True))
