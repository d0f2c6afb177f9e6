"""Tokens, SimHash and sharding against plain Python."""

import itertools
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from plain import sha, words

from factorloom.llm import common, queries, sharding, simhash, tokens

PATH, PATTERN = public_tokenizers.path(queries.BPE), public_tokenizers.PATTERN


def test_pieces_are_safe():
    enc = tokens._encoding(PATH, PATTERN)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "é", "1", " ", "  ", "\n", " x", "'s", "!", "　", "\x1c", "ß "]) for _ in range(rng.randrange(200)))
        assert "".join(tokens.pieces(text, 7)) == text
        assert [i for p in tokens.pieces(text, 7) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_tokens(awkward, empty, documents):
    enc = tokens._encoding(PATH, PATTERN)
    for df in (awkward, documents):
        name = tokens.ids_column(df)
        out = tokens.encode(df, PATH, PATTERN)
        raw = tokens.bytes_column(out)
        out = tokens.decode(out, PATH, PATTERN, name).withColumn("packed", tokens.packer()(name))
        for r in out.collect():
            want = enc.encode_ordinary(r["text"] or "")
            assert r[name] == want and bytes(r[raw]) == (r["text"] or "").encode() and sha(r["packed"]) == sha(struct.pack(f"<{len(want)}I", *want))
        short = tokens.encode(df, PATH, PATTERN, packed=True)
        for r in tokens.decode(short, PATH, PATTERN, name).collect():
            want = enc.encode_ordinary(r["text"] or "")
            assert bytes(r[name]) == struct.pack(f"<{len(want)}I", *want) and bytes(r[raw]) == (r["text"] or "").encode()
    assert tokens.encode(empty, PATH, PATTERN).count() == 0


def fingerprint(text, k=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, distance):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    for a, b in itertools.combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= distance:
            root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_simhash(awkward, documents, empty):
    for df in (awkward, documents):
        rows = [(r["doc_id"], fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
        group = components({p for _, p in rows}, 3)
        first = defaultdict(list)
        for i, p in rows:
            if i is not None:
                first[group[p]].append(i)
        want = Counter((i, p, min(first[group[p]], default=None)) for i, p in rows)
        got = Counter((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect())
        assert got == want
        kept = simhash.deduplicate(df)
        assert kept.columns == df.columns
        assert Counter(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == Counter({c for _, _, c in want if c is not None})
    assert simhash.near_duplicates(empty).count() == 0


def test_links_with_every_allocation(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = set()
    for c in centres:
        for _ in range(25):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            prints.add(x - 2**64 if x >= 2**63 else x)
    want = components({p % 2**64 for p in prints}, 3)
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    count, both = simhash.bit_counts(fps, "fp")
    assert count == len(prints) and both[3, 3] == sum(p >> 3 & 1 for p in prints) and both[3, 9] == sum((p >> 3 & 1) & (p >> 9 & 1) for p in prints)
    for m, limits in ((4, [0, 0, 0, 0]), (2, [1, 1]), (3, [0, 1, 0]), (5, [0, 0, -1, 0, 0]), (1, [2])):
        parts = simhash.grouped_bits(count, both, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        for block in (7, 4096):
            found = simhash.verified(simhash.blocks(simhash.probes(fps, "fp", parts, limits), ["part", "key"], "fp", block), 3).collect()
            root = {p: p for p in prints}

            def find(p):
                while root[p] != p:  # noqa: B023
                    p = root[p]  # noqa: B023
                return p

            for r in found:
                assert ((r["a"] ^ r["b"]) % 2**64).bit_count() <= 64
                root[find(r["a"])] = find(r["b"])
            if m == 1:
                continue  # not a full cover of distance 3
            assert {frozenset(x for x in prints if find(x) == f) for f in map(find, prints)} == {frozenset(x for x in prints if want[x % 2**64] == f) for f in set(want.values())}


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (500, 64)).astype(float)
    for rows in (500, 10**6, 10**10):
        parts, limits = simhash.thresholds(rows, x.T @ x * rows / 500, 3)
        assert sum(t + 1 for t in limits) == 4 and len(parts) == len(limits)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def whole_differencing(items, shards):
    """Karmarkar-Karp over all items at once, by sorting anew in each round: the set of items of each shard, the heaviest first."""
    partial = [(no, [(size, (name,))] + [(0, ())] * (shards - 1)) for no, (size, name) in enumerate(items)]
    while len(partial) > 1:
        partial.sort(key=lambda p: (p[1][-1][0] - p[1][0][0], p[0]))
        (_, a), (_, b) = partial[0], partial[1]
        joined = [(x + y, m + k) for (x, m), (y, k) in zip(a, reversed(b), strict=True)]
        partial = [*partial[2:], (max(len(items), partial[-1][0], *(p[0] + 1 for p in partial)), sorted(joined, key=lambda x: -x[0]))]
    return [set(members) for _, members in partial[0][1]] if partial else [set()] * shards


def test_differencing():
    assert sharding.differencing([]) == []
    rng = random.Random(1)
    for sizes, k in (([8, 7, 6, 5, 4], 2), ([5] * 16, 8), (list(range(1, 200)), 8), ([1000, 1, 1], 3), ([rng.randrange(1, 10**6) for _ in range(300)], 8)):
        found = sharding.differencing([(s,) + (0,) * (k - 1) for s in sizes])
        want = whole_differencing([(s, i) for i, s in enumerate(sizes)], k)
        assert [{i for i, x in enumerate(found) if x[0] == shard} for shard in range(k)] == want


def test_sharding(spark, sf_dir, documents):
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in documents.collect()]
    got = {r["doc_id"]: r for r in queries.op10_karmarkar_karp(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    sizes, hash_of = Counter(), {t: xxhash.xxh64_intdigest(t, 42) for _, t in texts}
    for i, t in texts:
        sizes[t] += len(t) + 1
        r = got[i]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    # The rule for equal items: by the signed hash of the group, which is hashed once more by the operator.
    again = {t: xxhash.xxh64_intdigest(struct.pack("<q", signed(hash_of[t])), 42) for t in sizes}
    order = sorted(sizes, key=lambda t: (-sizes[t], signed(again[t])))
    want = whole_differencing([(sizes[t], t) for t in order], 8)
    assert len(sizes) <= sharding.ITEMS and [{t for i, t in texts if got[i]["shard"] == k} for k in range(8)] == want
    for k in range(8):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got.values())))


def test_sharding_in_levels(spark, awkward, empty):
    from pyspark.sql import functions as F

    rows = [(i, f"{'text ' * (i % 97)}{i % 700}") for i in range(2000)] + [(None, None)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for items in (7, 100, 5000):
        loads, biggest, by = [0] * 8, Counter(), defaultdict(set)
        slots = defaultdict(list)
        for r in sharding.assign(df, F.col("text"), F.length(F.coalesce("text", F.lit("")) ) + 1, order=F.col("doc_id"), items=items).collect():
            n = len(r["text"] or "") + 1
            loads[r["sharded"]["shard"]] += n
            biggest[r["text"]] += n
            by[r["text"]].add(r["sharded"]["shard"])
            slots[r["sharded"]["shard"]].append(r["sharded"]["slot"])
        assert sum(loads) == sum(biggest.values()) and max(loads) - min(loads) <= max(biggest.values())
        assert all(len(x) == 1 for x in by.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    name = sharding.shard_column(awkward)
    out = sharding.assign(awkward, F.col("text"), F.length(F.coalesce("text", F.lit(""))), order=F.col("doc_id"), shards=3, items=4).collect()
    assert len(out) == awkward.count()
    by = defaultdict(list)
    for r in out:
        by[r[name]["shard"]].append(r[name]["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.assign(empty, F.col("text"), F.lit(1), order=F.col("doc_id")).count() == 0
