"""Embedding near duplicates: binary codes by iterative quantisation, multi-index Hamming tables, then the vectors themselves.

A rotation learnt on a bounded sample makes the signs of centred vectors balanced codes. Codes within a radius share, in one
of several tables, a substring within that table's radius, so codes meet in buckets halfway, each with some bits flipped; buckets are cut into blocks that are
verified pair by pair of blocks. Codes alone decide first which vectors have any candidate; only those go into the tables
again with their vectors, which decide. No pair leaves its task: a task gives each vector's number of links and a spanning
forest. Each pair counts in the first table where it meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import components, cut, each_salt, salt, salts
from factorloom.llm.simhash import Forest, blocks, pairs_in_groups, whole_groups

BITS = 64
#: Vectors that the rotation is learnt from, at most.
SAMPLE = 20_000
#: Differing bits that tables cover where no radius is learnt; of centred vectors at a cosine of 0.93, 7.7 are to be expected, with a deviation of 2.6.
RADIUS = 11
#: The part of the pairs at the least cosine whose codes may differ in more bits than the learnt radius.
MISS = 0.001
_PAIRS = 1 << 15
#: What a row of a table costs, in pairs compared.
_ROW = 32


def learn(sample: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and the projection onto the main directions, rotated so that signs lose least: alternately fix codes and rotation."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x.T @ x)
    axes = axes[: min(bits, x.shape[1])].T
    v = x @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    return mean, axes @ rotation


def codes(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    signs = (vectors - mean) @ projection >= 0
    wide = np.zeros((len(signs), BITS), dtype=bool)
    wide[:, : signs.shape[1]] = signs
    return np.packbits(wide, axis=1, bitorder="little").view("<i8").ravel()


def learnt_radius(sample: np.ndarray, mean: np.ndarray, projection: np.ndarray, least: float, seed: int = 5) -> int:
    """The distance that the codes of all but MISS of the pairs at the least cosine stay within.

    Pairs are planted at exactly that cosine beside vectors of the sample, once in any direction and once in the direction
    of another vector of it; the sample's own pairs count as well. The largest of the three distances is taken.
    """
    rng = np.random.default_rng(seed)
    at = rng.integers(0, len(sample), 20_000)
    own = sample[at]
    own_codes, most = codes(own, mean, projection).view(np.uint64), 0
    for toward in (rng.normal(size=own.shape), sample[rng.integers(0, len(sample), len(at))] - own):
        away = toward - (toward * own).sum(axis=1)[:, None] * own
        size = np.linalg.norm(away, axis=1)
        fine = size > 1e-9
        if fine.any():
            pair = least * own[fine] + math.sqrt(max(0.0, 1 - least * least)) * away[fine] / size[fine, None]
            apart = np.bitwise_count(own_codes[fine] ^ codes(pair, mean, projection).view(np.uint64))
            most = max(most, int(np.quantile(apart, 1 - MISS, method="higher")))
    some = sample[:4000]
    i, j = np.nonzero(np.triu(some @ some.T >= least, 1))
    if len(i):
        known = codes(some, mean, projection).view(np.uint64)
        most = max(most, int(np.quantile(np.bitwise_count(known[i] ^ known[j]), 1 - MISS, method="higher")))
    return most


def _ball(length: int, r: int) -> int:
    """How many keys a code goes to in a table: two codes that differ in r bits of it meet halfway, each with up to r / 2 bits flipped."""
    return sum(math.comb(length, d) for d in range(r // 2 + 1))


def _costs(plan: list[tuple[list[int], int]], rows: float) -> tuple[float, float]:
    """Of a code: the keys it goes to, and the pairs it is in, for so many rows in a class."""
    balls = [(_ball(len(p), r), len(p)) for p, r in plan]
    return sum(b for b, _ in balls), sum(b * b * rows / 2 ** (n + 1) for b, n in balls)


def tables(rows: float, radius: int = RADIUS, bits: int = BITS) -> list[tuple[list[int], int]]:
    """Substrings of nearly equal length and their radii, all even, as many as make keys and pairs cheapest for so many rows in a class.

    Codes within the radius are within the own radius of one table at least: the radii, each plus one, add up to more than the radius.
    """
    best = None
    for half in range(radius // 2 + 2):
        m = -(-(radius + 1) // (2 * half + 1))
        less = min(m, (m * (2 * half + 1) - radius - 1) // 2) if half else 0
        plan = [(list(range(bits))[k::m], 2 * half - 2 * int(k >= m - less)) for k in range(m)]
        keys, pairs = _costs(plan, rows)
        cost = (pairs >= rows / 2, _ROW * keys + pairs)  # tables that leave fewer pairs than a class has, if any do
        if best is None or cost < best[0]:
            best = (cost, plan)
    return best[1]


def plan_of(rows: float, radius: int) -> list[tuple[list[int], int]]:
    """The tables, or one bucket for all of a label where tables would leave no fewer pairs."""
    plan = tables(rows, radius)
    return plan if _costs(plan, rows)[1] < rows / 2 else [([], 0)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _probes(nodes: DataFrame, plan: list[tuple[list[int], int]], carried: list[str]) -> DataFrame:
    """Rows (label, part, key, flip, node, code, carried): each code's own keys, and those with up to half a table's radius of bits flipped."""
    flips = F.array(*[F.struct(F.lit(t).alias("part"), F.lit(_mask(bits)).alias("mask"), F.lit(_mask(list(c))).alias("flip")) for t, (bits, r) in enumerate(plan) for k in range(r // 2 + 1) for c in combinations(bits, k)])
    out = nodes.select("label", "node", "code", *carried, F.explode(flips).alias("f"))
    return out.select("label", F.col("f.part").alias("part"), F.col("code").bitwiseAND(F.col("f.mask")).bitwiseXOR(F.col("f.flip")).alias("key"), F.col("f.flip").alias("flip"), "node", "code", *carried)


_KEYS = ["label", "part", "key"]


def _blocked(nodes: DataFrame, plan: list[tuple[list[int], int]], carried: list[str], block: int) -> DataFrame:
    keys = [*_KEYS, "lo", "hi"]
    out = blocks(_probes(nodes, plan, carried), _KEYS, "node", block)
    return out.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "side", "flip", "node", "code", *carried)


def _candidates(f: pd.DataFrame, group: np.ndarray, radius: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    code, side, node = f["code"].to_numpy(dtype=np.int64).view(np.uint64), f["side"].to_numpy(), f["node"].to_numpy()
    for i, j in pairs_in_groups(group, side, _PAIRS):
        near = (np.bitwise_count(code[i] ^ code[j]) <= radius) & (node[i] != node[j])
        if near.any():
            yield i[near], j[near]


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the ways that two codes meet in a table, the one that counts: the smaller node flips (a) the lower half of the differing bits, the middle one included, and the greater node (b) the others."""
    more = np.bitwise_count(a).astype(np.int8) - np.bitwise_count(b).astype(np.int8)
    lowest = b & (~b + np.uint64(1))
    return ((more == 0) | (more == 1)) & ((b == 0) | (a < lowest))


def links(nodes: DataFrame, least: float, radius: int = RADIUS, block: int = 2048) -> DataFrame:
    """Of nodes (label, node, code, n, vector): rows (node, other, links) that add up to each node's links, weighted by n, and join what is linked."""
    size = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).head()[0] or 1.0
    first = plan_of(size, radius)

    def with_candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, group in whole_groups(batches, [*_KEYS, "lo", "hi"]):
            hit = np.zeros(len(f), dtype=bool)
            for i, j in _candidates(f, group, radius):
                hit[i] = hit[j] = True
            if hit.any():
                yield pd.DataFrame({"node": np.unique(f["node"].to_numpy()[hit])})

    some = _blocked(nodes, first, [], block).mapInPandas(with_candidates, "node long").distinct()
    nodes = cut(nodes.join(some, "node", "left_semi"))
    size = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).head()[0] or 1.0
    plan = plan_of(size, radius)
    masks = [np.uint64(_mask(bits) % (1 << 64)) for bits, _ in plan]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, group in whole_groups(batches, [*_KEYS, "lo", "hi"]):
            code, flip = (f[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("code", "flip"))
            part, n, node = f["part"].to_numpy(), f["n"].to_numpy(), f["node"].to_numpy()
            length = f["vector"].map(len).to_numpy()
            unit = np.zeros((len(f), length.max()))  # lengths differ between labels only; zeros change no cosine
            for size in np.unique(length):
                unit[length == size, :size] = np.stack(f["vector"][length == size].to_numpy())
            unit /= np.linalg.norm(unit, axis=1)[:, None]
            forest, count = Forest(len(f)), np.zeros(len(f), dtype=np.int64)
            for i, j in _candidates(f, group):  # of all that have met, the cosine decides
                i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
                once = _first_meeting(flip[i], flip[j])
                i, j = i[once], j[once]
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
                for t, (mask, (_, r)) in enumerate(zip(masks, plan, strict=True)):
                    near &= (part[i] <= t) | (np.bitwise_count((code[i] ^ code[j]) & mask) > r)  # not met in an earlier table
                i, j = i[near], j[near]
                forest.link(i, j)
                np.add.at(count, i, n[j])
                np.add.at(count, j, n[i])
            hit = np.flatnonzero((forest.root != np.arange(len(f))) | (count > 0))
            if len(hit):
                yield pd.DataFrame({"node": node[hit], "other": node[forest.root[hit]], "links": count[hit]})

    return _blocked(nodes, plan, ["n", "vector"], block).mapInPandas(verify, "node long, other long, links long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, radius: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """Per row of df: the id, n_links (other rows linked directly), component_id (the smallest id that links reach) and kept.

    Rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is least or more.
    Equal vectors of a label are one node with their number, so copies never make pairs. Vectors that are null, zero, or hold
    null or non-finite numbers link with nothing, nor do vectors of different lengths; each length has
    its own rotation and radius, learnt from about sample vectors in all, or 256 of each length, drawn by their hash. Rows without an id count as links, but name no component; kept is
    then whether the component has no id. The radius leaves out MISS of the pairs at the least cosine, as far as the
    sample tells, and fewer above; tests measure the recall against brute force.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("vector"))
    valid = rows.where("label is not null").where(fine)
    groups = cut(valid.groupBy("label", "vector").agg(F.count("*").alias("n"), F.min("id").alias("first"), salts("id").alias("bits")).withColumn("node", F.monotonically_increasing_id()))
    size, own = F.size("vector"), F.shiftrightunsigned(F.xxhash64("vector"), 1)
    counts = {r[0]: r[1] for r in groups.groupBy(size.alias("length")).count().orderBy("length").collect()}
    lengths = list(counts)
    each = max(sample // max(len(lengths), 1), 256)
    bounds = F.create_map(*[F.lit(v) for d, n in counts.items() for v in (d, int(min(1.0, each / n) * 2**63) - 1)])[size] if counts else F.lit(-1)
    drawn = groups.select("vector", own.alias("h")).where(F.col("h") <= bounds).toPandas().sort_values("h", kind="stable")["vector"]  # by hash: about as many as each, of any table
    learnt, radii = {}, {}
    for length in lengths:
        known = np.stack([x for x in drawn if len(x) == length])
        known = known / np.abs(known).max(axis=1)[:, None]
        known = known / np.linalg.norm(known, axis=1)[:, None]
        learnt[length] = learn(known)
        radii[length] = learnt_radius(known, *learnt[length], least) if radius is None else radius

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for length, f in b.groupby(b["vector"].map(len)):
                x = np.stack(f["vector"].to_numpy())
                x = x / np.abs(x).max(axis=1)[:, None]  # so that squares neither overflow nor vanish
                f = f.assign(code=codes(x / np.linalg.norm(x, axis=1)[:, None], *learnt[length]), vector=list(x))
                yield f[["label", "node", "n", "vector", "code"]]

    label = F.concat_ws(":", F.size("vector").cast("string"), F.col("label").cast("string")).alias("label")
    coded = cut(groups.select(label, "node", "n", "vector").mapInPandas(encode, "label string, node long, n long, vector array<double>, code long"))
    found = None
    for r in sorted(set(radii.values())) or [RADIUS]:
        some = links(coded.where(F.size("vector").isin([k for k, x in radii.items() if x == r])), least, r)
        found = some if found is None else found.union(some)
    found = cut(found)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = groups.join(counts, "node", "left").join(reach, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    nodes = nodes.join(firsts, "component").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", each_salt("bits").alias("part"))
    linked = valid.withColumn("part", salt("id")).join(nodes, ["label", "vector", "part"]).select("id", "n_links", "component_id")
    rest = rows.where(F.col("label").isNull() | ~F.coalesce(fine, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(rest).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
