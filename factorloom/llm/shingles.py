"""SimHash near duplicates by the similarity of shingle sets: long fingerprints name candidates, exact Jaccard similarity decides.

At a similarity of 0.8 about 15 % of the bits differ. Of 64 bits that is nearly ten, as many as leave no partition
untouched, so no distance on 64 bits tells such pairs from others. Here fingerprints are as long as it takes: partitions of
some bits each, whose widths and thresholds a dynamic programme picks so that probes and estimated candidates cost least
and a pair at the least similarity shares no partition with a chance of MISS. Bits of one partition come from hashes of
their own, so none is more correlated than another, and order groups them.

Texts with equal words are one node. Nodes that meet in a partition are compared on 128 bits; a spanning forest of what
passes is verified by the shingle sets themselves. Where this leaves members of a bucket in several components, every
remaining pair of different components that passes the 128 bits is verified in blocks. So a bucket of true copies costs its
length in exact comparisons, not its square; no task holds a whole bucket, and no edge joins anything before its exact
similarity is known.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from factorloom.llm.common import components, each_salt, salt, salts, small_batches, written
from factorloom.llm.simhash import Forest, blocks, first_rows, identified, pairs_in_groups, set_counts, shingle_hashes, whole_groups, words_of

#: The chance that a pair at the least similarity shares no partition; pairs above it have less.
MISS = 0.001
#: Bits that two nodes of a bucket are compared on.
CHECKED = 128
#: Members of one block of a bucket.
BLOCK = 2048
#: What a probe and a bit of the fingerprint cost, in comparisons of two nodes.
_PROBE, _BIT = 20.0, 0.5
_RNG = np.random.default_rng(11)
_TIMES = _RNG.integers(0, 1 << 63, 1 << 10, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, 1 << 10, dtype=np.uint64)


def differing(least: float) -> float:
    """The part of the bits that differ at a Jaccard similarity, at most: sets of unequal size have a larger cosine."""
    return math.acos(min(1.0, 2 * least / (1 + least))) / math.pi


def allotted(rows: int, least: float, miss: float = MISS) -> list[tuple[int, int]]:
    """The partitions' widths and thresholds (0 or 1 differing bits) of least cost for so many rows."""
    p, units = differing(least), 500
    options = []
    for width in range(8, 41):
        for limit in (0, 1):
            hit = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(limit + 1))
            gain = math.floor(units * math.log(1 - min(hit, 1 - 1e-12)) / math.log(miss))
            probes = 1 + limit * (1 + width)
            if gain:
                options.append((min(gain, units), _PROBE * probes + (1 + limit * width) * rows / 2 ** (width + 1) + _BIT * width, (width, limit)))
    best: list[tuple[float, int, tuple | None]] = [(0.0, 0, None)]
    for u in range(1, units + 1):
        best.append(min((best[max(0, u - gain)][0] + cost, max(0, u - gain), part) for gain, cost, part in options))
    out, u = [], units
    while u:
        _, u, part = best[u]
        out.append(part)
    return sorted(out, reverse=True)


def bits_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """So many words of fingerprint bits: whether each is set in over half of the hashes' own bits."""
    counts = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at : at + 4096, None] * _TIMES[:words] + _PLUS[:words]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        counts += set_counts(mixed)
    return 2 * counts > len(hashes)


def partition_keys(plan: list[tuple[int, int]]):
    """A function: of a fingerprint's bits, the number that each partition's bits make."""
    ends = np.cumsum([w for w, _ in plan])
    starts, weights = np.r_[0, ends[:-1]], np.concatenate([1 << np.arange(w, dtype=np.int64) for w, _ in plan])
    return lambda bits: np.add.reduceat(bits[: ends[-1]] * weights, starts).tolist()


def _sketches(shingle: int, plan: list[tuple[int, int]]):
    words, keys_of = max(CHECKED // 64, math.ceil(sum(w for w, _ in plan) / 64)), partition_keys(plan)

    @pandas_udf("same string, keys array<long>, c0 long, c1 long")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            w = words_of(t)
            bits = bits_of(np.unique(shingle_hashes(w, shingle)), words)
            checked = np.packbits(bits[-CHECKED:], bitorder="little").view("<i8").tolist()
            out.append((hashlib.md5(b" ".join(w)).hexdigest(), np.array(keys_of(bits) if w else [], dtype=np.int64), *checked))
        return pd.DataFrame(out, columns=["same", "keys", "c0", "c1"])

    return of


def _sets(shingle: int):
    @pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(words_of(t), shingle)).view("<i8") for t in texts], dtype=object)

    return of


def _alike(both, a, b, least: float):
    """Whether both / (a + b - both) is least or more."""
    return both >= least * (a + b - both) - 1e-9


_KEYS = ["part", "key", "lo", "hi"]


def _close(f: pd.DataFrame, most: int):
    """Whether two rows of a block are closer than most of the checked bits, and not both variants."""
    c0, c1, probe = f["c0"].to_numpy(dtype=np.int64).view(np.uint64), f["c1"].to_numpy(dtype=np.int64).view(np.uint64), f["probe"].to_numpy()
    return lambda i, j: (np.bitwise_count(c0[i] ^ c0[j]).astype(np.int64) + np.bitwise_count(c1[i] ^ c1[j]) <= most) & (probe[i] + probe[j] < 2)


def _joined(f: pd.DataFrame) -> Forest:
    forest = Forest(len(f))
    _, first, known = np.unique(f["component"].to_numpy(), return_index=True, return_inverse=True)
    forest.link(np.arange(len(f)), first[known])
    return forest


def _candidates(rows: DataFrame, most: int) -> DataFrame:
    """Of rows in blocks: (a, b), a spanning forest of the close pairs in each pair of blocks, the smallest node as each tree's root."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, group in whole_groups(batches, _KEYS):
            close, forest, node = _close(f, most), Forest(len(f)), f["node"].to_numpy()
            for i, j in pairs_in_groups(group, f["side"].to_numpy()):
                ok = close(i, j) & (node[i] != node[j])
                forest.link(i[ok], j[ok])
            hit = forest.root != np.arange(len(f))
            if hit.any():
                yield pd.DataFrame({"a": node[hit], "b": node[forest.root[hit]]})

    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "node").select(*_KEYS, "side", "probe", "node", "c0", "c1").mapInPandas(near, "a long, b long").where("a <> b").distinct()


def _still_apart(rows: DataFrame, most: int) -> DataFrame:
    """Of rows in blocks with their components: those with a close row of another component in their pair of blocks."""

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, group in whole_groups(batches, _KEYS):
            close, component, hit = _close(f, most), f["component"].to_numpy(), np.zeros(len(f), dtype=bool)
            for i, j in pairs_in_groups(group, f["side"].to_numpy()):
                ok = component[i] != component[j]
                ok[ok] = close(i[ok], j[ok])
                hit[i[ok]] = hit[j[ok]] = True
            if hit.any():
                yield f[hit]

    columns = [*_KEYS, "side", "probe", "node", "component", "c0", "c1"]
    kinds = "part int, key long, lo int, hi int, side int, probe int, node long, component long, c0 long, c1 long"
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS).select(*columns).mapInPandas(apart, kinds)


def _cross(rows: DataFrame, most: int, least: float) -> DataFrame:
    """Of rows in blocks with components and hashes: links a, b between different components that hold exactly."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, group in whole_groups(batches, _KEYS):
            close, forest, node, size = _close(f, most), _joined(f), f["node"].to_numpy(), f["hashes"].map(len).to_numpy()
            sets = [frozenset(x.tolist()) for x in f["hashes"]]
            a, b = [], []
            for i, j in pairs_in_groups(group, f["side"].to_numpy()):
                open_ = (forest.root[i] != forest.root[j]) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9)
                open_[open_] = close(i[open_], j[open_])
                for x, y in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
                    if forest.root[x] != forest.root[y] and _alike(len(sets[x] & sets[y]), size[x], size[y], least):
                        forest.link(np.array([x]), np.array([y]))
                        a.append(node[x])
                        b.append(node[y])
            if a:
                yield pd.DataFrame({"a": a, "b": b})

    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS).select(*_KEYS, "side", "probe", "node", "component", "c0", "c1", "hashes").mapInPandas(link, "a long, b long")


def _probed(nodes: DataFrame, plan: list[tuple[int, int]]) -> DataFrame:
    """Rows (part, key, probe, node, c0, c1): each node in each partition (probe 0), and its variants where the threshold is 1 (probe 1)."""
    out = nodes.select("node", "c0", "c1", F.posexplode("keys").alias("part", "key")).withColumn("probe", F.lit(0))
    some = F.create_map(*[F.lit(x) for i, (w, limit) in enumerate(plan) if limit for x in (i, w)]) if any(e for _, e in plan) else None
    if some is not None:
        wide = out.withColumn("width", F.element_at(some, F.col("part"))).where("width is not null")
        flips = wide.withColumn("bit", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
        out = out.unionByName(flips.withColumns({"key": F.expr("key ^ shiftleft(1L, bit)"), "probe": F.lit(1)}).drop("width", "bit"))
    return out


def _with_hub(edges: DataFrame, hashes: DataFrame) -> DataFrame:
    """edges (a, b) with the hashes of both; the edges of one b meet its hashes in several tasks."""
    hubs = edges.groupBy("b").agg(salts("a").alias("bits")).join(hashes.select(F.col("node").alias("b"), F.col("hashes").alias("others")), "b")
    both = edges.join(hashes.withColumnRenamed("node", "a"), "a").withColumn("part", salt("a"))
    return both.join(hubs.withColumn("part", each_salt("bits")).drop("bits"), ["b", "part"]).drop("part")


def links(nodes: DataFrame, texts: DataFrame, shingle: int, least: float, plan: list[tuple[int, int]], block: int = BLOCK) -> DataFrame:
    """Of nodes (node, keys, c0, c1, one, two), and the texts of rows (one, two): links (a, b), enough to join all candidates whose similarity is least or more."""
    p = differing(least)
    most = math.ceil(CHECKED * p + 4 * math.sqrt(CHECKED * p * (1 - p)))
    probed = _probed(nodes, plan)
    found = written(_candidates(blocks(probed, ["part", "key"], "node", block), most))
    touched = written(found.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    wanted = written(nodes.join(touched, "node").select("node", "one", "two"))
    with small_batches(nodes.sparkSession):
        hashes = written(texts.join(wanted, ["one", "two"]).dropDuplicates(["node"]).select("node", _sets(shingle)("text").alias("hashes")))
    both = _with_hub(found, hashes)
    held = written(both.where(_alike(F.size(F.array_intersect("hashes", "others")), F.size("hashes"), F.size("others"), least)).select("a", "b"))

    joined = written(components(held))
    known = touched.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    rest = _probed(nodes.join(touched, "node"), plan).join(known, "node")
    apart = written(_still_apart(blocks(rest, ["part", "key"], "node", block), most))
    return held.union(_cross(apart.join(hashes, "node"), most, least))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """Rows (group, id, one, two) for the rows of df: the group of near duplicates, the id, and the row's two hashes.

    Words are split at white space and ASCII letters lowered; a text of fewer words than a shingle is one shingle; null,
    empty and other texts without words are one group. Repeated rows give repeated rows; whole texts of any length count;
    columns of df only enter the two hashes, so their names can't clash. An empty table gives an empty table.
    """
    rows = identified(df, id_col, text_col)
    plan = allotted(df.count(), least, miss)
    with small_batches(df.sparkSession):
        slim = written(rows.select("id", "one", "two", _sketches(shingle, plan)("text").alias("s")).select("id", "one", "two", "s.*"))
    nodes = written(slim.groupBy("same").agg(F.min_by(F.struct("one", "two", "keys", "c0", "c1"), F.struct("one", "two")).alias("m"), salts("one").alias("bits")).select("same", "m.*", "bits").withColumn("node", F.monotonically_increasing_id()))
    found = components(links(nodes, rows.select("one", "two", "text"), shingle, least, plan, block))
    groups = nodes.join(found, "node", "left").select("same", F.coalesce("component", "node").alias("group"), each_salt("bits").alias("part"))
    return slim.select("same", "id", "one", "two", salt("one").alias("part")).join(groups, ["same", "part"]).select("group", "id", "one", "two")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """df with exactly one row of each group of near duplicates: that with the smallest id; rows without an id come last."""
    return first_rows(df, near_duplicates(df, id_col, text_col, shingle, least))
