"""SimHash near duplicates: fingerprints, and links by the generalised pigeonhole principle.

Two fingerprints at a distance of t or less, cut into partitions whose thresholds add up to t - m + 1, are within one
partition's threshold there. Correlated bits share a partition, so that the others tell more. The thresholds follow from a
dynamic programme over estimated candidate counts, which also picks the number of partitions. Probes meet in buckets; a
bucket of any size is cut into blocks and each pair of blocks is verified by itself, so no task holds a whole bucket. A
block pair tells only a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from factorloom.llm.common import components, cut, each_salt, free_name, salt, salts, written

BITS = 64
#: Members of one block of a bucket.
BLOCK = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DRAWN = 16


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, split at white space, ASCII letters lowered."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """The hash of each run of so many words, in order; fewer words are one shingle, none have none."""
    import xxhash

    if not words:
        return np.zeros(0, dtype="<u8")
    joined, ends, n = b" ".join(words), np.cumsum([len(w) + 1 for w in words]), max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter((hash_of(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), dtype="<u8", count=n)


def set_counts(words: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit words, how many rows have each bit: in bytes for 255 rows at a time, which cannot overflow."""
    counts = np.zeros(64 * words.shape[1], dtype=np.int64)
    for at in range(0, len(words), 16 * 255):
        bits = np.unpackbits(words[at : at + 16 * 255].view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            counts += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return counts


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit integer: per bit, whether it is set in over half the shingles' hashes."""
    hashes = shingle_hashes(words_of(text), shingle, seed)
    if not len(hashes):
        return 0
    counts = set_counts(hashes[:, None])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Adds the long column fingerprint_column(df) of each whole text; null and empty texts have 0."""

    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle, seed) for t in texts], dtype="int64")

    return df.withColumn(fingerprint_column(df), of(F.col(f"`{text_col}`").cast("string")))


def fingerprint_column(df: DataFrame) -> str:
    return free_name(df, "fingerprint")


def bit_counts(fps: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """The rows, and for each pair of bits how many rows have both: 64 x 64 numbers, summed over all rows by Spark."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b[column].to_numpy(dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
        yield pd.DataFrame({"bit": range(BITS), "both": [row.astype(np.int64).tolist() for row in total]})

    sums = fps.select(column).mapInPandas(partial, "bit int, both array<bigint>").select("bit", F.posexplode("both").alias("other", "n")).groupBy("bit", "other").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((BITS, BITS))
    both[sums["bit"].to_numpy(dtype=int), sums["other"].to_numpy(dtype=int)] = sums["n"].to_numpy(dtype=float)
    return fps.count(), both


def grouped_bits(rows: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about equal width; each starts from the free bit with most correlation and takes those nearest to it."""
    q = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(q * (1 - q), 1e-12))
    r = np.abs((both / max(rows, 1) - np.outer(q, q)) / np.outer(spread, spread))
    np.fill_diagonal(r, 0)
    free, parts = list(range(BITS)), []
    for k in range(m):
        width = len(free) // (m - k)
        own = [max(free, key=lambda b: (r[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < width:
            nearest = max(free, key=lambda b: (r[b, own].mean(), -b))
            own.append(nearest)
            free.remove(nearest)
        parts.append(sorted(own))
    return parts


def _within(q: np.ndarray, bits: list[int], most: int) -> list[float]:
    """For 0 to most, the chance that two rows differ in so many of the bits at most, bits taken as independent."""
    chance = [1.0]
    for p in (2 * q[b] * (1 - q[b]) for b in bits):
        chance = [(chance[d] if d < len(chance) else 0) * (1 - p) + (chance[d - 1] * p if d else 0) for d in range(len(chance) + 1)]
    return list(np.cumsum(chance)[: most + 1])


def thresholds(rows: int, both: np.ndarray, distance: int, most_parts: int = 8) -> tuple[list[list[int]], list[int]]:
    """The partitions and their thresholds (-1: not probed) that cost least: probe rows plus estimated candidates."""
    q = np.diag(both) / max(rows, 1)
    best = None
    for m in range(1, most_parts + 1):
        parts = grouped_bits(rows, both, m)
        within = [_within(q, bits, distance) for bits in parts]

        def cost(i: int, e: int) -> float:
            if e == 0:
                return 0.0
            probes = sum(math.comb(len(parts[i]), k) for k in range(e)) + (e > 1)  # noqa: B023
            return 20.0 * rows * probes + rows * rows * within[i][min(e, len(within[i])) - 1] / 2  # noqa: B023

        table = {0: (0.0, [])}  # by the sum of threshold + 1 so far
        for i in range(m):
            step: dict[int, tuple[float, list[int]]] = {}
            for total, (c, chosen) in table.items():
                for e in range(distance + 2 - total):
                    if total + e not in step or c + cost(i, e) < step[total + e][0]:
                        step[total + e] = (c + cost(i, e), [*chosen, e - 1])
            table = step
        if distance + 1 in table and (best is None or table[distance + 1][0] < best[0]):
            best = (*table[distance + 1], parts)
    return best[2], best[1]


def _masks(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >= 1 << (BITS - 1) else m


def probes(fps: DataFrame, column: str, parts: list[list[int]], limits: list[int]) -> DataFrame:
    """Rows (part, key, probe, fp): each fingerprint as it stands (probe 0), and where the limit is above 0 also its variants (probe 1)."""
    out = None
    for i, (bits, limit) in enumerate(zip(parts, limits, strict=True)):
        if limit < 0:
            continue
        key = F.col(column).bitwiseAND(F.lit(_masks(bits)))
        flips = [_masks(list(c)) for k in range(1, limit + 1) for c in combinations(bits, k)]
        one = fps.select(F.lit(i).alias("part"), key.alias("key"), F.lit(0).alias("probe"), F.col(column).alias("fp"))
        if flips:
            each = fps.select(key.alias("key"), F.col(column).alias("fp"), F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip"))
            one = one.union(each.select(F.lit(i).alias("part"), F.col("key").bitwiseXOR(F.col("flip")).alias("key"), F.lit(1).alias("probe"), "fp"))
        out = one if out is None else out.union(one)
    return out


def blocks(rows: DataFrame, keys: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """Of rows in buckets named by keys: cuts large buckets into blocks by a hash of value, and gives each row once for each pair of blocks that it belongs to (columns lo and hi; side 0 or 1, 2 where both are one block).

    Which buckets are large, a sixteenth of the rows tells, drawn by the hash of value; there are at most as many as the
    table has blocks, and Spark broadcasts them only where their written size allows. A wrong guess changes balance alone.
    """
    some = rows.where(F.pmod(F.xxhash64(value, F.lit(3)), F.lit(_DRAWN)) == 0)
    large = written(some.groupBy(*keys).agg((F.count("*") * _DRAWN).alias("in_bucket")).where(F.col("in_bucket") > max(block, 4 * _DRAWN)))
    n = F.coalesce(F.ceil(F.col("in_bucket") / block).cast("int"), F.lit(1))
    out = rows.join(large, keys, "left").withColumn("own", F.pmod(F.xxhash64(value, F.lit(1)), n).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    side = F.when(F.col("own") == F.col("other"), F.lit(2)).when(F.col("own") < F.col("other"), F.lit(0)).otherwise(F.lit(1))
    return out.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": side}).drop("own", "other", "in_bucket")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """From sorted batches, frames that end where a group ends, with the number of each row's group."""
    left: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = np.ones(len(b), dtype=bool)
        for k in keys:
            last &= b[k].to_numpy() == b[k].iloc[-1]
        cut_at = len(b) - int(last[::-1].argmin()) if not last.all() else 0
        if cut_at:
            yield _numbered(pd.concat([*left, b.iloc[:cut_at]], ignore_index=True), keys)
            left = []
        elif left and any(left[-1][k].iloc[-1] != b[k].iloc[0] for k in keys):
            yield _numbered(pd.concat(left, ignore_index=True), keys)
            left = []
        left.append(b.iloc[cut_at:])
    if left:
        yield _numbered(pd.concat(left, ignore_index=True), keys)


def _numbered(f: pd.DataFrame, keys: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    new = np.zeros(len(f), dtype=bool)
    for k in keys:
        v = f[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return f, np.cumsum(new)


def pairs_in_groups(group: np.ndarray, side: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of rows in one group that are both of side 2, or of side 0 and 1; some at a time. Groups stand together."""
    n = len(group)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    ends = np.r_[starts[1:], n]
    end_of = np.repeat(ends, ends - starts)
    at = np.arange(n)
    step = 1
    while len(at):
        at = at[at + step < end_of[at]]
        if not len(at):
            return
        for k in range(0, len(at), most):
            i = at[k : k + most]
            j = i + step
            ok = (side[i] == 2) & (side[j] == 2) | (side[i] + side[j] == 1)
            if ok.any():
                yield i[ok], j[ok]
        step += 1


class Forest:
    """Components of rows 0 to n - 1 under links that come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            if not len(i):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def verified(rows: DataFrame, distance: int) -> DataFrame:
    """Rows (part, key, lo, hi, side, probe, fp) to links a, b that join, per block pair, what lies within the distance."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, group in whole_groups(batches, ["part", "key", "lo", "hi"]):
            fp, side, probe = f["fp"].to_numpy(dtype=np.int64).view(np.uint64), f["side"].to_numpy(), f["probe"].to_numpy()
            forest = Forest(len(f))
            for i, j in pairs_in_groups(group, side):
                near = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & ((probe[i] + probe[j] < 2))
                forest.link(i[near], j[near])
            hit = forest.root != np.arange(len(f))
            if hit.any():
                signed = fp.view(np.int64)
                a, b = signed[hit], signed[forest.root[hit]]
                yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    keys = ["part", "key", "lo", "hi"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "side", "probe", "fp").mapInPandas(link, "a long, b long")


def links(fps: DataFrame, column: str, distance: int = 3) -> DataFrame:
    """From distinct fingerprints: links (a, b), enough to join all that lie within the distance of each other."""
    parts, limits = thresholds(*bit_counts(fps, column), distance)
    return verified(blocks(probes(fps, column, parts, limits), ["part", "key"], "fp"), distance)


def _grouped(rows: DataFrame, text_col: str, shingle: int, distance: int) -> DataFrame:
    """rows (id, text_col and others) with fp, component (of fingerprints) and component_id in place of the text."""
    print_ = fingerprint_column(rows)
    rows = cut(fingerprints(rows, text_col, shingle).withColumnRenamed(print_, "fp").drop(text_col))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("first"), salts("id").alias("bits")))
    found = components(links(nodes, "fp", distance)).select(F.col("node").alias("fp"), "component")
    nodes = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    known = nodes.join(firsts, "component").select("fp", "component", "component_id", each_salt("bits").alias("part"))  # copies meet their node in several tasks
    return rows.withColumn("part", salt("id")).join(known, ["fp", "part"]).drop("part")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """Per row of df: the id, its fingerprint (long) and component_id, the smallest id that links reach.

    Equal fingerprints count as one node, so copies never make pairs. Null and empty texts have fingerprint 0 and link with
    each other. Rows without an id take part and belong to a component, but give it no name: it is null if no member has
    an id. Repeated rows give repeated results; an empty table gives an empty table.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return _grouped(rows, "text", shingle, distance).select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def identified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row of df: id, text, and the longs one and two, which together tell apart rows that differ in any column."""
    every = [F.col(f"`{c}`") for c in df.columns]
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(*every).alias("one"), F.xxhash64(F.lit(1), *every).alias("two"))


def first_rows(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Of groups (group, id, one, two) over the rows of df: df with exactly one row of each group, that with the smallest id.

    A null id comes last, the row's hashes decide where an id repeats, and rows that are equal throughout are one.
    """
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "one", "two")).alias("m")).select("m.one", "m.two")
    one, two, rank = (free_name(df, f"row_{x}") for x in ("one", "two", "rank"))
    every = [F.col(f"`{c}`") for c in df.columns]
    out = df.select(*every, F.xxhash64(*every).alias(one), F.xxhash64(F.lit(1), *every).alias(two))
    out = out.join(first.select(F.col("one").alias(one), F.col("two").alias(two)), [one, two], "left_semi")
    return out.withColumn(rank, F.row_number().over(Window.partitionBy(one, two).orderBy(F.lit(0)))).where(F.col(rank) == 1).select(*every)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """df with exactly one row of each group of near duplicates: that with the smallest id; rows without an id come last."""
    groups = _grouped(identified(df, id_col, text_col), "text", shingle, distance)
    return first_rows(df, groups.select(F.col("component").alias("group"), "id", "one", "two"))
