"""Sharding by Karmarkar-Karp differencing: equal texts stay together, shards get nearly equal bytes.

Every group of equal texts is an item of the differencing. Items are dealt by hash to as many bins as there are ITEMS of
them; a task differences its bin down to one partial partition, and the partial partitions, which have a spread like any
item, are differenced in turn, level by level, until one is left. Each level has an ITEMS-th of the rows before, so nothing
comes to the driver and no task gets more than a bin.

Joining two partial partitions oppositely ordered never gives more spread than the larger of the two had. So however the
items are dealt, the heaviest shard exceeds the lightest by the bytes of the largest group at most; usually by a few bytes.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import cut, each_salt, free_name, salt, salts

#: Items of one bin, about.
ITEMS = 8_192


def differencing(loads: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """For each partial partition (its loads, largest first), the final place of each of its loads; place 0 is the heaviest.

    The two with the largest spread join oppositely ordered, until one is left; of equal spreads the one that came first.
    """
    n = len(loads)
    if not n:
        return []
    shards, loads = len(loads[0]), list(loads)
    parts: list[tuple | None] = [None] * n  # for a joined partition: its two parts and the place of each part's loads
    heap = [(x[-1] - x[0], i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = loads[a], loads[b]
        sums = [x[k] + y[shards - 1 - k] for k in range(shards)]
        order = sorted(range(shards), key=lambda k: -sums[k])
        place = [0] * shards
        for new, k in enumerate(order):
            place[k] = new
        loads.append(tuple(sums[k] for k in order))
        loads[a] = loads[b] = ()
        parts.append((a, b, place))
        heapq.heappush(heap, (loads[-1][-1] - loads[-1][0], len(loads) - 1))
    found: list[tuple[int, ...]] = [()] * n
    todo = [(heap[0][1], tuple(range(shards)))]
    while todo:
        i, final = todo.pop()
        if parts[i] is None:
            found[i] = final
            continue
        a, b, place = parts[i]
        todo.append((a, tuple(final[place[k]] for k in range(shards))))
        todo.append((b, tuple(final[place[shards - 1 - k]] for k in range(shards))))
    return found


def _level(items: DataFrame, shards: int, bins: int) -> DataFrame:
    """Of items (item, loads): rows (item, bin, places, sums), each item's places in its bin's partial partition, whose loads stand once, beside the bin's first item."""

    def difference(f: pd.DataFrame) -> pd.DataFrame:
        f = f.iloc[np.lexsort((f["item"], -f["loads"].map(sum)))].reset_index(drop=True)
        loads = [tuple(x.tolist()) for x in f["loads"]]
        places = differencing(loads)
        sums = np.zeros(shards, dtype=np.int64)
        np.add.at(sums, np.array(places).ravel(), np.array(loads).ravel())
        return pd.DataFrame({"item": f["item"], "bin": f["bin"], "places": [list(p) for p in places], "sums": [sums.tolist()] + [None] * (len(f) - 1)})

    dealt = items.select("item", "loads", F.pmod(F.xxhash64("item", F.lit("bin")), F.lit(bins)).alias("bin"))
    return cut(dealt.groupBy("bin").applyInPandas(difference, "item long, bin long, places array<int>, sums array<bigint>"))


def places(groups: DataFrame, shards: int, items: int = ITEMS) -> DataFrame:
    """Of groups (item, bytes), as many as there may be: rows (item, shard)."""
    zeros = F.array_repeat(F.lit(0).cast("long"), shards - 1)
    level, count, levels = groups.select("item", F.concat(F.array("bytes"), zeros).alias("loads")), groups.count(), []
    while True:
        bins = math.ceil(count / items) if count > items else 1
        levels.append(_level(level, shards, bins))
        if bins == 1:
            break
        level = levels[-1].where("sums is not null").select(F.col("bin").alias("item"), F.col("sums").alias("told"))
        level = level.select("item", F.reverse(F.array_sort("told")).alias("loads"))
        count = level.count()
    out = levels[0].select("item", "bin", F.element_at("places", 1).alias("at"))  # a group's bytes are the first of its loads
    for upper in levels[1:]:
        up = upper.select(F.col("item").alias("bin"), F.col("bin").alias("next"), "places")
        out = out.join(up, "bin").select("item", F.col("next").alias("bin"), F.element_at("places", F.col("at") + 1).alias("at"))
    return out.select("item", F.col("at").alias("shard"))


def assign(df: DataFrame, group: Column, size: Column, order: Column, shards: int = 8, items: int = ITEMS) -> DataFrame:
    """Adds the struct column shard_column(df): shard and slot (its number in the shard, without gaps, from 0).

    Rows with equal group stay together; null is a group too. Slots follow a hash of order and group, numbered over about
    the square root of the table's rows in buckets of as many rows, so rows without an order, or with equal ones, are spread
    as well. Items of equal bytes go by the hash of their group, so reruns agree. A group larger than a shard's share fills
    its shard alone as far as it can. Equal rows take neighbouring slots in any order. Texts of any length count by size
    alone. An empty table gives an empty table; no column of df can clash, because work columns take free names.
    """
    n = {k: free_name(df, f"shard_{k}") for k in ("group", "size", "part", "order", "bucket", "shard", "before")}
    rows = df.withColumns({n["group"]: F.xxhash64(group), n["size"]: size.cast("long")}).withColumn(n["order"], F.xxhash64(order, n["group"]))
    groups = cut(rows.groupBy(F.col(n["group"]).alias("item")).agg(F.sum(n["size"]).alias("bytes"), F.count("*").alias("n"), salts(n["order"]).alias("bits")))
    count = groups.agg(F.sum("n")).head()[0]
    known = places(groups, shards, items).join(groups, "item").select(F.col("item").alias(n["group"]), F.col("shard").alias(n["shard"]), each_salt("bits").alias(n["part"]))
    out = rows.withColumn(n["part"], salt(n["order"])).join(known, [n["group"], n["part"]])
    name = shard_column(df)
    bits = min(31, math.ceil(math.log2(max(1, count or 0)) / 2))
    out = out.withColumn(n["bucket"], F.shiftrightunsigned(F.col(n["order"]), 64 - bits) if bits else F.lit(0).cast("long"))
    counts = out.groupBy(n["shard"], n["bucket"]).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(n["shard"]).orderBy(n["bucket"]).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(n["shard"], n["bucket"], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(n["before"]))
    own = Window.partitionBy(n["shard"], n["bucket"]).orderBy(n["order"], n["size"])
    out = out.join(counts, [n["shard"], n["bucket"]]).withColumn(name, F.struct(F.col(n["shard"]).alias("shard"), (F.col(n["before"]) + F.row_number().over(own) - 1).cast("long").alias("slot")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], name)


def shard_column(df: DataFrame) -> str:
    return free_name(df, "sharded")
