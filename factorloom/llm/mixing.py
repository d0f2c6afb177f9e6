"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's exact budget.

Every document gets a random but repeatable key from its id. The keys' range is cut into about as many equal buckets as a
bucket has rows (the square root of the table's rows), and keys are uniform. Prefix sums then take two levels, both that
size: running sums by source over its buckets, and a window within each source's bucket. So a source with a third of all
rows is spread over as many tasks as there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import free_name, words

#: Weights by rank of the source, repeated; a source is used this many times at most.
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """From rows (source_null, source_key, source_size), one for each source, adds its target and its budget in whole words.

    Targets share the sum of all sizes by weight; those over most_epochs times their size stop there, and the rest is
    shared again. The fixed point has a closed form: in the order of limit by weight, the limited sources are a prefix.
    The windows without partitions see one row for each source.
    """
    by_name = Window.orderBy("source_null", "source_key")
    by_ratio = Window.orderBy("ratio", "source_null", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    out = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    out = out.withColumn("limit", (F.lit(most_epochs) * F.col("source_size")).cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("limit").over(by_ratio), zero)
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), zero))
    out = out.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    out = out.withColumn("target", F.least(F.col("weight") * F.coalesce("level", zero), F.col("limit")))
    return out.withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, text_col: str = "text", seed: str = "mix") -> DataFrame:
    """Adds the struct column mix_column(df): size, source_size, target and taken (words that the mix takes, repeats counted).

    A document is taken whole as often as its source's budget holds the whole source; of what is left, documents take their
    words in the order of their keys until the budget is met, so at most one document of a source is cut. Null sources are
    one source, after all others; null and empty texts have size 0 and take nothing; rows with equal ids stand next to
    each other in the order, by size and then by a hash of all their columns, and equal rows are taken one after the other. An empty table gives an empty table.
    """
    size = F.size(words(F.col(f"`{text_col}`"))).cast("long") if size is None else size
    n = {k: free_name(df, f"mix_{k}") for k in ("size", "key", "bucket", "none", "source", "row")}
    bits = min(31, math.ceil(math.log2(max(1, df.count())) / 2))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))))
    rows = df.withColumns({n["size"]: size, n["key"]: key, n["none"]: F.col(f"`{source_col}`").isNull(), n["source"]: F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))})
    rows = rows.withColumn(n["row"], F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))  # settles equal keys: reruns agree
    rows = rows.withColumn(n["bucket"], F.shiftright(F.conv(F.substring(n["key"], 1, 8), 16, 10).cast("long"), 32 - bits))
    at = [n["none"], n["source"]]
    sums = rows.groupBy(*at, n["bucket"]).agg(F.sum(n["size"]).alias("s"))
    totals = targets(sums.groupBy(F.col(n["none"]).alias("source_null"), F.col(n["source"]).alias("source_key")).agg(F.sum("s").alias("source_size")))
    earlier = Window.partitionBy(*at).orderBy(n["bucket"]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(earlier), F.lit(0)))
    share = sums.join(totals, (sums[n["none"]] == totals["source_null"]) & (sums[n["source"]] == totals["source_key"]))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long"))
    name = mix_column(df)
    share = share.select(*at, n["bucket"], F.struct("before", "source_size", "target", "budget", epochs.alias("epochs")).alias(name))
    own = Window.partitionBy(*at, n["bucket"]).orderBy(n["key"], n["size"], n["row"]).rowsBetween(Window.unboundedPreceding, -1)
    m = F.col(name)
    out = rows.join(share, [*at, n["bucket"]])
    before = m["before"] + F.coalesce(F.sum(n["size"]).over(own), F.lit(0))
    rest = m["budget"] - m["epochs"] * m["source_size"] - before
    taken = m["epochs"] * F.col(n["size"]) + F.greatest(F.lit(0).cast("long"), F.least(F.col(n["size"]), rest))
    out = out.withColumn(name, F.struct(F.col(n["size"]).alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), taken.alias("taken")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], name)


def mix_column(df: DataFrame) -> str:
    return free_name(df, "mixed")


def materialise(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The mix itself: a row for each whole use of a document, and for the document that a budget cuts, its first words, joined by spaces."""
    name = mix_column(df)
    m, text = F.col(name), F.col(f"`{text_col}`")
    part = free_name(df, "mix_part")
    uses = F.concat(F.array_repeat(F.lit(0).cast("long"), F.expr(f"cast(`{name}`.taken div `{name}`.size as int)")), F.when(F.expr(f"`{name}`.taken % `{name}`.size") > 0, F.array(F.expr(f"`{name}`.taken % `{name}`.size"))).otherwise(F.array().cast("array<bigint>")))
    out = mix(df, id_col, source_col, text_col=text_col).where(m["taken"] > 0).withColumn(part, F.explode(uses))
    cut_text = F.array_join(F.slice(words(text), 1, F.greatest(F.col(part), F.lit(1)).cast("int")), " ")
    out = out.withColumn(text_col, F.when(F.col(part) > 0, cut_text).otherwise(text))
    if chars_col and chars_col in df.columns:
        kind = dict(df.dtypes)[chars_col]
        out = out.withColumn(chars_col, F.when(F.col(part) > 0, F.length(text).cast(kind)).otherwise(F.col(chars_col)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
