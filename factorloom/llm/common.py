"""Shared by the operators: tables, cut lineage, words, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where none is named, a new temporary folder serves a local master; a cluster is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder, so that lost executors cost one read and no plan runs twice."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder. Unlike cut, the optimizer keeps nothing of the plan that made them: over many rounds, the constraints that it infers would grow without end."""
    at = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """What runs within sends Python workers so many rows at a time at most: whole texts and what is made of them take much more memory there than in Spark."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def settled(condition: Column) -> Column:
    """The condition, as a column value that the optimizer won't replace by its definition in a filter above, which would repeat long expressions."""
    return condition & (F.monotonically_increasing_id() >= 0)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: The parts that the rows of one key are dealt to at most where they meet what is known of the key.
SALTS = 63


def salt(*values: str) -> Column:
    """The part of a key's rows that a row belongs to."""
    return F.pmod(F.xxhash64(*values, F.lit(2)), F.lit(SALTS)).cast("int")


def salts(*values: str) -> Column:
    """An aggregate: the parts that the rows of a key have, as bits of one number."""
    return F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(f'`{v}`' for v in values)}, 2), {SALTS}) as int))"))


def each_salt(bits: str) -> Column:
    """A row for each part that the bits name."""
    return F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> shiftright({bits}, s) & 1 = 1)"))


def beside(rows: DataFrame, keys: list[str], value: str, having: str = "true", **aggregates: Column) -> DataFrame:
    """rows with aggregates over all rows of their keys, where these hold. Rows of one key meet them in up to SALTS tasks, dealt by value, so that a key with very many rows is no single task's work."""
    part, bits = free_name(rows, "part_of_key"), free_name(rows, "parts_of_key")
    known = rows.groupBy(*keys).agg(*[v.alias(k) for k, v in aggregates.items()], salts(value).alias(bits)).where(having)
    known = known.withColumn(part, each_salt(bits)).drop(bits)
    return rows.withColumn(part, salt(value)).join(known, [*keys, part]).drop(part)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: two columns a and b of one orderable type, no nulls; loops and repeats do no harm. Returns node and component
    (the smallest node reachable) for every node that occurs in an edge with another node. Each step takes minima with
    partial aggregation; a hub's edges meet its minimum in several tasks, so a hub with very many edges is never gathered
    in one. Rounds grow with the logarithm of the longest path, and each round's edges are written.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = beside(both, ["u"], "v", m=F.min("v")).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = beside(large, ["u"], "v", m=F.min("v")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.u", "e.v").where("u <> v").distinct())
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(hash(u, v))")).head()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
