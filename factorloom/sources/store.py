"""A store of panels by year, in Parquet: staged writes, a manifest that swaps years in at once, reads that list only the years asked for.

A year lies in year=Y/version=V. A write goes to a staging folder first; its years are counted and hashed from what was written, moved
beside the old versions, and become visible with the next numbered manifest. A reader follows one manifest, so it sees
the store before a write or after it, never between. Writers that meet are told: the later one's manifest number is taken.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

YEAR, VERSION = "year", "version"


class StoreError(ValueError):
    """A store, or a file from outside, is not what it should be."""


class _Files:
    """The file system that the path names, by Spark's own client, so that any path that Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def names(self, at: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(at))) if self._fs.exists(self._path(at)) else []

    def move(self, a: str, b: str) -> bool:
        self._fs.mkdirs(self._path(b).getParent())
        return not self._fs.exists(self._path(b)) and self._fs.rename(self._path(a), self._path(b))

    def remove(self, at: str) -> None:
        self._fs.delete(self._path(at), True)

    def put(self, at: str, text: str) -> None:
        out = self._fs.create(self._path(at), True)
        out.write(bytearray(text.encode()))
        out.close()

    def get(self, at: str) -> str:
        stream = self._fs.open(self._path(at))
        try:
            return bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()


def _measured(df: DataFrame) -> dict[int, tuple[int, str]]:
    """By year, the rows and a hash of all columns that the rows' order doesn't change."""
    own = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    high = F.shiftright(own, 20)  # so that sums don't overflow
    found = df.select(YEAR, own.alias("own"), high.alias("high")).groupBy(YEAR).agg(F.count("*").alias("n"), F.bit_xor("own").alias("x"), F.sum("high").alias("s"))
    return {int(r[YEAR]): (r["n"], f"{r['x'] & (2**64 - 1):016x}{r['s'] & (2**64 - 1):016x}") for r in found.collect()}  # one row a year


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    @property
    def _files(self) -> _Files:
        return _Files(self.spark, self.root)

    def manifest(self) -> dict:
        """The newest: its number, the schema, and by year the version, rows and hash. An empty store has number 0 and no years."""
        names = [n for n in self._files.names(self.root) if n.startswith("manifest-")]
        return json.loads(self._files.get(f"{self.root}/{names[-1]}")) if names else {"number": 0, "schema": None, "years": {}}

    def write(self, df: DataFrame, year: str) -> dict:
        """Puts in the years that df has, each whole in place of what the store had of it; other years stay. year names the column that tells them, which is kept. Rows without a year, another schema than the store's, and a column called version are errors."""
        if VERSION in df.columns or (YEAR in df.columns and year != YEAR):
            raise StoreError("columns called year and version belong to the store")
        files, before = self._files, self.manifest()
        schema = json.loads(df.drop(YEAR).schema.json())
        names = [(f["name"], f["type"]) for f in schema["fields"]]
        if before["schema"] is not None and names != [(f["name"], f["type"]) for f in before["schema"]["fields"]]:
            raise StoreError("the rows' schema is not the store's")
        version, staged = uuid.uuid4().hex, f"{self.root}/_staged-{uuid.uuid4().hex}"
        rows = df.withColumn(YEAR, F.col(f"`{year}`").cast("int"))
        rows.repartition(YEAR, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(8))).write.partitionBy(YEAR).parquet(staged)
        try:
            folders = [n for n in files.names(staged) if not n.startswith(("_", "."))]
            if any(not n.removeprefix(f"{YEAR}=").lstrip("-").isdigit() for n in folders if n.startswith(YEAR)):
                raise StoreError("rows without a year")
            told = _measured(self.spark.read.schema(self._schema(schema)).option("basePath", staged).parquet(staged)) if any(n.startswith(YEAR) for n in folders) else {}
            for y in told:
                if not files.move(f"{staged}/{YEAR}={y}", f"{self.root}/{YEAR}={y}/{VERSION}={version}"):
                    raise StoreError(f"year {y} could not be moved")
        finally:
            files.remove(staged)
        years = before["years"] | {str(y): {"version": version, "rows": n, "hash": h} for y, (n, h) in told.items()}
        after = {"number": before["number"] + 1, "schema": schema, "years": dict(sorted(years.items(), key=lambda x: int(x[0])))}
        self._commit(files, after)
        return after

    def _commit(self, files: _Files, manifest: dict) -> None:
        name = f"{self.root}/_manifest-{uuid.uuid4().hex}"
        files.put(name, json.dumps(manifest, indent=1))
        if not files.move(name, f"{self.root}/manifest-{manifest['number']:08}"):
            files.remove(name)
            raise StoreError("another write was first; write again")

    @staticmethod
    def _schema(schema: dict) -> T.StructType:
        return T.StructType([*T.StructType.fromJson(schema).fields, T.StructField(YEAR, T.IntegerType())])

    def read(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """The rows of the years from first to last, with the column year. Only their folders are listed; filters on year prune further."""
        m = self.manifest()
        if m["schema"] is None:
            raise StoreError(f"nothing was written to {self.root}")
        some = {int(y): v for y, v in m["years"].items() if (first is None or int(y) >= first) and (last is None or int(y) <= last)}
        if not some:
            return self.spark.createDataFrame([], self._schema(m["schema"]))
        schema = T.StructType([*self._schema(m["schema"]).fields, T.StructField(VERSION, T.StringType())])
        paths = [f"{self.root}/{YEAR}={y}/{VERSION}={v['version']}" for y, v in some.items()]
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*paths).drop(VERSION)

    def verify(self) -> list[int]:
        """The years whose rows are not what the manifest says."""
        m = self.manifest()
        if not m["years"]:
            return []
        told = _measured(self.read())
        return [int(y) for y, v in m["years"].items() if told.get(int(y)) != (v["rows"], v["hash"])]

    def vacuum(self) -> int:
        """Removes versions that the newest manifest doesn't name, and says how many; for when no reader is at an older one."""
        files, known, gone = self._files, {y: v["version"] for y, v in self.manifest()["years"].items()}, 0
        for folder in files.names(self.root):
            if folder.startswith(f"{YEAR}="):
                for version in files.names(f"{self.root}/{folder}"):
                    if version != f"{VERSION}={known.get(folder.removeprefix(f'{YEAR}='))}":
                        files.remove(f"{self.root}/{folder}/{version}")
                        gone += 1
        return gone


def write_result(df: DataFrame, at: str, kind: str = "parquet") -> None:
    """A result as Parquet, or as CSV with a header, at a path that must not exist: written beside it and moved there whole."""
    if kind not in ("parquet", "csv"):
        raise StoreError(f"a result is parquet or csv, not {kind!r}")
    files, staged = _Files(df.sparkSession, at), f"{at}.staged-{uuid.uuid4().hex}"
    writer = df.write.option("header", True) if kind == "csv" else df.write
    writer.format(kind).save(staged)
    if not files.move(staged, at):
        files.remove(staged)
        raise StoreError(f"{at} is there already")


def read_external(spark: SparkSession, at: str, schema: T.StructType | str) -> DataFrame:
    """A user's CSV (with a header) or Parquet, by the path's ending, in the schema's columns and types; a missing column or a value that doesn't fit is an error."""
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    kind = "csv" if at.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet"
    raw = spark.read.option("header", True).csv(at) if kind == "csv" else spark.read.parquet(at)
    missing = [f.name for f in want if f.name not in raw.columns]
    if missing:
        raise StoreError(f"{at} lacks {missing}")
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want])
