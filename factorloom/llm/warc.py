"""WARC archives: a deterministic sharded writer and a reader that checks digests.

Records are range-sorted by id, and by payload where ids repeat or are null. Shard bounds cut a sample, which a hash of
those draws, into equal bytes, so they depend on the rows alone, not on how they are dealt out. A task writes one shard: record by record into a file with a
temporary name, which takes its final name when it is full (by compressed size) or the shard ends. A task that runs again
writes the same bytes to the same names. Last, the list of files becomes the manifest, also by renaming; readers see only
what it lists.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import beside

#: Fixed values of the format.
VERSION, CRLF = b"WARC/1.0", b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ROLL_BYTES = 1 << 30
SHARD_BYTES = 1 << 28
#: Rows that the bounds are drawn from, for each shard; the driver sees no others.
SAMPLE_PER_SHARD = 50
#: What a record takes besides its payload, about.
_HEAD_BYTES = 500
DATE = "2000-01-01T00:00:00Z"
_MANIFEST = "file string, shard long, records long, bytes long, first long, last long"
_RECORD = "id long, url string, type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def _member(kind: str, key: str, fields: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    """One record with regenerated headers, as a gzip member without a time stamp."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(key)), ("WARC-Date", date), *fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    raw = VERSION + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in head) + CRLF + block + CRLF + CRLF
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _line(text: str) -> str:
    """A header value: what would end its line is escaped."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in text or "\n" in text else text


def _fs(uri: str):
    """The file system of a URI, which driver and executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":", "://", 1))


class _Shard:
    """The files of one shard."""

    def __init__(self, out: str, shard: int, roll: int, date: str):
        self.fs, self.root = _fs(out)
        self.shard, self.roll, self.date, self.seq, self.file = shard, roll, date, 0, None

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.seq:04d}.warc.gz"
        self.seq += 1
        self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.file = self.fs.open_output_stream(self.temporary)
        self.records, self.bytes, self.first, self.last = 0, 0, None, None
        self._put(_member("warcinfo", self.name, [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n", self.date))

    def _put(self, member: bytes) -> None:
        self.file.write(member)
        self.bytes += len(member)

    def add(self, row: int | None, member: bytes) -> dict | None:
        if self.file is None:
            self._open()
        self._put(member)
        self.records += 1
        self.first = row if self.records == 1 else self.first
        self.last = row
        return self.close() if self.bytes >= self.roll else None

    def close(self) -> dict | None:
        if self.file is None:
            return None
        self.file.close()
        self.file = None
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        return {"file": self.name, "shard": self.shard, "records": self.records, "bytes": self.bytes, "first": self.first, "last": self.last}


def _writer(out: str, roll: int, date: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, group, refers, told, again = None, None, None, False, 0
        done: list[dict | None] = []
        for b in batches:
            for number, no_id, row, same, kind, to, no_to, url, html in zip(b["shard"], b["no_id"], b["id"], b["same"], b["kind"], b["refers_to"], b["no_to"], b["url"], b["html"], strict=True):
                row, key = None if no_id else int(row), (bool(no_id), row, same)
                if key != group:
                    group, refers, told, again = key, None, False, 0
                if kind == 0:
                    refers, told = None if no_to else int(to), True
                    continue
                if shard is None or shard.shard != number:
                    done.append(shard.close() if shard else None)
                    shard = _Shard(out, int(number), roll, date)
                payload = b"" if html is None else html.encode("utf-8", "replace")
                sha = digest(payload)
                fields = [("WARC-Target-URI", _line(url))] if url is not None else []
                fields += [("X-Row", str(row))] if row is not None else []
                fields += [("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
                http = HTTP % len(payload)
                if told and (refers != row or again):
                    fields += [("WARC-Refers-To", _record_id(f"{refers} {sha} 0")), ("WARC-Profile", REVISIT_PROFILE)] + ([("X-Refers-To-Row", str(refers))] if refers is not None else [])
                    member = _member("revisit", f"{row} {sha} {again}", fields, http, date)
                else:
                    member = _member("response", f"{row} {sha} {again}", fields, http + payload, date)
                again += 1
                done.append(shard.add(row, member))
        done.append(shard.close() if shard else None)
        rows = [x for x in done if x]
        if rows:
            yield pd.DataFrame(rows).astype({"first": "Int64", "last": "Int64"})

    return write


def _bounds(sample: DataFrame, shards: int) -> list[tuple[bool, int, str]]:
    """Keys (has an id, id, payload's hash) that cut the sample (id, same, bytes) into shards of equal bytes; rows without an id come first."""
    drawn = sorted(((r["id"] is not None, r["id"] or 0, r["same"]), r["bytes"]) for r in sample.collect())
    sums = np.cumsum([n for _, n in drawn])
    cuts = np.searchsorted(sums, [sums[-1] * k / shards for k in range(1, shards)]) if drawn else []
    return sorted({drawn[i][0] for i in cuts})


def write(df: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shards: int | None = None, roll_bytes: int = ROLL_BYTES, least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Writes a record per row of df to the shared folder out (a URI), and returns the manifest.

    Of rows with equal payloads of at least least_bytes, that with the largest id is a response and the others revisit it;
    of equal rows the first is the response. Null payloads are empty; null URLs have no target field; rows without an id
    come first, and revisit what has one; a URL of any length is one line of the header, and names of other columns cannot clash. shards, if not given, is the session's number of shuffle partitions, or more for
    much data. An empty table gives a manifest without rows. Files appear under their names only when whole.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    rows = rows.withColumn("same", F.sha2(F.coalesce("html", F.lit("")), 256))
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length("html"))).head()
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size or 0) / SHARD_BYTES))
    some = rows.where(F.pmod(F.xxhash64("id", "same"), F.lit(max(1, count // (SAMPLE_PER_SHARD * shards)))) == 0)
    bounds = _bounds(some.groupBy("id", "same").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + _HEAD_BYTES).alias("bytes")), shards)

    @F.pandas_udf("int")
    def shard_of(no_id: pd.Series, ids: pd.Series, same: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, (not n, int(i), x)) for n, i, x in zip(no_id, ids, same, strict=True)], dtype="int32")

    keys = rows.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes).groupBy("id", "same").agg(F.count("*").alias("n"))
    told = beside(keys, ["same"], "id", "in_group > 1", refers_to=F.max("id"), in_group=F.sum("n")).select("id", "same", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    each = told.unionByName(rows.select("id", "same", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "html"))
    each = each.select(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), "same", "kind", F.coalesce("refers_to", F.lit(0)).alias("refers_to"), F.col("refers_to").isNull().alias("no_to"), "url", "html")
    each = each.withColumn("shard", shard_of("no_id", "id", "same"))
    order = ["shard", F.col("no_id").desc(), "id", "same", "kind", "url"]
    files = each.repartitionById(shards, "shard").sortWithinPartitions(*order).mapInPandas(_writer(out, roll_bytes, date), _MANIFEST)
    files.write.mode("overwrite").parquet(f"{out}/_temporary/manifest")
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(f"{out}/manifest")
    hadoop = at.getFileSystem(spark._jsc.hadoopConfiguration())
    hadoop.delete(at, True)
    if not hadoop.rename(path(f"{out}/_temporary/manifest"), at):
        raise OSError(f"the manifest could not be renamed in {out}")
    hadoop.delete(path(f"{out}/_temporary"), True)
    return spark.read.schema(_MANIFEST).parquet(f"{out}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and blocks of a stream of gzip members."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if line == CRLF:
                continue
            if line.strip() != VERSION:
                raise ValueError(f"not a record: {line[:40]!r}")
            head = {}
            while (line := f.readline()) != CRLF:
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[name] = value
            yield head, f.read(int(head["Content-Length"]))


def _reader(out: str, batch_bytes: int):
    def parse(head: dict[str, str], block: bytes) -> tuple:
        if f"sha1:{digest(block)}" != head["WARC-Block-Digest"]:
            raise ValueError(f"{head['WARC-Record-ID']}: its block's digest differs")
        http, _, payload = block.partition(CRLF + CRLF)
        size = next(int(x.split(b":")[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:"))
        sha, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
        if kind == "response" and (digest(payload) != sha or len(payload) != size):
            raise ValueError(f"{head['WARC-Record-ID']}: its payload differs")
        number = lambda k: int(head[k]) if k in head else None
        return number("X-Row"), head.get("WARC-Target-URI"), kind, number("X-Refers-To-Row"), size, sha, payload if kind == "response" else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "url", "type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"id": "Int64", "refers_to": "Int64"})
        for b in batches:
            for name in b["file"]:
                fs, root = _fs(out)
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for head, block in records(f):
                        if head["WARC-Type"] != "warcinfo":
                            rows.append(parse(head, block))
                            size += len(block) + 500
                        if size >= batch_bytes:
                            yield frame(rows)
                            rows, size = [], 0
                if rows:
                    yield frame(rows)

    return read


def read(spark: SparkSession, out: str, batch_bytes: int = 1 << 23) -> DataFrame:
    """The records of the files that the manifest in out lists: id, url, type, refers_to, payload_bytes, payload_digest, payload (null for revisits). Digests are checked."""
    files = spark.read.schema(_MANIFEST).parquet(f"{out}/manifest").select("file", "shard")
    n = max(1, min(files.count(), 10 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return files.repartition(n).mapInPandas(_reader(out, batch_bytes), _RECORD)
