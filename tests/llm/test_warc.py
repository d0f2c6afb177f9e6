"""Archives: round trip, revisits, equal bytes for equal rows."""

from collections import Counter
from pathlib import Path

from factorloom.llm import warc

ROWS = [
    (5, "http://a/1", "<p>é</p>"), (3, "http://a/2", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "http://b\r\n x", ""), (2, "u", None), (7, "u", "x" * 300_000), (8, "u", "own"),
    (8, "u", "own"), (8, "u", "other"), (None, "n", "<p>é</p>"), (None, "n", "only"), (None, "m", "only"), (None, None, None),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS same", "'x' AS kind", "3 AS shard")


def want(rows, least=0):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    n, top, seen, out = Counter(p for _, p in payloads), {}, set(), Counter()
    for i, p in payloads:
        top[p] = max((x for x in (top.get(p), i) if x is not None), default=None)
    for i, p in payloads:
        first = (i, p) not in seen
        seen.add((i, p))
        again = n[p] > 1 and len(p) >= least and not (i == top[p] and first)
        out[i, len(p), warc.digest(p), "revisit" if again else "response", top[p] if again else None] += 1
    return out


def test_round_trip(spark, tmp_path):
    for k, (shards, roll, least) in enumerate(((3, 1 << 30, 0), (1, 200, 0), (5, 1 << 30, 5))):
        out = f"file://{tmp_path}/{k}"
        manifest = warc.write(frame(spark), out, shards=shards, roll_bytes=roll, least_bytes=least)
        got = [tuple(r) for r in warc.read(spark, out).collect()]
        assert Counter((i, size, sha, kind, to) for i, _, kind, to, size, sha, _ in got) == want(ROWS, least)
        assert Counter(bytes(p) for *_, kind, _, _, _, p in got if p is not None) <= Counter((h or "").encode() for _, _, h in ROWS)
        assert manifest.agg({"records": "sum"}).head()[0] == len(ROWS)
        assert {r["file"] for r in manifest.collect()} == {p.name for p in Path(tmp_path / str(k)).glob("*.warc.gz")}
        assert not (tmp_path / str(k) / "_temporary").exists()
        if roll == 200:
            assert manifest.count() > 3


def test_same_rows_same_bytes(spark, tmp_path, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for k, df in enumerate((pages, pages.orderBy("html").repartition(5))):
        warc.write(df, f"file://{tmp_path}/{k}", shards=4, roll_bytes=20_000)
    a, b = ({p.name: p.read_bytes() for p in Path(tmp_path / str(k)).glob("*.warc.gz")} for k in range(2))
    assert a == b and len(a) > 4


def test_one_id_and_long_urls_are_spread(spark, tmp_path):
    rows = [(None if i % 3 else 7, "http://h/" + "y" * (20_000 if i % 50 == 0 else 3), f"page {i} " + "z" * (i % 40)) for i in range(600)]
    out = f"file://{tmp_path}/hot"
    manifest = warc.write(frame(spark, rows), out, shards=6).collect()
    assert len({r["shard"] for r in manifest}) == 6 and max(r["records"] for r in manifest) < 200
    got = warc.read(spark, out).select("id", "url", "payload").collect()
    assert Counter((r["id"], r["url"], bytes(r["payload"]).decode()) for r in got) == Counter(rows)


def test_empty(spark, tmp_path):
    out = f"file://{tmp_path}/none"
    assert warc.write(frame(spark).where("false"), out).count() == 0 and warc.read(spark, out).count() == 0


def test_a_changed_byte_is_found(spark, tmp_path):
    import gzip

    import pytest

    out = f"file://{tmp_path}/bad"
    warc.write(frame(spark, [(1, "u", "payload")]), out, shards=1)
    path = next(Path(tmp_path / "bad").glob("*.warc.gz"))
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"payload\r\n", b"paYload\r\n")))
    with pytest.raises(Exception, match="differs"):
        warc.read(spark, out).collect()
