"""Naive Bayes support vectors, whitening and importance resampling against plain versions and held-out rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from factorloom.llm import nbsvm, resampling, whitening


def run(name, spark, folder):
    return [r.asDict() for r in __spark_entry__.queries()[name](spark, folder).collect()]


# --- naive Bayes support vectors


def plain_grams(text):
    """The n-grams of a text as strings."""
    w = (text or "").split()
    forms = [nbsvm.shape(x) if not i or w[i - 1].lower() != x.lower() else "repeats" for i, x in enumerate(w)]
    low = [x.lower() for x in w]
    return {("w", *low[i : i + n]) for n in (1, 2) for i in range(len(w) - n + 1)} | {("s", *forms[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def test_indicators_are_those_of_each_text_alone(awkward):
    texts = [r["text"] for r in awkward.select("text").collect()] + ["a b", "b a", "a  b"]
    got = {}
    for first, doc, bucket in nbsvm.indicators(texts):
        for d, b in zip(doc, bucket, strict=True):
            got.setdefault(first + int(d), []).append(int(b))
    for i, t in enumerate(texts):
        alone = [int(b) for _, _, bucket in nbsvm.indicators([t]) for b in bucket]
        assert got.get(i, []) == alone == sorted(set(alone))
        grams = len(plain_grams(t))
        assert len(alone) <= grams and len(alone) >= grams * (1 - grams / nbsvm.BUCKETS)  # all but some that meet in a bucket
    assert got[len(texts) - 3] == got[len(texts) - 1] != got[len(texts) - 2]


def test_descent_solves_the_dual():
    """No other weights near the found ones lose less."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 6)) for _ in range(60)]
    y = np.where(np.array([r[0] % 3 for r in rows]) > 0, 1.0, -1.0)
    ratio = rng.normal(size=40)
    weight, bias = nbsvm.dual_descent(rows, y, ratio, rounds=2000)

    def loss(w, b):
        x = [ratio[r] / np.linalg.norm(ratio[r]) for r in rows]
        return (w @ w + b * b) / 2 + sum(max(0.0, 1 - s * (v @ w[r] + b)) for r, v, s in zip(rows, x, y, strict=True))

    least = loss(weight, bias)
    for _ in range(300):
        assert loss(weight + rng.normal(size=40) * 0.01, bias + rng.normal() * 0.01) >= least - 1e-3


def test_ratios_count_all_labelled_rows(spark, documents):
    rows = documents.withColumn("mark", F.when(F.col("doc_id") % 7 == 0, 0).when(F.col("doc_id") % 7 < 6, 1))
    model = nbsvm.fit(rows.repartition(5), "text", F.col("mark"), sample_rows=30)
    counts = np.ones((2, nbsvm.BUCKETS))
    for r in rows.where("mark is not null").collect():
        for _, _, bucket in nbsvm.indicators([r["text"]]):
            counts[r["mark"], bucket] += 1
    shares = np.log(counts / counts.sum(axis=1)[:, None])
    assert np.allclose(model.ratio, shares[1] - shares[0], rtol=0, atol=1e-12)
    again = nbsvm.fit(rows.repartition(3), "text", F.col("mark"), sample_rows=30)
    assert np.array_equal(model.weight, again.weight) and model.slope == again.slope


def test_scores_of_awkward_tables(awkward, empty, spark):
    marked = awkward.withColumn("mark", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0))
    model = nbsvm.fit(marked, "text", F.col("mark"))
    out = nbsvm.classify(marked.withColumn("quality_score", F.lit("taken")), model)
    assert out.columns[-1] == "quality_score_" and out.where("quality_score_ between 0 and 1").count() == awkward.count()
    by_text = {}
    for r in out.collect():
        by_text.setdefault(r["text"] or "", set()).add(r["quality_score_"])
    assert all(len(v) == 1 for v in by_text.values())
    assert nbsvm.classify(empty, model).count() == 0
    for rows in (empty.withColumn("mark", F.lit(1)), awkward.withColumn("mark", F.lit(None).cast("int"))):
        assert {r["quality_score"] for r in nbsvm.classify(awkward, nbsvm.fit(rows, "text", F.col("mark"))).collect()} == {0.5}
    one_class = nbsvm.fit(awkward.withColumn("mark", F.lit(1)), "text", F.col("mark"))
    n = awkward.count()
    assert one_class.share == (n + 1) / (n + 2) and set(one_class.scores(["x", None])) == {one_class.share}


def test_held_out_accuracy(spark, sf_dir):
    got = {r["doc_id"]: r for r in run("op11_nbsvm", spark, sf_dir)}
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(got) == docs
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["doc_id"] in docs}
    held = [(got[i]["score"], m) for i, m in marks.items() if got[i]["held_out"]]
    pairs = [(a > b) + (a == b) / 2 for a, m in held if m for b, k in held if not k]
    assert not pairs or np.mean(pairs) >= 0.95
    assert np.mean([(s >= 0.3) == m for s, m in held]) >= 0.85


def test_labels_of_held_out_rows_teach_nothing(spark, tmp_path):
    """Whatever the held-out rows' labels say, no score moves; repeated labels and labels of no document do no harm."""
    docs = [(i, ("good plain words here " if i % 3 else "JUNK!! JUNK!! ### ") * (1 + i % 4)) for i in range(200)]
    at = [str(tmp_path / x) for x in "ab"]
    for k, folder in enumerate(at):
        spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        marks = [(i, int(i % 3 > 0) ^ (k if zlib.crc32(str(i).encode()) % 5 == 0 else 0)) for i in range(150)]
        spark.createDataFrame([*marks, *marks[:9], (9999, 1), (None, 0), (7, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    a, b = ({r["doc_id"]: r["score"] for r in run("op11_nbsvm", spark, folder)} for folder in at)
    assert a == b and all((a[i] >= 0.3) == bool(i % 3) for i in a)


# --- whitening


def test_whitening_against_plain(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(300, 6)) * [3, 2, 1, 1e-1, 5e-2, 1]).astype(np.float32)
    v[:, 5] = v[:, 0]  # a dimension that says nothing new: no component of its own
    rows = [(i, [float(c) for c in x], "l") for i, x in enumerate(v)]
    rows += [rows[3], (None, rows[5][1], None), (901, None, "l"), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], "l"), (903, [float("nan")] * 6, "l"), (904, [float("inf")] * 6, "l"), (905, [1e300] * 6, "l")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = run("op12_whitening", spark, str(tmp_path))
    kept = [r for r in rows if r[1] and None not in r[1] and np.all(np.isfinite(r[1])) and max(map(abs, r[1])) < 2.0**46]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]] for r in kept]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    apart = np.array([[n * c - s for c, s in zip(r, total, strict=True)] for r in x], dtype=np.float64) / n
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    k = int((values > values.sum() * 1e-12).sum())
    assert k == 5 and len(got) == n * k and {r["n"] for r in got} == {n}
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == Counter((r[0], sum((n * c - s) ** 2 for c, s in zip(q, total, strict=True))) for r, q in zip(kept, x, strict=True))
    plain = {r[0]: a @ vectors[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-9)) for r, a in zip(kept, apart, strict=True)}
    for c in range(1, k + 1):
        mine = {r["vec_id"]: r for r in got if r["component"] == c}
        sign = np.sign(mine[0]["whitened"] * plain[0][c - 1])
        assert all(abs(sign * r["whitened"] - plain[i][c - 1]) < 1e-8 for i, r in mine.items())
        assert mine[0]["explained"] == pytest.approx(values[::-1][c - 1] / values.sum(), rel=1e-10)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_of_awkward_tables(spark):
    schema = "vec_id long, embedding array<float>, whitened string"
    none = spark.createDataFrame([], schema)
    assert whitening.whiten(none).count() == 0 and whitening.by_component(whitening.whiten(none)).count() == 0
    alone = spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [], "x"), (3, None, "x")], schema)
    assert [(r["vec_id"], r["deviation"], list(r["whitened"])) for r in whitening.whiten(alone).where("deviation is not null and size(explained) = 0 and vec_id = 1").collect()] == [(1, 0, [])]
    assert whitening.by_component(whitening.whiten(alone)).count() == 0
    two_lengths = spark.createDataFrame([(i, [float(i % 5), float(i % 3)] if i % 2 else [float(i % 7)], "x") for i in range(40)], schema)
    out = whitening.whiten(two_lengths).collect()
    assert len(out) == 40 and {(len(r["whitened"]), r["n"]) for r in out} == {(1, 20), (2, 20)} and all(r["identity_error"] < 1e-9 for r in out)


def test_deviations_stay_exact_beyond_machine_integers():
    x, n = np.array([[2**52, -(2**52)], [1, 5]]), 10**9
    total = [2**52 + 1, 5 - 2**52]
    apart = whitening.deviations(x, n, total)
    assert apart.dtype == object and apart[0, 0] == n * 2**52 - total[0]
    assert whitening.squares(apart) == [None, None] and whitening.squares(np.array([[3, 4]])) == [25]


# --- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_runs(text, longest):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for i in range(len(w)) for n in range(1, longest + 1) if i + n <= len(w)]


def plain_resampling(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    s, t = Counter(), Counter()
    for texts, into in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            into.update(zlib.crc32(f.encode()) % buckets for f in plain_runs(x, longest))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        runs = plain_runs(x, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in runs)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x)), None])
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: len(may) * percent // 100]):
        r[5] = k + 1
    return out


def test_resampling_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in run("op13_importance_resampling", spark, sf_dir))
    assert got == Counter((r[0], r[1], r[2], r[3], r[5]) for r in plain_resampling(docs, target))


@pytest.mark.parametrize("longest", [1, 3])
def test_longer_runs_small_tries_and_awkward_rows(spark, awkward, empty, longest):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    target = spark.createDataFrame([("a b c a", 1), (None, 2), ("näïve text", 3)], "text string, n int")
    totals = resampling.bucket_totals(awkward.repartition(4), "text", longest, nodes=5)
    want = Counter(zlib.crc32(f.encode()) % resampling.BUCKETS for _, t in docs for f in plain_runs(t, longest))
    assert {r["bucket"]: r["n"] for r in totals.collect()} == want
    clash = awkward.withColumn("importance", F.lit(1))
    out = resampling.importance(clash, target, longest=longest)
    assert out.columns[:-1] == clash.columns
    got = Counter((r["doc_id"], r["text"], *r[out.columns[-1]]) for r in out.collect())
    assert got == Counter((r[0], t, r[4], r[1], r[2], r[3]) for r, (_, t) in zip(plain_resampling(docs, [r["text"] for r in target.collect()], longest), docs, strict=True))
    drawn = resampling.resample(clash, target, longest=longest, least_words=2, percent=50)
    want = Counter(r[0] for r in plain_resampling(docs, [r["text"] for r in target.collect()], longest, least=2, percent=50) if r[5])
    assert drawn.columns == clash.columns and Counter(r["doc_id"] for r in drawn.collect()) == want
    assert resampling.resample(empty, target, longest=longest).count() == 0 and resampling.importance(awkward, empty).count() == len(docs)


def test_ranks_over_many_ties(spark):
    rows = [(i if i % 3 else None, 20 + i % 2, 5 if i % 4 else i) for i in range(600)] + [(7, 19, 10**9)]
    scored = spark.createDataFrame(rows, "id long, n_words long, score long").repartition(9)
    got = resampling.ranked(scored, "id", percent=40).collect()
    may = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[2], r[0] is None, r[0] or 0))
    assert Counter((r["id"], r["score"]) for r in got) == Counter((r[0], r[2]) for r in rows)
    told = sorted((r["rank"], r["id"], r["score"]) for r in got if r["rank"])
    assert [r[0] for r in told] == list(range(1, 241)) and [r[1:] for r in told] == [(r[0], r[2]) for r in may[:240]]
