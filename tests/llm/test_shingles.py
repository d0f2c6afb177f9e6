"""Near duplicates by shingles against brute force, and one row of each group."""

import random
from collections import defaultdict

import corpus_pipeline as cp
from plain import words

from factorloom.llm import shingles, simhash


def shingle_set(text, k=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, least=0.8):
    """The group of each text, as its first member's index, and the pairs that make the groups."""
    sets, root, pairs = [shingle_set(t) for t in texts], list(range(len(texts))), []
    by, where = defaultdict(set), lambda k: k if root[k] == k else where(root[k])
    for k, s in enumerate(sets):
        for x in s or {""}:
            by[x].add(k)
    for i, s in enumerate(sets):
        for j in {j for x in s or {""} for j in by[x] if j < i}:
            both = len(s & sets[j])
            if both >= least * len(s | sets[j]):
                pairs.append((j, i, both / max(1, len(s | sets[j]))))
                a, b = sorted((where(i), where(j)))
                root[b] = a
    return [where(k) for k in range(len(texts))], pairs


def changed(rng, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def planted(seed=1, n=120):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 120, 400])))
        texts += [base, *[changed(rng, base, max(1, round(len(base.split()) * rng.choice([0.005, 0.015, 0.02, 0.025, 0.03, 0.08])))) for _ in range(rng.randrange(4))]]
    rng.shuffle(texts)
    return texts


def test_near_dedup_is_by_similarity(spark):
    texts = planted()
    group, pairs = brute(texts)
    assert sum(s < 0.85 for *_, s in pairs) > 20
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in cp.near_dedup(spark, docs, "").collect()) == sorted(set(group))


def test_recall_over_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.where("doc_id is not null").select("doc_id", "text").orderBy("doc_id").collect()]
    group, _ = brute([t for _, t in rows])
    assert sorted(r["doc_id"] for r in shingles.deduplicate(documents).collect()) == [rows[k][0] for k in sorted(set(group))]


def test_chains_in_one_bucket_and_blocks(spark):
    """A large group whose members are near their neighbours only, in blocks of any size."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(150))]
    for _ in range(60):
        texts.append(changed(rng, texts[-1], 2))
    texts += [changed(rng, texts[0], 15) for _ in range(40)]
    group, _ = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (7, 1024):
        got = {r["id"]: r["group"] for r in shingles.near_duplicates(df, block=block).collect()}
        assert len({(got[k], group[k]) for k in range(len(texts))}) == len(set(got.values())) == len(set(group))


def test_rows_without_id_stay(spark):
    """Distinct texts without an id all stay, and so do different texts of one id; copies still shrink to one."""
    text = lambda k: " ".join(f"t{k}x{j}" for j in range(40))
    rows = [(None, text(k)) for k in range(5)] + [(None, text(0)), (7, text(10)), (7, text(11)), (8, text(12)), (None, text(12)), (9, text(12)), (8, text(12)), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS one", "1 AS id")
    want = sorted([(None, text(k)) for k in range(5)] + [(7, text(10)), (7, text(11)), (8, text(12))], key=str)
    for f in (simhash.deduplicate, shingles.deduplicate):
        got = f(df)
        assert got.columns == df.columns
        out = [(r["doc_id"], r["text"]) for r in got.collect()]
        assert sorted([x for x in out if x[1]], key=str) == want and len(out) == len(want) + 1
    assert shingles.deduplicate(df.where("false")).count() == 0


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """Before, fingerprints and hash sets were made of 10,000 whole texts at a time, as Python numbers, and an executor took more than 3,000 MB."""
    from factorloom.llm import shingles

    name, seen, written = "spark.sql.execution.arrow.maxRecordsPerBatch", [], shingles.written
    before = spark.conf.get(name)

    def told(df):
        if "ArrowEvalPython" in df._jdf.queryExecution().optimizedPlan().toString():
            seen.append(int(spark.conf.get(name)))
        return written(df)

    monkeypatch.setattr(shingles, "written", told)
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(40)) + (" x" if k else "")) for k in range(2)], "doc_id long, text string")
    assert shingles.deduplicate(docs).count() == 1
    assert len(seen) == 2 and max(seen) <= 256 and spark.conf.get(name) == before
