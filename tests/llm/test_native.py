"""Quality rules, secret scans, licence scans and mixing against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

from plain import words
from pyspark.sql import functions as F

from factorloom.llm import credentials, licences, mixing, quality


def repeat_words(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    return len({i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(8)})


def test_quality_measures(awkward, documents):
    for df in (awkward, documents):
        texts = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.report(df).collect())
        want = Counter()
        for i, t in texts:
            lines = [x for x in (t or "").split("\n") if words(x)]
            n, rep = len(words(t)), repeat_words(t)
            want[i, n, sum(map(len, words(t))), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n] += 1
        assert got == want


def test_quality_keeps_columns_and_empty(awkward, empty):
    assert quality.keep(awkward).columns == awkward.columns
    assert quality.keep(empty).count() == 0 and quality.report(empty).count() == 0
    kept = {r["doc_id"] for r in quality.keep(awkward).collect()}
    assert kept <= {r["doc_id"] for r in quality.report(awkward).where("kept").collect()}


def strong(text):
    t, out = text or "", []
    for m in re.finditer(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return tuple(sorted(out))


def test_strong_spans(awkward, documents):
    for df in (awkward, documents):
        base, every = credentials.spans_columns(df)
        got = Counter((r["doc_id"], tuple(tuple(x) for x in r[base])) for r in credentials.scan(df).collect())
        assert got == Counter((r["doc_id"], strong(r["text"])) for r in df.collect())


def weak_linked(text, reach):
    t = text or ""
    parts = list(strong(t))
    for k, (pattern, _) in credentials.WEAK.items():
        parts += [(m.start(), credentials.KINDS.index(k), m.end()) for m in re.finditer(pattern.replace("(?i:access", "(?i:access"), t)]
    role = lambda p: credentials.ROLES[credentials.KINDS[p[1]]]
    out = set()
    for p in parts:
        kind = credentials.KINDS[p[1]]
        if kind in credentials.WEAK and any(role(q) in credentials.WEAK[kind][1] and (p[0] - reach <= q[2] <= p[0] or p[2] <= q[0] <= p[2] + reach) for q in parts):
            out.add(p)
    return out


def test_weak_parts_need_their_complements(spark):
    pad = lambda n: " lorem" * (n // 6)
    key = "aB3" * 12
    texts = [
        f"client_id = my.app and {key} at https://api.example.com/v1", f"only {key} alone", "https://api.example.com/v1 alone", f"https://a.example/{pad(150)} {key}", f"https://a.example/ {pad(900)} {key}",
        f"login: bob {pad(180)} token = abcdefghij {pad(300)} login: eve", f"10.0.0.1 {pad(190)}token=abcdefgh{pad(195)} 10.0.0.2 {pad(300)} 10.0.0.3", *[f"{pad(k)}10.0.0.{k % 250}{pad(3 * k)} secret=abcdefgh{pad(k)} login: x{k}y" for k in range(0, 400, 13)],
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in credentials.scan(df).collect():
        got, base = {tuple(x) for x in r["secret_spans"]}, {tuple(x) for x in r["strong_spans"]}
        assert base <= got and got - base == weak_linked(r["text"], credentials.REACH), r["text"]


def test_nothing_complements_itself(spark):
    hexa = "0123456789abcdef" * 2
    texts = [f"https://h/{hexa}", f"user_name = {hexa}", f"https://h/{hexa} and token: {hexa}", f"client_id=abc;{hexa}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    extra = {r["doc_id"]: [credentials.KINDS[s["no"]] for s in r["secret_spans"] if s not in r["strong_spans"]] for r in credentials.scan(df).collect()}
    assert extra == {0: [], 1: [], 2: ["endpoint"], 3: ["identifier"]}


def test_redact_long_text_of_many_spans(spark):
    rng = random.Random(3)
    parts = [rng.choice(["lorem ipsum ", "é😀 ", "token = abcdefgh ", f"{'0123456789abcdef' * 2} ", f"https://h.example/x?{'ab' * 40} secret: qwertz ", "x" * 5000 + " "]) for _ in range(4000)]
    texts = ["".join(parts), "".join(parts[:60]), "token=" + "A" * 20_000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: [tuple(s) for s in r["secret_spans"]] for r in credentials.scan(df).collect()}
    for r in credentials.redact(df, chars_col=None).collect():
        t, at, out = texts[r["doc_id"]], 0, ""
        for start, _, end in spans[r["doc_id"]]:
            if start >= at:
                out += t[at:start] + "[secret]"
            at = max(at, end)
        assert r["text"] == out + t[at:]


def test_redact(awkward, empty, spark):
    out = credentials.redact(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count() and credentials.redact(empty).count() == 0
    df = spark.createDataFrame([(1, "é token = \"abcdef0123456789abcdef0123\" end", 0)], "doc_id long, text string, n_chars long")
    r = credentials.redact(df).head()
    assert r["text"] == "é [secret]\" end" and r["n_chars"] == len(r["text"])


def test_licences(awkward, empty, spark):
    s = licences.SENTENCES
    mit = f"{s['mit-grant']}:\n\n{s['mit-condition']}. Some other words! {s['mit-warranty']}."
    df = spark.createDataFrame([(1, mit), (2, f"{s['mit-warranty']}. {s['mit-condition']}. {s['mit-grant']}."), (3, f"{s['gpl-free']}: {s['gpl-redistribute-2']}."), (4, "released   UNDER the mit license!")], "doc_id long, text string")
    found = {r["doc_id"]: r["licence"]["licences"] for r in licences.scan(df).collect()}
    assert found == {1: ["MIT"], 2: [], 3: ["GPL-2.0-or-later"], 4: ["MIT"]}
    name = licences.licence_column(awkward)
    assert Counter(len(r[name]["licences"]) for r in licences.scan(awkward).collect()) == {0: awkward.count() - 1, 2: 1}
    assert licences.scan(empty).count() == 0


def test_mixing(awkward, empty, documents):
    for df in (awkward, documents):
        name = mixing.mix_column(df)
        rows = [(r["doc_id"], r["source"], r[name]) for r in mixing.mix(df).collect()]
        assert Counter(m["size"] for _, _, m in rows) == Counter(len(words(r["text"])) for r in df.collect())
        sizes, taken, target = defaultdict(int), defaultdict(int), {}
        for _, s, m in rows:
            assert 0 <= m["taken"] <= 3 * m["size"]
            sizes[s] += m["size"]
            taken[s] += m["taken"]
            target[s] = m["target"]
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: 1 + k % 3 for k, s in enumerate(order)}
        want, free, left = {}, set(order), float(sum(sizes.values()))
        while free:
            level = left / sum(weight[s] for s in free)
            over = {s for s in free if weight[s] * level > 3 * sizes[s]}
            if not over:
                want |= {s: weight[s] * level for s in free}
                break
            want |= {s: 3.0 * sizes[s] for s in over}
            left -= sum(3 * sizes[s] for s in over)
            free -= over
        for s in order:
            assert math.isclose(want[s], target[s], rel_tol=1e-9) and taken[s] == math.floor(target[s] + 0.5)
        again = Counter((r["doc_id"], r[name]["taken"]) for r in mixing.mix(df.repartition(3)).collect())
        assert again == Counter((i, m["taken"]) for i, _, m in rows)
        out = mixing.materialise(df)
        assert out.columns == df.columns
        words_out = sum(len(words(r["text"])) for r in out.select("text").collect())
        assert words_out == sum(taken.values())
    assert mixing.mix(empty).count() == 0 and mixing.materialise(empty).count() == 0
    assert mixing.mix(documents.where(F.lit(False)).withColumn("source", F.lit(None).cast("string"))).count() == 0


def test_the_mix_of_rows_without_ids_is_the_same_however_they_lie(spark):
    rows = [(None, f"w{i} " * (2 + i % 3), "en", f"s{i % 2}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixes = [sorted(map(tuple, mixing.materialise(df.repartition(n)).collect()), key=str) for n in (1, 5, 7)]
    assert mixes[0] == mixes[1] == mixes[2] and mixes[0]
