"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter

import corpus_pipeline as cp
from test_free import PATH, PATTERN
from test_native import strong, weak_linked
from test_shingles import brute

from factorloom.llm import credentials, quality, tokens


def redacted(text):
    at, out = 0, ""
    for start, _, end in sorted({*strong(text), *weak_linked(text, credentials.REACH)}):
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


def test_stages(spark, sf_dir, documents):
    docs, columns = documents.select("doc_id", "text", "lang", "source", "n_chars"), ["doc_id", "text", "lang", "source", "n_chars"]
    report = {r["doc_id"]: r["kept"] for r in quality.report(docs).collect()}
    kept = cp.quality_rules(spark, docs, sf_dir).cache()
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in report.items() if v}

    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    least = {rows[k][0] for k in brute([t for _, t in rows])[0]}
    single = cp.near_dedup(spark, kept, sf_dir).cache()
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == least

    clean = cp.secret_scan(spark, single, sf_dir).cache()
    told = {r["doc_id"]: redacted(r["text"]) for r in single.collect()}
    assert clean.columns == columns and {r["doc_id"]: r["text"] for r in clean.collect()} == told and all(r["n_chars"] == len(r["text"]) for r in clean.collect() if "[secret]" in r["text"])

    mixed = cp.mix_sources(spark, clean, sf_dir).cache()
    uses = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == columns and set(uses) <= least and max(uses.values()) <= 3

    enc = tokens._encoding(PATH, PATTERN)
    want = Counter((r["doc_id"], tuple(enc.encode_ordinary(r["text"] or ""))) for r in mixed.collect())
    rows = cp.tokenize(spark, mixed, sf_dir).collect()
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in rows) == want and all(r["round_trip"] for r in rows)

    whole = Counter((r["doc_id"], tuple(r["token_ids"])) for r in cp.run(spark, sf_dir).collect())
    assert whole == want
