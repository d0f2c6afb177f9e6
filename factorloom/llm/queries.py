"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import credentials, embeddings, licences, mixing, nbsvm, quality, resampling, sharding, simhash, suffixes, tokens, warc, whitening
from factorloom.llm.common import shared_dir, table

BPE = "byte_bpe_50k.tiktoken"


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("licence")
    return out.select("doc_id", F.size(found["sentence_ids"]).cast("long").alias("n_sentences"), F.array_join(found["sentence_ids"], ",").alias("sentence_ids"), F.size(found["licences"]).cast("long").alias("n_licences"), F.array_join(found["licences"], ",").alias("licences"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = credentials.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    strong = F.col("strong_spans")

    def spans_of(kind: int):
        return F.size(F.filter(strong, lambda span: span["no"] == kind))  # one parameter: a second one would be the position

    counts = [spans_of(kind).cast("long").alias(f"n_{name}") for kind, name in enumerate(credentials.STRONG)]
    return out.select("doc_id", *counts, F.sha2(credentials.told(strong), 256).alias("base_sha256"), credentials.told(F.col("secret_spans")).alias("spans"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path(BPE), public_tokenizers.PATTERN
    out = tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, packed=True)
    out = tokens.decode(out.drop("text"), path, pattern, "token_ids")
    n_tokens = F.expr("octet_length(token_ids) div 4").cast("long")
    return out.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("token_bytes", 256).alias("decoded_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), out)
    return warc.read(spark, out).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op5_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "mixed.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size, crc = F.octet_length("text").cast("long") + 1, F.crc32("text")
    slim = docs.select("doc_id", F.xxhash64("text").alias("same"), size.alias("size"), crc.alias("text_crc32"))
    out = sharding.assign(slim, F.col("same"), F.col("size"), order=F.col("doc_id"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "sharded.shard", "sharded.slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.crc32(id_text) % 5 == 0).alias("held_out"))
    marks = table(spark, sf_dir, "labels").where(F.crc32(id_text) % 5 != 0).groupBy("doc_id").agg(F.min("quality").alias("mark"))
    labelled = docs.where("not held_out").join(marks.hint("merge"), "doc_id")  # labels grow with the corpus: never broadcast
    model = nbsvm.fit(labelled, "text", F.col("mark"))
    out = nbsvm.classify(docs, model)
    score = F.col(nbsvm.score_column(docs))
    return out.select("doc_id", "held_out", score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = resampling.importance(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "importance.*")
    return resampling.ranked(scored, "doc_id").select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_licence_scan, op2_secret_scan, op3_byte_bpe, op4_warc, op5_itq_near_dedup, op6_simhash_near_dedup, op7_mixing, op8_quality_rules, op9_suffix_dedup, op10_karmarkar_karp, op11_nbsvm, op12_whitening, op13_importance_resampling)}

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

_OP1_RULES = ",\n".join(
    f"CASE WHEN regexp_matches(ids, '{''.join(('(^|,)' if not i else ',([^,]+,)*') + x.replace('-', '[-]') for i, x in enumerate(rule))}(,|$)') THEN {n} END" for n, (_, rule) in enumerate(licences.RULES, 1)
)
_OP1 = f"""
WITH known(sentence, id) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in licences.known_sentences().items())}),
parts AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n+|[.!?;:]+(?:[\\x20\\x09-\\x0D]+|$)')) AS part, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\n+|[.!?;:]+(?:[\\x20\\x09-\\x0D]+|$)'), 1) AS pos FROM documents),
hits AS (SELECT doc_id, pos, id FROM parts JOIN known ON sentence = trim(regexp_replace(lower(part), '[^a-z0-9.]+', ' ', 'g'))),
seq AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids FROM hits GROUP BY doc_id),
names AS (SELECT doc_id, list_transform(list_filter([{_OP1_RULES}], lambda x: x IS NOT NULL), lambda x: ['{"', '".join(name for name, _ in licences.RULES)}'][x]) AS found FROM seq),
firsts AS (SELECT doc_id, list_filter(found, lambda x, i: list_position(found, x) = i) AS found FROM names)
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(len(found), 0) AS n_licences, coalesce(array_to_string(found, ','), '') AS licences
FROM documents d LEFT JOIN seq USING (doc_id) LEFT JOIN firsts USING (doc_id)
"""

_OP7 = f"""
WITH rows AS (SELECT doc_id, source, source IS NULL AS none, coalesce(source, '') AS src, coalesce(len({_WORDS}), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT none, src, sum(size)::BIGINT AS source_size FROM rows GROUP BY ALL),
w AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][(row_number() OVER (ORDER BY none, src) - 1) % 3 + 1]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS lim FROM s),
r AS (SELECT *, lim / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(lim) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level FROM r WINDOW p AS (ORDER BY ratio, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(weight * coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), 0), lim) AS target FROM l),
b AS (SELECT none, src, source_size, target, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
o AS (SELECT rows.*, coalesce(sum(size) OVER (PARTITION BY none, src ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM rows)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM o JOIN b USING (none, src)
"""

_STOPS = ", ".join("'" + w + "'" for w in quality._stop_words())
_MOST = {(r.measure, "most"): r.most for r in quality.RULES} | {(r.measure, "least"): r.least for r in quality.RULES if r.least is not None}
_OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lower(lang) NOT IN ('en', 'de', 'fr', 'es'), false) AS unlisted FROM documents),
w AS (SELECT doc_id, text, unlisted, {_WORDS} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(after - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS lines, len(list_filter(w, lambda x: x IN ({_STOPS}))) AS stops, unlisted,
  length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS letters, len(list_filter(l, lambda x: regexp_matches(x, '\|[^|]*\|[^|]*\|'))) AS bars,
  len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS dots, len(regexp_extract_all(text, '[!?]')) AS shouts
  FROM w LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_chars, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbols,
  CASE WHEN unlisted THEN 1 WHEN n_words > 0 THEN stops / n_words ELSE 0 END AS stop_share, CASE WHEN lines > 0 THEN n_dup_lines / lines ELSE 0 END AS dup_share,
  CASE WHEN lines > 0 THEN bars / lines ELSE 0 END AS bar_share, CASE WHEN lines > 0 THEN dots / lines ELSE 0 END AS dot_share,
  CASE WHEN word_chars > 0 THEN letters / word_chars ELSE 0 END AS letter_share, CASE WHEN n_words > 0 THEN shouts / n_words ELSE 0 END AS shout_share FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND mean_chars BETWEEN {_MOST["mean_word_chars", "least"]} AND {_MOST["mean_word_chars", "most"]} AND symbols <= {_MOST["symbol_share", "most"]}
  AND stop_share >= {_MOST["stop_word_share", "least"]} AND dup_share <= {_MOST["dup_line_share", "most"]} AND bar_share <= {_MOST["bar_line_share", "most"]}
  AND dot_share <= {_MOST["ellipsis_line_share", "most"]} AND letter_share >= {_MOST["alpha_share", "least"]} AND shout_share <= {_MOST["shout_share", "most"]} AS kept
FROM v
"""

_OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id AND r.root < p.b),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id
"""

_BITS = "(unhex(sha1(coalesce(html, '')))::BIT)::VARCHAR"
_BASE32 = f"array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + {' + '.join(f'{16 >> k} * substr(bits, (i * 5 + {k + 1})::INT, 1)::INT' for k in range(5))})::INT, 1)), '')"
_OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, {_BITS} AS bits FROM pages),
g AS (SELECT payload, max(page_id) AS top FROM p GROUP BY payload)
SELECT page_id, strlen(payload) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN g USING (payload)
"""

_LOWERED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: CRC-32 by its rule: a table of 256 numbers from eight steps each, then byte by byte.
_OP13 = f"""
WITH d AS (SELECT doc_id, {_LOWERED} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_LOWERED}) AS word FROM benchmark),
v AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
tb AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
h AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i::INT + 1, 2))::BIGINT) AS bytes FROM v),
c AS (SELECT word, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM h, tb),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN c USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN c USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN c USING (word) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT AS u FROM d LEFT JOIN w USING (doc_id)),
k AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM k)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM k WHERE n_features >= 20) // 100 THEN place END AS rank FROM o
"""

SQL = {"op13_importance_resampling": _OP13, "op4_warc": _OP4, "op5_itq_near_dedup": _OP5, "op1_licence_scan": _OP1, "op7_mixing": _OP7, "op8_quality_rules": _OP8}
