"""Secret scans: strong patterns, and weak parts of credentials that count only beside their complements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import cut, free_name

#: Fixed values. Strong kinds: pattern, the group whose length counts, its least length.
STRONG = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Weak kinds: pattern, and the roles of which one must be near.
WEAK = {
    "identifier": (r"(?:\b(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}\b|\b(?i:access_?key_?id|client_?id|user_?name|account_?id|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,})", ("secret",)),
    "key": (r"(?<![A-Za-z0-9+/=_-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])", ("identifier", "endpoint")),
    "endpoint": (r"(?:\b(?i:https?|wss?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3|ftp)://[^\x20\x09-\x0D\"'<>]+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b)", ("secret",)),
}
ROLES = {"assign": "secret", "hex": "secret", "access": "identifier", "identifier": "identifier", "key": "secret", "endpoint": "endpoint"}
KINDS = (*STRONG, *WEAK)
#: Characters between two parts of one credential at most.
REACH = 200
_SPAN = "array<struct<start:int,no:int,end:int>>"
_BLOCK = 256
_TEXT_BLOCK = 4096


def _prefix_sums(df: DataFrame, column: str) -> DataFrame:
    """Replaces an array of int by its running sums: in blocks, so that the work stays near the array's length."""
    blocks, sums = free_name(df, "secret_blocks"), free_name(df, "secret_sums")
    none = F.array().cast("array<int>")
    grown = lambda xs: F.aggregate(xs, none, lambda s, x: F.concat(s, F.array(x + F.when(F.size(s) > 0, F.element_at(s, -1)).otherwise(F.lit(0)))))
    n = F.ceil(F.size(column) / _BLOCK).cast("int")
    df = df.withColumn(blocks, F.when(F.size(column) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda b: grown(F.slice(F.col(column), b * _BLOCK + 1, _BLOCK)))).otherwise(F.array().cast("array<array<int>>")))
    df = df.withColumn(sums, F.concat(F.array(F.lit(0)), grown(F.transform(F.col(blocks), lambda b: F.element_at(b, -1)))))
    return df.withColumn(column, F.flatten(F.zip_with(F.col(blocks), F.slice(F.col(sums), 1, F.size(blocks)), lambda b, s: F.transform(b, lambda x: x + s)))).drop(blocks, sums)


def _spans(df: DataFrame, text: str, kind: str, pattern: str, group: int, least: int, out: str) -> DataFrame:
    """Adds the column out: the spans of the pattern's matches in the column text. Pieces between matches and the matches themselves give the positions."""
    hits, ends = free_name(df, "secret_hits"), free_name(df, "secret_ends")
    has = F.col(text).rlike(pattern)
    lengths = lambda g: F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(g)), lambda x: F.length(x))
    none = F.array().cast("array<int>")
    df = df.withColumn(hits, F.when(has, lengths(0)).otherwise(none))
    pieces = F.transform(F.split(F.col(text), pattern, -1), lambda x: F.length(x))
    df = df.withColumn(ends, F.when(F.size(hits) > 0, F.zip_with(F.slice(pieces, 1, F.size(hits)), F.col(hits), lambda p, h: p + h)).otherwise(none))
    df = _prefix_sums(df, ends)
    spans = F.zip_with(F.col(ends), F.col(hits), lambda e, h: F.struct((e - h).alias("start"), F.lit(KINDS.index(kind)).alias("no"), e.alias("end")))
    if group:
        counted = F.when(F.size(hits) > 0, lengths(group)).otherwise(none)
        spans = F.filter(F.zip_with(spans, counted, lambda s, n: F.when(n >= least, s)), lambda s: s.isNotNull())
    else:
        spans = F.filter(spans, lambda s: s["end"] - s["start"] >= least)
    return df.withColumn(out, spans.cast(_SPAN)).drop(hits, ends)


def _found(df: DataFrame, text_col: str, strong: str, weak: str) -> DataFrame:
    text = free_name(df, "secret_text")
    df = df.withColumn(text, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    cols = {}
    for kind in KINDS:
        pattern, group, least = STRONG[kind] if kind in STRONG else (WEAK[kind][0], 0, 1)
        cols[kind] = free_name(df, f"secret_{kind}")
        df = _spans(df, text, kind, pattern, group, least, cols[kind])
    return df.withColumns({strong: F.sort_array(F.concat(*[F.col(cols[k]) for k in STRONG])), weak: F.sort_array(F.concat(*[F.col(cols[k]) for k in WEAK]))}).drop(text, *cols.values())


def _role(no: Column) -> Column:
    return F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), no + 1)


def link(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Of rows (scope, start, no, end), the weak ones with a part beside them that complements them: in the same scope, at most reach away, and not overlapping, so that nothing complements itself.

    An interval join on buckets of reach characters. A part lends its end to what follows and its start to what comes
    before. A weak part asks for an end from reach before its start to its start, and for a start from its end to reach
    after it; such a range meets at most two buckets, one from below and one from above, so a bucket's least and greatest
    position of each role decide exactly. No bucket gives more than a row for each weak part, role and side.
    """
    in_bucket = lambda x: F.floor(x / reach).cast("int")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("end").alias("at")), F.struct(F.lit(1).alias("side"), F.col("start").alias("at")))).alias("lent")
    lent = parts.select("scope", _role(F.col("no")).alias("role"), sides).select("scope", "role", "lent.side", "lent.at", in_bucket(F.col("lent.at")).alias("bucket"))
    edges = lent.groupBy("scope", "bucket", "role", "side").agg(F.min("at").alias("least"), F.max("at").alias("most"))
    needs = F.array(*[F.struct(F.lit(KINDS.index(k)).alias("no"), F.lit(r).alias("role")) for k, (_, roles) in WEAK.items() for r in roles])
    weak = parts.where(F.col("no") >= len(STRONG)).select("scope", "start", "no", "end", F.explode(needs).alias("need")).where("need.no = no")
    before = F.struct(F.lit(0).alias("side"), F.greatest(F.col("start") - reach, F.lit(0)).alias("low"), F.col("start").alias("high"))
    after = F.struct(F.lit(1).alias("side"), F.col("end").alias("low"), (F.col("end") + reach).alias("high"))
    asked = weak.select("scope", "start", "no", "end", F.col("need.role").alias("role"), F.explode(F.array(before, after)).alias("r")).select("scope", "start", "no", "end", "role", "r.*")
    asked = asked.withColumn("bucket", F.explode(F.array_distinct(F.array(in_bucket(F.col("low")), in_bucket(F.col("high"))))))
    from_low, to_high = F.col("bucket") == in_bucket(F.col("low")), F.col("bucket") == in_bucket(F.col("high"))
    met = F.when(from_low & ~to_high, F.col("most") >= F.col("low")).otherwise(F.col("least") <= F.col("high"))  # where both ends meet one bucket, low is 0
    return asked.join(edges, ["scope", "bucket", "role", "side"]).where(met).select("scope", "start", "no", "end").distinct()


def scan(df: DataFrame, text_col: str = "text", reach: int = REACH, keep_text: bool = True) -> DataFrame:
    """Adds spans_columns(df): the strong spans, and all spans, as sorted arrays of (start, no, end) in code points.

    Spans are found once and the rows written with them, without the text where keep_text is false. Documents without weak
    parts are done in their row; the parts of the others, which are few, are linked. Null and empty texts have no spans;
    repeated rows are scopes of their own; names of other columns cannot clash, because work columns take free names.
    """
    base, every = spans_columns(df)
    weak, scope = free_name(df, "secret_weak"), free_name(df, "secret_scope")
    found = _found(df, text_col, base, weak)
    found = cut((found if keep_text else found.drop(text_col)).withColumn(scope, F.monotonically_increasing_id()))
    done = found.where(F.size(weak) == 0).withColumn(every, F.col(base)).drop(weak, scope)
    open_ = found.where(F.size(weak) > 0)
    parts = open_.select(F.col(scope).alias("scope"), F.explode(F.concat(base, weak)).alias("p")).select("scope", "p.*")
    linked = link(parts, reach).groupBy(F.col("scope").alias(scope)).agg(F.collect_list(F.struct("start", "no", "end")).alias(weak))
    more = F.coalesce(F.col(weak), F.array().cast(_SPAN))
    open_ = open_.drop(weak).join(linked, scope, "left").withColumn(every, F.sort_array(F.concat(F.col(base), more))).select(*done.columns)
    return done.unionByName(open_)


def spans_columns(df: DataFrame) -> tuple[str, str]:
    return free_name(df, "strong_spans"), free_name(df, "secret_spans")


def told(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"], s["end"])), ",")


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """Block by block of the text, so that work stays near the text's length: a block takes the spans that touch it, and the mark where one starts."""
    cut_at = lambda b: b * _TEXT_BLOCK

    def of_block(block: Column, b: Column) -> Column:
        own = F.filter(spans, lambda s: (s["start"] < cut_at(b + 1)) & (s["end"] > cut_at(b)))
        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(s: Column, x: Column) -> Column:
            start, end = x["start"] - cut_at(b), F.least(x["end"] - cut_at(b), F.lit(_TEXT_BLOCK))
            told = F.when((start >= 0) & (start >= s["at"]), F.concat(s["out"], F.substring(block, s["at"] + 1, start - s["at"]), F.lit(mark))).otherwise(s["out"])
            return F.struct(F.greatest(s["at"], end).alias("at"), told.alias("out"))

        return F.when(F.size(own) > 0, F.aggregate(own, begin, step, lambda s: F.concat(s["out"], F.substring(block, s["at"] + 1, F.length(block))))).otherwise(block)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_TEXT_BLOCK}}}"), F.lit(0)), of_block), "")


def redact(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[secret]", reach: int = REACH) -> DataFrame:
    """df with every span of its texts replaced by a mark; overlapping spans share one. Texts without spans, null and empty ones too, stay as they are; repeated rows stay repeated; very long texts are done in blocks; the columns are those of df, whatever their names."""
    _, every = spans_columns(df)
    text = F.col(f"`{text_col}`")
    out = scan(df, text_col, reach).withColumn(text_col, F.when(F.size(every) > 0, _redacted(text.cast("string"), F.col(every), mark)).otherwise(text))
    if chars_col and chars_col in df.columns:
        out = out.withColumn(chars_col, F.when(F.size(every) > 0, F.length(text).cast(dict(df.dtypes)[chars_col])).otherwise(F.col(chars_col)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
