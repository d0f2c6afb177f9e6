"""Quality rules: a table of thresholds, compiled into Spark projections over each text, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import free_name, settled, words

#: The languages of the lists, as a language column names them.
LANGUAGES = ("en", "de", "fr", "es")
#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on was with as be by are this from at or an a",
    "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch",
    "de la le les et des en un une du que est pour dans par au qui sur pas avec",
    "de la que el en y a los se del las un por con no una su para es al",
)


WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A text fails if the measure is below least or above most."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Shares are of words, lines or characters, from 0 to 1. The first two rules are the base rules.
RULES = (
    Rule("n_words", least=20),
    Rule("repeat_share", most=0.30),
    Rule("mean_word_chars", least=2.0, most=15.0),
    Rule("symbol_share", most=0.10),
    Rule("stop_word_share", least=0.02),
    Rule("dup_line_share", most=0.40),
    Rule("bar_line_share", most=0.50),
    Rule("ellipsis_line_share", most=0.30),
    Rule("alpha_share", least=0.50),
    Rule("shout_share", most=0.50),
)
BASE_RULES = RULES[:2]


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def _stop_words() -> list[str]:
    """The stop words as they stand inside a sentence and at its start."""
    found = set(" ".join(STOP_WORDS).split())
    return sorted(found | {w.capitalize() for w in found})


def _of_equal_neighbours(pairs: Column) -> Column:
    """Of structs (k, at) sorted by k, the at of each whose k the one before or after has too."""
    keys = F.transform(pairs, lambda p: p["k"])
    marked = F.zip_with(pairs, F.concat(F.array(F.lit(None)), keys), lambda p, k: F.struct(p["k"].alias("k"), p["at"].alias("at"), F.coalesce(p["k"] == k, F.lit(False)).alias("hit")))
    hits = F.zip_with(marked, F.slice(keys, 2, F.size(keys)), lambda m, k: F.when(m["hit"] | F.coalesce(m["k"] == k, F.lit(False)), m["at"]))
    return F.filter(hits, lambda at: at.isNotNull())


def measure(df: DataFrame, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """Adds the measures of each text as one struct column, whose name measures_column(df) tells; filters on it are safe, because they don't repeat its definition.

    Null and empty texts have no words and all measures zero; shares without a denominator are zero. Where lang_col names a
    language without a list of stop words, their share is 1; a null language is judged by all lists. Very long texts are
    measured whole: windows meet in a sorted array of hashes, about 100 bytes for each word of one text at a time. Other
    columns pass through, and no name of theirs can clash, because work columns take free names.
    """
    steps = ("text", "words", "lines", "h1", "h2", "h4", "h8", "pairs", "texts", "starts", "measures")
    names = {k: free_name(df, f"quality_{k}") for k in steps}
    c = {k: F.col(v) for k, v in names.items()}
    put = lambda d, name, value: d.withColumn(names[name], value)
    out = put(df, "text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    out = put(out, "words", words(c["text"]))
    out = put(out, "lines", F.filter(F.split(c["text"], "\n"), lambda x: x.rlike(WORD)))
    # A window's hash joins those of its halves, so each word is hashed once and each window takes three more steps.
    out = put(out, "h1", F.transform(c["words"], lambda w: F.xxhash64(w)))
    for half in (1, 2, 4):
        whole = c[f"h{half}"]
        left, right = F.slice(whole, 1, F.greatest(F.size(whole) - half, F.lit(0))), F.slice(whole, half + 1, F.size(whole))
        out = put(out, f"h{2 * half}", F.zip_with(left, right, lambda x, y: F.xxhash64(x, y)))
    numbered = F.sort_array(F.transform(c["h8"], lambda h, i: F.struct(h.alias("k"), i.alias("at"))))
    out = put(out, "pairs", F.when(F.size(F.array_distinct(c["h8"])) < F.size(c["h8"]), numbered))
    met = F.transform(_of_equal_neighbours(c["pairs"]), lambda at: F.struct(F.array_join(F.slice(c["words"], at + 1, WINDOW), " ").alias("k"), at.alias("at")))
    out = put(out, "texts", F.when(c["pairs"].isNotNull(), F.sort_array(met)))
    out = put(out, "starts", F.when(c["texts"].isNotNull(), F.sort_array(_of_equal_neighbours(c["texts"]))))
    gaps = F.zip_with(c["starts"], F.slice(c["starts"], 2, F.size(c["starts"])), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    repeated = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    unlisted = ~F.lower(F.col(f"`{lang_col}`")).isin(*LANGUAGES) if lang_col else F.lit(False)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n_words, n_lines, chars = _size(c["words"]), _size(c["lines"]), F.length(F.array_join(c["words"], "")).cast("long")
    n_symbols = F.regexp_count(c["text"], F.lit("[#*$%&|<>]")).cast("long")
    stop_words = _size(F.filter(c["words"], lambda w: w.isin(_stop_words())))
    letters = F.length(F.regexp_replace(c["text"], r"\P{L}+", "")).cast("long")
    dup_lines = n_lines - _size(F.array_distinct(c["lines"]))
    bars = _size(F.filter(c["lines"], lambda x: x.rlike(r"\|[^|]*\|[^|]*\|")))
    dots = _size(F.filter(c["lines"], lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("\u2026")))
    shouts = F.regexp_count(c["text"], F.lit("[!?]")).cast("long")
    measures = {
        "n_words": n_words, "word_chars": chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated,
        "repeat_share": share(repeated, n_words), "mean_word_chars": share(chars, n_words), "symbol_share": share(n_symbols, chars),
        "stop_word_share": F.when(unlisted, F.lit(1.0)).otherwise(share(stop_words, n_words)), "dup_line_share": share(dup_lines, n_lines), "bar_line_share": share(bars, n_lines),
        "ellipsis_line_share": share(dots, n_lines), "alpha_share": share(letters, chars), "shout_share": share(shouts, n_words),
    }
    out = put(out, "measures", F.when(settled(F.lit(True)), F.struct(*[v.alias(k) for k, v in measures.items()])))
    return out.drop(*[v for k, v in names.items() if k != "measures"])


def measures_column(df: DataFrame) -> str:
    """The struct column that measure(df) adds."""
    return free_name(df, "quality_measures")


def verdict(measures: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression: whether the measures hold against every rule. A share of exactly the threshold passes."""
    out = F.lit(True)
    for r in rules:
        if r.measure == "repeat_share":  # in whole numbers, so that the edge is exact
            out = out & (F.lit(100) * measures["n_repeat_words"] <= F.lit(round(100 * r.most)) * measures["n_words"])
            continue
        if r.least is not None:
            out = out & (measures[r.measure] >= r.least)
        if r.most is not None:
            out = out & (measures[r.measure] <= r.most)
    return out


def _lang(df: DataFrame, lang_col: str) -> str | None:
    return lang_col if lang_col in df.columns else None


def keep(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, lang_col: str = "lang") -> DataFrame:
    """The rows whose text passes every rule, with the columns of df. Null and empty texts go; repeated rows stay together or go together."""
    return measure(df, text_col, _lang(df, lang_col)).where(verdict(F.col(measures_column(df)), rules)).select(*[F.col(f"`{c}`") for c in df.columns])


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, lang_col: str = "lang") -> DataFrame:
    """One row per input row: the id, the measures, base_failed and kept."""
    slim = df.select(*dict.fromkeys([id_col, text_col, *([lang_col] if _lang(df, lang_col) else [])]))
    m = F.col(measures_column(slim))
    out = measure(slim, text_col, _lang(df, lang_col))
    return out.select(id_col, *[m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], (~verdict(m, BASE_RULES)).alias("base_failed"), (verdict(m, BASE_RULES) & verdict(m, rules)).alias("kept"))
