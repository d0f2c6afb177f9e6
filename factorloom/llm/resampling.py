"""Importance resampling towards a target's distribution of hashed n-grams.

Each task keeps a trie of the words it has seen: a node stands for a run of words, with its count and the CRC state of its text, so a
longer run's checksum goes on from its parent's. Tries only ever leave their task as totals by bucket, and start anew when they have
grown large, so memory is bounded. A second pass walks tries whose nodes hold their bucket's gain.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import cut, free_name, written

BUCKETS = 10_000
#: Words of a run at most.
LONGEST = 1
#: Nodes of a trie before it starts anew.
NODES = 200_000
#: Words that a document needs to be drawn, and the part of those documents that is drawn, in hundredths.
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed: what a word is made of, after A to Z were lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Trie:
    """Runs of words as paths. A node is a list: its value (a count or a gain), the CRC state of its text, and its children by word."""

    def __init__(self, longest: int, start):
        self.longest, self.start, self.size, self.root = longest, start, 0, [0, 0, {}]

    def child(self, node: list, word: str) -> list:
        found = node[2].get(word)
        if found is None:
            text = word.encode("utf-8", "surrogatepass")
            crc = zlib.crc32(text if node is self.root else b" " + text, node[1])
            found = node[2][word] = [self.start(crc), crc, {} if self.longest > 1 else None]
            self.size += 1
        return found

    def runs(self, words: list[str]) -> Iterator[list]:
        """The node of each run of 1 to longest words, once for each place where it stands."""
        if self.longest == 1:
            known, root = self.root[2], self.root
            for w in words:
                yield known.get(w) or self.child(root, w)
            return
        for i in range(len(words)):
            node = self.root
            for w in words[i : i + self.longest]:
                node = self.child(node, w)
                yield node

    def nodes(self) -> Iterator[list]:
        todo = [self.root]
        while todo:
            for node in (todo.pop()[2] or {}).values():
                yield node
                todo.append(node)


def lowered(text: Column) -> Column:
    """A to Z in lower case, and nothing else; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _CAPITALS, _CAPITALS.lower())


def bucket_totals(df: DataFrame, text_col: str, longest: int = LONGEST, buckets: int = BUCKETS, nodes: int = NODES) -> DataFrame:
    """Rows (bucket, n): how many runs of all whole texts fall into each bucket, at most `buckets` rows from each task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, trie = np.zeros(buckets, dtype=np.int64), Trie(longest, lambda crc: 0)

        def settle() -> None:
            at = np.array([node[1] for node in trie.nodes()], dtype=np.int64) % buckets
            np.add.at(total, at, np.array([node[0] for node in trie.nodes()], dtype=np.int64))

        for f in batches:
            for text in f["text"]:
                for node in trie.runs(_WORD.findall(text)):
                    node[0] += 1
                if trie.size > nodes:
                    settle()
                    trie = Trie(longest, lambda crc: 0)
        settle()
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "n": total[some]})

    return df.select(lowered(F.col(f"`{text_col}`")).alias("text")).mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """By bucket, thousandths of the logarithm of the target's smoothed share over the source's, rounded down. Both come as bucket totals, so the driver holds two numbers for a bucket."""
    told = []
    for totals in (source, target):
        n = np.zeros(buckets, dtype=np.int64)
        for r in totals.collect():
            n[r["bucket"]] = r["n"]
        told.append(n.tolist())
    (s, t), (s_all, t_all) = told, [float(sum(n)) + buckets for n in told]
    return np.array([math.floor(1000 * math.log((b + 1.0) * s_all / ((a + 1.0) * t_all))) for a, b in zip(s, t, strict=True)], dtype=np.int64)


def weigher(gain: np.ndarray, longest: int = LONGEST, nodes: int = NODES):
    """A column function: lower-cased texts to (n_words, n_features, weight)."""
    gain, buckets = gain.tolist(), len(gain)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        start = lambda crc: gain[crc % buckets]
        trie = Trie(longest, start)
        for texts in batches:
            told = np.zeros((len(texts), 3), dtype=np.int64)
            for i, text in enumerate(texts):
                words = _WORD.findall(text)
                values = [node[0] for node in trie.runs(words)]
                told[i] = len(words), len(values), sum(values)
                if trie.size > nodes:
                    trie = Trie(longest, start)
            yield pd.DataFrame(told, columns=["n_words", "n_features", "weight"])

    return weigh


def score(weight: Column, id_: Column, seed: int = SEED) -> Column:
    """The weight with Gumbel noise that the id decides; a null id counts as the text null."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """df with the struct column importance_column(df): n_words, n_features, weight and score of each whole text. Null and empty texts have no words and weight 0."""
    gain = gains(bucket_totals(df, text_col, longest, buckets), bucket_totals(target, target_text_col, longest, buckets), buckets)
    name = importance_column(df)
    out = df.withColumn(name, weigher(gain, longest)(lowered(F.col(f"`{text_col}`"))))
    m = F.col(name)
    return out.withColumn(name, F.struct(m["n_words"].alias("n_words"), m["n_features"].alias("n_features"), m["weight"].alias("weight"), score(m["weight"], F.col(f"`{id_col}`")).alias("score")))


def importance_column(df: DataFrame) -> str:
    return free_name(df, "importance")


def ranked(scored: DataFrame, id_col: str, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Of narrow rows (id, n_words, score and others): all of them, with the rank among the drawn, null for the others.

    Rows that may be drawn are sorted by ranges of falling score, then id, null last; a range's place in the order is the rows of the
    ranges before it, and a row's place in its range is its position there. No task sees more than a range, and the driver no
    row. Rows that agree in all of this are drawn in the order of their other columns and their place in the table.
    """
    rows = written(scored)
    own = free_name(rows, "at_row")
    order = [F.col("score").desc(), F.col(f"`{id_col}`").asc_nulls_last(), *[F.col(f"`{c}`") for c in rows.columns if c not in ("score", id_col)], F.col(own)]
    some = F.col("n_words") >= least_words
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.where(some).withColumn(own, F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = cut(ordered).drop(own).withColumn(own, F.monotonically_increasing_id())
    part = F.shiftright(own, 33).alias("part")
    counts = ordered.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", before.alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).cast("long").alias("drawn"))
    place, at = free_name(rows, "rank"), F.col(own).bitwiseAND(F.lit((1 << 33) - 1))
    out = ordered.withColumn("part", part).join(F.broadcast(starts), "part")  # one row a partition
    rank = F.col("before") + at + 1
    out = out.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(rank <= F.col("drawn"), rank).alias(place))
    rest = rows.where(~some).withColumn(place, F.lit(None).cast("long"))
    return out.unionByName(rest)


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of df that are drawn, whole and with df's columns only: the percent of the rows with least_words words or more whose scores are highest.

    Null and empty texts are not drawn, unless least_words is 0; repeated rows are drawn each for itself; ties go to the smaller id, then
    null. An empty table gives an empty table, and an empty target a draw by how rare a text's words are. Columns may have any name.
    """
    row, name = free_name(df, "drawn_row"), importance_column(df)
    keyed = written(importance(df, target, id_col, text_col, target_text_col, longest, buckets).withColumn(row, F.monotonically_increasing_id()))
    drawn = ranked(keyed.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("id"), f"{name}.n_words", f"{name}.score"), "id", least_words, percent)
    return keyed.join(drawn.where("rank is not null").select(F.col("row").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
