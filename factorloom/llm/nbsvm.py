"""A quality classifier: naive Bayes support vectors. n-gram indicators are scaled by their classes' log-count ratios, and a linear hinge-loss model over them is fitted by dual coordinate descent.

n-grams are of two kinds: runs of one and two words in lower case, and runs of one to three word shapes, where a shape
tells capitals, letters, digits and other characters, and whether the word repeats the one before. Both are hashed to BUCKETS
buckets, so that counts, ratios and weights have a size that no corpus changes. Counts are of all labelled rows; the
hinge-loss model sees a sample of bounded size. The scores' scale is tuned on margins of rows that neither the model of their
fold nor their own part of the ratios has seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import free_name

BITS = 16
BUCKETS = 1 << BITS
#: Rows and n-grams of the sample that the hinge-loss model is fitted on, about, at most.
SAMPLE_ROWS = 10_000
SAMPLE_GRAMS = 16_000_000
#: Parts of the sample that tune the scale in turn.
FOLDS = 5
#: Longest runs of words and of shapes.
WORD_RUN, SHAPE_RUN = 2, 3
#: Code points of texts that are taken apart at once, about.
_PIECE = 1 << 20
_KNOWN = 300_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SAME = zlib.crc32(b"\0repeats")
_PART = 2048


def shape(word: str) -> str:
    """A for capitals, a for other letters, 0 for digits, other characters themselves; runs count once, and no more than twelve characters of the shape."""
    if word.isalpha():  # most words, without a look at each character
        if word.islower():
            return "a"
        if word.isascii() and (word.isupper() or word.istitle()):
            return "A" if word.isupper() else "Aa"
    told = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:64])
    return re.sub(r"(.)\1+", r"\1", told, flags=re.S)[:12]


class _Words(dict):
    """The place of each word in the tables of hashes; forgets all when it has grown large."""

    def __init__(self):
        super().__init__()
        self.hashes: list[tuple[int, int]] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self.hashes)
        self.hashes.append((zlib.crc32(word.lower().encode("utf-8", "surrogatepass")), zlib.crc32(b"\0" + shape(word).encode("utf-8", "surrogatepass"))))
        return at

    def bounded(self) -> _Words:
        if len(self) > _KNOWN:
            self.clear()
            self.hashes.clear()
        return self


#: Each Python worker's own; only a short cut.
_WORDS = _Words()


def _runs(tokens: np.ndarray, doc: np.ndarray, longest: int, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of each run of 1 to longest tokens that stays within a document."""
    for n in range(1, longest + 1):
        if n > len(tokens):
            return
        last = len(tokens) - n + 1
        h = tokens[:last].copy()
        for j in range(1, n):
            h = (h * _ODD) ^ (tokens[j : last + j] + np.uint64(j))
            h ^= h >> np.uint64(29)
        inside = doc[:last] == doc[n - 1 :]
        yield doc[:last][inside], (((h + np.uint64(kind * 1_000_003 + n)) * _ODD) >> np.uint64(64 - BITS))[inside].astype(np.int64)


def indicators(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of some texts after the others: the first one's place, and the sorted distinct pairs (text, bucket), texts counted from the first. Null has none."""
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars + len(texts[to] or "") <= _PIECE):
            chars += len(texts[to] or "")
            to += 1
        known = _WORDS.bounded()
        parts = [(t or "").split() for t in texts[at:to]]
        places = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=sum(map(len, parts)))
        doc = np.repeat(np.arange(to - at), [len(p) for p in parts])
        hashes = np.array(known.hashes, dtype=np.uint64).reshape(-1, 2)[places] if len(places) else np.zeros((0, 2), dtype=np.uint64)
        word, form = hashes[:, 0].copy(), hashes[:, 1].copy()
        again = np.zeros(len(word), dtype=bool)
        again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        form[again] = _SAME
        pairs = [d * BUCKETS + b for runs in (_runs(word, doc, WORD_RUN, 0), _runs(form, doc, SHAPE_RUN, 1)) for d, b in runs]
        pairs = np.sort(np.concatenate([*pairs, np.zeros(0, dtype=np.int64)]))
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        yield at, pairs >> BITS, pairs & (BUCKETS - 1)
        at = to


@dataclass(frozen=True)
class Model:
    """Ratios by bucket, the hinge-loss model's weights over scaled indicators, and the logistic scale of its margin. Without both classes among the labels, every score is the share of good rows."""

    share: float
    ratio: np.ndarray
    weight: np.ndarray
    bias: float = 0.0
    slope: float = 0.0
    offset: float = 0.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores from 0 to 1."""
        if self.slope == 0.0:
            return np.full(len(texts), self.share)
        margin = np.zeros(len(texts))
        top, square = self.ratio * self.weight, self.ratio * self.ratio
        for first, doc, bucket in indicators(texts):
            n = int(doc[-1]) + 1 if len(doc) else 0
            size = np.sqrt(np.bincount(doc, weights=square[bucket], minlength=n))
            margin[first : first + n] = np.bincount(doc, weights=top[bucket], minlength=n) / np.where(size > 0, size, 1.0)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (margin + self.bias) + self.offset, -500, 500)))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 10, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and bias of least |w|^2 / 2 + cost * hinge losses, over indicators scaled by ratio and rows scaled to length 1. Each step settles one row's dual variable exactly within 0 and cost; rounds end early when no variable moves."""
    weight, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    sizes = [float(np.sqrt((ratio[r] ** 2).sum())) or 1.0 for r in rows]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = ratio[r] / sizes[i]
            gradient = y[i] * (x @ weight[r] + bias) - 1.0
            to = min(max(alpha[i] - gradient / (x @ x + 1.0), 0.0), cost)
            step = (to - alpha[i]) * y[i]
            if step:
                weight[r] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = to
        if moved < 1e-3 * cost:
            break
    return weight, bias


def logistic_scale(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that tells good rows by margin, towards targets a little inside 0 and 1, by Newton steps; slopes stay positive."""
    n1, n0 = good.sum(), (~good).sum()
    t = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, 0.0
    loss = lambda a, b: np.logaddexp(0, a * margin + b).sum() - (t * (a * margin + b)).sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        v = p * (1 - p) + 1e-12
        h = np.array([[(v * margin * margin).sum() + 1e-9, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-9]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(slope - size * step[0], offset - size * step[1]) > loss(slope, offset):
            size /= 2
        slope, offset = slope - size * step[0], offset - size * step[1]
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(slope), 1e-6), float(offset)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's rows by class (bucket -1) and rows with each n-gram by class."""
    n, grams = np.zeros(2, dtype=np.int64), np.zeros((2, BUCKETS), dtype=np.int64)
    for f in batches:
        good = f["good"].to_numpy(dtype=np.int64)
        n += np.bincount(good, minlength=2)
        for first, doc, bucket in indicators(f["text"].tolist()):
            grams += np.bincount(good[first + doc] * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, BUCKETS)
    some = np.flatnonzero(grams.any(axis=0))
    yield pd.DataFrame({"bucket": np.concatenate([[-1], some]), "bad": np.concatenate([n[:1], grams[0, some]]), "good": np.concatenate([n[1:], grams[1, some]])})


def _taken_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with their n-grams as packed buckets instead of their texts."""
    for f in batches:
        told = [b""] * len(f)
        for first, doc, bucket in indicators(f["text"].tolist()):
            ends = np.searchsorted(doc, np.arange(int(doc[-1]) + 2 if len(doc) else 0))
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                told[first + i] = bucket[a:b].astype("<i4").tobytes()
        yield pd.DataFrame({"key": f["key"], "good": f["good"], "grams": told})


def fit(labelled: DataFrame, text_col: str, good: Column, least: float = 1.0, cost: float = 1.0, blend: float = 0.25, sample_rows: int = SAMPLE_ROWS, sample_grams: int = SAMPLE_GRAMS) -> Model:
    """A model of which rows are good: 1 or 0; rows where that is null teach nothing.

    Log-count ratios are of all rows, least added to each count. The hinge-loss model takes the rows whose hash lies below a
    bound that leaves about sample_rows rows and sample_grams n-grams, whatever the corpus; one task fits it, and its weights are
    drawn towards their mean size: blend of them is their own. Rows are ordered by hash before, so runs agree. Repeated rows teach as
    often as they stand there; null and empty texts have no n-grams and move the bias only; without rows of both classes the
    model gives every text the same score. Other columns play no part.
    """
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), good.cast("int").alias("good"), F.xxhash64(F.col(f"`{text_col}`"), F.lit(3)).alias("key")).where("good in (0, 1)")
    counts = rows.select("text", "good").mapInPandas(_counts, "bucket int, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    table = counts[counts["bucket"] >= 0]
    n0, n1 = (int(counts.loc[counts["bucket"] < 0, c].sum()) for c in ("bad", "good"))
    bad, well = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bad[table["bucket"]], well[table["bucket"]] = table["bad"], table["good"]
    constant = np.log((bad + least).sum()) - np.log((well + least).sum())
    ratio = np.log(well + least) - np.log(bad + least) + constant
    share = (n1 + 1) / (n0 + n1 + 2)
    if not n0 or not n1:
        return Model(share, ratio, np.zeros(BUCKETS))
    part = min(1.0, sample_rows / (n0 + n1), sample_grams / max(1.0, bad.sum() + well.sum()))
    bound = int(part * 2**63) - 1

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(batches) or [pd.DataFrame({"key": [], "good": [], "grams": []})]).sort_values(["key", "good", "grams"])
        grams, y = [np.frombuffer(g, dtype="<i4") for g in f["grams"]], np.where(f["good"].to_numpy() == 1, 1.0, -1.0)
        n = len(f)

        def blended(at: np.ndarray) -> tuple[np.ndarray, float]:
            weight, bias = dual_descent([grams[i] for i in at], y[at], ratio, cost)
            return (1 - blend) * np.abs(weight).mean() + blend * weight, bias * blend

        margin = np.zeros(n)
        for fold in range(FOLDS):
            own = np.arange(n) % FOLDS == fold
            weight, bias = blended(np.flatnonzero(~own))
            for i in np.flatnonzero(own):
                g, one = grams[i], (y[i] > 0, y[i] < 0)
                unseen = np.log(well[g] + least - one[0]) - np.log(bad[g] + least - one[1]) + constant
                margin[i] = unseen @ weight[g] / (float(np.sqrt((unseen**2).sum())) or 1.0) + bias
        slope, offset = logistic_scale(margin, y > 0)
        weight, bias = blended(np.arange(n))
        yield pd.DataFrame({"weight": [weight.tolist()], "bias": [bias], "slope": [slope], "offset": [offset]})

    sample = rows.where(F.shiftrightunsigned("key", 1) <= bound).select("key", "good", "text").mapInPandas(_taken_apart, "key long, good int, grams binary")
    found = sample.repartition(1).mapInPandas(fitted, "weight array<double>, bias double, slope double, offset double").head()
    return Model(share, ratio, np.array(found["weight"]), found["bias"], found["slope"], found["offset"])


def scorer(model: Model):
    """A column function: texts to scores from 0 to 1. Null and empty texts have a score too, that of no n-grams."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = texts.tolist()
            yield pd.Series(np.concatenate([np.zeros(0), *[model.scores(known[k : k + _PART]) for k in range(0, len(known), _PART)]]))

    return score


def classify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with each whole text's score in a column of a free name, score_column(df)."""
    return df.withColumn(score_column(df), scorer(model)(F.col(f"`{text_col}`").cast("string")))


def score_column(df: DataFrame) -> str:
    return free_name(df, "quality_score")
