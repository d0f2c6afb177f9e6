"""Repeated byte strings: a distributed merge sort of sampled suffixes that never compares a known common prefix again.

Every 50-byte string has one anchor: the leftmost of its 12-byte strings with the least hash. Equal strings have equal
anchors, so only suffixes at anchors (about one position in twenty) are sorted; with each goes the text before it that its
strings need. Documents are dealt to runs by hash. A run sorts its suffixes, equal ones once with their smallest document,
cuts the order at range bounds and sends each range front-coded. A range joins its parts in a loser tree of strings whose
common prefixes with the last output are known, finds for each string its smallest document, and tells runs what they cannot
know. Runs then mark their bytes. Copies of whole texts are set aside first, so a text of many copies goes through once.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, SEED = 50, 12  # the seed has 8 to 16 bytes
_SPAN = WIDTH - SEED + 1  # anchors that one string has to choose from
_LEFT = _SPAN - 1
RUN_BYTES = 8 << 20
ENTRIES_IN_RANGE = 200_000
#: Documents that range bounds are drawn from, and suffixes, at most about.
SAMPLE_DOCS, SAMPLE_KEYS = 4_000, 50_000
_CHUNK = 1 << 20
_WORDS = (WIDTH + 1 + _LEFT + 1 + 7) // 8


def _loads(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; raw ends with seven bytes more."""
    out = np.empty(len(raw) - 7, dtype="<u8")
    for k in range(8):
        part = np.frombuffer(raw[k : k + (len(raw) - k) // 8 * 8].tobytes(), dtype="<u8")
        out[k::8] = part[: len(out[k::8])]
    return out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' joined bytes: those bytes, and for each anchor its position and the first and last start of the strings that have it. Strings lie within one text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(texts) + bytes(64), dtype=np.uint8)
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    none = np.zeros(0, dtype=np.int64)
    if n < WIDTH:
        return raw[:n], none, none, none
    inside = np.zeros(n + 1, dtype=np.int8)
    long = lengths >= WIDTH
    np.add.at(inside, (ends - lengths)[long], 1)
    np.add.at(inside, (ends - WIDTH + 1)[long], -1)
    owners, starts = [], []
    level = 0
    for low in range(0, n - WIDTH + 1, _CHUNK):  # in pieces, so that the numbers of all positions never stand in memory together
        high = min(low + _CHUNK, n - WIDTH + 1)
        words = _loads(raw[low : high + _SPAN + 24])
        size = high - low + _SPAN - 1
        h = words[:size] * np.uint64(0x9E3779B97F4A7C15) + words[SEED - 8 : SEED - 8 + size] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        least = (h >> np.uint64(40) << np.uint64(40)) | np.arange(low, low + size, dtype=np.uint64)  # ties go to the left
        done = 1
        while done < _SPAN:
            step = min(done, _SPAN - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        own = np.cumsum(inside[low:high], dtype=np.int32) + level
        level = int(own[-1])
        own = np.flatnonzero(own)
        at = (least[own] & np.uint64((1 << 40) - 1)).astype(np.int64)
        turn = np.r_[True, (at[1:] != at[:-1]) | (own[1:] != own[:-1] + 1)] if len(own) else np.zeros(0, bool)
        owners.append(at[turn])
        starts.append(np.stack([own[turn], np.r_[own[np.flatnonzero(turn)[1:] - 1], own[-1:]]]) + low if len(own) else np.zeros((2, 0), np.int64))
    owner, (first, last) = np.concatenate(owners), np.concatenate(starts, axis=1)
    new = np.r_[True, (owner[1:] != owner[:-1]) | (first[1:] != last[:-1] + 1)] if len(owner) else np.zeros(0, bool)
    return raw[:n], owner[new], first[new], last[np.r_[np.flatnonzero(new)[1:] - 1, len(owner) - 1]] if len(owner) else none


def sorted_rows(words: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian words: by the first two, and by the others only where those are equal."""
    first, second = words[:, 0].astype(np.uint64), words[:, 1].astype(np.uint64)
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    tied = np.r_[False, (first[1:] == first[:-1]) & (second[1:] == second[:-1])] if len(order) else np.zeros(0, bool)
    group = np.cumsum(~tied)
    tied[:-1] |= tied[1:]
    some = np.flatnonzero(tied)
    rest = words[order[some]]
    order[some] = order[some[np.lexsort([*(rest[:, w].astype(np.uint64) for w in range(rest.shape[1] - 1, 1, -1)), group[some]])]]
    return order


class Run:
    """The sorted distinct suffixes of some documents, with where each occurs."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids, self.lengths = ids, np.array([len(t) for t in texts], dtype=np.int64)
        self.raw, at, low, high = anchors(texts)
        self.ends = np.cumsum(self.lengths)
        m = len(at)
        right, left = high + WIDTH - at, at - low
        key = np.zeros((m, 8 * _WORDS), dtype=np.uint8)
        padded = np.concatenate([np.zeros(_LEFT, np.uint8), self.raw, np.zeros(WIDTH, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view
        key[:, :WIDTH] = rows(padded, WIDTH)[at + _LEFT]
        key[:, :WIDTH] *= np.arange(WIDTH) < right[:, None]
        key[:, WIDTH] = right
        key[:, WIDTH + 1 : WIDTH + 1 + _LEFT] = rows(padded, _LEFT)[at][:, ::-1]  # backwards from the anchor
        key[:, WIDTH + 1 : WIDTH + 1 + _LEFT] *= np.arange(_LEFT) < left[:, None]
        key[:, WIDTH + 1 + _LEFT] = left
        words = key.view(">u8")
        order = sorted_rows(words)
        words = words[order]
        new = np.r_[True, (words[1:] != words[:-1]).any(axis=1)] if m else np.zeros(0, bool)
        self.of = np.empty(m, dtype=np.int64)  # each occurrence's entry
        self.of[order] = np.cumsum(new) - 1
        self.at, self.low, self.high = at, low, high
        self.key = key[order][new]
        self.doc = ids[np.searchsorted(self.ends, at, side="right")] if m else np.zeros(0, np.int64)
        self.least = np.minimum.reduceat(self.doc[order], np.flatnonzero(new)) if m else np.zeros(0, np.int64)

    def parts(self, bounds: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """The entries of each range, front-coded."""
        seeds = self.key[:, :SEED].tobytes()
        n, cuts = len(self.key), []
        for b in bounds:
            low, high = cuts[-1] if cuts else 0, n
            while low < high:
                mid = (low + high) // 2
                if seeds[mid * SEED : mid * SEED + SEED] < b:
                    low = mid + 1
                else:
                    high = mid
            cuts.append(low)
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, n], strict=True)):
            if a < b:
                yield k, front_coded(self.key[a:b], self.least[a:b], a)

    def removed(self, answers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Which bytes go, from what the run knows itself and from answers (entry, least and greatest distance of a string's start before the anchor, document)."""
        mark = np.zeros(len(self.raw) + 1, dtype=np.int32)

        def cover(start: np.ndarray, stop: np.ndarray) -> None:
            np.add.at(mark, start, 1)
            np.add.at(mark, stop, -1)

        own = self.doc > self.least[self.of] if len(self.of) else np.zeros(0, bool)
        cover(self.low[own], self.high[own] + WIDTH)
        entry, near, far, doc = answers
        if len(entry):
            order = np.argsort(self.of, kind="stable")
            first = np.searchsorted(self.of[order], entry)
            times = np.searchsorted(self.of[order], entry, side="right") - first
            each = np.repeat(np.arange(len(entry)), times)
            where = order[np.repeat(first, times) + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)]
            hit = self.doc[where] > doc[each]
            where, each = where[hit], each[hit]
            cover(self.at[where] - far[each], self.at[where] - near[each] + WIDTH)
        return np.cumsum(mark)[:-1] > 0


_HEAD = struct.Struct("<qq")


def common_prefixes(key: np.ndarray) -> np.ndarray:
    """Of each row's suffix with that of the row before; 0 for the first."""
    if not len(key):
        return np.zeros(0, np.int64)
    same = np.concatenate([key[1:, :WIDTH] == key[:-1, :WIDTH], np.zeros((len(key) - 1, 1), bool)], axis=1)
    shorter = np.minimum(key[1:, WIDTH], key[:-1, WIDTH])
    return np.r_[0, np.minimum(same.argmin(axis=1), shorter)].astype(np.int64)


def front_coded(key: np.ndarray, doc: np.ndarray, first: int) -> bytes:
    """Sorted entries, each suffix without the prefix that it shares with the one before."""
    shared, right, left = common_prefixes(key), key[:, WIDTH], key[:, WIDTH + 1 + _LEFT]
    col = np.arange(WIDTH)
    rest = key[:, :WIDTH][(col >= shared[:, None]) & (col < right[:, None])]
    before = key[:, WIDTH + 1 : WIDTH + 1 + _LEFT][np.arange(_LEFT) < left[:, None]]
    raw = _HEAD.pack(len(key), first) + shared.astype(np.uint8).tobytes() + right.tobytes() + left.tobytes() + doc.astype("<i8").tobytes() + rest.tobytes() + before.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(raw)


def front_decoded(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The entries, their documents, their known common prefixes, and the first one's number."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, first = _HEAD.unpack_from(raw)
    data = np.frombuffer(raw, dtype=np.uint8, offset=_HEAD.size)
    shared, right, left = (data[k * n : (k + 1) * n] for k in range(3))
    doc = np.frombuffer(raw, dtype="<i8", count=n, offset=_HEAD.size + 3 * n)
    key = np.zeros((n, 8 * _WORDS), dtype=np.uint8)
    col = np.arange(WIDTH)
    told = (col >= shared[:, None]) & (col < right[:, None])
    at = 11 * n
    key[:, :WIDTH][told] = data[at : at + int(told.sum())]
    at += int(told.sum())
    rows = np.arange(n)
    for k in range(WIDTH):  # a byte not told is that of the last row that told it
        key[:, k] = np.where(k < right, key[np.maximum.accumulate(np.where(shared <= k, rows, 0)), k], 0)
    key[:, WIDTH], key[:, WIDTH + 1 + _LEFT] = right, left
    key[:, WIDTH + 1 : WIDTH + 1 + _LEFT][np.arange(_LEFT) < left[:, None]] = data[at:]
    return key, doc, shared.astype(np.int64), first


def merged(keys: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """The stream of each output, and its common prefix with the output before, from sorted streams with theirs.

    A loser tree. Each stream's head knows its common prefix with the last output. The longer one wins unseen; only if two
    are as long are bytes compared, from there on, and the loser keeps how far they agreed.
    """
    k = 1 << max(0, (len(keys) - 1).bit_length())
    head: list[bytes] = [s[0] if s else b"" for s in keys] + [b""] * (k - len(keys))
    known = [0 if s else -1 for s in keys] + [-1] * (k - len(keys))
    position, size = [0] * k, [len(s) for s in keys] + [0] * (k - len(keys))
    tree = [0] * k
    from_bytes = int.from_bytes

    def play(a: int, b: int) -> tuple[int, int]:
        """The winner and the loser."""
        h = known[a]
        if h != known[b]:
            return (a, b) if h > known[b] else (b, a)
        if h < 0:
            return a, b
        x, y = head[a][h:], head[b][h:]
        n = min(len(x), len(y))
        differ = from_bytes(x[:n]) ^ from_bytes(y[:n])
        agreed = h + (n - (differ.bit_length() + 7) // 8 if differ else n)
        if x <= y:
            known[b] = agreed
            return a, b
        known[a] = agreed
        return b, a

    row = list(range(k))
    while len(row) > 1:  # the first round, level by level
        up = []
        for i in range(0, len(row), 2):
            win, lose = play(row[i], row[i + 1])
            tree[(k >> (k // len(row)).bit_length()) + i // 2] = lose
            up.append(win)
        row = up
    winner, stream, prefix = row[0], [], []
    put, told = stream.append, prefix.append
    while known[winner] >= 0:
        put(winner)
        told(known[winner])
        at = position[winner] = position[winner] + 1
        if at < size[winner]:
            head[winner] = keys[winner][at]
            known[winner] = shared[winner][at]
        else:
            known[winner] = -1
        node = (winner + k) >> 1
        while node:
            other = tree[node]
            h, g = known[winner], known[other]
            if g > h:
                tree[node] = winner
                winner = other
            elif g == h and h >= 0:
                win, lose = play(winner, other)
                tree[node] = lose
                winner = win
            node >>= 1
    return stream, prefix


def smallest_documents(key: np.ndarray, doc: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted entries: each (entry, distance of a string's start before the anchor, document) where another entry's smaller document has the same string."""
    n = len(key)
    right, left = key[:, WIDTH].astype(np.int64), key[:, WIDTH + 1 + _LEFT].astype(np.int64)
    near = np.r_[prefix[1:], 0] >= SEED
    near |= prefix >= SEED
    some = np.flatnonzero(near)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    factor = np.uint64(0x9E3779B97F4A7C15)
    before = np.zeros(n, dtype=np.uint64)
    for far in range(_LEFT + 1):
        if far:
            before = (before + key[:, WIDTH + far].astype(np.uint64) + np.uint64(1)) * factor
        group = np.cumsum(prefix < WIDTH - far)
        own = some[(right[some] >= WIDTH - far) & (left[some] >= far)]
        if len(own) < 2:
            continue
        g = group[own]
        same = np.r_[False, g[1:] == g[:-1]]
        same |= np.r_[same[1:], False]
        own, g = own[same], g[same]
        todo, salt = [(own, g)], np.uint64(1)
        while todo:
            own, g = todo.pop()
            if len(own) < 2:
                continue
            mixed = (g.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (before[own] * salt)
            order = np.argsort(mixed, kind="stable")
            own, g, mixed = own[order], g[order], mixed[order]
            new = np.r_[True, mixed[1:] != mixed[:-1]]
            first = own[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
            equal = (group[first] == g) & (key[own, WIDTH + 1 : WIDTH + 1 + far] == key[first, WIDTH + 1 : WIDTH + 1 + far]).all(axis=1)
            if not equal.all():  # hashes met that are of other strings: those go round again among themselves
                todo.append((own[~equal], g[~equal]))
                own, new = own[equal], new[equal]
            least = np.minimum.reduceat(doc[own], np.flatnonzero(new))[np.cumsum(new) - 1]
            hit = least < doc[own]
            if hit.any():
                found.append((own[hit], np.full(int(hit.sum()), far, dtype=np.int64), least[hit]))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_ANSWER = np.dtype([("entry", "<u4"), ("near", "u1"), ("far", "u1"), ("doc", "<i8")])


def answers(runs: list[int], blobs: list[bytes]) -> list[tuple[int, bytes]]:
    """One range: joins the runs' parts and tells each run the smaller documents of its entries' strings."""
    decoded = [front_decoded(b) for b in blobs]
    lists, shared = [], []
    for key, _, known, _ in decoded:
        raw, right = key[:, :WIDTH].tobytes(), key[:, WIDTH].tolist()
        lists.append([raw[WIDTH * i : WIDTH * i + r] for i, r in enumerate(right)])
        shared.append(known.tolist())
    stream, prefix = (np.array(x, dtype=np.int64) for x in merged(lists, shared))
    del lists, shared
    sizes = np.array([len(d[0]) for d in decoded])
    rank = np.empty(len(stream), dtype=np.int64)  # each output's place in its stream
    order = np.argsort(stream, kind="stable")
    rank[order] = np.arange(len(stream)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    source = (np.cumsum(sizes) - sizes)[stream] + rank
    key, doc = np.concatenate([d[0] for d in decoded])[source], np.concatenate([d[1] for d in decoded])[source]
    entry, far, least = smallest_documents(key, doc, prefix)
    order = np.lexsort((far, entry))
    entry, far, least = entry[order], far[order], least[order]
    new = np.r_[True, (entry[1:] != entry[:-1]) | (far[1:] != far[:-1] + 1) | (least[1:] != least[:-1])] if len(entry) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    stop = np.r_[start[1:], len(entry)] - 1 if len(start) else start
    rows = np.zeros(len(start), dtype=_ANSWER)
    firsts = np.array([d[3] for d in decoded], dtype=np.int64)
    of = stream[entry[start]] if len(start) else start
    rows["entry"], rows["near"], rows["far"], rows["doc"] = firsts[of] + rank[entry[start]] if len(start) else 0, far[start], far[stop] if len(start) else 0, least[start]
    compress = zstandard.ZstdCompressor(level=3).compress
    return [(runs[s], compress(rows[of == s].tobytes())) for s in np.unique(of).tolist()]


def _bytes(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _run_of(f: pd.DataFrame, first: set) -> tuple[Run, pd.DataFrame]:
    """The run of a group's documents that stand for their text, in a fixed order, and those documents."""
    f = f[[x in first for x in zip(f["id"], f["same"], strict=True)]].drop_duplicates(["id", "same"]).sort_values(["id", "same"], kind="stable")
    return Run(f["id"].to_numpy(dtype=np.int64), _bytes(f["text"])), f


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES, entries_in_range: int = ENTRIES_IN_RANGE) -> DataFrame:
    """Per row of df: id, n_bytes, n_removed, n_spans and kept (the bytes that stay).

    A byte goes if it is covered by a 50-byte string that also starts in a row with a smaller id. Null texts are empty;
    texts below 50 bytes stay; rows with equal ids take nothing from each other; rows without an id neither lose bytes nor
    take any. Strings never cross rows and are those of the input. An empty table gives an empty table.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    docs = docs.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), "text", F.sha2("text", 256).alias("same"))
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).head()
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = max(parallel, math.ceil((size or 0) / run_bytes))
    ranges = max(parallel, math.ceil((size or 0) / ((_SPAN + 1) / 2) / entries_in_range))
    docs = docs.withColumn("run", F.pmod(F.xxhash64("id", "same"), F.lit(runs)).cast("int"))
    firsts = docs.where("not no_id").where(F.octet_length("text") >= WIDTH).groupBy("same").agg(F.min("id").alias("id"))
    firsts = firsts.select(F.pmod(F.xxhash64("id", "same"), F.lit(runs)).cast("int").alias("run"), F.col("id").alias("first_id"), F.concat("same", F.lit("")).alias("first_same"))
    bounds = _bounds(docs, count, ranges)

    def send(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        run, _ = _run_of(left[~left["no_id"]], set(zip(right["first_id"], right["first_same"], strict=True)) if len(right) else set())
        return pd.DataFrame([(int(group[0]), k, blob) for k, blob in run.parts(bounds)], columns=["run", "range", "part"])

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("run")
        return pd.DataFrame(answers([int(r) for r in f["run"]], [bytes(b) for b in f["part"]]), columns=["run", "told"])

    def finish(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = right[right["told"].isna()] if len(right) else right
        run, own = _run_of(left[~left["no_id"]], set(zip(names["first_id"], names["first_same"], strict=True)) if len(names) else set())
        told = [np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(b)), dtype=_ANSWER) for b in (right["told"] if len(right) else []) if b is not None]
        told = np.concatenate(told) if told else np.zeros(0, dtype=_ANSWER)
        gone = run.removed((told["entry"].astype(np.int64), told["near"].astype(np.int64), told["far"].astype(np.int64), told["doc"]))
        at, kept = 0, {}
        for key, n in zip(zip(own["id"], own["same"], strict=True), run.lengths.tolist(), strict=True):
            g = gone[at : at + n]
            kept[key] = (int(g.sum()), int((g & ~np.r_[False, g[:-1]]).sum()), run.raw[at : at + n][~g].tobytes())
            at += n
        out = []
        for i, no_id, same, raw in zip(left["id"], left["no_id"], left["same"], _bytes(left["text"]), strict=True):
            gone_all = (len(raw), 1, b"") if len(raw) >= WIDTH and not no_id else (0, 0, raw)
            out.append((None if no_id else int(i), len(raw), *(gone_all if no_id or (i, same) not in kept else kept[i, same])))
        return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"id": "Int64"})

    # Both steps read the documents by run, so Spark shuffles them once.
    parts = docs.groupBy("run").cogroup(firsts.groupBy("run")).applyInPandas(send, "run int, range int, part binary")
    told = parts.groupBy("range").applyInPandas(join, "run int, told binary")
    told = firsts.withColumn("told", F.lit(None).cast("binary")).unionByName(told.select("run", F.lit(0).cast("long").alias("first_id"), F.lit("").alias("first_same"), "told"))
    out = docs.groupBy("run").cogroup(told.groupBy("run")).applyInPandas(finish, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def _bounds(docs: DataFrame, count: int, ranges: int) -> list[bytes]:
    """First bytes that cut the suffixes into ranges of about equal numbers, from the suffixes of some documents. Bounds change the balance, never the result."""
    some = docs.where(F.pmod(F.xxhash64("same", F.lit("bounds")), F.lit(max(1, math.ceil(count / SAMPLE_DOCS)))) == 0).select("same", "text")
    share = max(1, math.ceil(SAMPLE_DOCS * 300 / SAMPLE_KEYS))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw, at, _, _ = anchors(_bytes(b["text"]))
            drawn = [bytes(raw[a : a + SEED]) for a in at.tolist()]
            drawn = [x for x in drawn if hashlib.blake2b(x, digest_size=2).digest()[0] % min(share, 256) == 0]
            yield pd.DataFrame({"seed": drawn})

    found = sorted(set(map(bytes, some.select("text").mapInPandas(keys, "seed binary").distinct().toPandas()["seed"])))
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []
