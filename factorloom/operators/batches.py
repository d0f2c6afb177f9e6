"""Windows along histories and cross-sections of dates in Arrow batches: one shuffle and one sort by key, then NumPy runs over whole groups.

A batch is cut where its last group starts, and what is left waits for the next one. So a task holds one batch and one group, whatever the table's
size, and many short histories share a call. A window of d rows is missing unless all d values are there, at consecutive ordinals; a row without
an ordinal has none. Missing is NaN. Sums run from the oldest row on, as Spark's do. Rows of one key have different ordinals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import nullcontext
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.operators.names import free


def _changes(keys: pa.Array) -> np.ndarray:
    """Where a key differs from the one before it; a null is a key too."""
    none = keys.is_null().to_numpy(zero_copy_only=False)
    return pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False) | (none[1:] != none[:-1])


def whole(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key)
        if held and _changes(pa.concat_arrays([held[-1].column(key)[-1:], keys[:1]])).any():
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.flatnonzero(_changes(keys))
        if len(cuts):
            cut = int(cuts[-1]) + 1
            yield pa.Table.from_batches([*held, b[:cut]])
            held = [b[cut:]]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


class Groups:
    """Whole groups, one after the other, each in the order of its ordinals."""

    def __init__(self, new: np.ndarray, at: np.ndarray):
        places = np.arange(len(at))
        self.at, self.starts, self.group = at, np.flatnonzero(new), np.cumsum(new) - 1
        broken = new | np.isnan(at) | np.r_[True, np.diff(at) != 1] if len(at) else new
        #: Rows before this one at consecutive ordinals; -1 without an ordinal.
        self.run = np.where(np.isnan(at), -1, places - np.maximum.accumulate(np.where(broken, places, 0)))
        self.gaps = bool((broken & ~new).any())

    def each(self, function: Callable[..., np.ndarray], *arrays: np.ndarray) -> np.ndarray:
        """A function of one group, for all of them."""
        ends = np.r_[self.starts[1:], len(self.at)]
        return np.concatenate([function(*(a[i:j] for a in arrays)) for i, j in zip(self.starts, ends, strict=True)])


Window = Callable[..., np.ndarray]


def _back(x: np.ndarray, k: int) -> np.ndarray:
    return x if not k else np.r_[np.full(min(k, len(x)), np.nan), x[: max(len(x) - k, 0)]]


def _oldest_first(x: np.ndarray, d: int) -> Iterator[np.ndarray]:
    padded = np.concatenate([np.full(d - 1, np.nan), x])
    return (padded[k : k + len(x)] for k in range(d))


def _full(g: Groups, d: int, value: np.ndarray) -> np.ndarray:
    return np.where(g.run >= d - 1, value, np.nan)


def delay(g: Groups, x: np.ndarray, d: int) -> np.ndarray:
    if not g.gaps:
        return np.where(g.run >= d, _back(x, d), np.nan)
    low, high = np.nanmin(g.at), np.nanmax(g.at)
    own = ~np.isnan(g.at)
    code = g.group * (high - low + 2 + d) + np.where(own, g.at - low, high - low + 1)
    place = np.minimum(np.searchsorted(code, code - d), len(code) - 1)
    return np.where(own & (code[place] == code - d), x[place], np.nan)


def weighted(g: Groups, x: np.ndarray, weights: list[float]) -> np.ndarray:
    """Weights of the oldest row first."""
    total = np.zeros(len(x))
    for w, y in zip(weights, _oldest_first(x, len(weights)), strict=True):
        total += y if w == 1.0 else y * w
    return _full(g, len(weights), total)


def product(g: Groups, x: np.ndarray, d: int) -> np.ndarray:
    out = np.ones(len(x))
    for y in _oldest_first(x, d):
        out *= y
    return _full(g, d, out)


def extreme(g: Groups, x: np.ndarray, d: int, least: bool) -> np.ndarray:
    """The least or greatest value, by windows of doubled length."""
    f, width = np.minimum if least else np.maximum, 1
    while width < d:
        step = min(width, d - width)
        x, width = f(x, _back(x, step)), width + step
    return _full(g, d, x)


def flat(g: Groups, x: np.ndarray, d: int) -> np.ndarray:
    return extreme(g, x, d, True) == extreme(g, x, d, False)


def covariance(g: Groups, x: np.ndarray, y: np.ndarray, d: int) -> np.ndarray:
    """Of a sample, by updated means."""
    mx, my, c = (np.zeros(len(x)) for _ in range(3))
    for n, (a, b) in enumerate(zip(_oldest_first(x, d), _oldest_first(y, d), strict=True), 1):
        dx = a - mx
        mx += dx / n
        my += (b - my) / n
        dx *= b - my
        c += dx
    return _full(g, d, c / (d - 1))


def deviation(g: Groups, x: np.ndarray, d: int) -> np.ndarray:
    """Of a sample; exactly 0 on a constant window."""
    mean, m2 = np.zeros(len(x)), np.zeros(len(x))
    for n, a in enumerate(_oldest_first(x, d), 1):
        off = a - mean
        part = off / n
        mean += part
        np.subtract(off, part, out=part)
        part *= off
        m2 += part
    return np.where(flat(g, x, d), 0.0, _full(g, d, np.sqrt(m2 / (d - 1))))


def correlation(g: Groups, x: np.ndarray, y: np.ndarray, d: int) -> np.ndarray:
    """Pearson, 0 if a side is constant, within -1 and 1. One pass for the means of both sides, with what `covariance` and `deviation` add up."""
    mx, my, c, vx, vy = (np.zeros(len(x)) for _ in range(5))
    for n, (a, b) in enumerate(zip(_oldest_first(x, d), _oldest_first(y, d), strict=True), 1):
        dx, dy = a - mx, b - my
        for off, mean, square in ((dx, mx, vx), (dy, my, vy)):
            part = off / n
            mean += part
            np.subtract(off, part, out=part)
            part *= off
            square += part
        np.subtract(b, my, out=dy)
        dy *= dx
        c += dy
    lx, ly = extreme(g, x, d, True), extreme(g, y, d, True)
    constant = (lx == extreme(g, x, d, False)) | (ly == extreme(g, y, d, False))
    spread = np.sqrt(vx / (d - 1)) * np.sqrt(vy / (d - 1))
    r = _full(g, d, np.clip(c / (d - 1) / np.where(spread == 0, np.nan, spread), -1.0, 1.0))
    return np.where(~np.isnan(lx + ly) & constant, 0.0, r)


def place_in_window(g: Groups, x: np.ndarray, d: int) -> np.ndarray:
    """The newest value's percentile, ties averaged."""
    less, same = (np.zeros(len(x), np.int8 if d < 128 else np.int32) for _ in range(2))
    for y in _oldest_first(x, d):
        less += y < x
        same += y == x
    return np.where(np.isnan(extreme(g, x, d, True)), np.nan, (less + (same.astype(float) + 1) / 2) / d)


def first_place(g: Groups, x: np.ndarray, d: int, least: bool, latest: bool = False) -> np.ndarray:
    """The place of the first extreme, or of the latest, from 1 at the oldest row."""
    best, place = None, np.ones(len(x))
    for k, y in enumerate(_oldest_first(-x if least else x, d), 1):
        if best is None:
            best = y
            continue
        beats = y >= best if latest else y > best
        best, place = np.where(beats, y, best), np.where(beats, float(k), place)
    return np.where(np.isnan(extreme(g, x, d, True)), np.nan, place)


def scatter(g: Groups, x: np.ndarray, d: int) -> np.ndarray:
    """The mean absolute deviation from the window's mean."""
    mean, total = weighted(g, x, [1.0] * d) / d, np.zeros(len(x))
    for y in _oldest_first(x, d):
        total += np.abs(y - mean)
    return _full(g, d, total / d)


def rank_present(x: np.ndarray) -> np.ndarray:
    """Percentiles in one group among the values that are there, ties averaged."""
    n, order, out = len(x) - int(np.isnan(x).sum()), np.argsort(x), np.full(len(x), np.nan)  # what is missing sorts last
    if n:
        v = x[order[:n]]
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        after = np.r_[first[1:], n]
        out[order[:n]] = np.repeat((first + after + 1) / 2 / n, after - first)
    return out


def mean_present(x: np.ndarray) -> np.ndarray:
    """One group's mean of the values that are there, on all its rows."""
    v = x[~np.isnan(x)]
    return np.full(len(x), v.sum() / len(v) if len(v) else np.nan)


def share(x: np.ndarray) -> np.ndarray:
    """Of one group's sum of absolute values."""
    total = np.nansum(np.abs(x))
    return x / total if total else np.full(len(x), np.nan)


def off_mean(x: np.ndarray, part: np.ndarray) -> np.ndarray:
    """In one group, less the mean of the row's part."""
    _, part = np.unique(part, return_inverse=True)
    has = ~np.isnan(x)
    n = np.bincount(part, weights=has)
    return x - (np.bincount(part, weights=np.where(has, x, 0.0)) / np.where(n == 0, np.nan, n))[part]


def _numbers(table: pa.Table, c: str) -> np.ndarray:
    return np.asarray(table[c].to_numpy(), dtype=float)


def _new(table: pa.Table, key: str) -> np.ndarray:
    return np.r_[True, _changes(table[key].combine_chunks() if table[key].num_chunks != 1 else table[key].chunk(0))]


#: Rows that runs see at once, about.
AT_ONCE = 1 << 13


class Work:
    """What a stage makes of a table of whole groups: runs (name: function and the names of its inputs) after one another, and the columns it passes on."""

    def __init__(self, runs: dict[str, tuple[Window, list[str]]], kept: list[str], infinite: Iterable[str] = (), inner: Iterable[str] = ()):
        self.runs, self.kept, self.unbound, self.inner = runs, kept, frozenset(infinite), frozenset(inner)
        self.passed = [name for name in runs if name not in self.inner]
        self.last = {c: name for name, (_, inputs) in runs.items() for c in inputs}

    def of(self, table: pa.Table, key: str, order: str) -> pa.Table:
        """Missing results are NaN. Some groups at a time, so that their arrays stay in the processor's cache."""
        new = _new(table, key)
        starts = np.flatnonzero(new)
        cuts = [0]
        for i in starts[np.searchsorted(starts, np.arange(AT_ONCE, len(table), AT_ONCE))[: len(starts)].clip(max=len(starts) - 1)].tolist():
            if i > cuts[-1]:
                cuts.append(i)
        told: dict[str, list[np.ndarray]] = {name: [] for name in self.passed}
        for i, j in zip(cuts, [*cuts[1:], len(table)], strict=True):
            for name, made in self._made(table.slice(i, j - i), new[i:j], order):
                told[name].append(made)
        return pa.table([*table.select(self.kept).columns, *(pa.array(np.concatenate(x), pa.float64()) for x in told.values())], names=[*self.kept, *self.passed])

    def _made(self, table: pa.Table, new: np.ndarray, order: str) -> Iterator[tuple[str, np.ndarray]]:
        groups, arrays = Groups(new, _numbers(table, order)), {}
        with np.errstate(all="ignore"):
            for name, (function, inputs) in self.runs.items():
                for c in inputs:
                    if c not in arrays:
                        arrays[c] = _numbers(table, c)
                made = function(groups, *(arrays[c] for c in inputs))
                arrays[name] = made = made if name in self.unbound else np.where(np.isfinite(made), made, np.nan)
                if name not in self.inner:
                    yield name, made
                for c in {*inputs, name}:
                    if self.last.get(c, name) == name:
                        del arrays[c]


def _plain(table: pa.Table, made: Iterable[str]) -> Iterator[pa.RecordBatch]:
    """Batches for Spark, in which what was made is null where it is missing."""
    for c in made:
        table = table.set_column(table.column_names.index(c), c, pa.array(_numbers(table, c), pa.float64(), from_pandas=True))
    return iter(table.to_batches(max_chunksize=10_000))


def stage(df: DataFrame, key: str, order: str, runs: dict[str, tuple[Window, list[Column | str]]], keep: Iterable[str] | None = None, laid: bool = False, infinite: Iterable[str] = (), inner: Iterable[str] = ()) -> DataFrame:
    """df's columns (of keep, if given) with one for each run (name: function of groups and arrays, and what it reads: columns of df, or runs before it), in whole groups by key in the order of order.

    Runs that inner names serve later runs only. Infinite results are missing, but for the runs that infinite names.
    laid: df's partitions hold whole groups in that order already; it is not shuffled and sorted again.
    """
    kept = list(df.columns) if keep is None else [c for c in df.columns if c in set(keep)]
    read, extra = {}, {}
    for name, (_, inputs) in runs.items():
        read[name] = []
        for c in inputs:
            if not isinstance(c, str):
                extra[own := free(df, f"read_{len(extra)}")] = c.cast("double")
                c = own
            read[name].append(c)
    sent = [c for c in df.columns if c in {key, order, *kept, *(c for cs in read.values() for c in cs)}]
    rows = df.select(*[F.col(f"`{c}`") for c in sent], *[c.alias(n) for n, c in extra.items()])
    work = Work({name: (function, read[name]) for name, (function, _) in runs.items()}, kept, infinite, inner)  # what tasks need: no columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches, key):
            yield from _plain(work.of(table, key, order), work.passed)

    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in work.passed])
    return (rows if laid else _laid(rows, key, order)).mapInArrow(run, schema)


def _laid(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.repartition(F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`"), F.col(f"`{order}`").asc_nulls_last())


#: Rows of a block of histories, about; a block holds whole ones.
BLOCK = 1 << 17
#: Rows of one piece at most, and bytes of the pieces of one batch, about.
PIECE, SENT = 1 << 16, 1 << 23


def _blocks(batches: Iterable[pa.RecordBatch], key: str, block: str, size: int) -> Iterator[pa.Table]:
    """Tables of some whole groups, size rows or a little more each, with the number of the table among all tasks' tables in the column block. The rows of a task come in a fixed order, so a task that runs again numbers alike."""
    held, rows, n = [], 0, TaskContext.get().partitionId() << 32

    def numbered() -> pa.Table:
        table = pa.concat_tables(held).combine_chunks()
        return table.append_column(block, pa.array(np.full(len(table), n, np.int64)))

    for table in whole(batches, key):
        held.append(table)
        rows += len(table)
        if rows >= size:
            yield numbered()
            held, rows, n = [], 0, n + 1
    if held:
        yield numbered()


def _sorted(table: pa.Table, *keys: str) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in keys], null_placement="at_end")).combine_chunks()


def _counted(x: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Integers k and the number n of values that are there, if each of these is k / 2 / n to the last bit, as a whole date's ranks are; 0 where a value is missing."""
    n = int((~np.isnan(x)).sum())
    for v in (x[:64], x):
        k = np.rint(v * (2.0 * n))
        if not n or 2 * n >= 1 << 31 or not (np.isnan(v) | (k >= 1) & (k <= 2 * n) & (k / 2 / max(n, 1) == v)).all():
            return None
    return np.where(np.isnan(k), 0, k).astype(np.int32), n


def _ranks_as_counts(table: pa.Table) -> pa.Table:
    """A date's table whose ranks are integers, a third of the size when compressed; the field tells what they are parts of."""
    for i, field in enumerate(table.schema):
        if field.type == pa.float64() and not table[i].null_count and (told := _counted(table[i].to_numpy())):
            table = table.set_column(i, field.with_type(pa.int32()).with_metadata({"of": str(told[1])}), pa.array(told[0]))
    return table


def _ranks(table: pa.Table) -> pa.Table:
    for i, field in enumerate(table.schema):
        if field.metadata and b"of" in field.metadata:
            k = table[i].to_numpy()
            table = table.set_column(i, pa.field(field.name, pa.float64()), pa.array(np.where(k == 0, np.nan, k / 2 / int(field.metadata[b"of"]))))
    return table


def _sent(table: pa.Table, key: str, packed: bool = False, date: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (key, piece) of a table that is sorted by key: each key's rows as Arrow bytes, in pieces of a bounded size. packed: compressed, as they are shuffled next; date: the table is a whole date."""
    starts = np.flatnonzero(_new(table, key))
    if packed and date:
        table = _ranks_as_counts(table)
    keys, pieces, size = [], [], 0
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(table)], strict=True):
        for at in range(i, j, PIECE):
            sink = pa.BufferOutputStream()
            with pa.CompressedOutputStream(sink, "zstd") if packed else nullcontext(sink) as to, pa.ipc.new_stream(to, table.schema) as out:
                out.write_table(table.slice(at, min(PIECE, j - at)))
            keys.append(at)
            pieces.append(sink.getvalue())
            size += pieces[-1].size
            if size >= SENT:
                yield _rows(table, key, keys, pieces)
                keys, pieces, size = [], [], 0
    if keys:
        yield _rows(table, key, keys, pieces)


def _rows(table: pa.Table, key: str, places: list[int], pieces: list[pa.Buffer]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([table[key].take(pa.array(places)).combine_chunks(), pa.array([p.to_pybytes() for p in pieces], pa.binary())], names=["key", "piece"])


def _gathered(batches: Iterable[pa.RecordBatch], packed: bool = False) -> Iterator[pa.Table]:
    """The tables of the keys, from rows (key, piece) in which a key's pieces follow each other."""
    held, now = [], None

    def joined() -> pa.Table:
        """The pieces so far, which are let go."""
        table = pa.concat_tables(held).combine_chunks()
        held.clear()
        return table

    for b in batches:
        for key, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if held and key != now:
                yield joined()
            now = key
            rows = pa.BufferReader(piece.as_py())
            held.append(_ranks(pa.ipc.open_stream(pa.CompressedInputStream(rows, "zstd") if packed else rows).read_all()))
    if held:
        yield joined()


@dataclass(frozen=True)
class Part:
    """One of many stages: over histories or over dates, its runs, the columns that are read after it (None: all), and the runs that may be infinite and those that later runs of the stage alone read."""

    along: bool
    runs: dict[str, tuple[Window, list[str]]]
    keep: frozenset[str] | None = None
    infinite: frozenset[str] = frozenset()
    inner: frozenset[str] = frozenset()


#: Stages of one kind in a row that have processes of their own; more of them share one.
APART = 3


def _together(parts: list[Part], columns: list[str], always: set[str]) -> list[Part]:
    """The parts, those of a longer row of one kind than APART as one. Each process of a task holds a block and its own libraries, so many in a row took more memory than an executor has; in one, values that only the row itself reads live for some groups at a time."""
    told, columns, last = [], list(columns), parts[-1]
    for along, row in groupby(parts, key=lambda p: p.along):
        row, before = list(row), columns
        for p in row:
            columns = [*(c for c in columns if p.keep is None or c in p.keep or p is not last and c in always), *(n for n in p.runs if n not in p.inner)]
        if len(row) > APART:
            runs = {n: f for p in row for n, f in p.runs.items()}
            row = [Part(along, runs, frozenset(columns) & {*before}, frozenset().union(*(p.infinite for p in row)), frozenset(runs) - {*columns})]
        told += row
    return told


def stages(df: DataFrame, along: str, across: str, parts: list[Part], laid: bool = False, size: int = BLOCK) -> DataFrame:
    """Stages one after the other, over histories (groups of along in the order of across) or over dates (groups of across in the order of along); results are those of `stage` for each of them.

    Histories stand in blocks of size rows or a little more. Between stages Spark has a row for each block, date, or date's part of a block, with all its columns as Arrow
    bytes in pieces of a bounded size, and turns between histories and dates shuffle those. So columns become rows of the table, and rows columns, at the start and the end only.
    laid: df's partitions hold whole histories by date already.
    """
    if not parts[0].along:  # blocks come first
        parts = [Part(True, {}, None if any(p.keep is None for p in parts) else frozenset().union(*(p.keep or () for p in parts), *(inputs for p in parts for _, inputs in p.runs.values()))), *parts]
    parts = _together(parts, df.columns, {along, across})
    block, columns, works = free(df, "block"), list(df.columns), []
    for k, part in enumerate(parts):
        always = {along, across, block} if k + 1 < len(parts) else set()
        kept = [c for c in columns if part.keep is None and c != block or c in (part.keep or ()) or c in always]
        works.append(Work(part.runs, kept, part.infinite, part.inner))
        columns = [*kept, *works[-1].passed]
        if k == 0 and always:
            works[0].kept, columns = [*kept, block], [*columns, block]
    told = [c for c in columns if c != block]
    kinds = {c: df.schema[c] if c in df.columns else T.StructField(c, T.DoubleType()) for c in told}
    keys = {True: T.StructField("key", T.LongType()), False: T.StructField("key", df.schema[across].dataType)}
    read = {along, across, *works[0].kept, *(c for _, inputs in works[0].runs.values() for c in inputs)}
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c in read])
    out = out if laid else _laid(out, along, across)
    for k, (part, work) in enumerate(zip(parts, works, strict=True)):
        after = parts[k + 1].along if k + 1 < len(parts) else None
        schema = T.StructType(list(kinds.values()) if after is None else [keys[after], T.StructField("piece", T.BinaryType())])
        by, turned, turns = (along, across) if part.along else (across, along), k > 0 and parts[k - 1].along != part.along, after is not None and after != part.along
        out = out.mapInArrow(_task(work, by, turned, (block, size) if k == 0 else None, None if after is None else block if after else across, turns, not part.along, [c for c in told if c not in df.columns]), schema)
        if turns:
            out = out.repartition("key").sortWithinPartitions("key")
    return out


def _task(work: Work, by: tuple[str, str], turned: bool, start: tuple[str, int] | None, then: str | None, turns: bool, date: bool, made: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a stage of `stages` does in a task: rows or pieces come in, pieces by the key of the next stage or rows go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, by[0], *start) if start else _gathered(batches, turned):
            if turned:
                table = _sorted(table, *by)
            table = work.of(table, *by)
            yield from _plain(table, made) if then is None else _sent(_sorted(table, then) if turns else table, then, turns, date)

    return run
