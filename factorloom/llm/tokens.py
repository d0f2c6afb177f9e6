"""Byte-level BPE: ids by a local rank file, and back to bytes."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from factorloom.llm.common import free_name

#: Code points of one call of the tokenizer, about.
PIECE = 100_000


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """Cuts a long text where no match of a pre-split pattern can cross: between a non-space and one space that a letter follows.

    There a match ends before the space, whatever comes later, because a space starts a match or ends a run of white space,
    and the run here is one character long. Without such a place, the piece grows until one comes.
    """
    start, n = 0, len(text)
    while n - start > most:
        at = start + most
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= n:
                at = -1
                break
            if not text[at - 1].isspace() and text[at + 1].isascii() and text[at + 1].isalpha():
                break
            at += 1
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int32))


def _packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([ids.astype("<u4").tobytes() for ids in arrays], pa.binary())


def _ids(lists: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each row, from lists or from packed bytes; null has none."""
    if not isinstance(lists, pa.ListArray):
        for row in lists:
            yield np.frombuffer(row.as_py() or b"", dtype="<u4")
        return
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    for a, b, there in zip(offsets[:-1], offsets[1:], lists.is_valid(), strict=True):
        yield values[a:b] if there.as_py() else values[:0]


def encoder(path: str, pattern: str, piece: int = PIECE, packed: bool = False):
    """A column function: text to ids, as an array or packed as little-endian unsigned 32-bit integers. Null is taken as empty. path must be readable on the executors. Ids stay in arrays of four bytes each."""
    told = _packed if packed else _lists

    @arrow_udf("binary" if packed else "array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoding(path, pattern)
        for texts in batches:
            yield told([np.concatenate([enc.encode_to_numpy(p, disallowed_special=()).astype(np.int32) for p in pieces(t.as_py() or "", piece)]) for t in texts])

    return encode


def decoder(path: str, pattern: str):
    """A column function: ids to raw bytes, which need not be a whole text in UTF-8. Null is taken as no ids."""

    @arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoding(path, pattern)
        for lists in batches:
            yield pa.array([enc.decode_bytes(ids.tolist()) for ids in _ids(lists)], pa.binary())

    return decode


def packer():
    """A column function: ids to little-endian unsigned 32-bit integers."""

    @arrow_udf("binary")
    def packed(lists: pa.Array) -> pa.Array:
        return _packed(list(_ids(lists)))

    return packed


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", packed: bool = False) -> DataFrame:
    """Adds the column ids_column(df) with the ids of each whole text, packed or as an array; null and empty texts have none."""
    return df.withColumn(ids_column(df), encoder(path, pattern, packed=packed)(F.col(f"`{text_col}`").cast("string")))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str) -> DataFrame:
    """Adds the column bytes_column(df) with the bytes that the ids, packed or in an array, stand for."""
    return df.withColumn(bytes_column(df), decoder(path, pattern)(F.col(f"`{ids_col}`")))


def ids_column(df: DataFrame) -> str:
    return free_name(df, "token_ids")


def bytes_column(df: DataFrame) -> str:
    return free_name(df, "token_bytes")
