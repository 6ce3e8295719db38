"""Vectorised scans over the UTF-8 bytes of Arrow string columns.

Operators that look at every character of every text share these routines.
They work on the Arrow data buffer itself, block by block, so memory is bounded
by the block (or by a single longer text) and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK = 1 << 20
U = np.uint64


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """This worker's tables under ``key``; only those of the operator that ran last are kept, so that stages do not pile up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a generator over Arrow batches; when its task ends, free memory goes back to the system."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


#: ASCII white space: space, and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes when words are what stands between white space.
NOT_SPACE = ~SPACE
#: Lower-cases A-Z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Word bytes when words are ASCII letters, digits and everything above ASCII (after lower-casing).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BYTE = stream(11, 256)[LOWER]  # a letter and its capital have one value
_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_PI = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 8)
        out = np.full(size, base, U)
        out[0] = 1
        with np.errstate(over="ignore"):
            out = np.multiply.accumulate(out)
        _powers[base] = have = out
    return have[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The column with null as empty, and 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(texts: pa.LargeStringArray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) for runs of whole texts of about ``limit`` bytes."""
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by text) of the words; no word crosses a text's border."""
    m = is_word[buf]
    if not len(m):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(m))]
    first[cut] = m[cut]
    last[cut - 1] = m[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased: a polynomial over byte values, then mixed."""
    if not len(starts):
        return np.zeros(0, U)
    h = np.empty(len(buf) + 1, U)
    h[0] = 0
    np.cumsum(_BYTE[buf] * _pow(_P, len(buf)), out=h[1:])
    return mix((h[ends] - h[starts]) * _pow(_PI, len(buf))[starts] + (ends - starts).astype(U))


def extend(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with new columns that ``fn`` makes from each Arrow batch, in order of ``fields``.

    As with ``withColumn``, a column that has the name of a new one gives way to it, whatever its case.
    """
    new_names = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new_names]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    @tidied
    def run(batches):
        for b in batches:
            new = fn(b)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in kept] + new, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
