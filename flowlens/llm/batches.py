"""Texts inside a task: Arrow columns as byte arrays, words, and rolling fingerprints.

Spark partitions and moves the rows; these helpers only look at one Arrow batch at a time and
work on slices of about a megabyte of text, so a task's memory follows the slice (or the
longest single text) and not the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
U64 = np.uint64


def name(column: str) -> Column:
    """A column by its name, whatever dots or back-quotes that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def any_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators whose Arrow tasks look columns up by name: dots and back-quotes in names do no harm.

    Such columns of the first frame go through the operator under plain names.
    """

    @functools.wraps(operator)
    def run(documents: DataFrame, *args, **options) -> DataFrame:
        plain = {c: f"plain_{uuid.uuid4().hex}" for c in documents.columns if "." in c or "`" in c}
        if not plain:
            return operator(documents, *args, **options)
        options = {k: plain.get(v, v) if isinstance(v, str) else v for k, v in options.items()}
        out = operator(documents.toDF(*[plain.get(c, c) for c in documents.columns]), *args, **options)
        back = {v: k for k, v in plain.items()}
        return out.toDF(*[back.get(c, c) for c in out.columns])

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 places where its texts begin; null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, places, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that a slice holds at most ``limit`` bytes of text or one row."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        yield from cut(batch, sizes, limit)
        release()


def release() -> None:
    """Give unused memory back: workers live on between tasks and share an executor's memory."""
    Fingerprints.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def cut(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of one batch in slices whose sizes add up to at most ``limit``, or of one row."""
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Fingerprints:
    """64-bit fingerprints of any span of a byte array, from one running sum.

    ``byte_values`` maps each byte to the value it counts as, so a folded alphabet (lower
    case) needs no second copy of the text. Equal spans have equal fingerprints wherever
    they lie.
    """

    _BASE = 0x9E3779B97F4A7C15
    _powers = np.ones(1, U64)
    _inverse = np.ones(1, U64)

    def __init__(self, data: np.ndarray, fold: np.ndarray | None = None):
        n = len(data)
        if len(self._powers) < n + 1:
            size = n + (1 << 18)
            kind = type(self)
            kind._powers = np.cumprod(np.r_[U64(1), np.full(size - 1, self._BASE, U64)], dtype=U64)
            inverse = pow(self._BASE, -1, 1 << 64)
            kind._inverse = np.cumprod(np.r_[U64(1), np.full(size - 1, inverse, U64)], dtype=U64)
        values = mix(np.arange(1, 257, dtype=U64))
        if fold is not None:
            values = values[fold]
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values[data] * self._powers[:n], dtype=U64, out=self.sums[1:])
        self._inverse = self._inverse  # its own reference, whatever the class forgets

    @classmethod
    def forget(cls) -> None:
        """Drop the tables of powers, which take 16 bytes per byte of the longest array so far."""
        cls._powers = cls._inverse = np.ones(1, U64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self._inverse[start]


#: Lower case for A to Z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A to Z are lower case: digits, letters, and beyond ASCII.
WORD_BYTES = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: ``[^\x20\x09-\x0D]``
SOLID_BYTES = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def runs(data: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of member bytes; runs end where a text ends."""
    inside = member[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    opens = inside & ~before
    opens[edges] = inside[edges]
    start = np.flatnonzero(opens)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    closes = inside & ~after
    last = at[1:][at[1:] > 0] - 1
    closes[last] = inside[last]
    end = np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    """The n + 1 places where each row's entries begin in an array sorted by row."""
    return np.searchsorted(rows, np.arange(n + 1))


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the given spans."""
    depth = np.bincount(start, minlength=n + 1).astype(np.int64)
    depth -= np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(depth)[:n] > 0


def list_array(values: pa.Array, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
