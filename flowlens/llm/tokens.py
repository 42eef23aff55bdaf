"""Token counts of byte-level BPE by a two-tier lookup on pre-tokens.

Texts are cut into pre-tokens with array operations. A first pass keeps each task's heavy
hitters; their sums over all tasks make a table of bounded size, from a pre-token's 64-bit
fingerprint to its number of tokens, which is broadcast. Other pre-tokens are looked up in the
worker's own cache, and only those missing there are encoded. Pre-tokens are never shuffled,
except the heavy hitters, of which each task has at most ``TASK_HEAVY``.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import batches as B

#: Heavy hitters kept and sent by one task, and entries of the broadcast table.
TASK_HEAVY = 4_096
TABLE_SIZE = 65_536
#: Slots of a worker's cache (10 bytes each).
CACHE_BITS = 21
OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)
# The white space of Unicode.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The endings that the pattern cuts off after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@cache
def _classes() -> np.ndarray:
    """The class of each code point, and BREAK for the mark between texts."""
    import unicodedata

    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return np.r_[table, np.uint8(BREAK)]


def pre_tokens(points: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, for code points in which 0x110000 marks the border of two texts."""
    kind = _classes()[points]
    n = len(points)
    before, after = np.r_[np.uint8(BREAK), kind[:-1]], np.r_[kind[1:], np.uint8(BREAK)]
    fresh = kind != before
    blank = points == 0x20
    joined = np.r_[False, blank[:-1]] & (kind != SPACE) & (kind != BREAK)
    start = (fresh & ~joined) | (kind == BREAK)
    # the last of several white-space characters before a text's next word stands apart
    last = (kind == SPACE) & (after != SPACE) & (after != BREAK)
    start |= last
    quote = np.flatnonzero((points == 0x27) & start & (after == LETTER))
    for ending in ENDINGS:
        room = quote[quote + len(ending) < n]
        hit = room[np.all([points[room + 1 + i] == ord(c) for i, c in enumerate(ending)], axis=0)]
        start[hit + 1] = False
        behind = hit[hit + 1 + len(ending) < n] + 1 + len(ending)
        start[behind[kind[behind] == LETTER]] = True
        quote = np.setdiff1d(quote, hit, assume_unique=True)
    return start


class PreTokens:
    """The pre-tokens of a slice of rows: row, byte span and fingerprint of each."""

    def __init__(self, rows: pa.RecordBatch, text: str, special: re.Pattern | None):
        data, at = B.text_bytes(rows.column(text))
        whole = data.tobytes()
        points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        widths = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.r_[0, np.cumsum(widths, dtype=np.int64)]
        extra = np.zeros(rows.num_rows, np.int64)
        if special is not None and (found := [m.span() for m in special.finditer(whole)]):
            row = np.searchsorted(at, [a for a, _ in found], side="right") - 1
            inside = [(a, b, r) for (a, b), r in zip(found, row, strict=True) if b <= at[r + 1]]
            extra = np.bincount([r for _, _, r in inside], minlength=rows.num_rows)
            points = points.copy()
            for a, b, _ in inside:
                points[np.searchsorted(byte_at, a) : np.searchsorted(byte_at, b)] = 0x110000
        borders = np.searchsorted(byte_at, at[1:])
        marked = np.insert(points, borders, 0x110000)
        place = np.insert(byte_at[:-1], borders, at[1:])
        start = np.flatnonzero(pre_tokens(marked))
        ends = np.r_[place[start[1:]], len(data)]
        real = marked[start] != 0x110000
        self.start, self.end = place[start][real], ends[real]
        self.row = np.searchsorted(at, self.start, side="right") - 1
        self.prints = B.mix(B.Fingerprints(data).spans(self.start, self.end))
        self.data, self.n, self.special = whole, rows.num_rows, extra
        self.sizes = np.diff(at)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].decode("utf-8")


class Table:
    """A compact hash table: one probe in a table of fingerprints and small counts."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.counts = np.zeros(1 << bits, np.int32)

    def put(self, prints: np.ndarray, counts: np.ndarray) -> None:
        at = prints >> self.shift
        self.keys[at], self.counts[at] = prints, counts
        won = self.keys[at] == prints  # of several in one slot the last one stays
        self.counts[at[won]] = counts[won]

    def get(self, prints: np.ndarray) -> np.ndarray:
        """The counts, -1 where the table has none."""
        at = prints >> self.shift
        return np.where(self.keys[at] == prints, self.counts[at], -1)


@cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _lengths(path: str, texts: list[str]) -> np.ndarray:
    """Tokens of each pre-token, encoded by itself."""
    return np.array([len(e) for e in _tokenizer(path).encode_batch(texts, add_special_tokens=False)], np.int32)


@cache
def _special(path: str) -> re.Pattern | None:
    with open(path, encoding="utf-8") as file:
        marks = [t["content"].encode() for t in json.load(file)["added_tokens"]]
    return re.compile(b"|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True))) if marks else None


_caches: dict[str, Table] = {}


def heavy_hitters(documents: DataFrame, path: str, *, text: str = "text", limit: int = TABLE_SIZE, per_task: int = TASK_HEAVY) -> DataFrame:
    """The ``limit`` most frequent pre-tokens over all rows, from each task's ``per_task`` heaviest."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, counts, texts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
        for rows in B.slices(parts, text):
            found = PreTokens(rows, text, _special(path))
            own, first, n = np.unique(found.prints, return_index=True, return_counts=True)
            top = np.argsort(-n, kind="stable")[: 4 * per_task]
            new = np.fromiter((found.text(i) for i in first[top]), object, len(top))
            prints, at = np.unique(np.r_[prints, own[top]], return_inverse=True)
            counts = np.bincount(at, np.r_[counts, n[top]], len(prints)).astype(np.int64)
            joined, texts = np.r_[texts, new], np.empty(len(prints), object)
            texts[at] = joined
            if len(prints) > 8 * per_task:
                keep = np.sort(np.argsort(-counts, kind="stable")[: 4 * per_task])
                prints, counts, texts = prints[keep], counts[keep], texts[keep]
        keep = np.argsort(-counts, kind="stable")[:per_task]
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts[keep].tolist(), pa.string()), pa.array(counts[keep])], ["pre_token", "n"]
        )

    found = documents.select(text).mapInArrow(count, "pre_token string, n long")
    return found.groupBy("pre_token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre_token").limit(limit)


@B.any_names
def count_tokens(
    documents: DataFrame, path: str, *, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens",
    keep_text: bool = True, table_size: int = TABLE_SIZE,
) -> DataFrame:
    """Add the bytes and tokens of each text under the tokenizer file at ``path``.

    The counts are those of the tokenizer without begin, end or added tokens, truncation or
    padding; a special string in a text is one token. A null text counts as empty: 0 and 0.
    Columns of these names are replaced; an empty table stays empty.
    """
    frequent = [r["pre_token"] for r in heavy_hitters(documents, path, text=text, limit=table_size).collect()]
    first = Table(18)
    if frequent:
        data, at = B.text_bytes(pa.array(frequent, pa.string()))
        order = slice(None, None, -1)  # the most frequent last, so that it keeps a shared slot
        first.put(B.mix(B.Fingerprints(data).spans(at[:-1], at[1:]))[order], _lengths(path, frequent)[order])
    shared = documents.sparkSession.sparkContext.broadcast(first)
    df = documents.drop(n_bytes, n_tokens)
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(n_bytes, T.LongType()), T.StructField(n_tokens, T.LongType())])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = shared.value, _caches.setdefault(path, Table(CACHE_BITS))
        for rows in B.slices(parts, text):
            found = PreTokens(rows, text, _special(path))
            counts = table.get(found.prints)
            rest = np.flatnonzero(counts < 0)
            counts[rest] = own.get(found.prints[rest])
            rest = rest[counts[rest] < 0]
            if len(rest):
                prints, at, back = np.unique(found.prints[rest], return_index=True, return_inverse=True)
                lengths = _lengths(path, [found.text(i) for i in rest[at]])
                own.put(prints, lengths)
                counts[rest] = lengths[back]
            total = np.bincount(found.row, counts, rows.num_rows).astype(np.int64) + found.special
            columns = [*(rows.column(c) for c in names), pa.array(found.sizes), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, [*names, n_bytes, n_tokens])

    return df.mapInArrow(count, schema)
