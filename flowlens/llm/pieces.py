"""Piece encoding and decoding by suffix-array matching (byte-pair models with byte fallback).

The new words of a slice are put one after another; their suffixes are sorted as deep as the
longest piece, every piece is found in them by binary search, and its occurrences become
edges sorted by position. A word is a run of blanks and what follows it; no piece reaches
over its border. A word is cut further wherever no edge crosses, which changes nothing.
Then the edges are relaxed in the model's order: short parts step together, each taking its
best edge over two neighbouring symbols until none is left; a long part, such as a page
without a blank, keeps its edges in a heap, so its time grows with n log n.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowlens.llm import batches as B

#: Bytes of text encoded together.
SLICE_BYTES = 1 << 20
#: Symbols matched at a time, words and ids a worker remembers, and ids decoded at a time.
MATCHED, REMEMBERED, REMEMBERED_IDS, DECODED = 150_000, 200_000, 2_000_000, 300_000
#: Parts of more symbols than this are relaxed by a heap.
STEPPED = 48
BLANK = "▁"
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Pieces of a model file: symbols, ranks (best score first), bytes, and byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize(" a　ﬁ  ") not in (f"{BLANK * 2}a　ﬁ{BLANK * 2}", " a　ﬁ  "):
            raise ValueError("only models that leave the text as it is are supported")
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        texts = [model.id_to_piece(i) for i in plain]
        if any(BLANK in t.lstrip(BLANK) for t in texts):
            raise ValueError("a piece reaches over the border of two words")
        self.unknown = model.unk_id()
        self.bytes_of = [b""] * n
        for i, t in zip(plain, texts, strict=True):
            self.bytes_of[i] = t.replace(BLANK, " ").encode()
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
        self.has_bytes = bool((self.byte_ids != self.unknown).all())
        points = sorted({ord(c) for t in texts for c in t})
        self.points = np.array(points, np.uint32)
        number = {chr(p): i + 2 for i, p in enumerate(points)}  # 0 is the border, 1 any other character
        self.longest = max(map(len, texts))
        words = -(-self.longest // 4)
        self.keys = np.zeros((len(texts), words), np.uint64)
        self.tops = np.zeros((len(texts), words), np.uint64)
        for row, t in enumerate(texts):
            for k in range(words * 4):
                low, high = (number[t[k]], number[t[k]]) if k < len(t) else (0, 0xFFFF)
                shift = np.uint64(48 - 16 * (k % 4))
                self.keys[row, k // 4] |= np.uint64(low) << shift
                self.tops[row, k // 4] |= np.uint64(high) << shift
        self.ids = np.array(plain, np.int32)
        self.sizes = np.array([len(t) for t in texts])
        scores = np.array([model.get_score(i) for i in plain])
        self.ranks = np.full(n, _NONE, np.int64)
        self.ranks[self.ids] = np.unique(-scores, return_inverse=True)[1]
        self.lengths = np.array([len(b) for b in self.bytes_of])
        self.raw = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.raw_at = np.r_[0, np.cumsum(self.lengths)]

    def symbols(self, points: np.ndarray) -> np.ndarray:
        points = np.where(points == 0x20, np.uint32(ord(BLANK)), points)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at + 2, 1).astype(np.uint64)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _within(keys: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each value in its own range of the sorted keys."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at = keys[np.minimum(middle, len(keys) - 1)]
        before = (at <= value if right else at < value) & open_
        low = np.where(before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low


def edges(symbols: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """A table [position, length] of the pieces that occur there, -1 where none does."""
    n = len(symbols)
    words = vocab.keys.shape[1]
    padded = np.r_[symbols, np.zeros(4 * words + 4, np.uint64)]
    block = np.zeros(n + 4 * words, np.uint64)
    for k in range(4):
        block |= padded[k : k + len(block)] << np.uint64(48 - 16 * k)
    rank = np.unique(block, return_inverse=True)[1].astype(np.int64)
    reach = 4
    while reach < 4 * words:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-reach] = rank[reach:]
        rank = np.unique(rank << 32 | ahead, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    suffixes = np.argsort(rank[:n], kind="stable")
    low = np.zeros(len(vocab.ids), np.int64)
    high = np.full(len(vocab.ids), n, np.int64)
    for word in range(words):
        keys = block[suffixes + 4 * word]
        open_ = np.flatnonzero((vocab.sizes > 4 * word) & (low < high))
        a, b = low[open_], high[open_]
        low[open_] = _within(keys, a, b, vocab.keys[open_, word], False)
        high[open_] = _within(keys, a, b, vocab.tops[open_, word], True)
    count = np.maximum(high - low, 0)
    piece = np.repeat(np.arange(len(count)), count)
    at = suffixes[np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(piece))]
    order = np.argsort(at, kind="stable")
    table = np.full((n, vocab.longest + 1), -1, np.int32)
    table[at[order], vocab.sizes[piece[order]]] = vocab.ids[piece[order]]
    return table


def edge_table(symbols: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """``edges`` of any number of symbols, matched in blocks that overlap by the longest piece."""
    if len(symbols) <= 2 * MATCHED:
        return edges(symbols, vocab)
    table = np.full((len(symbols), vocab.longest + 1), -1, np.int32)
    for at in range(0, len(symbols), MATCHED):
        block = symbols[at : at + MATCHED + vocab.longest]
        table[at : at + MATCHED] = edges(block, vocab)[:MATCHED]
    return table


def uncrossed(table: np.ndarray) -> np.ndarray:
    """The part of each position: parts meet where no edge crosses, so no edge of one changes another."""
    reach = np.ones(len(table), np.int64)
    for size in range(2, table.shape[1]):
        reach[table[:, size] >= 0] = size
    reach = np.maximum.accumulate(reach + np.arange(len(table)))
    return np.r_[0, np.cumsum(reach[:-1] <= np.arange(1, len(table)))]


def _relaxed(table: np.ndarray, place: np.ndarray, part: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the final symbols, in order. Each part takes its edge of best rank, the leftmost of equals, again and again."""
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    count = np.diff(np.r_[first, len(part)])
    short = np.repeat(count <= STEPPED, count)
    found = [_stepped(table, place[short], part[short], ranks)]
    if not short.all():
        by_piece = ranks.tolist()
        for at in np.flatnonzero(count > STEPPED).tolist():
            begin = int(place[first[at]])
            found.append(_heaped(table[begin : begin + count[at]], begin, ranks, by_piece))
    start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(start)
    return start[order], end[order]


def _heaped(table: np.ndarray, begin: int, ranks: np.ndarray, by_piece: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Spans of one part, whose edges wait in a heap by rank and place; an edge that no longer fits is passed over."""
    n, width = table.shape
    piece_of = memoryview(np.ascontiguousarray(table).reshape(-1))
    piece = table[: n - 1, 2] if width > 2 else np.full(n - 1, -1)
    at = np.flatnonzero(piece >= 0)
    heap = np.sort(ranks[piece[at]] << 32 | at).tolist()
    size = [1] * n
    before = list(range(-1, n - 1))
    while heap:
        key = heappop(heap)
        i = key & 0xFFFFFFFF
        j = i + size[i]
        if not size[i] or j >= n:
            continue
        total = size[i] + size[j]
        found = piece_of[i * width + total] if total < width else -1
        if found < 0 or by_piece[found] != key >> 32:
            continue
        size[i], size[j] = total, 0
        after, ahead = i + total, before[i]
        if after < n:
            before[after] = i
            joined = total + size[after]
            if joined < width and (found := piece_of[i * width + joined]) >= 0:
                heappush(heap, by_piece[found] << 32 | i)
        if ahead >= 0:
            joined = size[ahead] + total
            if joined < width and (found := piece_of[ahead * width + joined]) >= 0:
                heappush(heap, by_piece[found] << 32 | ahead)
    sizes = np.array(size)
    start = np.flatnonzero(sizes)
    return start + begin, start + begin + sizes[start]


def _stepped(table: np.ndarray, start: np.ndarray, part: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of many parts, which take one edge each at a time."""
    longest = table.shape[1] - 1
    end = start + 1
    done_start, done_end = [start[:0]], [start[:0]]
    while len(start):
        size = np.r_[end[1:], 0] - start
        pair = np.r_[part[1:] == part[:-1], False] & (size <= longest)
        piece = np.where(pair, table[start, np.where(pair, size, 0)], -1)
        rank = np.where(piece >= 0, ranks[piece] << 32 | np.arange(len(start)), _NONE)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        best = np.minimum.reduceat(rank, first)
        ended = np.repeat(best == _NONE, np.diff(np.r_[first, len(start)]))
        done_start.append(start[ended])
        done_end.append(end[ended])
        taken = (best[best != _NONE] & 0xFFFFFFFF).astype(np.int64)
        end[taken] = end[taken + 1]
        keep = ~ended
        keep[taken + 1] = False
        start, end, part = start[keep], end[keep], part[keep]
    return np.concatenate(done_start), np.concatenate(done_end)


def encode_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and the place where each word's begin."""
    points = np.frombuffer(b"".join(words).decode("utf-8").encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w.decode("utf-8")) for w in words])
    ends = np.cumsum(sizes)
    ids, counts = [], []
    at = 0
    while at < len(words):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + MATCHED, side="right")))
        own = points[base : ends[stop - 1]]
        border = ends[at:stop] - base
        symbols = np.insert(vocab.symbols(own), border, 0)
        shown = np.insert(own, border, 0)
        word = np.repeat(np.arange(stop - at), sizes[at:stop])
        place = np.arange(len(own)) + word
        table = edge_table(symbols, vocab)
        start, end = _relaxed(table, place, uncrossed(table)[place], vocab.ranks)
        piece = table[start, end - start]
        owner = np.searchsorted(border + np.arange(stop - at), start, side="right")
        width = np.ones(len(piece), np.int64)
        strange = np.flatnonzero(piece < 0)
        if len(strange):
            raw = [chr(p).encode() for p in shown[start[strange]]]
            new = [vocab.byte_ids[np.frombuffer(r, np.uint8)] if vocab.has_bytes else np.array([vocab.unknown], np.int32) for r in raw]
            width[strange] = [len(x) for x in new]
            first = np.cumsum(width) - width
            out = np.repeat(piece, width)
            for f, x in zip(first[strange], new, strict=True):
                out[f : f + len(x)] = x
            piece = out
        ids.append(piece)
        counts.append(np.bincount(np.repeat(owner, width), minlength=stop - at))
        at = stop
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.r_[0, np.cumsum(count)]


class _Known:
    """Words met before: sorted prints, and the ids of each."""

    def __init__(self) -> None:
        self.prints = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def add(self, prints: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        if len(self.prints) + len(prints) > REMEMBERED or len(self.ids) + len(ids) > REMEMBERED_IDS:
            self.__init__()
        counts = np.r_[np.diff(self.at), np.diff(at)]
        begin = np.r_[self.at[:-1], at[:-1] + len(self.ids)]
        both, order = np.r_[self.prints, prints], np.argsort(np.r_[self.prints, prints], kind="stable")
        self.ids = gather(np.r_[self.ids, ids], begin[order], counts[order])
        self.at = np.r_[0, np.cumsum(counts[order])]
        self.prints = both[order]


def gather(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of ``count`` values from each ``begin``, one after another."""
    return values[np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())] if len(count) else values[:0]


_known: dict[str, _Known] = {}


def encoded_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the place where each text's begin."""
    vocab, known = vocabulary(path), _known.setdefault(path, _Known())
    data, at = B.text_bytes(pc.replace_substring(texts.cast(pa.large_string()), BLANK, " "))
    full = np.diff(at) > 0
    data = np.insert(data, at[:-1][full], 32)  # the blank that the model sets before a text
    at = at + np.r_[0, np.cumsum(full)]
    blank = data == 32
    opens = blank & ~np.r_[False, blank[:-1]]
    opens[at[:-1][full]] = True
    start = np.flatnonzero(opens)
    end = np.r_[start[1:], len(data)]
    prints = B.mix(B.Fingerprints(data).spans(start, end))
    own, first, back = np.unique(prints, return_index=True, return_inverse=True)
    where = np.minimum(np.searchsorted(known.prints, own), max(0, len(known.prints) - 1))
    new = np.ones(len(own), bool) if not len(known.prints) else known.prints[where] != own
    raw = data.tobytes()
    fresh = first[new]
    fresh_ids, fresh_at = encode_words([raw[a:b] for a, b in zip(start[fresh].tolist(), end[fresh].tolist(), strict=True)], vocab)
    begin, count = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    begin[new], count[new] = fresh_at[:-1] + len(known.ids), np.diff(fresh_at)
    if not new.all():
        begin[~new], count[~new] = known.at[where[~new]], np.diff(known.at)[where[~new]]
    ids = gather(np.r_[known.ids, fresh_ids], begin[back], count[back])
    if len(fresh_at) > 1:
        known.add(own[new], fresh_ids, fresh_at)
    rows = np.searchsorted(at, start, side="right") - 1
    per_text = np.bincount(rows, count[back], len(texts)).astype(np.int64)
    return ids, np.r_[0, np.cumsum(per_text)]


def _decoded(ids: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> list[str]:
    """The text of each run of ids."""
    raw = gather(vocab.raw, vocab.raw_at[ids], vocab.lengths[ids]).tobytes()
    ends = np.r_[0, np.cumsum(vocab.lengths[ids])][np.r_[0, np.cumsum(sizes)]].tolist()
    return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends[:-1], ends[1:], strict=True)]


@B.any_names
def encode(
    documents: DataFrame, path: str, *, text: str = "text", out: str = "ids", keep_text: bool = True, decoded: str | None = None
) -> DataFrame:
    """Add the piece ids of each text, as the model at ``path`` gives them without begin or end.

    Null and empty texts have no ids. A character without a piece becomes its UTF-8 bytes'
    pieces. The model's own blank sign counts as a blank. With ``decoded`` the text that the
    ids give back is added under that name, in the same pass. Existing columns of these
    names are replaced.
    """
    more = [decoded] if decoded else []
    df = documents.drop(out, *more)
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    names = [f.name for f in kept]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in B.slices(parts, text, SLICE_BYTES):
            ids, at = encoded_texts(rows.column(text), path)
            columns = [*(rows.column(c) for c in names), B.list_array(pa.array(ids, pa.int32()), at)]
            if decoded:
                columns.append(pa.array(_decoded(ids, np.diff(at), vocabulary(path)), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*names, out, *more])

    added = [T.StructField(out, T.ArrayType(T.IntegerType())), *(T.StructField(c, T.StringType()) for c in more)]
    return df.mapInArrow(run, T.StructType([*kept, *added]))


@B.any_names
def decode(documents: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each list of ids; null or empty lists give the empty text.

    Bytes that are no UTF-8 become U+FFFD; null ids and ids outside the model are an error.
    """
    df = documents.drop(out)
    names = df.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)

        def lengths(rows: pa.RecordBatch) -> np.ndarray:
            return pc.fill_null(pc.list_value_length(rows.column(ids)), 0).to_numpy(zero_copy_only=False).astype(np.int64)

        for rows in (part for batch in parts for part in B.cut(batch, lengths(batch), DECODED)):
            column, sizes = rows.column(ids), lengths(rows)
            own = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = pa.array(_decoded(own, sizes, vocab), pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns, texts], [*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))
