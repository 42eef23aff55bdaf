"""Benchmark passages in training documents, found through one FM-index per shard of text.

A shard is a slice of a task's rows. Its words become the numbers of a benchmark's vocabulary;
a stretch of words that all belong to it, and that is at least as long as the shortest phrase,
can hold a phrase, and nothing else can, so only such stretches enter the shard's index.
Phrases are searched backwards through the wavelet tree's ranks, their places come from sampled
suffix positions, and the places merge into spans to remove. Every hit is then compared word
by word with the phrase.

No row is shuffled. The benchmark is read in blocks of bounded size, each broadcast by itself;
a large benchmark takes one narrow pass over the rows per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import batches as B
from flowlens.llm.fm_index import FmIndex

#: Bytes of benchmark text in one broadcast block (and one item more at most).
BLOCK_BYTES = 4 << 20
HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()),
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    ]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_SPAN = pa.struct([(x, pa.int32()) for x in ("first_word", "end_word", "start", "end")])


class Phrases:
    """The distinct windows of some benchmark items, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            data, at = B.text_bytes(pa.array([text], pa.string()))
            start, end, _ = B.runs(data, at, B.WORD_BYTES)
            words = B.Fingerprints(data, B.LOWER).spans(start, end).tolist()
            last = max(1, len(words) - window + 1) if words else 0
            for i in range(last):
                found.setdefault(tuple(words[i : i + window]), set()).add(item)
        keys = list(found)
        self.items = [sorted(found[k]) for k in keys]
        self.words = np.unique(np.array([w for k in keys for w in k], np.uint64))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[B.mix(self.words) >> np.uint64(44)] = True
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({len(k) for k in keys}):
            own = [i for i, k in enumerate(keys) if len(k) == length]
            symbols = np.searchsorted(self.words, np.array([keys[i] for i in own], np.uint64)) + 1
            self.by_length[length] = (np.array(own), symbols)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary, from 1; 0 for a word outside it."""
        out = np.zeros(len(words), np.int64)
        near = np.flatnonzero(self.filter[B.mix(words) >> np.uint64(44)])
        if len(near):
            at = np.minimum(np.searchsorted(self.words, words[near]), len(self.words) - 1)
            out[near] = np.where(self.words[at] == words[near], at + 1, 0)
        return out

    def hits(self, numbers: np.ndarray, row: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(phrase, first word, length) of all occurrences in one shard."""
        if not self.by_length or not len(numbers):
            return []
        known = numbers > 0
        fresh = np.r_[True, (row[1:] != row[:-1]) | (known[1:] != known[:-1])]
        stretch = np.flatnonzero(fresh)
        size = np.diff(np.r_[stretch, len(numbers)])
        use = known[stretch] & (size >= min(self.by_length))
        stretch, size = stretch[use], size[use]
        if not len(stretch):
            return []
        # each stretch and one separator, whose number no phrase holds
        place = np.repeat(stretch - np.r_[0, np.cumsum(size + 1)[:-1]], size + 1) + np.arange(int((size + 1).sum()))
        ends = np.cumsum(size + 1) - 1
        place[ends] = -1
        index = FmIndex(np.where(place >= 0, numbers[place], len(self.words) + 1))
        found = []
        for length, (phrase, symbols) in self.by_length.items():
            low, high = index.search(symbols)
            which = np.repeat(np.arange(len(phrase)), high - low)
            rows = np.repeat(low - np.r_[0, np.cumsum(high - low)[:-1]], high - low) + np.arange(len(which))
            first = place[index.locate(rows)]
            same = (numbers[first[:, None] + np.arange(length)] == symbols[which]).all(axis=1)
            found.append((phrase[which[same]], first[same], length))
        return found


def _scan(rows: pa.RecordBatch, text: str, phrases: Phrases) -> list[dict]:
    data, at = B.text_bytes(rows.column(text))
    start, end, row = B.runs(data, at, B.WORD_BYTES)
    numbers = phrases.numbers(B.Fingerprints(data, B.LOWER).spans(start, end))
    bounds = B.per_row(row, rows.num_rows)
    out = [{"n_words": int(n), "spans": [], "items": []} for n in np.diff(bounds)]
    found = phrases.hits(numbers, row)
    if not found:
        return out
    first = np.concatenate([x[1] for x in found])
    stop = np.concatenate([x[1] + x[2] for x in found])
    hit = np.r_[False, B.covered(first, stop, len(numbers)), False]
    for doc in np.unique(row[first]):
        a, b = bounds[doc], bounds[doc + 1]
        own = np.r_[False, hit[a + 1 : b + 1], False]
        begins, ends = np.flatnonzero(own[1:] & ~own[:-1]), np.flatnonzero(own[:-1] & ~own[1:])
        out[doc]["spans"] = [
            {"first_word": int(x), "end_word": int(y), "start": int(start[a + x] - at[doc]), "end": int(end[a + y - 1] - at[doc])}
            for x, y in zip(begins, ends, strict=True)
        ]
    pairs = {(int(row[f]), int(p)) for ps, fs, _ in found for p, f in zip(ps, fs, strict=True)}
    items: dict[int, set[str]] = {}
    for doc, phrase in pairs:
        items.setdefault(doc, set()).update(phrases.items[phrase])
    for doc, own in items.items():
        out[doc]["items"] = sorted(own)
    return out


def _joined(a: dict | None, b: dict) -> dict:
    """The hits of two blocks: spans of words that touch or overlap become one."""
    if a is None or not a["spans"]:
        return b
    if not b["spans"]:
        return a
    spans: list[dict] = []
    for span in sorted(a["spans"] + b["spans"], key=lambda s: s["first_word"]):
        if spans and span["first_word"] <= spans[-1]["end_word"]:
            if span["end_word"] > spans[-1]["end_word"]:
                spans[-1] |= {k: span[k] for k in ("end_word", "end")}
        else:
            spans.append(dict(span))
    return {"n_words": b["n_words"], "spans": spans, "items": sorted({*a["items"], *b["items"]})}


@B.any_names
def find_passages(
    documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = 10, keep_text: bool = True, out: str = "passages",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add one struct column: words, spans of hit words (with byte places), and item ids.

    Words are runs of digits, letters (A-Z count as lower case) and characters beyond ASCII. A
    phrase is ``window`` consecutive words of an item, or all of a shorter item; an item
    without words has none. A word inside any occurrence of a phrase is hit; spans that touch
    are one. A null or empty text has no words. Repeated rows and items are each looked at
    alone; a null item id is written "null". An empty benchmark hits nothing, and an empty
    table stays empty. A column of ``documents`` already called ``out`` is replaced.
    ``keep_text=False`` leaves the text out of the result.
    """
    items = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("t")
    ).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t") + 16)).head()[0] or 0
    blocks = int(size // block_bytes) + 1
    df = documents.drop(out)
    context = df.sparkSession.sparkContext
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == block).collect()
        phrases = context.broadcast(Phrases([tuple(r) for r in own], window))
        first, last = block == 0, block == blocks - 1
        kept = [f for f in df.schema.fields if f.name not in (out, *([text] if last and not keep_text else []))]
        schema = T.StructType([*kept, T.StructField(out, HITS)])
        names = [f.name for f in kept]

        def scan(parts: Iterator[pa.RecordBatch], phrases=phrases, names=names, first=first) -> Iterator[pa.RecordBatch]:
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
            for rows in B.slices(parts, text):
                hits = _scan(rows, text, phrases.value)
                if not first:
                    hits = [_joined(a, b) for a, b in zip(rows.column(out).to_pylist(), hits, strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(hits, kind)], [*names, out])

        df = df.mapInArrow(scan, schema)
    return df


@B.any_names
def without_passages(found: DataFrame, *, text: str = "text", passages: str = "passages", drop_share: float = 0.5) -> DataFrame:
    """Cut the spans out of the texts; rows of which over ``drop_share`` of the words are hit go.

    A row without hits keeps its text as it is, null included.
    """
    names = [c for c in found.columns if c != passages]
    schema = T.StructType([f for f in found.schema.fields if f.name != passages])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            hits, texts = rows.column(passages).to_pylist(), rows.column(text).to_pylist()
            keep = []
            for i, hit in enumerate(hits):
                n_hit = sum(s["end_word"] - s["first_word"] for s in hit["spans"])
                keep.append(n_hit <= drop_share * hit["n_words"])
                if n_hit and keep[-1]:
                    data, pieces, at = texts[i].encode(), [], 0
                    for s in hit["spans"]:
                        pieces.append(data[at : s["start"]])
                        at = s["end"]
                    texts[i] = b"".join([*pieces, data[at:]]).decode()
            columns = [pa.array(texts, pa.string()) if c == text else rows.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return found.mapInArrow(cut, schema)
