"""Word pairs and triples that stand together more often than apart.

A shard is a slice of texts. Its words, as integers, are sorted into two indexes, one of the
text and one of the text read backwards, as far as phrases reach. A phrase is an interval of
rows in both; the symbols before an interval's rows are what can be put to its left (or, in
the backward index, to its right), so each interval splits into those of the longer phrases
with their counts. Counts are summed across shards.

A phrase is frequent only if its parts are, in the whole corpus. So words are counted first,
then pairs of frequent words, then triples of frequent pairs; what is frequent goes to the
tasks as a bit filter of bounded size. The filter may let too much through, which costs
shuffle, never the other way round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import batches as B
from flowlens.session import materialized

#: Occurrences of a candidate; share of them, in per cent, in a longer candidate that drops it.
LEAST, WITHIN = 10, 50
#: Bytes of text in a shard.
SHARD_BYTES = 2 << 20
#: A filter has at most 2 to so many bits: 32 MB.
FILTER_BITS = 28
#: What ends a piece, and what parts words.
_ENDS = B.byte_class((0x2E, 0x2E), (0x2C, 0x2C), (0x3B, 0x3B), (0x3A, 0x3A), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
_WORD = ~(_ENDS | B.byte_class((0x20, 0x20), (0x09, 0x09)))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = B.mix(np.arange(1, 4, dtype=np.uint64))
UNKNOWN = "und"


class Filter:
    """A set of 64-bit prints as bits; it may hold more than was put in, and is empty at size 0."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def places(prints: np.ndarray, bits: int) -> np.ndarray:
        """Three bits for each print."""
        return np.stack([B.mix(prints + seed) >> np.uint64(64 - bits) for seed in _SEEDS])

    def has(self, prints: np.ndarray) -> np.ndarray:
        found = np.ones(len(prints), bool)
        for place in self.places(prints, self.bits):
            found &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def filtered(prints: DataFrame, most_bits: int = FILTER_BITS) -> Filter:
    """The filter of a column of longs; at most 2 ** ``most_bits`` bits reach the driver."""
    prints = prints.toDF("print")
    bits = min(most_bits, max(10, math.ceil(math.log2(16 * prints.count() + 1))))

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            place = np.unique(Filter.places(batch.column("print").to_numpy().view(np.uint64), bits))
            at, bit = place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63))
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
            words = np.bitwise_or.reduceat(bit, first) if len(at) else bit
            yield pa.RecordBatch.from_arrays([pa.array(at[first].view(np.int64)), pa.array(words.view(np.int64))], ["at", "word"])

    rows = prints.mapInArrow(mark, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(max(1, 1 << bits - 6), np.uint64)
    words[rows.column("at").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
    return Filter(words, bits)


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """One print for each phrase of word prints."""
    out = parts[0]
    for more in parts[1:]:
        out = B.mix(out * _FACTOR + more)
    return out


class Words:
    """The words of a slice: where they lie, their prints (which differ by language), where pieces begin."""

    def __init__(self, rows: pa.RecordBatch):
        self.data, at = B.text_bytes(rows.column("text"))
        self.start, self.end, self.row = B.runs(self.data, at, _WORD)
        marks = np.r_[0, np.cumsum(_ENDS[self.data])]
        # a new text, or an end sign since the word before
        self.opens = np.ones(len(self.start), bool)
        self.opens[1:] = (self.row[1:] != self.row[:-1]) | (marks[self.start[1:]] != marks[self.end[:-1]])
        tongue = rows.column("tongue").to_numpy().view(np.uint64)
        self.prints = B.mix(B.Fingerprints(self.data, B.LOWER).spans(self.start, self.end) ^ tongue[self.row])


class Index:
    """Intervals of phrases in the texts read forwards and backwards, sorted by ``depth`` symbols.

    Symbols are integers from 1, and 0 stands between pieces. Phrases of up to ``depth``
    symbols are intervals, though longer ones may not be.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth = depth
        self.before, self.step, self.first = self._sorted(symbols)
        self.symbols = symbols

    def _sorted(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbol before each row, the row of the suffix that begins there, first rows of symbols."""
        n = len(symbols)
        rank, width = symbols.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while width < self.depth:
            more = min(width, self.depth - width)
            ahead = np.zeros(n, np.int64)
            if more < width:  # the last step adds fewer symbols than it has
                ahead[: n - width] = symbols[width:]
            else:
                ahead[: n - width] = rank[width:] + 1
            key = rank * (int(ahead.max(initial=0)) + 1) + ahead
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            width += more
        before = symbols[order - 1]
        step = np.empty(n, np.int64)
        step[np.argsort(before, kind="stable")] = np.arange(n)
        return before, step, np.r_[0, np.cumsum(np.bincount(symbols))]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All symbols but 0, the first rows of their intervals (in both indexes alike), their counts."""
        count = np.diff(self.first)
        symbol = np.arange(1, len(count))
        return symbol, self.first[1:-1], count[1:]

    def left(self, low: np.ndarray, count: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each interval's phrases with one symbol more before: interval, symbol, low, count, and low when read backwards."""
        owner = np.repeat(np.arange(len(low)), count)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        row = low[owner] + within
        symbol = self.before[row]
        order = np.lexsort((symbol, owner))
        owner, symbol, row = owner[order], symbol[order], row[order]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])]) if len(row) else row
        many = np.diff(np.r_[first, len(row)])
        # within an interval the smaller symbols come first in the backward index too
        new_back = back[owner[first]] + within[first]
        real = symbol[first] > 0
        return owner[first][real], symbol[first][real], self.step[row[first]][real], many[real], new_back[real]


def _shards(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[Words]:
    for rows in B.slices(parts, "text", size):
        yield Words(rows)


def _symbols(words: Words, frequent: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Integers for the frequent words, 0 between pieces and for the others, and each integer's print."""
    known = frequent.has(words.prints)
    prints, own = np.unique(words.prints[known], return_inverse=True)
    value = np.zeros(len(words.prints), np.int64)
    value[known] = own + 1
    place = np.arange(len(value)) + np.cumsum(words.opens)
    symbols = np.zeros(len(value) + int(words.opens.sum()) + 1, np.int64)
    symbols[place] = value
    # of several zeros one says as much
    return symbols[np.r_[True, (symbols[1:] != 0) | (symbols[:-1] != 0)]], np.r_[np.uint64(0), prints]


def _pairs(words: Words, frequent: Filter) -> tuple[list[np.ndarray], np.ndarray]:
    symbols, prints = _symbols(words, frequent)
    index = Index(symbols, 2)
    word, low, count = index.words()
    owner, left, _, many, _ = index.left(low, count, low)
    return [prints[left], prints[word[owner]]], many


def _triples(words: Words, frequent: Filter, pairs: Filter) -> tuple[list[np.ndarray], np.ndarray]:
    """Frequent pairs by a step to the left, then triples by a step to the right."""
    symbols, prints = _symbols(words, frequent)
    index, mirror = Index(symbols, 2), Index(symbols[::-1].copy(), 2)
    word, low, count = index.words()
    owner, left, _, many, back = index.left(low, count, low)
    one, two = prints[left], prints[word[owner]]
    known = pairs.has(joined([one, two]))
    one, two, many, back = one[known], two[known], many[known], back[known]
    owner, right, _, times, _ = mirror.left(back, many, back)
    three = prints[right]
    known = pairs.has(joined([two[owner], three]))
    return [one[owner][known], two[owner][known], three[known]], times[known]


def _counted(texts: DataFrame, frequent: Filter, pairs: Filter | None, least: int, size: int) -> DataFrame:
    """w1, w2 (and w3) and a: the frequent pairs of frequent words, or triples of frequent pairs."""
    n = 2 if pairs is None else 3
    columns = [f"w{i + 1}" for i in range(n)]
    shared = texts.sparkSession.sparkContext.broadcast((frequent, pairs))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = shared.value
        for slice_ in _shards(parts, size):
            phrase, times = _pairs(slice_, words) if known is None else _triples(slice_, words, known)
            yield pa.RecordBatch.from_arrays([*(pa.array(w.view(np.int64)) for w in phrase), pa.array(times)], [*columns, "a"])

    kinds = ", ".join(f"{c} long" for c in [*columns, "a"])
    rows = texts.mapInArrow(count, kinds).groupBy(*columns).agg(F.sum("a").alias("a"))
    return materialized(rows.where(F.col("a") >= least), "phrases-counted")


def _words(texts: DataFrame, size: int) -> DataFrame:
    """w (print), lang, word and f of every word of a language."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in B.slices(parts, "text", size):
            words = Words(rows)
            prints, first, times = np.unique(words.prints, return_index=True, return_counts=True)
            small = B.LOWER[words.data].tobytes()
            spelt = [small[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints.view(np.int64)), rows.column("lang").take(pa.array(words.row[first])), pa.array(spelt, pa.binary()).cast(pa.string()), pa.array(times)],
                ["w", "lang", "word", "f"],
            )

    rows = texts.mapInArrow(count, "w long, lang string, word string, f long")
    return materialized(rows.groupBy("w", "lang", "word").agg(F.sum("f").alias("f")), "phrases-words")


def collocations(
    documents: DataFrame, *, text: str = "text", lang: str = "lang", top: int = 2_000, least: int = LEAST, within: int = WITHIN,
    shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Per language its ``top`` phrases of two or three words: lang, rank, phrase, a, l, r, n, score.

    Words are A-Z as a-z, without blanks and tabs; a phrase lies between ``.,;:!?`` and line
    breaks. ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut (ties: the
    first), ``n`` all words of the language. Phrases of fewer than ``least`` occurrences are
    none; one with ``within`` per cent or more of its occurrences in a longer one is left out.
    Order: score and ``a`` descending, phrase ascending by bytes. Null texts have no words, a
    null language is ``und``; rows all count, equal ones too; other columns play no part.
    """
    tongue = F.coalesce(B.name(lang).cast("string"), F.lit(UNKNOWN))
    texts = documents.where(B.name(text).isNotNull()).select(B.name(text).alias("text"), tongue.alias("lang"), F.xxhash64(tongue).alias("tongue"))
    words = _words(texts, shard_bytes)
    frequent = filtered(words.where(F.col("f") >= least).select("w"), filter_bits)
    pairs = _counted(texts, frequent, None, least, shard_bytes)
    known = filtered(pairs.mapInArrow(_pair_prints, "print long"), filter_bits)
    triples = _counted(texts, frequent, known, least, shard_bytes)
    return _ranked(words, pairs, triples, top, within)


def _pair_prints(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        prints = joined([batch.column(c).to_numpy().view(np.uint64) for c in ("w1", "w2")])
        yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64))], ["print"])


#: The score of each cut, exact: a decimal holds the products, and ``div`` drops what is left.
_WORST = """
  transform(cuts, c -> struct(
    cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * 1000000BD div (cast(c.l as decimal(18,0)) * cast(c.r as decimal(18,0))) as score,
    c.k as k, c.l as l, c.r as r))"""


def _ranked(words: DataFrame, pairs: DataFrame, triples: DataFrame, top: int, within: int) -> DataFrame:
    """Cuts, scores, what longer phrases hold, and the first of each language."""
    # the longest phrase around a pair
    around = triples.select("w1", "w2", "a").union(triples.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    two = pairs.join(around, ["w1", "w2"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(within) * F.col("a"))
    )

    def word(i: int, what: list[str]) -> DataFrame:
        return words.select(F.col("w").alias(f"w{i}"), *[F.col(c).alias(f"{c}{i}") for c in what])

    two = two.join(word(1, ["lang", "word", "f"]), "w1").join(word(2, ["word", "f"]), "w2").select(
        F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2").alias("phrase"), "a",
        F.array(F.struct(F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f2").alias("r"))).alias("cuts"),
    )
    head = pairs.select("w1", "w2", F.col("a").alias("f12"))
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    three = triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"])
    three = three.join(word(1, ["lang", "word", "f"]), "w1").join(word(2, ["word"]), "w2").join(word(3, ["word", "f"]), "w3").select(
        F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
        F.array(F.struct(F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f23").alias("r")),
                F.struct(F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f3").alias("r"))).alias("cuts"),
    )
    scored = two.union(three).withColumn("worst", F.array_min(F.expr(_WORST)))
    best = Window.partitionBy("lang").orderBy(F.desc("worst.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "worst.l", "worst.r", "n", F.col("worst.score").alias("score")
    )
