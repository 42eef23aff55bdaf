"""Language of texts: scripts narrow the candidates, Viterbi over word scores labels spans.

A word's score under a language is the log probability of its byte trigrams (with its ends),
from counts over all learning rows. Viterbi chooses one language per word, with a penalty for
each switch; neighbouring words of one language are a span, and a text's language is the one
with most bytes in spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import batches as B

BUCKETS = 1 << 15
#: Cost of a switch of language between two words, in nats.
SWITCH = 12.0
#: A script is a candidate's if at least this share of the language's words use it.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: Word scores (words x languages) that are decoded together.
DECODED = 3_000_000
# First and last code points of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)], "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)], "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x9FFF)],
}
_LETTERS = B.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_ANY_LETTER = regex.compile(r"\p{L}")


def _script_of(points: np.ndarray) -> np.ndarray:
    """The number of the script of each code point; the last number is for all others."""
    out = np.full(len(points), len(SCRIPTS), np.int64)
    for i, ranges in enumerate(SCRIPTS.values()):
        for low, high in ranges:
            out[(points >= low) & (points <= high)] = i
    return out


class Words:
    """Words (runs of letter bytes) of a slice, their scripts, and the trigram at each byte."""

    def __init__(self, rows: pa.RecordBatch, text: str):
        data, at = B.text_bytes(rows.column(text))
        self.start, self.end, self.row = B.runs(data, at, _LETTERS)
        plain = np.where(_LETTERS[data], B.LOWER[data], 32).astype(np.uint32)
        before, after = np.r_[np.uint32(32), plain[:-1]], np.r_[plain[1:], np.uint32(32)]
        if len(self.start):
            before[self.start], after[self.end - 1] = 32, 32  # words at the border of two texts
        self.inside = plain != 32
        key = (before << 16 | plain << 8 | after) * np.uint32(0x9E3779B1)
        self.bucket = (key >> np.uint32(17)).astype(np.int32)
        lead = [np.r_[data, np.zeros(4, np.uint8)][self.start + i].astype(np.int64) for i in range(4)]
        two, three = (lead[0] & 31) << 6 | lead[1] & 63, (lead[0] & 15) << 12 | (lead[1] & 63) << 6 | lead[2] & 63
        points = np.select([lead[0] < 0x80, lead[0] < 0xE0, lead[0] < 0xF0], [lead[0], two, three], 0x10000)
        self.script = _script_of(points)
        self.at = at


@dataclass
class Model:
    languages: list[str]
    #: log probability of each trigram bucket under each language
    scores: np.ndarray
    #: which languages are candidates for each script
    allowed: np.ndarray


def learn(documents: DataFrame, *, text: str = "text", label: str = "lang") -> Model:
    """Count trigrams and scripts per language over all rows; rows without a label don't count.

    The counts that reach the driver are at most ``BUCKETS`` per language.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for rows in B.slices(parts, text):
            words = Words(rows, text)
            langs = np.array(rows.column(label).to_pylist(), object)
            byte_row = np.repeat(np.arange(rows.num_rows), np.diff(words.at))[words.inside]
            buckets = words.bucket[words.inside]
            for lang in set(langs):
                own = langs == lang
                sums = total.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1, np.int64))
                sums[:BUCKETS] += np.bincount(buckets[own[byte_row]], minlength=BUCKETS)
                sums[BUCKETS:] += np.bincount(words.script[own[words.row]], minlength=len(SCRIPTS) + 1)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(sums[at])], ["lang", "at", "n"]
            )

    rows = documents.select(F.col(text).alias(text), F.col(label).cast("string").alias(label)).where(F.col(label).isNotNull())
    counted = rows.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    languages = sorted(found["lang"].unique())
    sums = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    sums[found["at"].to_numpy(), found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = found["n"]
    grams, scripts = sums[:BUCKETS], sums[BUCKETS:]
    scores = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, scores, allowed)


def word_scores(words: Words, model: Model) -> np.ndarray:
    if not len(words.start):
        return np.zeros((0, len(model.languages)), np.float32)
    inside = np.flatnonzero(words.inside)
    first = np.searchsorted(inside, words.start)
    scores = np.add.reduceat(model.scores[words.bucket[inside]], first, axis=0)
    scores[~model.allowed[words.script]] = -1e6
    return scores


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word; row i has the words ``at[i]`` to ``at[i + 1]``.

    Rows of similar length are decoded in step with each other. Ties prefer no switch, then
    the first language.
    """
    labels = np.zeros(len(scores), np.int16)
    sizes = np.diff(at)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    stop = len(order)
    while stop:
        longest = sizes[order[stop - 1]]
        first = np.searchsorted(sizes[order[:stop]], longest // 1.4, side="left")
        first = max(first, stop - max(1, DECODED // (int(longest) * scores.shape[1])))
        group = order[first:stop][::-1]  # longest first, so the rows still open lead
        stop = first
        lengths, begin = sizes[group], at[group]
        open_at = len(group) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
        best = scores[begin].copy()
        stays, tops = [], []
        for t in range(1, longest):
            n = open_at[t]
            now = best[:n]
            top = now.argmax(axis=1)
            jump = now[np.arange(n), top] - switch
            stay = now >= jump[:, None]
            best[:n] = np.where(stay, now, jump[:, None]) + scores[begin[:n] + t]
            stays.append(stay)
            tops.append(top)
        label = best.argmax(axis=1)
        labels[begin + lengths - 1] = label
        for t in range(longest - 1, 0, -1):
            n = open_at[t]
            own = label[:n]
            label[:n] = np.where(stays[t - 1][np.arange(n), own], own, tops[t - 1])
            labels[begin[:n] + t - 1] = label[:n]
    return labels


@B.any_names
def labelled(documents: DataFrame, model: Model, *, text: str = "text", switch: float = SWITCH, keep_text: bool = True, spans: bool = True) -> DataFrame:
    """Add lang_pred, score (share of the letter bytes in that language's spans) and lang_spans.

    A span is (first byte, end byte, language). A text that is null or has no letter is
    ``und`` with score 0 and no spans, as is every text if nothing was learned. Ties go to
    the language first in the alphabet. Columns of these names are replaced.
    """
    added = ["lang_pred", "score", *(["lang_spans"] if spans else [])]
    df = documents.drop(*added)
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    kinds = [T.StringType(), T.DoubleType(), T.ArrayType(span)]
    schema = T.StructType([*kept, *(T.StructField(a, k) for a, k in zip(added, kinds, strict=False))])
    names = [f.name for f in kept]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def decode(held: list[tuple[pa.RecordBatch, Words, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sizes = [np.bincount(w.row, minlength=r.num_rows) for r, w, _ in held]
        scores = np.concatenate([s for _, _, s in held])
        labels = viterbi(scores, np.r_[0, np.cumsum(np.concatenate(sizes))], switch)
        done = 0
        for rows, words, own in held:
            label = labels[done : done + len(own)].astype(np.int64)
            done += len(own)
            yield _result(rows, words, label, model.languages)

    def _result(rows: pa.RecordBatch, words: Words, label: np.ndarray, languages: list[str]) -> pa.RecordBatch:
        n, k = rows.num_rows, len(languages)
        letters = np.zeros((n, k))
        np.add.at(letters, (words.row, label), words.end - words.start)
        best, whole = letters.argmax(axis=1), letters.sum(axis=1)
        real = np.fromiter((t is not None and _ANY_LETTER.search(t) is not None for t in rows.column(text).to_pylist()), bool, n)
        real &= whole > 0
        score = np.where(real, letters.max(axis=1) / np.maximum(whole, 1), 0.0)
        tongue = np.where(real, np.array(languages, object)[best], UNKNOWN)
        columns = [*(rows.column(c) for c in names), pa.array(tongue.tolist(), pa.string()), pa.array(score)]
        if spans:
            keep = real[words.row]
            row, lab, start, end = words.row[keep], label[keep], words.start[keep], words.end[keep]
            fresh = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (lab[1:] != lab[:-1])]) if len(row) else np.zeros(0, int)
            last = np.r_[fresh[1:] - 1, len(row) - 1][: len(fresh)]
            base = words.at[row[fresh]]
            items = pa.StructArray.from_arrays(
                [pa.array((start[fresh] - base).astype(np.int32)), pa.array((end[last] - base).astype(np.int32)),
                 pa.array(np.array(languages, object)[lab[fresh]].tolist(), pa.string())], ["start", "end", "lang"],
            )
            columns.append(B.list_array(items, B.per_row(row[fresh], n)))
        return pa.RecordBatch.from_arrays(columns, [*names, *added])

    def label_all(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in B.slices(parts, text):
            if not shared.value.languages:
                yield _none(rows)
                continue
            words = Words(rows, text)
            held.append((rows, words, word_scores(words, shared.value)))
            words.bucket = words.inside = None  # only needed for the scores
            size += held[-1][2].size
            if size >= DECODED:
                yield from decode(held)
                held, size = [], 0
        if held:
            yield from decode(held)

    def _none(rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        new = [pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array([[]] * n, pa.list_(pa.struct(
            [("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))]
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *new[: len(added)]], [*names, *added])

    return df.mapInArrow(label_all, schema)


def remainder(key: str, of: int):
    """crc32 of an id as text, modulo ``of``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(of))
