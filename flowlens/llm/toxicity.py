"""Toxicity of texts whose words may be disguised: restore the words, then score them.

A noisy channel writes letters as look-alike signs, spreads a word over single letters or
pieces, and repeats letters. For a word that could have passed it, the lattice of what each
character may stand for is decoded by Viterbi under a character trigram model, counted over
all texts. Plain words stand for themselves. The score is a logistic model on the evidence
of the restored words, learned from labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import batches as B
from flowlens.session import materialized

#: Labelled rows the classifier is fitted on at most, chosen by the hash of their id.
MAX_LABELLED = 100_000
#: Words with evidence that the model keeps at most, the strongest first.
MAX_WORDS = 10_000
#: Penalty on the weights of the logistic model.
PENALTY = 3e-4
#: Bytes of the beginnings of words that count as words of their own.
BEGINNINGS = (6, 8)
#: Restored words a worker remembers.
REMEMBERED = 100_000
# Letters that a sign may stand for, and what each reading costs in nats.
LOOK_ALIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il",
}
READ_COST, DROP_COST, REPEAT_COST = 1.0, 4.0, 0.5
#: Signs that may join the pieces of one word.
JOINTS = b"-._*~'+/\\ "
BORDER, DIGIT, FOREIGN, SYMBOLS = 0, 27, 28, 29

_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"@$!|")] = True
_ALNUM = B.WORD_BYTES
_LETTER = B.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_JOINT = np.zeros(256, bool)
_JOINT[list(JOINTS)] = True
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[48:58] = DIGIT
_SYMBOL[128:] = FOREIGN


def character_model(documents: DataFrame, *, text: str = "text") -> np.ndarray:
    """Costs (negative log probabilities) of a symbol after two others, counted over all rows."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for rows in B.slices(parts, text):
            data, at = B.text_bytes(rows.column(text))
            symbols = np.insert(_SYMBOL[data], at[:-1], BORDER)
            symbols = np.r_[BORDER, symbols, BORDER]
            symbols = symbols[np.r_[True, (symbols[1:] != BORDER) | (symbols[:-1] != BORDER)]]
            before = np.r_[BORDER, symbols[:-2]]
            before[symbols[:-1] == BORDER] = BORDER  # a word's first letter follows two borders
            total += np.bincount((before * SYMBOLS + symbols[:-1]) * SYMBOLS + symbols[1:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    found = documents.select(text).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**3)
    counts[found["at"].to_numpy(int)] = found["n"]
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = three.sum(0) + 0.5
    one = two / two.sum(1, keepdims=True)
    return -np.log((three + 4 * one[None]) / (three.sum(2, keepdims=True) + 4))


def restore(word: bytes, costs: np.ndarray) -> bytes:
    """The likeliest plain word behind ``word`` (lower case): Viterbi over what its characters stand for.

    A state is the last two symbols written. A letter stands for itself, or for nothing if it
    repeats the character before; a sign stands for a letter it resembles or for nothing, a
    digit for such a letter or itself; anything else is dropped.
    """
    states: dict[tuple[int, int], tuple[float, tuple]] = {(BORDER, BORDER): (0.0, ())}
    last = -1
    for byte in word:
        readings = []
        symbol = int(_SYMBOL[byte])
        if symbol:
            readings.append((symbol, byte, 0.0))
        for letter in LOOK_ALIKE.get(chr(byte), ""):
            readings.append((int(_SYMBOL[ord(letter)]), ord(letter), READ_COST))
        drop = REPEAT_COST if byte == last and byte < 128 else 0.0 if not readings else DROP_COST if not symbol else None
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in states.items():
            if drop is not None and ((a, b) not in new or cost + drop < new[a, b][0]):
                new[a, b] = (cost + drop, path)
            for s, out, extra in readings:
                key, now = (b, s), cost + extra + costs[a, b, s]
                if key not in new or now < new[key][0]:
                    new[key] = (now, (path, out))
        states, last = new, byte
    path = min((cost + costs[a, b, BORDER], path) for (a, b), (cost, path) in states.items())[1]
    out = bytearray()
    while path:
        path, byte = path
        out.append(byte)
    return bytes(out[::-1])


_remembered: dict[bytes, bytes] = {}


def again(prints: np.ndarray) -> np.ndarray:
    """The fingerprint of "this word, at least twice"."""
    return B.mix(prints ^ np.uint64(0x5851F42D4C957F2D))


class Restored:
    """The restored words of a slice: row and fingerprint of each."""

    def __init__(self, rows: pa.RecordBatch, text: str, costs: np.ndarray):
        data, at = B.text_bytes(rows.column(text))
        n = len(data)
        low = B.LOWER[data]
        same = np.zeros(n + 2, bool)
        same[1:n] = low[1:] == low[:-1]
        # runs of three or more equal signs, and exclamation marks behind a word, are decoration
        third = same[1 : n + 1] & same[: n] if n else same[:0]
        long_run = third[:n].copy()
        long_run[: max(0, n - 1)] |= third[1:n]
        long_run[: max(0, n - 2)] |= third[2:n]
        sign = _SIGNS[data] & ~long_run
        follow = np.r_[_ALNUM[data[1:]], False] if n else np.zeros(0, bool)
        sign &= ~((data == 0x21) | (data == 0x7C)) | follow
        member = _ALNUM[data] | sign
        marked = np.where(member, np.uint8(97), np.uint8(32))
        start, end, row = B.runs(marked, at, B.SOLID_BYTES)
        letters = np.r_[0, np.cumsum(_LETTER[data])]
        odd = np.r_[0, np.cumsum(~_LETTER[data])]
        triple = third.copy()
        triple &= _LETTER[data]
        repeats = np.r_[0, np.cumsum(triple)]
        has = letters[end] > letters[start]
        strange = has & ((odd[end] > odd[start]) | (repeats[end] > np.minimum(repeats[np.minimum(start + 2, n)], repeats[end])))
        # doubled letters count once in every word, as the channel may have doubled or merged them
        single = ~(same[:n] & _LETTER[data] & (data < 128))
        single[start] = True
        squeezed = np.r_[0, np.cumsum(single)]
        whole = B.Fingerprints(data[single], B.LOWER)
        prints = whole.spans(squeezed[start], squeezed[end])
        plain = has & ~strange
        more_rows, more_words = [row[strange]], [bytes(low[a:b]) for a, b in zip(start[strange], end[strange], strict=True)]
        # pieces one joint apart: letters spread by a sign or a blank, or parts of a cut word
        if len(start) > 1:
            gap = start[1:] - end[:-1]
            joint = (gap == 1) & (row[1:] == row[:-1]) & _JOINT[data[np.minimum(end[:-1], n - 1)]]
            alone = end - start == 1
            blank = data[np.minimum(end[:-1], n - 1)] == 32
            linked = joint & (~blank | alone[1:] & alone[:-1])
            edge = np.flatnonzero(np.diff(np.r_[False, linked, False].astype(np.int8)))
            firsts, lasts = edge[::2], edge[1::2]
            use = (letters[end[lasts]] - letters[start[firsts]] >= 3) & (lasts - firsts >= np.where(alone[firsts], 2, 1))
            firsts, lasts = firsts[use], lasts[use]
            keep = np.r_[member, False]
            for a, b in zip(start[firsts], end[lasts], strict=True):
                more_words.append(bytes(low[a:b][keep[a:b]]))
            more_rows.append(row[firsts])
        words = [self._restored(w, costs) for w in more_words]
        extra = np.zeros(0, np.uint64)
        if words:
            raw = b"".join(words)
            joined = np.frombuffer(raw, np.uint8)
            places = np.r_[0, np.cumsum([len(w) for w in words])]
            restored = B.Fingerprints(joined, B.LOWER)
            extra = restored.spans(places[:-1], places[1:])
        self.row = np.r_[row[plain], np.concatenate(more_rows)].astype(np.int64)
        self.prints = np.r_[prints[plain], extra]
        # the beginnings of longer words count too: many forms of a word share one
        starts, ends, sources = [squeezed[start[plain]]], [squeezed[end[plain]]], [whole]
        if words:
            starts, ends, sources = [*starts, places[:-1]], [*ends, places[1:]], [whole, restored]
        begins, begin_rows, at_row = [], [], 0
        for first, last, source in zip(starts, ends, sources, strict=True):
            own = self.row[at_row : at_row + len(first)]
            at_row += len(first)
            for i, size in enumerate(BEGINNINGS):
                longer = last - first > size
                begins.append(B.mix(source.spans(first[longer], first[longer] + size) + np.uint64(i + 1)))
                begin_rows.append(own[longer])
        self.row = np.r_[self.row, np.concatenate(begin_rows)]
        self.prints = np.r_[self.prints, np.concatenate(begins)]
        self.n, self.strange = rows.num_rows, len(words)

    @staticmethod
    def _restored(word: bytes, costs: np.ndarray) -> bytes:
        out = _remembered.get(word)
        if out is None:
            if len(_remembered) >= REMEMBERED:
                _remembered.clear()
            plain = restore(word, costs)
            out = bytes(c for i, c in enumerate(plain) if not i or c != plain[i - 1] or not 97 <= c <= 122)
            _remembered[word] = out
        return out

    def once(self) -> tuple[np.ndarray, np.ndarray]:
        """Each (fingerprint, row) once, and once more under another fingerprint if it is repeated."""
        order = np.lexsort((self.row, self.prints))
        prints, row = self.prints[order], self.row[order]
        new = np.r_[True, (prints[1:] != prints[:-1]) | (row[1:] != row[:-1])] if len(prints) else np.zeros(0, bool)
        twice = ~new & np.r_[False, new[:-1]]
        return np.r_[prints[new], again(prints[twice])], np.r_[row[new], row[twice]]


@dataclass
class Evidence:
    """Sorted fingerprints of words, the weight of each, the intercept, and the character model."""

    prints: np.ndarray
    weights: np.ndarray
    intercept: float
    costs: np.ndarray

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << 20, bool)
        self.filter[B.mix(self.prints) >> np.uint64(44)] = True

    def find(self, found: Restored) -> tuple[np.ndarray, np.ndarray]:
        """(place of a word with evidence, row), each pair once."""
        near = self.filter[B.mix(found.prints) >> np.uint64(44)] | self.filter[B.mix(again(found.prints)) >> np.uint64(44)]
        found.prints, found.row = found.prints[near], found.row[near]
        prints, row = found.once()
        if not len(self.prints):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
        hit = self.prints[at] == prints
        return at[hit], row[hit]

    def scores(self, found: Restored) -> np.ndarray:
        at, row = self.find(found)
        return 1 / (1 + np.exp(-self.intercept - np.bincount(row, self.weights[at], found.n)))


def candidate_words(labelled: DataFrame, costs: np.ndarray, yes_all: int, no_all: int, *, text: str = "text", label: str = "label") -> np.ndarray:
    """Fingerprints of the restored words whose counts in the two classes can't be chance.

    The bar (a G statistic) rises with the number of words looked at.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(costs)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums(held: list) -> pa.RecordBatch:
            prints, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            yes = np.concatenate([h[1] for h in held])
            hits = np.bincount(at, yes, len(prints)).astype(np.int64)
            rest = np.bincount(at, 1 - yes, len(prints)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(hits), pa.array(rest)], ["word", "yes", "no"])

        held, size = [], 0
        for rows in B.slices(parts, text):
            prints, row = Restored(rows, text, shared.value).once()
            held.append((prints, rows.column(label).to_numpy(zero_copy_only=False).astype(np.int64)[row]))
            size += len(prints)
            if size > 2_000_000:
                yield sums(held)
                held, size = [], 0
        if held:
            yield sums(held)

    words = labelled.select(text, label).mapInArrow(count, "word long, yes long, no long")
    words = words.groupBy("word").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    n = yes_all + no_all
    g = F.lit(0.0)
    for column, whole in (("yes", yes_all), ("no", no_all)):
        share = (F.col("yes") + F.col("no")) * whole / n
        absent = F.lit(whole) - F.col(column)
        g += 2 * F.when(F.col(column) > 0, F.col(column) * F.log(F.col(column) / share)).otherwise(0.0)
        g += 2 * F.when(absent > 0, absent * F.log(absent / (whole - share))).otherwise(0.0)
    looked_at = words.agg(F.approx_count_distinct("word")).head()[0]
    found = words.withColumn("g", g).where(F.col("g") > 2 * math.log(max(looked_at, 1)) + 4)
    kept = found.orderBy(F.desc("g"), "word").limit(MAX_WORDS).select("word").collect()
    return np.sort(np.array([r["word"] for r in kept], np.int64).view(np.uint64))


def learn(labelled: DataFrame, costs: np.ndarray, *, text: str = "text", label: str = "label") -> Evidence:
    """A logistic model on the presence of candidate words, with an absolute-value penalty.

    The penalty leaves out words that only go along with others, such as the other words of
    copied texts. Without rows of both classes the model is the share of label 1.
    """
    classes = dict(labelled.groupBy(label).count().collect())
    yes_all, no_all = classes.get(1, 0), classes.get(0, 0)
    none = np.zeros(0, np.uint64)
    if not yes_all or not no_all:
        return Evidence(none, np.zeros(0), 700.0 if yes_all else -700.0, costs)
    prints = candidate_words(labelled, costs, yes_all, no_all, text=text, label=label)
    if not len(prints):
        return Evidence(none, np.zeros(0), math.log(yes_all / no_all), costs)
    shared = labelled.sparkSession.sparkContext.broadcast(Evidence(prints, np.zeros(len(prints)), 0.0, costs))

    def present(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in B.slices(parts, text):
            at, row = shared.value.find(Restored(rows, text, costs))
            order = np.argsort(row, kind="stable")
            words = pa.array(at[order].astype(str).tolist(), pa.string())
            lists = B.list_array(words, B.per_row(row[order], rows.num_rows))
            yield pa.RecordBatch.from_arrays([lists, rows.column(label).cast(pa.float64())], ["words", "label"])

    rows = materialized(labelled.select(text, label).mapInArrow(present, "words array<string>, label double"), "toxic-words")
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(prints))], "words", "features")
    vectors.setBinary(True).setMinTF(0)
    fitted = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, standardization=False, maxIter=60).fit(vectors.transform(rows))
    weights = fitted.coefficients.toArray()
    used = weights != 0
    return Evidence(prints[used], weights[used], float(fitted.intercept), costs)


@B.any_names
def scored(
    documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
    out: str = "score", max_labelled: int = MAX_LABELLED, keep_text: bool = True,
) -> DataFrame:
    """Add the probability of label 1 to every row; ``labels`` (key, label) are the rows to learn from.

    At most ``max_labelled`` labels are used; of several labels of one key the largest
    counts, and null ones don't. A null text counts as empty. Without labels of both
    classes every score is near 0, or near 1 if all are 1. An existing ``out`` is replaced.
    """
    costs = character_model(documents, text=text)
    given = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    given = given.orderBy(F.xxhash64(key), key).limit(max_labelled)  # bounded, so it can be broadcast
    known = documents.select(key, text).join(F.broadcast(given), key).select(text, "_label")
    evidence = learn(known, costs, text=text, label="_label")
    df = documents.drop(out)
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    names = [f.name for f in kept]
    shared = documents.sparkSession.sparkContext.broadcast(evidence)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in B.slices(parts, text):
            values = shared.value.scores(Restored(rows, text, shared.value.costs))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(values)], [*names, out])

    return df.mapInArrow(add, T.StructType([*kept, T.StructField(out, T.DoubleType())]))
