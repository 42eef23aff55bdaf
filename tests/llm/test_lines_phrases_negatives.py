"""Shared lines, phrases and hard negatives against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowlens.llm import lines, negatives, phrases
from tests.llm import edges

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def many_lines():
    """Documents of shared and own lines, some in every document, some at the limits of length and count."""
    rng = random.Random(3)
    common = [f"line {i} that is long enough to count as one {'x' * i}" for i in range(12)]
    rows = []
    for i in range(120):
        own = [f"{i} own line, seen here only, and long enough too"] * rng.randint(0, 2)
        picked = [rng.choice([str.upper, str.lower, lambda s: f" \t{s}\r"])(common[k]) for k in range(12) if rng.random() < (0.95, 0.3, 0.05)[k % 3]]
        text = own + picked + ["short", "", "é" * 39, "é" * 40] * (i % 2)
        rng.shuffle(text)
        rows.append((i, "\n".join(text), "en", "s", 0))
    rows += [(500, None, None, None, 0), (501, "", "en", None, 0), (502, "\n\n", "en", "s", 0), (None, common[0], "en", "s", 0)]
    rows += [(503, "\n".join([common[0]] * 3), "en", "s", 0)] * 2 + [(503, f"another text\n{common[0]}", "en", "s", 0)]
    return rows


def kept_lines(rows, points=40, least=5):
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n") if doc is not None else []:
            holders[line.strip(" \t\n\v\f\r").translate(LOWER)].add(doc)
    shared = {k: max(v) for k, v in holders.items() if len(k) >= points and len(v) >= least}
    out = []
    for doc, text, *_ in rows:
        whole = (text or "").split("\n")
        left = [x for x in whole if doc is None or shared.get(x.strip(" \t\n\v\f\r").translate(LOWER), doc) == doc]
        out.append((doc, None if text is None else "\n".join(left), len(whole), len(whole) - len(left)))
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_shared_lines(spark, parts):
    rows = many_lines()
    docs = edges.frame(spark, rows).withColumnRenamed("source", "a.b").withColumnRenamed("lang", "lines")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = lines.without_lines(docs, lines.dropped_lines(docs))
        got = [(r[0], r[1], r["lines"][0], r["lines"][1]) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.columns == ["doc_id", "text", "a.b", "n_chars", "lines"]
    assert sorted(got, key=repr) == sorted(kept_lines(rows), key=repr)


def test_lines_of_an_empty_table_and_of_one_document(spark):
    none = spark.createDataFrame([], edges.SCHEMA)
    assert lines.without_lines(none, lines.dropped_lines(none)).count() == 0
    one = edges.frame(spark, [(1, "a line\nthe same\nthe same", "en", "s", 0)])
    assert lines.dropped_lines(one).count() == 0
    assert lines.dropped_lines(one, points=1, least=1).count() == 0


def best_phrases(rows, top, least, within):
    count, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                count.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in count.items() if len(p) > 2 and a >= least}
    longer = defaultdict(int)
    for p, a in candidates.items():
        if len(p) == 4:
            for part in (p[:3], (p[0], *p[2:])):
                longer[part] = max(longer[part], a)
    out = defaultdict(list)
    for p, a in candidates.items():
        if 100 * longer[p] >= within * a:
            continue
        cuts = [(count[p[0], *p[1 : k + 1]], count[p[0], *p[k + 1 :]], k) for k in range(1, len(p) - 1)]
        score, _, left, right = min((1_000_000 * a * a // (x * y), k, x, y) for x, y, k in cuts)
        out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return {
        (lang, i + 1, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, found in out.items() for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top])
    }


@pytest.mark.parametrize(("size", "bits"), [(phrases.SHARD_BYTES, phrases.FILTER_BITS), (300, 6)])
def test_phrases(spark, size, bits):
    """Also with many small shards, and filters too small to hold back anything."""
    rng = random.Random(5)
    some = "a b c dd ee ff é Ü one two".split()
    rows = edges.documents()
    rows += [(1000 + i, "".join(rng.choice(some) + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".\n"]) for _ in range(60)), "en" if i % 2 else None, "s", 0) for i in range(60)]
    rows += [(3000, "very common pair " * 200, "und", "s", 0)] * 2
    docs = edges.frame(spark, rows).withColumnRenamed("source", "w1.a")
    got = phrases.collocations(docs, top=40, least=5, shard_bytes=size, filter_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == best_phrases(rows, 40, 5, 50)


def test_phrases_of_nothing(spark):
    for rows in ([], [(1, None, None, None, 0), (2, "", "en", "s", 0), (3, ".,;", "en", "s", 0), (4, "one", "en", "s", 0)]):
        assert phrases.collocations(spark.createDataFrame(rows, edges.SCHEMA)).count() == 0


def test_huge_counts_are_exact(spark):
    """Products past 64 bits; equal scores go to the first cut."""
    big = 4_000_000_000_123
    words = spark.createDataFrame([(1, "en", "a", big), (2, "en", "b", big), (3, "en", "c", big)], "w long, lang string, word string, f long")
    pairs = spark.createDataFrame([(1, 2, big - 5), (2, 3, big - 5)], "w1 long, w2 long, a long")
    triples = spark.createDataFrame([(1, 2, 3, big // 3)], "w1 long, w2 long, w3 long, a long")
    got = {r.phrase: r for r in phrases._ranked(words, pairs, triples, 10, 50).collect()}
    assert got["a b"].score == 1_000_000 * (big - 5) ** 2 // big**2
    assert got["a b c"].score == 1_000_000 * (big // 3) ** 2 // (big * (big - 5))
    assert (got["a b c"].l, got["a b c"].r, got["a b c"].n) == (big, big - 5, 3 * big)


def hard(rows, anchors):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, []).append((label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for a in anchors:
        if a not in good:
            continue
        label, v = min(good[a])
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w, strict=True)), i, own) for i, all_ in good.items() if i != a for own, w in all_ if len(w) == len(v)
        )
        for s, i, _ in [x for x in scored if x[2] == label][:5]:
            window = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(a, i, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(window[:10])]
    return sorted(out)


@pytest.mark.parametrize("numbers", [negatives.BLOCK_NUMBERS, 64])
def test_hard_negatives(spark, numbers):
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 0.3, (6, 8))
    rows = [(i, (middle[i % 6] + rng.normal(0, 0.2, 8)).tolist(), int(rng.integers(0, 4)) if i % 3 else 7) for i in range(500)]
    rows += [(600, None, 1), (601, [1.0] * 7 + [None], 1), (602, [float("nan")] * 8, 1), (603, [float("inf")] * 8, 1), (604, [0.5] * 8, None)]
    rows += [(610, [0.0] * 8, 1), (611, [0.5, 0.25], 1), (612, [0.5, 0.5], 1), (613, [0.25, 0.25], 2), (614, [], 1), (615, [], 2), (None, [0.1] * 8, 1)]
    rows += [(1000 + i, [0.3] * 8, i % 2) for i in range(40)] + [(1000, [0.3] * 8, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    frame = frame.withColumn("a.b", frame.label).withColumn("block", frame.label).repartition(5)
    asked = [0, 50, 100, 333, 600, 610, 611, 614, 1000, 1001]
    out = negatives.hard_negatives(frame, frame.where(frame.vec_id.isin(asked)), numbers=numbers)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == hard(rows, asked)


def test_hard_negatives_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<double>, label long")
    assert negatives.hard_negatives(frame, frame).count() == 0


def test_large_products_and_the_curve():
    a, b = np.array([[1 << 40, -3]]), np.array([[1 << 20, 5], [1 << 40, 1]])
    assert negatives.products(a, b).tolist() == [[(1 << 60) - 15, (1 << 63) - 1]]
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    place = negatives.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
    assert set(steps.tolist()) == {1}  # neighbours on the curve are neighbours in the grid
