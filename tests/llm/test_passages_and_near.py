"""Benchmark passages, near-duplicates and components against plain Python."""

import random
import re
from itertools import pairwise

import numpy as np

from flowlens.llm import decontaminate, near
from flowlens.llm.components import components
from tests.llm import edges

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def hits(text, items, window):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, item_text in items:
        own = WORD.findall((item_text or "").translate(LOWER))
        size = min(window, len(own))
        phrases = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if own else 0):
            if tuple(words[i : i + size]) in phrases:
                hit.update(range(i, i + size))
                found.add(item)
    return len(words), hit, sorted(found)


def test_passages_match_brute_force_in_one_block_and_in_many(spark):
    rows = edges.documents()
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 50]
    items = [(i, " ".join(t.split()[3 : 3 + n]).upper()) for i, (t, n) in enumerate(zip(texts, (30, 12, 9, 1, 40, 10, 3), strict=False))]
    items += [(90, None), (91, ""), (92, "?!"), (93, items[0][1]), (94, "one")]
    docs = edges.frame(spark).withColumnRenamed("source", "item")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {r[0]: hits(r[1], items, 10) for r in rows}
    for size in (decontaminate.BLOCK_BYTES, 200):
        found = decontaminate.find_passages(docs, bench, block_bytes=size)
        assert found.columns == [*docs.columns, "passages"]
        for row in found.collect():
            words, hit, ids = want[row.doc_id]
            spans = row.passages.spans
            assert row.passages.n_words == words
            assert {w for s in spans for w in range(s.first_word, s.end_word)} == hit
            assert all(a.end_word < b.first_word for a, b in pairwise(spans))
            assert sorted(map(int, row.passages.items)) == ids
            for s in spans:
                cut = (row.text or "").encode()[s.start : s.end].decode()
                assert len(WORD.findall(cut.translate(LOWER))) == s.end_word - s.first_word


def test_cutting_passages(spark):
    docs = spark.createDataFrame(
        [(1, "keep these words, alpha beta gamma, and these too"), (2, "alpha beta gamma"), (3, None), (4, "é alpha beta gamma é bb cc dd")],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(1, "Alpha beta GAMMA")], "item_id long, text string")
    kept = decontaminate.without_passages(decontaminate.find_passages(docs, bench)).collect()
    assert {r.doc_id: r.text for r in kept} == {1: "keep these words, , and these too", 3: None, 4: "é  é bb cc dd"}


def test_passages_of_empty_tables(spark):
    docs, bench = edges.frame(spark), spark.createDataFrame([], "item_id long, text string")
    assert all(not r.passages.spans for r in decontaminate.find_passages(docs, bench).collect())
    assert decontaminate.find_passages(docs.limit(0), docs.selectExpr("doc_id as item_id", "text")).count() == 0


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def classes(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and both:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_duplicates_match_all_pairs(spark):
    rows = edges.documents()
    sets = {r[0]: shingles(r[1], 3) for r in rows}
    want = classes(sets, 85)
    docs = edges.frame(spark).withColumnRenamed("source", "rep")
    got = {r.id: r for r in near.near_duplicates(docs, words=3, percent=85).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert len(set(want.values())) < len(want) - 8


def test_near_duplicates_in_large_nodes(spark, monkeypatch):
    """Nodes of more than three documents are compared block by block, or branch on."""
    monkeypatch.setattr(near, "NODE", 4)
    rows = edges.documents()
    want = classes({r[0]: shingles(r[1], 5) for r in rows}, 80)
    docs = edges.frame(spark).withColumnRenamed("source", "a.b").withColumnRenamed("lang", "label")
    for whole in (10**9, 6):
        monkeypatch.setattr(near, "WHOLE", whole)
        got = near.near_duplicates(docs, words=5, percent=80).collect()
        assert {r.id: r.component_id for r in got} == want


def families():
    """A star (copies linked to the original, hardly to each other) and a chain without an original."""
    rng = random.Random(5)
    texts = []
    for copies, step, whole in ((70, 4, True), (60, 3, False)):
        base = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        texts += [" ".join(base)] if whole else []
        for i in range(copies):
            copy = list(base)
            copy[i * step : i * step + 12] = [f"e{rng.randrange(10**9)}" for _ in range(12)]
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return [(i, t, None, None, None) for i, t in enumerate(texts)]


def test_near_duplicates_of_families_in_large_nodes(spark, monkeypatch):
    """Neither a star nor a chain falls apart, compared in blocks or after branching."""
    rows = families()
    want = classes({r[0]: shingles(r[1], 3) for r in rows}, 85)
    assert len(set(want.values())) == 2
    for node, whole in ((12, 10**9), (8, 40)):
        monkeypatch.setattr(near, "NODE", node)
        monkeypatch.setattr(near, "WHOLE", whole)
        got = near.near_duplicates(edges.frame(spark, rows), words=3, percent=85).collect()
        assert {r.id: r.component_id for r in got} == want


def test_links_by_bits_equal_links_by_pairs(monkeypatch):
    """Forests of the same components whatever the way, and exact counts; parts cover every pair."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 90).astype(np.uint64)
    sets = [np.zeros(0, np.uint64)]
    for _ in range(150):
        own = base[rng.random(90) < rng.choice([0.95, 0.9, 0.5])]
        sets.append(np.sort(np.r_[own, rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)]))
    monkeypatch.setattr(near, "COLUMNS", 64)

    def trees(links):
        root = np.arange(len(sets))
        for i, j, common, whole in links:
            assert common == len(np.intersect1d(sets[i], sets[j])) and whole == len(sets[i]) + len(sets[j]) - common
            assert 100 * common >= 85 * whole and root[i] != root[j]
            near._merged(root, i, np.array([j]))
        return root.tolist()

    few = trees(near._links_of_few(sets, 85))
    assert trees(near._links_of_many(sets, 85)) == few
    assert 5 < len(set(few)) < 140
    monkeypatch.setattr(near, "PART", 7)
    monkeypatch.setattr(near, "PART_SHINGLES", 500)
    part = near._parts(np.array([len(s) for s in sets]))
    assert (np.bincount(part) <= 7).all() and part.max() > 20


def test_recall_on_a_family_around_the_limit(spark):
    """Fifteen hundred copies, alike at 0.75 to 0.95, next to texts of one common sentence."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(1500):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(148)
            copy[at] = f"e{i}x{at}"
        texts.append(" ".join(copy))
    texts += [" ".join(base[:12] + [f"o{i}y{k}" for k in range(60)]) for i in range(300)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    sets = [np.array(sorted({hash(x) for x in shingles(t, 3)}), np.int64).view(np.uint64) for t in texts]
    sets = [np.sort(s) for s in sets]
    root = np.arange(len(sets))
    for i, j, _, _ in near._links_of_many(sets, 85):
        near._merged(root, i, np.array([j]))
    got = {r.id: r.component_id for r in near.near_duplicates(edges.frame(spark, rows), words=3, percent=85).collect()}
    assert got == dict(enumerate(root.tolist()))


def test_near_duplicates_without_ids_twice_and_of_nothing(spark):
    rows = [(None, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (1, "z y x", None, None, None), (2, "z y x", None, None, None)]
    got = sorted((r.id or 0, r.component_id or 0, r.kept) for r in near.near_duplicates(edges.frame(spark, rows), words=3).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near.near_duplicates(edges.frame(spark, [])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 99), (99, 98), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, 98: 98, 99: 98, 100: 98}
