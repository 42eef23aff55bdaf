"""Language, toxicity, neighbours, transcripts and shards."""

import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import chat, language, neighbours, shards, toxicity
from tests.llm import edges


def all_paths(scores, switch):
    """The best labelling of the words by trying all of them."""
    best = None
    for labels in product(range(scores.shape[1]), repeat=len(scores)):
        value = sum(scores[i, x] for i, x in enumerate(labels)) - switch * sum(a != b for a, b in zip(labels, labels[1:], strict=False))
        if best is None or value > best[0] + 1e-6:
            best = (value, labels)
    return best


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 7, 0, 5, 7, 3, 6]
    scores = rng.normal(size=(sum(sizes), 3)).astype(np.float32)
    at = np.r_[0, np.cumsum(sizes)]
    got = language.viterbi(scores, at, 0.7)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if a < b:
            own = scores[a:b]
            path = got[a:b]
            value = sum(own[i, x] for i, x in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:], strict=False))
            assert value == pytest.approx(all_paths(own, 0.7)[0], abs=1e-4)


def test_languages_spans_and_scripts(spark):
    words = {"en": "the of and that with this from have", "de": "der und nicht auch eine werden ist für", "ru": "это что как его она они было"}
    rng = random.Random(1)

    def prose(lang, n):
        return " ".join(rng.choice(words[lang].split()) for _ in range(n))

    rows = [(i, prose(lang, 30), lang, None, 0) for i, lang in enumerate(["en", "de", "ru"] * 10)]
    model = language.learn(edges.frame(spark, [*rows, (99, prose("de", 9), None, None, 0)]))
    assert model.languages == ["de", "en", "ru"]
    texts = [f"{prose('en', 30)} {prose('de', 12)}", prose("ru", 3), "  12 — 34!", None, "", "Für ÜBER", f"{prose('de', 5)} {prose('ru', 9)}"]
    asked = edges.frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]).withColumnRenamed("source", "score")
    got = {r.doc_id: r for r in language.labelled(asked, model).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["en", "ru", "und", "und", "und", "de", "ru"]
    assert [s.lang for s in got[0].lang_spans] == ["en", "de"] and [s.lang for s in got[6].lang_spans] == ["de", "ru"]
    cut = texts[0].encode()[got[0].lang_spans[1].start : got[0].lang_spans[1].end].decode()
    assert cut.split() == texts[0].split()[30:]
    assert got[3].score == 0 and got[1].score == 1 and 0.5 < got[0].score < 1
    nothing = language.labelled(asked, language.learn(edges.frame(spark, [])))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language.labelled(asked.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def insulted(spark):
    rng = random.Random(4)
    plain = "the and of that with from moon lake idea book stone grass water letter summer evening".split()
    docs, labels = [], []
    for i in range(300):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 3 == 0:
            words[rng.randrange(30)] = rng.choice(["idiot", "moron", "worthless"])
        docs.append((i, " ".join(words), None, None, 0))
        labels.append((i, int(i % 3 == 0)))
    hidden = ["1d10t", "m0r0n", "w0rthle$$", "i d i o t", "m.o.r.o.n", "iiidiooot", "idi-ot", "MORON!!!", "***idiot***"]
    asked = [(1000 + i, f"the moon and the lake {w} of summer evening", None, None, 0) for i, w in enumerate(hidden)]
    clean = ["the 4 moons of 2024", "a letter from the lake", None, "", "  ", "look!! a book $$$", "b o o k", "moon " * 3000]
    asked += [(2000 + i, t, None, None, 0) for i, t in enumerate(clean)]
    return docs, labels, asked, hidden


def test_hidden_words_are_restored_and_scored(spark, insulted):
    docs, labels, asked, hidden = insulted
    given = spark.createDataFrame([*labels, (5, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(edges.frame(spark, docs + asked).withColumnRenamed("source", "_label"), given).collect()}
    assert len(got) == len(docs) + len(asked)
    assert all(got[1000 + i] > 0.5 for i in range(len(hidden))), [(w, got[1000 + i]) for i, w in enumerate(hidden)]
    assert all(got[i] < 0.3 for i, *_ in asked if i >= 2000)


def test_scores_without_labels_and_of_nothing(spark, insulted):
    docs = edges.frame(spark, insulted[0][:20])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert max(r.score for r in toxicity.scored(docs, none).collect()) < 1e-6
    ones = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert min(r.score for r in toxicity.scored(docs, ones).collect()) > 1 - 1e-6
    assert toxicity.scored(docs.limit(0), none).count() == 0


def test_nearest_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=9).tolist()) for i in range(200)]
    rows += [(200 + i, rows[i % 7][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, [0.0] * 9), (302, [1.0] * 8 + [None]), (303, [float("nan")] * 9), (304, [float("inf")] + [1.0] * 8)]
    rows += [(305, [1.0, 2.0]), (310, [1.0, 2.5]), (306, []), (320, [1e200] * 9), (330, [-1e200] * 9), (340, [1e-200] * 9), (None, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    want = set()
    for q in (i for i in good if i % 10 == 0):
        found = sorted((float(np.sqrt(sum(np.float64(x) ** 2 for x in good[q] - v))), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        want |= {(q, rank + 1, i, d) for rank, (d, i) in enumerate(found[:10])}
    for block in (4_096, 5):
        got = neighbours.nearest(df, df.where("vec_id % 10 = 0"), 10, query_block=block).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert neighbours.nearest(df, df.limit(0)).count() == 0 and neighbours.nearest(df.limit(0), df).count() == 0


def test_best_branch_of_reply_trees(spark):
    nodes = [
        (1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 2.0), (1, 4, 2, 5.0), (1, 5, 3, 1.0), (1, 6, 5, 1.0),  # 1-2-4 is best
        (2, 1, None, None), (2, 2, 99, 3.0),  # a missing parent makes a root
        (3, 1, 2, 9.0), (3, 2, 1, 9.0), (3, 3, None, 0.0),  # a cycle is on no path
        (None, 1, None, 1.0), (None, 2, 1, 1.0),
        *[(4, i, i - 1 if i else None, 1.0) for i in range(70)],
    ]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double").repartition(3)
    got = {}
    for r in chat.chosen_paths(df).collect():
        got.setdefault(r.tree, []).append((r.position, r.node))
    want = {1: [1, 2, 4], 2: [2], 3: [3], None: [1, 2], 4: list(range(70))}
    assert {t: [n for _, n in sorted(p)] for t, p in got.items()} == want
    assert all(sorted(x for x, _ in p) == list(range(len(p))) for p in got.values())
    assert chat.chosen_paths(df.limit(0)).count() == 0
    assert {(r.tree, r.path) for r in chat.chosen_paths(df.where("tree = 1"), top=5).collect()} == {(1, 4), (1, 6)}


def test_transcripts_read_back(spark):
    odd = ["", None, "\\", "<|end|>", "\\<|text|>\\\\", "</s>[INST] ok [/INST]", "<|", "|>", "<<<|turn|>", "a\nb\n", "<</SYS>><s>", "é😀[[INST]]\\["]
    rows = [(c, t, ["user", "assistant", None, "<|end|>\n"][(c + t) % 4], odd[(c * 5 + t) % len(odd)]) for c in range(6) for t in range(c * 3)]
    rows += [(50, 1, "user", "b"), (50, 1, "assistant", "a"), (50, None, "user", "first"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.formatted(chat.linked(df))
    out = out.withColumn("said", chat.read_turns(out.formatted)).withColumn("loss", chat.read_masked(out.formatted, out.mask))
    low = lambda x: (x is not None, x if x is not None else 0)
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), low(r[2] or None), low(r[3]))):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {r.tree: r for r in out.collect()}
    assert {c: [tuple(t) for t in r.said] for c, r in got.items()} == want
    assert {c: r.loss for c, r in got.items()} == {c: [t for role, t in turns if role == "assistant"] for c, turns in want.items()}
    for r in got.values():
        assert r.formatted.count(chat.END) == r.n_turns
    assert chat.formatted(chat.linked(df.limit(0))).count() == 0


def test_shards_are_even_gapless_and_keep_groups(spark, tmp_path):
    rows = edges.documents()
    rows += [(1000 + i, f"text {i} " * (i % 60), None, None, 0) for i in range(3000)] + [(9000 + i, "one hot text", None, None, 0) for i in range(1500)]
    rows += [(None, "no id", None, None, 0), (1000, "text 0", None, None, 0), (1000, "text 0", None, None, 0)]
    docs = edges.frame(spark, rows).withColumnRenamed("source", "size")
    for limit in (shards.RANGE_ROWS, 100):
        got = shards.sharded(docs, 8, range_rows=limit).collect()
        assert sorted((-1 if r.id is None else r.id, r.size, r.text_crc32) for r in got) == sorted(
            (-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
        )
        held = [[r for r in got if r.shard == s] for s in range(8)]
        assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in held)
        sizes = [sum(r.size for r in own) for own in held]
        assert max(sizes) - min(sizes) < 0.1 * sum(sizes) / 8 + 2 * max(len(t or "") for _, t, *_ in rows)
        split = {}
        for r in got:
            split.setdefault(r.hash, set()).add(r.shard)
        assert sum(len(s) > 1 for s in split.values()) <= 1
    shards.write_shards(docs, str(tmp_path / "out"), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and set(docs.columns) - {"size"} <= set(back.columns)
    assert shards.sharded(docs.limit(0), 8).count() == 0


def test_pipeline_texts_of_scores_are_arrow_safe():
    rows = pa.RecordBatch.from_arrays([pa.array([None, "", "a"])], ["text"])
    assert toxicity.Restored(rows, "text", np.zeros((29, 29, 29))).n == 3
