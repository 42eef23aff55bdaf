"""The stages one by one against plain Python, on the table of edge cases."""

import public_tokenizers
import pyarrow as pa
from sentencepiece import SentencePieceProcessor

import corpus_pipeline as pipeline
from flowlens.llm import language
from tests.llm import edges
from tests.llm.test_passages_and_near import classes, hits, shingles
from tests.llm.test_repeats_and_pieces import spans


def cut_bytes(text, removed):
    data, out, at = text.encode(), b"", 0
    for a, b in removed:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out, at = out + data[at:a], b
    return (out + data[at:]).decode()


def test_every_stage(spark, tmp_path):
    rows = edges.documents()
    docs = edges.frame(spark, rows)
    items = [(1, " ".join(next(t for _, t, *_ in rows if t and len(t.split()) == 4000).split()[100:140])), (2, "two words")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    state = {i: t for i, t, *_ in rows}
    frames = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = frames[name] = spark.read.parquet(str(tmp_path / name))
        if name != "pieces":
            assert docs.columns == edges.frame(spark).columns
    # only one language is labelled, so what has a letter is kept
    state = {i: t for i, t in state.items() if t and any(c.isalpha() for c in t)}
    assert {r.doc_id: r.text for r in frames["language"].collect()} == state
    group = classes({i: shingles(t, 5) for i, t in state.items()}, 80)
    state = {i: t for i, t in state.items() if group[i] == i}
    assert {r.doc_id: r.text for r in frames["near"].collect()} == state
    removed = spans(sorted(state.items()), 100)
    state = {i: cut_bytes(t, removed[i][1]) for i, t in state.items()}
    state = {i: t for i, t in state.items() if t.strip() or not removed[i][1]}
    got = {r.doc_id: r for r in frames["repeats"].collect()}
    assert {i: r.text for i, r in got.items()} == state
    assert all(r.n_chars == len(r.text) for r in got.values())
    after = {r.doc_id: r.text for r in frames["benchmark"].collect()}
    for i, t in state.items():
        n, hit, _ = hits(t, items, 10)
        assert (i in after) == (2 * len(hit) <= n)
        if i in after:
            assert after[i] == t if not hit else not hits(after[i], items[:1], 10)[1]
    library = SentencePieceProcessor(model_file=public_tokenizers.path(pipeline.MODEL))
    for r in frames["pieces"].collect():
        assert r.ids == library.encode(after[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip
    assert frames["pieces"].count() == len(after)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    edges.frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_row_has_a_language(spark):
    rows = [(i, t, None, s, n) for i, t, _, s, n in edges.documents()] + [(-1, "12 _ 3", None, None, 0), (-2, "² ½", None, None, 0)]
    want = {i: t for i, t, *_ in rows if t and language._ANY_LETTER.search(t)}
    assert want and -1 not in want and -2 not in want
    kept = pipeline.one_language(spark, edges.frame(spark, rows), "")
    assert kept.columns == edges.frame(spark).columns
    assert {r.doc_id: r.text for r in kept.collect()} == want


def test_stages_bound_the_batches_of_workers(spark):
    before = {key: spark.conf.get(key) for key in pipeline.LIMITS}
    most = pipeline.LIMITS["spark.sql.execution.arrow.maxBytesPerBatch"]
    docs = spark.range(0, 64, 1, 1).selectExpr("id as doc_id", "repeat(concat('word ', id, ' '), 20000) as text", "'en' as lang")

    def sizes(parts):
        for rows in parts:
            yield pa.RecordBatch.from_arrays([pa.array([rows.nbytes])], ["size"])

    try:
        for label, stage in pipeline.STAGES:
            if label in ("language", "pieces"):
                for key, value in before.items():
                    spark.conf.set(key, value)
                stage(spark, docs, "")
                found = [r.size for r in docs.mapInArrow(sizes, "size long").collect()]
                assert sum(found) > 4 * most
                assert max(found) < most + 400_000, label
        lower = str(most // 4)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", lower)
        pipeline.encoded(spark, docs, "")
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").startswith(lower)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
