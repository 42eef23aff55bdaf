"""Columns whose names hold dots and back-quotes go through every text operator."""

from flowlens.llm import decontaminate, language, pieces, repeats, tokens, toxicity
from flowlens.llm.queries import tokenizer
from tests.llm import edges


def test_odd_names_and_plain_names_give_the_same(spark):
    rows = [r for r in edges.documents() if r[1] is None or len(r[1]) < 2_000]
    plain = edges.frame(spark, rows)
    odd = plain.withColumnRenamed("source", "a.b").withColumnRenamed("n_chars", "c`d")
    bench = plain.limit(3).selectExpr("doc_id as item_id", "text")
    labels = plain.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    model = language.learn(plain)
    path = tokenizer("piece_bpe_32k.model")
    for run in (
        lambda df: decontaminate.without_passages(decontaminate.find_passages(df, bench)),
        lambda df: language.labelled(df, model),
        lambda df: pieces.decode(pieces.encode(df, path), path),
        lambda df: repeats.without_repeats(repeats.repeated_spans(df)),
        lambda df: tokens.count_tokens(df, tokenizer("byte_bpe_50k.json")),
        lambda df: toxicity.scored(df, labels),
    ):
        want, got = run(plain), run(odd)
        assert got.columns == [{"source": "a.b", "n_chars": "c`d"}.get(c, c) for c in want.columns]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_number_signs_are_no_letters(spark):
    docs = edges.frame(spark, [(1, "\u00b2 \u00bd \u2460", "en", None, 0), (2, "some words", "en", None, 0), (3, "\u65e5\u672c", "ja", None, 0), (4, "\u216b", "en", None, 0)])
    got = {r.doc_id: r.lang_pred for r in language.labelled(docs, language.learn(docs)).collect()}
    assert got == {1: "und", 2: "en", 3: "ja", 4: "und"}
