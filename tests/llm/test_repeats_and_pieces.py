"""Repeated passages, token counts and pieces against plain Python and the public libraries."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from flowlens.llm import batches, pieces, repeats, tokens
from tests.llm import edges

PIECES, BPE = (public_tokenizers.path(f) for f in ("piece_bpe_32k.model", "byte_bpe_50k.json"))


def spans(rows, window):
    seen, out = set(), {}
    for key, text in rows:
        data = (text or "").encode()
        cover = bytearray(len(data))
        for i in range(len(data) - window + 1):
            if data[i : i + window] in seen:
                cover[i : i + window] = b"\1" * window
            seen.add(data[i : i + window])
        edge = [i for i in range(len(cover) + 1) if (i < len(cover) and cover[i]) != (i > 0 and cover[i - 1])]
        kept = bytes(b for b, c in zip(data, cover, strict=True) if not c)
        out[key] = (len(data), list(zip(edge[::2], edge[1::2], strict=True)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("divided", [False, True])
def test_repeats_match_brute_force(spark, monkeypatch, divided):
    if divided:  # every anchor with two pieces is divided by window
        monkeypatch.setattr(repeats, "SLICE_PIECES", 2)
        monkeypatch.setattr(repeats, "BUCKET_PIECES", 1)
    rows = edges.documents()
    want = spans(sorted((r[0], r[1]) for r in rows), 100)
    docs = edges.frame(spark).withColumnRenamed("source", "bucket").withColumnRenamed("n_chars", "id")
    found = repeats.repeated_spans(docs)
    assert found.columns == [*docs.columns, "repeats"]
    got = {r.doc_id: (r.repeats.n_bytes, [tuple(s) for s in r.repeats.spans], r.repeats.kept_sha256) for r in found.collect()}
    assert got == want
    kept = {r.doc_id: r.text for r in repeats.without_repeats(found).collect()}
    assert kept[min(i for i, t, *_ in rows if t is None)] is None
    assert all(kept.get(i) == t for i, t, *_ in rows if not want[i][1])


def test_repeats_of_rows_with_one_id_and_of_nothing(spark):
    text = "".join(chr(97 + random.Random(3).randrange(26)) + str(i) for i in range(80))
    rows = [(1, text, None, None, 0), (1, text, None, None, 0), (2, f"zz{text}", None, None, 0), (None, "short", None, None, 0)]
    got = sorted((r.doc_id or 0, len(r.repeats.spans)) for r in repeats.repeated_spans(edges.frame(spark, rows)).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 1)]
    assert repeats.repeated_spans(edges.frame(spark, [])).count() == 0


@pytest.mark.parametrize("keep_text", [True, False])
def test_one_shuffle_of_the_texts_serves_pieces_and_spans(spark, keep_text):
    found = repeats.repeated_spans(edges.frame(spark), keep_text=keep_text)
    assert len(found.collect()) == len(edges.documents())
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1


def test_released_workers_keep_no_tables_of_powers():
    data, at = np.random.default_rng(1).integers(0, 256, 500_000).astype(np.uint8), np.array([3])
    held = batches.Fingerprints(data)
    want = held.spans(at, at + 400_000).tolist()
    batches.release()
    assert len(batches.Fingerprints._powers) == len(batches.Fingerprints._inverse) == 1
    assert held.spans(at, at + 400_000).tolist() == want
    assert batches.Fingerprints(data[:450_000]).spans(at, at + 400_000).tolist() == want


def test_levels_halve():
    levels = repeats.Levels(4)
    rng = random.Random(1)
    seen = set()
    for _ in range(30):
        batch = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(4, 12))) for _ in range(5)]
        want = []
        for piece in batch:
            for i in range(len(piece) - 3):
                want.append(piece[i : i + 4] in seen)
                seen.add(piece[i : i + 4])
        assert levels.add(batch).tolist() == want
        assert all(len(a) >= 2 * len(b) for a, b in zip(levels.levels, levels.levels[1:], strict=False))


ODD = ["a", "the", "s", " ", "  ", "     ", "\n", "\t", "1", "é", "²", "日", "!", "''", "'s", "'re", "ing", "　", "<s>", "don't", "\r", "😀",
       "\xa0", "\x1c", "hello", "aaaaaaaa", "\0", "<|endoftext|>", " " * 25]


def odd_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(n)] + [None, ""]


def test_pre_tokens_match_the_library():
    texts, library = odd_texts(3000), Tokenizer.from_file(BPE)
    found = tokens.PreTokens(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), "text", tokens._special(BPE))
    lengths = tokens._lengths(BPE, [found.text(i) for i in range(len(found.row))])
    got = np.bincount(found.row, lengths, len(texts)).astype(int) + found.special
    assert got.tolist() == [len(library.encode(t or "", add_special_tokens=False)) for t in texts]


def test_token_counts(spark):
    docs, library = edges.frame(spark).withColumnRenamed("source", "n_tokens"), Tokenizer.from_file(BPE)
    for size in (50, 1):
        got = tokens.count_tokens(docs, BPE, table_size=size).collect()
        assert len(got) == len(edges.documents())
        for r in got:
            text = r.text or ""
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False)))
    assert tokens.count_tokens(docs.limit(0), BPE).count() == 0


def test_pieces_match_the_library():
    library = SentencePieceProcessor(model_file=PIECES)
    texts = [*odd_texts(1500), "▁x▁▁y", "a" * 3000]
    for part in (texts, texts[::3]):  # the second time from the words met before
        ids, at = pieces.encoded_texts(pa.array(part, pa.string()), PIECES)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t or "") for t in part]


def unbroken_texts(n):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    signs = "日本語的是不了人我在有中国这個漢字をはにのがと한글"
    return {
        "base64": "".join(rng.choices(letters, k=n)),
        "signs": "".join(rng.choices(signs, k=n)),
        "one letter": "a" * n,
        "repeated": ("internationalisation" * n)[:n],
        "blanks": " " * n,
        "mixed": "".join(rng.choices(["the", "ing", "日", "é", "1", "aa", "_", "😀"], k=n // 2)),
    }


def test_long_words_match_the_library():
    library = SentencePieceProcessor(model_file=PIECES)
    for size in (49, 4_000, 50_000):
        texts = list(unbroken_texts(size).values())
        ids, at = pieces.encoded_texts(pa.array(texts, pa.string()), PIECES)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t) for t in texts]


def test_a_million_characters_without_a_blank():
    library = SentencePieceProcessor(model_file=PIECES)
    texts = unbroken_texts(1_000_000)
    for name in ("base64", "signs"):
        began = time.process_time()
        ids, _ = pieces.encoded_texts(pa.array([texts[name]], pa.string()), PIECES)
        assert time.process_time() - began < 60
        assert ids.tolist() == library.encode(texts[name])


def test_words_remembered_stay_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED_IDS", 1_000)
    library = SentencePieceProcessor(model_file=PIECES)
    for text in (unbroken_texts(700 + k)["base64"] for k in range(6)):
        assert pieces.encoded_texts(pa.array([text]), PIECES)[0].tolist() == library.encode(text)
        assert len(pieces._known[PIECES].ids) <= 1_000


def test_pieces_round_trip(spark):
    docs = edges.frame(spark).withColumnRenamed("source", "ids")
    back = pieces.decode(pieces.encode(docs, PIECES), PIECES)
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert pieces.decode(pieces.encode(docs.limit(0), PIECES), PIECES).count() == 0
    broken = spark.createDataFrame([([198 + 3],), (None,), ([],)], "ids array<int>")
    assert sorted(r.decoded for r in pieces.decode(broken, PIECES).collect()) == ["", "", "�"]
