"""Small tables with the cases every text operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents() -> list[tuple]:
    """Nulls, blanks, repeats, copies with edits, passages, long words, and texts of many kinds."""
    rng = random.Random(7)
    syllables = "tha ni or el ti sha be que mon der ung ist con la".split()

    def prose(n: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    passage = prose(60)
    base = prose(120).split()
    texts = [None, "", " ", "\n\t", "one", "two words", "... !!", "a" * 5000, "é" * 300, "日本語のテキスト " * 30, passage, passage]
    texts += [prose(rng.randint(5, 200)) for _ in range(40)]
    texts += [f"{prose(20)} {passage} {prose(15)}" for _ in range(6)]
    for i in range(8):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"edit{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 3 + [prose(4000), "x\0y <|endoftext|> don't  stop\r\n", "ab " * 400]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}", 0) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
