"""The corpus pipeline: stages over ``documents``, each one an operator of the text subpackage.

Each stage works on all rows and whole texts that the one before it kept. Null ids and texts
pass through; an empty table gives an empty result. Stages keep the columns of ``documents``;
the last one adds the piece ids of the texts.

A stage hands its rows to Python workers in Arrow batches of bounded size and reads Parquet in short
vectors. Spark's own sizes are counts of rows, so with whole texts they take memory many times
over: in the vectors, in the buffer of the socket, and in each worker of a task.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, language, near, pieces, repeats
from flowlens.llm.batches import name
from flowlens.llm.queries import table, tokenizer
from flowlens.session import work_path

#: A text of which no language has this share of the letters is rejected.
MAIN_LANGUAGE = 0.5
#: A text is dropped, not cut, if benchmark passages hold more than this share of its words.
PASSAGE_SHARE = 0.5
#: What counts as a letter in ``language.labelled``.
LETTER = r"\p{L}"
MODEL = "piece_bpe_32k.model"
#: Bytes of an Arrow batch (and one row more), and rows of a vector of the Parquet reader.
LIMITS = {"spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _columns(docs: DataFrame) -> list:
    return [name(c) for c in docs.columns]


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def _bounded(stage: Stage) -> Stage:
    """Lower the session's limits to ``LIMITS`` before the stage; lower ones stay.

    Spark reads them when it plans the result, so they hold on after the call.
    """

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, most in LIMITS.items():
            now = int(spark.conf.get(key).removesuffix("b"))
            if not 0 < now <= most:
                spark.conf.set(key, str(most))
        return stage(spark, docs, sf_dir)

    return bounded


@_bounded
def one_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that have letters and one main language; all with letters if no row has a language."""
    model = language.learn(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(LETTER))
    found = language.labelled(docs, model, spans=False)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MAIN_LANGUAGE))
    return kept.select(*_columns(docs))


@_bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates keep the document of smallest id."""
    gone = near.near_duplicates(docs, words=5, percent=80).where(~F.col("kept")).select(F.col("id").alias("doc_id"))
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*_columns(docs))


@_bounded
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out what an earlier document, or the same one before, already says."""
    return _recounted(repeats.without_repeats(repeats.repeated_spans(docs))).select(*_columns(docs))


@_bounded
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out benchmark passages; documents that are mostly such passages go."""
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"))
    return _recounted(decontaminate.without_passages(found, drop_share=PASSAGE_SHARE)).select(*_columns(docs))


@_bounded
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ids, n_tokens, and whether decoding the ids gives the text back (blank signs as blanks)."""
    path = tokenizer(MODEL)
    back = pieces.encode(docs, path, decoded="decoded")
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.BLANK), F.lit(" "))
    return back.select(*_columns(docs), "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == plain).alias("round_trip"))


STAGES = [
    ("language", one_language),
    ("near", near_duplicates),
    ("repeats", repeated_passages),
    ("benchmark", benchmark_passages),
    ("pieces", encoded),
]

#: SQL can't express the language model or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    before = {key: spark.conf.get(key) for key in LIMITS}
    docs = table(spark, sf_dir, "documents")
    try:
        for label, stage in STAGES:
            path = work_path(spark, f"pipeline-{label}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return docs
