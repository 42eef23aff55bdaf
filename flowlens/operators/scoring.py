"""Model registry, ensemble vote and detection records.

A scorer yields ``p_attack`` per packet: one probability, or NULL where it fails. Scores
come *wide* (columns of the packet row, voted on without a shuffle) or *long*
(one row per packet and model, voted on with one aggregation per packet).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.schemas import MODEL
from flowlens.session import broadcast_if_small, computed_once

REGISTRY_BROADCAST_ROWS = 10_000
# Labels of the vote.
LABELS = ("attack", "normal", "unknown")
DETECTION_COLUMNS = [
    "packet_id",
    "timestamp",
    "src_ip",
    "dst_ip",
    "protocol",
    "prediction",
    "confidence",
    "is_alert",
]


# --- registry ---------------------------------------------------------------------------


def registry(spark: SparkSession, models: Sequence[tuple] = ()) -> DataFrame:
    """Table of ``(model, kind, weight, model_order, path)``."""
    rows = [(m[0], m[1], float(m[2]), i, m[3] if len(m) > 3 else None)
            for i, m in enumerate(models)]
    return spark.createDataFrame(rows, MODEL)


def clamped_weight(weight: Column) -> Column:
    """Weights lie in [0, 1]; a missing one is 1."""
    return F.least(F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))


def set_weight(models: DataFrame, name: str, weight: float) -> DataFrame:
    new = clamped_weight(F.lit(float(weight)))
    return models.withColumn(
        "weight", F.when(F.col("model") == name, new).otherwise(F.col("weight"))
    )


def add_model(models: DataFrame, name: str, kind: str, path: str | None = None) -> DataFrame:
    """Append with weight 1 and the next order; a known name changes nothing."""
    last = models.agg(
        F.coalesce(F.max("model_order"), F.lit(-1)).alias("last"),
        F.coalesce(F.bool_or(F.col("model") == name), F.lit(False)).alias("known"),
    ).first()
    if last["known"]:
        return models
    row = [(name, kind, 1.0, last["last"] + 1, path)]
    return models.unionByName(models.sparkSession.createDataFrame(row, MODEL))


def remove_model(models: DataFrame, name: str) -> DataFrame:
    return models.where(F.col("model") != name)


def model_info(models: DataFrame, name: str) -> DataFrame:
    return models.where(F.col("model") == name)


# --- scorers ----------------------------------------------------------------------------

Scorer = Callable[[DataFrame], DataFrame]
_SCORER_KINDS: dict[str, Callable[..., Scorer]] = {}


def scorer_kind(kind: str):
    """Register a factory for models of one kind: ``factory(path) -> scorer``."""

    def register(factory: Callable[..., Scorer]) -> Callable[..., Scorer]:
        _SCORER_KINDS[kind] = factory
        return factory

    return register


def make_scorer(kind: str, *args) -> Scorer:
    if kind not in _SCORER_KINDS:
        raise ValueError(f"no scorer for models of kind {kind}")
    return _SCORER_KINDS[kind](*args)


@scorer_kind("mllib")
def mllib_scorer(path: str) -> Scorer:
    """A saved MLlib pipeline: the probability of class 1."""
    from pyspark.ml import PipelineModel

    model = PipelineModel.load(path)

    def score(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("p_attack", attack_probability("probability"))

    return score


@scorer_kind("python")
def python_scorer(predict: Callable[[pd.DataFrame], pd.Series], schema: str) -> Scorer:
    """A foreign model, called on Arrow batches: ``predict(frame) -> p_attack``."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(p_attack=predict(frame))

    return lambda df: df.mapInPandas(batches, f"{schema}, p_attack double")


def attack_probability(column: str, classes: int = 2) -> Column:
    """The probability of class 1, or with more classes of any but class 0, the harmless one."""
    from pyspark.ml.functions import vector_to_array

    parts = vector_to_array(F.col(column))
    return parts[1] if classes == 2 else 1 - parts[0]


def best_class(probabilities: Column, labels: Sequence[str] | None = None) -> tuple[Column, Column]:
    """Label and probability of the most likely class; the first on ties.

    Without labels, or past their end, the label is the index as text.
    """
    top = F.array_max(probabilities)
    index = F.array_position(probabilities, top) - 1
    text = index.cast("string")
    if labels:
        named = F.get(F.array(*[F.lit(x) for x in labels]), index.cast("int"))
        return F.coalesce(named, text), top
    return text, top


# --- vote -------------------------------------------------------------------------------


def _label_of(p: Column, classes: Column) -> Column:
    return F.when(classes == 1, "unknown").when(p > 0.5, "attack").otherwise("normal")


class Score(NamedTuple):
    """What one model says on a row: ``p_attack``, its weight, and its number of classes."""

    p: Column
    weight: float = 1.0
    classes: int = 2


def _outcome(totals: dict[str, Column], firsts: dict[str, Column], weights: Column):
    """Winner and confidence from per-label sums, first places and the weight total."""
    entries = [
        F.when(
            firsts[x].isNotNull(),
            F.struct(totals[x].alias("score"), (-firsts[x]).alias("order"), F.lit(x).alias("label")),
        )
        for x in LABELS
    ]
    best = F.greatest(*entries)
    share = F.try_divide(best["score"], weights)
    voted = F.coalesce(weights > 0, F.lit(False))
    prediction = F.when(voted, best["label"]).otherwise("unknown")
    confidence = F.when(voted, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return prediction, confidence


def vote_wide(df: DataFrame, scores: Sequence[Score], mode: str = "reference") -> DataFrame:
    """Add ``prediction`` and ``confidence`` from scores that are columns of ``df``; no shuffle.

    ``reference`` adds ``p_attack * weight`` to the label each model voted for, also for
    "normal" votes, so one confident attack vote beats two normal ones. ``mean`` compares
    the weighted mean of ``p_attack`` with 0.5.
    """
    voters = [s for s in scores if s.weight > 0]
    # Each step is a projection of its own: one long expression would be repeated in every
    # place it is used, and make code too large for the JIT compiler.
    df = df.withColumns({f"_p{i}": _given(s.p) for i, s in enumerate(voters)})
    p = [F.col(f"_p{i}") for i in range(len(voters))]
    weight = [F.lit(float(s.weight)) for s in voters]
    steps = {
        "_weights": _total([F.when(a.isNotNull(), w).otherwise(0.0)
                            for a, w in zip(p, weight, strict=True)]),
        "_all": _total([F.coalesce(a * w, F.lit(0.0)) for a, w in zip(p, weight, strict=True)]),
    }
    for x in LABELS:
        votes = [_votes_for(x, a, s.classes) for a, s in zip(p, voters, strict=True)]
        steps[f"_sum_{x}"] = _total([F.when(v, a * w).otherwise(0.0)
                                     for v, a, w in zip(votes, p, weight, strict=True)])
        places = [F.when(v, i) for i, v in enumerate(votes)]
        steps[f"_first_{x}"] = F.coalesce(*places, F.lit(None).cast("int"))
    stepped = df.withColumns(steps)
    prediction, confidence = _decide(mode)
    voted = computed_once(stepped, {"prediction": prediction, "confidence": confidence})
    return voted.drop(*steps, *[f"_p{i}" for i in range(len(voters))])


def _given(p: Column) -> Column:
    """A score, or NULL where the scorer failed: NaN is no probability."""
    return F.nanvl(p.cast("double"), F.lit(None).cast("double"))


def _votes_for(label: str, p: Column, classes: int) -> Column:
    if classes == 1:
        return p.isNotNull() & F.lit(label == "unknown")
    return {"attack": p > 0.5, "normal": p <= 0.5}.get(label, F.lit(False))


def _decide(mode: str) -> tuple[Column, Column]:
    """The vote from the per-label sums and first places."""
    if mode == "mean":
        return _mean_vote(F.col("_all"), F.col("_weights"))
    return _outcome(
        {x: F.col(f"_sum_{x}") for x in LABELS},
        {x: F.col(f"_first_{x}") for x in LABELS},
        F.col("_weights"),
    )


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _mean_vote(weighted: Column, weights: Column) -> tuple[Column, Column]:
    mean = F.try_divide(weighted, weights)
    label = F.when(mean.isNull(), "unknown").when(mean > 0.5, "attack").otherwise("normal")
    return label, F.coalesce(F.when(mean > 0.5, mean).otherwise(1 - mean), F.lit(0.0))


def with_weights(scores: DataFrame, models: DataFrame) -> DataFrame:
    """Join the registry onto long scores; models not in it do not vote."""
    weights = models.select("model", "weight", "model_order")
    return scores.join(broadcast_if_small(weights, REGISTRY_BROADCAST_ROWS), "model")


def vote_long(scores: DataFrame, mode: str = "reference") -> DataFrame:
    """``(packet_id, prediction, confidence)`` from rows of packet, model, order, weight, p.

    One aggregation per packet with all labels as columns, so one shuffle.
    """
    p, w = _given(F.col("p_attack")), F.col("weight")
    valid = (w > 0) & p.isNotNull()
    classes = F.col("classes") if "classes" in scores.columns else F.lit(2)
    label = F.when(valid, _label_of(p, classes))
    sums = [F.sum(F.when(valid, w)).alias("_weights"), F.sum(F.when(valid, p * w)).alias("_all")]
    for x in LABELS:
        sums.append(F.sum(F.when(label == x, p * w)).alias(f"_sum_{x}"))
        sums.append(F.min(F.when(label == x, F.col("model_order"))).alias(f"_first_{x}"))
    grouped = scores.groupBy("packet_id").agg(*sums)
    prediction, confidence = _decide(mode)
    return grouped.select(
        "packet_id", prediction.alias("prediction"), confidence.alias("confidence")
    )


# --- detections -------------------------------------------------------------------------


def detection_records(voted: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Packets with ``prediction`` and ``confidence`` to detection rows."""
    at = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6 if timestamp is None else timestamp
    missing = {c: F.coalesce(F.col(c), F.lit("N/A")) for c in ("src_ip", "dst_ip", "protocol")}
    return voted.select(
        "packet_id",
        at.alias("timestamp"),
        *[v.alias(k) for k, v in missing.items()],
        "prediction",
        "confidence",
        (F.col("prediction") != "normal").alias("is_alert"),
    )


def detect(
    packets: DataFrame,
    scores: Sequence[Score],
    timestamp: Column | None = None,
    mode: str = "reference",
) -> DataFrame:
    """Vote on wide scores and keep the detection columns; map-side only."""
    return detection_records(vote_wide(packets, scores, mode), timestamp)


def apply_processors(
    df: DataFrame, processors: Sequence[Callable[[DataFrame], DataFrame]]
) -> DataFrame:
    """Run packet processors in order; each is a function of a DataFrame."""
    return reduce(lambda frame, step: frame.transform(step), processors, df)
