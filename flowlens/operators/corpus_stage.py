"""Corpus preparation as a pipeline stage that is fitted, saved and loaded with its model.

Fitting learns medians, most frequent values, category codes, clip bounds and scales from the
rows it is given, normally the training part. The fitted stage is a projection of literals, so
it costs no shuffle and works on streams; only columns of many categories are joined with
their codes, which are saved as tables beside the parameters.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.numeric import finite, standardized
from flowlens.operators import prep
from flowlens.operators.encode import CODES_BROADCAST_ROWS, LITERAL_CATEGORIES, category_lists, distributed_codes, modes
from flowlens.operators.quantiles import exact_quantiles
from flowlens.operators.split import class_sizes
from flowlens.session import broadcast_if_small, materialized, work_path


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _kind(field: T.StructField) -> str:
    return "number" if isinstance(field.dataType, T.NumericType | T.BooleanType) else "text"


class CorpusPreparation(Estimator):
    """Learns to turn a corpus row into a vector ``features`` and a ``label``.

    The label column is ``label``, or else found by name. Columns named in ``keep`` and
    address columns are no features; of the rest, numbers and truth values count as numbers and
    all else as text. Rows without a label are not learned from; there must be two classes.
    """

    def __init__(self, label: str | None = None, keep: tuple[str, ...] = (), literal_categories: int = LITERAL_CATEGORIES):
        super().__init__()
        self.label, self.keep, self.literal_categories = label, tuple(keep), literal_categories

    def _fit(self, dataset: DataFrame) -> CorpusPreparationModel:
        usable = prep.drop_address_columns(dataset.drop(*self.keep))
        label = self.label or prep.find_label(usable.columns)
        kinds = {f.name: _kind(f) for f in usable.schema.fields if f.name != label}
        names = {name: f"c{i}" for i, name in enumerate(kinds)}
        rows = usable.where(_column(label).isNotNull()).select(
            _column(label).cast("string").alias("label"), *[_given(name, kind).alias(names[name]) for name, kind in kinds.items()]
        )
        rows = materialized(rows, "corpus-stage")
        labels = sorted(class_sizes(rows, "label"), key=_label_order)
        if len(labels) < 2:
            raise ValueError("the label column has one class only")
        numbers = [names[c] for c, kind in kinds.items() if kind == "number"]
        texts = [names[c] for c, kind in kinds.items() if kind == "text"]
        medians = {c: (m[0] if m[0] is not None else 0.0) for c, m in exact_quantiles(rows, {c: [0.5] for c in numbers}).items()}
        common = {c: m if m is not None else "unknown" for c, m in modes(rows, texts).items()}
        filled = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in common.items()})
        lists = category_lists(filled, texts, self.literal_categories)
        tables = {}
        for c in texts:
            if lists[c] is None:
                tables[c] = work_path(dataset.sparkSession, "codes")
                codes = distributed_codes(filled.select(F.col(c).alias("value")), "value")
                codes.select("value", F.col("_code").alias("code")).write.parquet(tables[c])
        state: dict[str, Any] = {
            "label": label, "labels": labels, "columns": [[name, names[name], kind] for name, kind in kinds.items()],
            "medians": medians, "modes": common, "codes": {c: v for c, v in lists.items() if v is not None},
            "bounds": {}, "scale": {},
        }
        model = CorpusPreparationModel(state, tables)
        features = list(names.values())
        coded = materialized(model.coded(rows).select(*features), "corpus-coded")
        state["bounds"] = prep.clip_bounds(coded, features)
        state["scale"] = {c: list(v) for c, v in prep.fit_standard(prep.clip(coded, state["bounds"]), features).items()}
        return CorpusPreparationModel(state, tables)._resetUid(self.uid)


def _label_order(value: str) -> tuple:
    """Numbers in their order, then texts in theirs."""
    try:
        return (0, float(value), value)
    except ValueError:
        return (1, 0.0, value)


def _given(name: str, kind: str) -> Column:
    return finite(_column(name).try_cast("double")) if kind == "number" else _column(name).cast("string")


class CorpusPreparationModel(Model, MLReadable, MLWritable):
    """Rows with ``features``, and ``label`` (an index into ``labels``) where the rows have one.

    A missing, null, non-finite or unreadable number is the median; a missing or null text, and
    one never seen, is the most frequent one. A column of nulls alone is 0 or ``unknown``. An
    unknown label is null. Other columns stay; ones called ``features`` or ``label`` are replaced.
    """

    def __init__(self, state: dict[str, Any], tables: dict[str, str]):
        super().__init__()
        self.state, self.tables = state, tables

    @property
    def labels(self) -> list[str]:
        return self.state["labels"]

    @property
    def feature_names(self) -> list[str]:
        return [name for name, _, _ in self.state["columns"]]

    def coded(self, rows: DataFrame) -> DataFrame:
        """The features as numbers, before clipping and scaling; ``rows`` has them under plain names."""
        numbers = {c: F.coalesce(F.col(c), F.lit(m)) for c, m in self.state["medians"].items()}
        rows = rows.withColumns(numbers)
        for c, values in self.state["codes"].items():
            known = F.array(*[F.lit(v) for v in values])
            common = F.lit(float(values.index(self.state["modes"][c])))
            place = F.array_position(known, F.col(c)) - 1
            rows = rows.withColumn(c, F.when(place >= 0, place.cast("double")).otherwise(common))
        for c, path in self.tables.items():
            codes = rows.sparkSession.read.schema("value string, code long").parquet(path)
            common = codes.where(F.col("value") == self.state["modes"][c]).first()["code"]
            codes = broadcast_if_small(codes.select(F.col("value").alias(c), F.col("code").alias(f"{c}_code")), CODES_BROADCAST_ROWS)
            rows = rows.join(codes, c, "left").withColumn(c, F.coalesce(F.col(f"{c}_code"), F.lit(common)).cast("double")).drop(f"{c}_code")
        return rows

    def prepared(self, dataset: DataFrame) -> DataFrame:
        """The dataset's columns as ``in0``, ``in1``, ... and each prepared feature under its plain name."""
        own = [F.col("`" + c.replace("`", "``") + "`").alias(f"in{i}") for i, c in enumerate(dataset.columns)]
        given = [
            (_given(name, kind) if name in dataset.columns else F.lit(None).cast("double" if kind == "number" else "string")).alias(plain)
            for name, plain, kind in self.state["columns"]
        ]
        rows = prep.clip(self.coded(dataset.select(*own, *given)), self.state["bounds"])
        return rows.withColumns({c: standardized(F.col(c), *p) for c, p in self.state["scale"].items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = self.prepared(dataset)
        vector = array_to_vector(F.array(*[F.col(plain) for _, plain, _ in self.state["columns"]]))
        kept = [F.col(f"in{i}").alias(c) for i, c in enumerate(dataset.columns) if c not in ("features", "label")]
        made = [vector.alias("features")]
        if self.state["label"] in dataset.columns:
            said = F.col(f"in{dataset.columns.index(self.state['label'])}").cast("string")
            place = F.array_position(F.array(*[F.lit(v) for v in self.labels]), said) - 1
            made.append(F.when(place >= 0, place.cast("double")).alias("label"))
        return rows.select(*kept, *made)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: CorpusPreparationModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        text = json.dumps({"state": self.model.state, "tables": list(self.model.tables)})
        spark.createDataFrame([(text,)], "state string").coalesce(1).write.json(f"{path}/state")
        for c, table in self.model.tables.items():
            spark.read.parquet(table).write.parquet(f"{path}/codes/{c}")


class _Reader(MLReader):
    def load(self, path: str) -> CorpusPreparationModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        text = spark.read.schema("state string").json(f"{path}/state").first()["state"]
        stored = json.loads(text)
        tables = {c: f"{path}/codes/{c}" for c in stored["tables"]}
        return CorpusPreparationModel(stored["state"], tables)._resetUid(metadata["uid"])
