"""Saved models: one MLlib pipeline per folder, listed as a registry table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from flowlens.operators.scoring import registry


#: Weights and places of the models, one small JSON folder per model.
REGISTRY = "_registry"
_ENTRY = "model string, weight double, place int"


def save_model(model: PipelineModel, folder: str, name: str, weight: float = 1.0, place: int = 0) -> str:
    """Save a pipeline, and its weight and place in the vote."""
    path = f"{folder.rstrip('/')}/{name}"
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    entry = spark.createDataFrame([(name, float(weight), place)], _ENTRY).coalesce(1)
    entry.write.mode("overwrite").json(f"{folder.rstrip('/')}/{REGISTRY}/{name}")
    return path


def load_models(
    spark: SparkSession, folder: str
) -> tuple[dict[str, PipelineModel], DataFrame, list[str]]:
    """Models by name, their registry with stored weights and places, and the folders that failed to load.

    A model saved without an entry has weight 1 and place 0; places of one number are by name.
    """
    parent = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = {}
    if system.exists(parent):
        for status in system.listStatus(parent):
            if status.isDirectory() and status.getPath().getName() != REGISTRY:
                paths[status.getPath().getName()] = status.getPath().toString()
    models, failed = {}, []
    for name, path in sorted(paths.items()):
        try:
            models[name] = PipelineModel.load(path)
        except Exception:  # a folder that is no saved pipeline is skipped and reported
            failed.append(name)
    stored = {}
    if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{REGISTRY}")):
        entries = spark.read.schema(_ENTRY).json(f"{folder.rstrip('/')}/{REGISTRY}/*")
        stored = {r["model"]: (r["place"], r["weight"]) for r in entries.collect()}
    models = dict(sorted(models.items(), key=lambda m: (stored.get(m[0], (0, 1.0))[0], m[0])))
    rows = [(name, "mllib", stored.get(name, (0, 1.0))[1], paths[name]) for name in models]
    return models, registry(spark, rows), failed
