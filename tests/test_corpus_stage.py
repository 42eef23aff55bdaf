"""Preparation and model as one saved pipeline."""

import math

import pytest
from pyspark.ml import PipelineModel

from flowlens.operators.corpus_stage import CorpusPreparation, CorpusPreparationModel
from flowlens.plans.training import fit_and_save
from flowlens.session import work_path

SCHEMA = "id long, `a.size` double, kind string, flag boolean, empty double, none string, `Src IP` string, label string"


def corpus(spark, n=60):
    rows = [
        (i, float("nan") if i % 7 == 0 else float(i % 10), None if i % 11 == 0 else f"k{i % 3}", i % 2 == 0, None, None, "1.1.1.1",
         None if i % 13 == 5 else ("bad" if i % 10 > 6 else "good"))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def vectors(df):
    return {r.id: [round(x, 9) for x in r.features] for r in df.collect()}


@pytest.mark.parametrize("literal", [256, 1])
def test_saved_and_loaded_stage_gives_the_same_rows(spark, literal):
    """Also with the codes of a text column as a table."""
    df = corpus(spark)
    model = CorpusPreparation(keep=("id",), literal_categories=literal).fit(df)
    assert model.feature_names == ["a.size", "kind", "flag", "empty", "none"]
    assert bool(model.tables) == (literal == 1)
    path = work_path(spark, "stage")
    model.save(path)
    with pytest.raises(Exception, match="exists"):
        model.save(path)
    back = CorpusPreparationModel.load(path)
    assert (back.uid, back.state, back.labels) == (model.uid, model.state, ["bad", "good"])
    out = back.transform(df)
    assert out.columns == ["id", "a.size", "kind", "flag", "empty", "none", "Src IP", "features", "label"]
    assert vectors(out) == vectors(model.transform(df))
    assert {(r["label"], r["id"] % 13 == 5) for r in out.collect()} == {(0.0, False), (1.0, False), (None, True)}
    # by hand: the size of row 3, whose bounds and scale come from the labelled rows
    sizes = [4.5 if i % 7 == 0 else float(i % 10) for i in range(60) if i % 13 != 5]
    known = sorted(float(i % 10) for i in range(60) if i % 13 != 5 and i % 7)
    middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    sizes = sorted(middle if i % 7 == 0 else float(i % 10) for i in range(60) if i % 13 != 5)

    def cut(p):
        at = (len(sizes) - 1) * p
        low = math.floor(at)
        return sizes[low] + (at - low) * (sizes[min(low + 1, len(sizes) - 1)] - sizes[low])

    clipped = [min(max(x, cut(0.001)), cut(0.999)) for x in sizes]
    mean = sum(clipped) / len(clipped)
    sd = math.sqrt(sum((x - mean) ** 2 for x in clipped) / len(clipped))
    assert vectors(out)[3][0] == pytest.approx((3.0 - mean) / sd)
    assert {v[3] for v in vectors(out).values()} == {0.0} and {v[4] for v in vectors(out).values()} == {0.0}


def test_rows_that_fit_never_saw(spark):
    model = CorpusPreparation(keep=("id",)).fit(corpus(spark))
    common = model.state["modes"][model.state["columns"][1][1]]
    odd = spark.createDataFrame(
        [(1, "7", "never seen", 9), (2, "x", None, 9), (3, None, common, 9)], "id long, `a.size` string, kind string, features int"
    )
    out = model.transform(odd)
    assert out.columns == ["id", "a.size", "kind", "features"]
    got = vectors(out)
    assert got[1][1] == got[2][1] == got[3][1]
    assert got[2] == got[3] and got[1][0] != got[2][0]


def test_one_class_is_refused_and_empty_input_too(spark):
    for df in (corpus(spark).where("label = 'bad'"), corpus(spark, 0)):
        with pytest.raises(ValueError, match="one class"):
            CorpusPreparation().fit(df)


def test_fit_save_load_score(spark):
    path = work_path(spark, "pipeline")
    df = corpus(spark)
    model = fit_and_save(df.where("label is not null"), path, keep=("id",), trees=5, depth=4)
    loaded = PipelineModel.load(path)
    rows = {r.id: r.prediction for r in loaded.transform(df.drop("label")).collect()}
    assert rows == {r.id: r.prediction for r in model.transform(df).collect()}
    right = [rows[i] == (0.0 if i % 10 > 6 else 1.0) for i in range(60) if i % 7]
    assert sum(right) / len(right) > 0.9
    fit_and_save(df.where("label is not null"), path, keep=("id",), trees=3, depth=2)  # a later one takes its place
    assert PipelineModel.load(path).stages[1].getNumTrees == 3
