import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowlens.operators import anomaly

EMBEDDINGS = "/root/testdata/sf0.001/embeddings.parquet"


@pytest.fixture(scope="module")
def parted(spark):
    part = F.when(F.col("vec_id") % 5 == 0, "test").when(F.col("vec_id") % 5 == 1, "validation").otherwise("train")
    df = spark.read.parquet(EMBEDDINGS)
    return df.select("vec_id", F.col("embedding").cast("array<double>").alias("features"), part.alias("split"))


def arrays(df):
    rows = df.orderBy("vec_id").collect()
    return np.array([r["features"] for r in rows]), np.array([r["split"] for r in rows]), [r["vec_id"] for r in rows]


def test_moments_equal_numpy_however_rows_are_dealt(spark, parted):
    x, split, _ = arrays(parted)
    for parts in (1, 40):
        found = anomaly.moments(parted.repartition(parts), part=F.col("split"))
        assert set(found) == {"train", "validation", "test"}
        for part, m in found.items():
            some = x[split == part]
            assert m.n == len(some)
            np.testing.assert_allclose(m.mean, some.mean(axis=0), atol=1e-12)
            np.testing.assert_allclose(m.spread / m.n, np.cov(some.T, bias=True), atol=1e-10)


def test_moments_far_from_zero_keep_their_digits(spark):
    rows = [([1e9 + i % 3, 1e9 - i % 2],) for i in range(1200)]
    m = anomaly.moments(spark.createDataFrame(rows, "features array<double>").repartition(7))["all"]
    x = np.array([r[0] for r in rows]) - 1e9
    np.testing.assert_allclose(m.spread / m.n, np.cov(x.T, bias=True), rtol=1e-6, atol=1e-6)


def test_errors_of_every_width_equal_those_of_the_rows(spark, parted):
    x, split, ids = arrays(parted)
    fitted = anomaly.fit(parted, left=0.5)
    train = x[split == "train"]
    _, _, directions = np.linalg.svd(train - train.mean(axis=0))
    errors = {(r["part"], r["width"]): r["mean_error"] for r in fitted.errors.collect()}
    for part in ("train", "validation", "test"):
        y = (x[split == part] - train.mean(axis=0)) @ directions.T
        for k in (0, 1, 17, 63, 64):
            assert errors[part, k] == pytest.approx((y[:, k:] ** 2).sum(axis=1).mean(), rel=1e-6, abs=1e-9)
    held = np.array([errors["validation", k] for k in range(65)])
    width = int(np.flatnonzero(held <= 0.5 * held[0])[0])
    assert fitted.coding.width == width
    assert [r["width"] for r in fitted.errors.where("chosen").collect()] == [width] * 3
    y = (x - train.mean(axis=0)) @ directions.T
    want = (y[:, width:] ** 2).sum(axis=1)
    got = {r["vec_id"]: r for r in fitted.scored.collect()}
    np.testing.assert_allclose([got[i]["error"] for i in ids], want, rtol=1e-6)
    cutoff = np.quantile(want[split == "train"], 0.99)
    assert fitted.coding.cutoff == pytest.approx(cutoff, rel=1e-6)
    assert {i for i in ids if got[i]["is_anomaly"]} == {i for i, e in zip(ids, want) if e > fitted.coding.cutoff}
    figures = {r["part"]: r for r in fitted.figures.collect()}
    assert figures["test"]["n"] == (split == "test").sum()
    assert figures["test"]["mean_error"] == pytest.approx(errors["test", width], rel=1e-6)


def test_rows_out_of_the_plane_are_flagged(spark):
    train = [(i, [float(i), 2.0 * i + 0.01 * (i % 7 - 3), 0.0], "train" if i % 3 else "validation") for i in range(600)]
    odd = [(1000, [10.0, 80.0, 0.0], "test"), (1001, [10.0, 20.0, 9.0], "test"), (1002, [10.0, 20.0, 0.0], "test")]
    df = spark.createDataFrame(train + odd, "id long, features array<double>, split string")
    fitted = anomaly.fit(df)
    assert fitted.coding.width == 1
    flagged = {r["id"] for r in fitted.scored.where("split = 'test' and is_anomaly").collect()}
    assert flagged == {1000, 1001}


def test_broken_vectors_take_no_part(spark):
    good = [(i, [float(i % 5), float(i % 3)], "train") for i in range(30)]
    bad = [(100, None, "train"), (101, [], "train"), (102, [1.0, None], "train"), (103, [float("nan"), 1.0], "test"),
           (104, [float("inf"), 1.0], "train")]
    df = spark.createDataFrame(good + bad, "id long, features array<double>, split string")
    fitted = anomaly.fit(df, left=0.0, widths=[1])
    assert fitted.coding.width == 1
    scored = {r["id"]: r for r in fitted.scored.collect()}
    assert len(scored) == 35
    for i in (100, 101, 102, 103, 104):
        assert scored[i]["error"] is None and scored[i]["is_anomaly"] is False
    assert anomaly.moments(df)["all"].n == 30


def test_no_training_rows_and_mixed_lengths_are_errors(spark):
    df = spark.createDataFrame([([1.0], "test")], "features array<double>, split string")
    with pytest.raises(ValueError, match="no training rows"):
        anomaly.fit(df)
    mixed = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "features array<double>").coalesce(1)
    with pytest.raises(Exception, match="vectors of 1"):
        anomaly.moments(mixed)


def test_saved_coding_scores_vectors_alike(spark, parted, tmp_path):
    fitted = anomaly.fit(parted, widths=[8, 16], left=None)
    assert fitted.coding.width == 16
    fitted.coding.save(spark, str(tmp_path / "coding"))
    loaded = anomaly.Coding.load(spark, str(tmp_path / "coding"))
    vectors = parted.withColumn("features", array_to_vector("features"))
    again = {r["vec_id"]: (r["error"], r["is_anomaly"]) for r in loaded.score(vectors).collect()}
    assert again == {r["vec_id"]: (r["error"], r["is_anomaly"]) for r in fitted.scored.collect()}


def test_width_by_validation_error():
    errors = [10.0, 4.0, 0.4, 0.0]
    assert anomaly.choose_width(errors, 0.05) == 2
    assert anomaly.choose_width(errors, 0.01) == 3
    assert anomaly.choose_width(errors, 0.01, [1, 2]) == 2
    assert anomaly.choose_width(errors, None, [1, 2, 64]) == 3
