import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import encode, features, nearest, oversample, prep, quantiles, selection, split

INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize("limit", [10**9, 5])
def test_quantiles_equal_numpy(spark, limit):
    rng = random.Random(3)
    rows = [
        (rng.gauss(0, 1e6), float(rng.choice([1, 1, 1, 2, 7])), None if i % 3 else 10.0**-i, 5.0)
        for i in range(301)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    probs = [0.0, 0.001, 0.3333, 0.5, 0.999, 1.0]
    got = quantiles.exact_quantiles(df, {c: probs for c in df.columns}, single_task_values=limit)
    for i, c in enumerate(df.columns):
        values = [r[i] for r in rows if r[i] is not None]
        assert got[c] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert quantiles.exact_quantiles(df, {"a": [0.5]}) == {"a": [None]}


def test_column_stats_of_constant_and_single_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, NAN), (1.0, INF)], "a double, b double")
    got = {r["column"]: r for r in quantiles.column_stats(df, ["a", "b"], "a").collect()}
    assert got["a"]["sd_pop"] == 0 and got["a"]["corr"] is None
    assert got["b"]["n"] == 1 and got["b"]["var_samp"] is None and got["b"]["mean"] == 2.0


@pytest.fixture(scope="module")
def feature_rows(spark):
    rows = [
        (10, 0.0, 1, 5.0, 1.0), (None, 10.0, 0, 5.0, 2.0), (30, None, 1, 5.0, 4.0),
        (20, 5.0, None, 5.0, 8.0),
    ]
    schema = ("packet_size int, src_ip_num double, protocol_tcp int, flow_bytes double, "
              "flow_duration double")  # fmt: skip
    return spark.createDataFrame(rows, schema)


def test_preprocessor(spark, feature_rows, tmp_path):
    fitted = prep.Preprocessor.fit(feature_rows)
    fitted.save(spark, f"{tmp_path}/p")
    for one in (fitted, prep.Preprocessor.load(spark, f"{tmp_path}/p")):
        out = one.transform(feature_rows)
        assert out.columns == [
            "packet_size", "src_ip_num", "flow_bytes", "flow_duration",
            "protocol_tcp_0", "protocol_tcp_1",
        ]
        rows = out.collect()
        assert [r["src_ip_num"] for r in rows] == [0.0, 1.0, 0.0, 0.5]
        assert [r["flow_bytes"] for r in rows] == [0.0] * 4  # a constant column
        assert [r["packet_size"] for r in rows][1] == 0.0  # the mean, then standardised
        assert [r["protocol_tcp_1"] for r in rows] == [1, 0, 1, 0]
        sd = np.std([1, 2, 4, 8])
        assert rows[3]["flow_duration"] == pytest.approx((8 - 3.75) / sd)


def test_preprocessor_on_new_and_single_rows(spark, feature_rows):
    fitted = prep.Preprocessor.fit(feature_rows)
    row = spark.createDataFrame([(20, 5.0, 9, 5.0, 1.0)], feature_rows.schema)
    out = fitted.transform(row).first()
    assert (out["protocol_tcp_0"], out["protocol_tcp_1"]) == (0.0, 0.0)  # unseen category
    with pytest.raises(ValueError):
        prep.Preprocessor().transform(row)


def test_fills(spark):
    rows = [(1.0, None, "b", None), (3.0, None, "a", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "x double, empty double, c string, nothing string")
    out = prep.fill_mode(prep.fill_median(df)).collect()
    assert [r["x"] for r in out] == [1.0, 3.0, 2.0] and {r["empty"] for r in out} == {0.0}
    assert out[2]["c"] == "a" and out[0]["nothing"] == "unknown"  # the smaller of two modes


def test_infinities(spark):
    df = spark.createDataFrame([(INF,), (-INF,), (NAN,), (2.0,), (4.0,)], "x double")
    assert [r[0] for r in prep.null_nonfinite(df).collect()] == [None, None, None, 2.0, 4.0]
    got = [r[0] for r in prep.infinite_to_mean(df, ["x"]).collect()]
    assert got[:2] == [3.0, 3.0] and math.isnan(got[2])


@pytest.mark.parametrize(
    "columns, label",
    [
        (["a", "target", "Label"], "Label"),
        (["Target", "class"], "class"),
        (["x", " Attack Type ", "my class"], " Attack Type "),
        (["x", "y"], "y"),
    ],
)
def test_find_label(columns, label):
    assert prep.find_label(columns) == label


def test_drop_address_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Source IP` int, src_ip int, RIP int")
    assert prep.drop_address_columns(df).columns == ["src_ip"]


@pytest.mark.parametrize("limit", [100, 1])
def test_label_encode(spark, limit):
    words = ["b", "a", None, "c", "a", "é", "B"] * 3
    df = spark.createDataFrame(list(enumerate(words)), "id int, w string").repartition(3)
    order = sorted({w for w in words if w is not None})
    got = {r["id"]: r["w"] for r in encode.label_encode(df, ["w"], limit).collect()}
    assert got == {i: None if w is None else order.index(w) for i, w in enumerate(words)}


def test_select_features(spark):
    rows = [(float(i), 1.0, float(i % 3), float(-2 * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, flat double, b double, y double")
    names, scores = selection.select_features(df, ["a", "flat", "b"], "y", "correlation", 2)
    assert names == ["a", "b"] and scores.where("feature = 'flat'").first()["score"] is None
    assert selection.select_features(df, ["a", "flat", "b"], None, "variance", 1)[0] == ["a"]
    assert selection.select_features(df, ["a", "b"], None, "other") == (["a", "b"], None)
    binary = df.withColumn("y", (F.col("a") > 15).cast("double"))
    assert selection.select_features(binary, ["a", "flat"], "y", "importance", 1)[0] == ["a"]


def test_generated_columns_equal_the_vector(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, 5), (0.5, -3.0, 7.0, 23)],
                               "a double, b double, c double, time_hour int")
    names = ["a", "b", "c", "time_hour"]
    wide = features.generate_features(df, names)
    assert features.generated_names(names) == [
        c for c in wide.columns if c not in ("time_of_day", "time_period")
    ]
    assert len(features.generated_names([str(i) for i in range(23)])) == 69 + 2346
    vectors = [r[0] for r in df.select(features.generated_vector(names)).collect()]
    assert vectors == [[r[c] for c in features.generated_names(names)] for r in wide.collect()]
    assert [(r["time_of_day"], r["time_period"]) for r in wide.collect()] == [(0, 0), (3, 2)]


def test_split_is_exact_and_repeatable(spark):
    labels = ["a"] * 700 + ["b"] * 293 + ["c"] * 7
    df = spark.createDataFrame(list(enumerate(labels)), "id bigint, label string")

    def parts(frame):
        return {r["id"]: r["split"] for r in split.stratified_split(frame, "label", "id").collect()}

    first = parts(df)
    assert first == parts(df.repartition(7)) and len(first) == 1000
    sizes = {p: sum(1 for v in first.values() if v == p) for p in split.PARTS}
    assert sizes == {"train": 800, "validation": 100, "test": 100}
    of_a = [first[i] for i in range(700)]
    assert of_a.count("train") == 560 and of_a.count("test") == 70


def test_allocation_adds_up():
    assert split.allocate({"a": 5, "b": 3, "c": 2}, 3) == {"a": 1, "b": 1, "c": 1}
    assert sum(split.allocate({i: 7 * i + 1 for i in range(9)}, 100).values()) == 100


@pytest.mark.parametrize("cell_rows", [1000, 16])
def test_oversampling(spark, cell_rows):
    """A third of the minority rows are copies of one vector."""
    rng = random.Random(1)
    rows = [(i, 0, [rng.random(), rng.random()]) for i in range(150)]
    rows += [(1000 + i, 1, [5.0, 5.0] if i % 3 == 0 else [5 + rng.random(), 5 + rng.random()])
             for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, label int, features array<double>")
    out = oversample.balance_classes(df, "label", cell_rows=cell_rows)
    rows_out = out.collect()
    made = [r for r in rows_out if r["synthetic"]]
    assert len(rows_out) == 300 and len(made) == 90 and {r["label"] for r in made} == {1}
    assert all(5 <= x <= 6 for r in made for x in r["features"])
    again = oversample.balance_classes(df.repartition(5), "label", cell_rows=cell_rows)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, rows_out))


def _brute(vectors, rows, k):
    """The sorted distances of each vector's k nearest rows, copies included."""
    found = []
    for i, v in enumerate(vectors):
        far = np.sqrt(((vectors - v) ** 2).sum(axis=1))
        counts = rows.copy()
        counts[i] -= 1
        order = np.argsort(far)[: k + 1]
        found.append(np.repeat(far[order], np.minimum(counts[order], k))[:k])
    return found


def _neighbour_distances(spark, vectors, rows, k, cell_rows, label=1):
    data = [(label, [float(x) for x in v], int(n), 1) for v, n in zip(vectors, rows, strict=True)]
    points = spark.createDataFrame(data, "label int, features array<double>, _rows bigint, _copies bigint")
    out = nearest.nearest_in_class(points.repartition(4), "label", "features", k, cell_rows=cell_rows).collect()
    assert len(out) == len(vectors)
    return {
        tuple(r["features"]): (
            [x["d"] ** 0.5 for x in r["near"] for _ in range(min(x["n"], k))][:k],
            [tuple(x["v"]) for x in r["near"]],
        )
        for r in out
    }


@pytest.mark.parametrize("width, n, cell_rows", [(2, 600, 40), (6, 300, 1000), (3, 3, 2), (2, 1, 5), (8, 300, 80)])
def test_neighbours_are_exact(spark, width, n, cell_rows):
    rng = np.random.default_rng(width)
    vectors = rng.normal(size=(n, width)) + rng.integers(0, 3, size=(n, 1)) * 20
    rows = np.where(rng.random(n) < 0.1, 7, 1)
    got = _neighbour_distances(spark, vectors, rows, 5, cell_rows)
    for v, expected in zip(vectors, _brute(vectors, rows, 5), strict=True):
        assert got[tuple(v)][0] == pytest.approx(list(expected), abs=1e-9)


def test_neighbours_do_not_depend_on_the_cells(spark):
    grid = np.array([(x, y) for x in range(12) for y in range(12)], dtype=float)  # ties everywhere
    ones = np.ones(len(grid), dtype=int)
    assert _neighbour_distances(spark, grid, ones, 3, 10) == _neighbour_distances(spark, grid, ones, 3, 500)


def test_neighbours_of_twenty_thousand_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(20_000, 4)) * [1, 1, 1, 0.1] + rng.integers(0, 40, size=(20_000, 1))
    got = _neighbour_distances(spark, vectors, np.ones(20_000, dtype=int), 5, 1_000)
    for i, (found, far) in enumerate(nearest.nearest(vectors, vectors, 6)):
        assert found[0] == i
        assert got[tuple(vectors[i])][0] == pytest.approx(list(np.sqrt(far[1:])), abs=1e-9)


@pytest.mark.parametrize("block_rows", [1, 60, 32_768])
def test_neighbours_do_not_depend_on_the_blocks(spark, monkeypatch, block_rows):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(nearest, "ROUGH", 1_000)
    rng = np.random.default_rng(9)
    vectors = np.unique(np.r_[rng.normal(size=(200, 3)), rng.integers(0, 4, size=(60, 3)) + 9], axis=0)
    rows = np.where(rng.random(len(vectors)) < 0.2, 3, 1)
    got = _neighbour_distances(spark, vectors, rows, 5, 16)
    for v, expected in zip(vectors, _brute(vectors, rows, 5), strict=True):
        assert got[tuple(v)][0] == pytest.approx(list(expected), abs=1e-9)


def test_a_class_of_one_block_meets_only_itself(spark, monkeypatch):
    """Vectors without structure in 40 cells: every cell would meet every other one."""
    pairs = []
    kept = nearest._pairs
    monkeypatch.setattr(nearest, "_pairs", lambda *a: pairs.append(kept(*a)) or pairs[-1])
    vectors = np.random.default_rng(2).normal(size=(600, 30))
    _neighbour_distances(spark, vectors, np.ones(600, dtype=int), 5, 16)
    assert [p.count() for p in pairs] == [1]


def test_synthetic_rows_are_the_same_for_any_cells(spark):
    rng = np.random.default_rng(4)
    data = [(i, int(i % 4 == 0), [float(x) for x in rng.normal(size=3)]) for i in range(400)]
    df = spark.createDataFrame(data, "id bigint, label int, features array<double>")
    made = [
        sorted(map(repr, oversample.balance_classes(df, "label", cell_rows=c, traced=True).where("synthetic").collect()))
        for c in (9, 2_048)
    ]
    assert len(made[0]) == 200 and made[0] == made[1]


def test_nearest_equals_differences():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(40, 3)) + 1e6  # products alone would lose the distances
    for i, (found, _) in enumerate(nearest.nearest(vectors, vectors, 6, block=7)):
        distance = ((vectors - vectors[i]) ** 2).sum(axis=1)
        assert list(found) == list(np.argsort(distance, kind="stable")[:6])


def test_one_class_is_left_alone(spark):
    df = spark.createDataFrame([(1, 0, [1.0])], "id bigint, label int, features array<double>")
    assert oversample.balance_classes(df, "label").count() == 1


def test_the_number_of_classes_has_a_limit_that_can_be_raised(spark):
    from flowlens.operators.oversample import balance_classes
    from flowlens.operators.split import stratified_split

    rows = [(i, i % 12, [float(i), 0.0]) for i in range(130)]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    for refused in (lambda: stratified_split(df, "label", "id", max_classes=11), lambda: balance_classes(df, "label", max_classes=11)):
        with pytest.raises(ValueError, match="more than 11 classes"):
            refused()
    assert stratified_split(df, "label", "id", max_classes=12).count() == 130
    balanced = balance_classes(df, "label", k=2, cell_rows=4, max_classes=12)
    assert {r["count"] for r in balanced.groupBy("label").count().collect()} == {11}


def test_generated_vectors_by_blocks_equal_those_by_row(spark):
    from flowlens.operators import features as X

    rows = [(i, float(i % 7) - 3, None if i % 5 == 0 else i / 3, float("nan") if i % 11 == 0 else 1e200, i) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d long").repartition(2)
    names = ["a", "b", "c", "d"]
    found = {"n": lambda values, none: (~none).sum(axis=0), "last": lambda values, none: values[-1], "sum": lambda values, none: np.where(none, 0, values).sum(axis=0)}
    made = X.with_generated(df, names, found).withColumn("want", X.generated_vector(names))
    given = 0
    for r in made.collect():
        present = [v for v in r["want"] if v is not None]
        assert (len(r["want"]), r["n"]) == (78, len(present)) and np.isclose(r["last"], r["want"][-1], equal_nan=True)
        assert np.isclose(r["sum"], sum(present), equal_nan=True)
        given += 1
    assert given == 600
    assert X.with_generated(df.where("false"), names, found).count() == 0


def test_a_fit_of_importances_reads_bounded_partitions(spark, monkeypatch):
    """A task of the forest holds a row for every tree, so partitions don't grow with the table."""
    monkeypatch.setattr(selection, "FIT_ROWS", 100)
    df = spark.range(5_000).coalesce(1).selectExpr("id % 7 as a", "id % 3 as b", "cast(id % 2 as double) as y")
    fitted = []
    fit = selection.RandomForestClassifier.fit
    monkeypatch.setattr(selection.RandomForestClassifier, "fit", lambda self, rows: fitted.append(rows) or fit(self, rows))
    scores = selection.importance_scores(df, ["a", "b"], "y", trees=3)
    assert scores.count() == 2
    sizes = [r["count"] for r in fitted[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 5_000 and max(sizes) <= 200
