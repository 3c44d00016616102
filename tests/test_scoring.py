import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotlog.operators import scoring as S
from slotlog.plans import model_jobs as M
from tests.conftest import day


def frame(spark, pairs, model="m"):
    return spark.createDataFrame([(model, int(y), float(p)) for y, p in pairs], "model string, label long, score double")


def brute(pairs):
    """Metrics by definition over all thresholds."""
    y, p = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    pos, neg = (y == 1).sum(), (y == 0).sum()
    r0, p0, f0, auprc, auroc = 0.0, 1.0, 0.0, 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp, fp = ((p >= t) & (y == 1)).sum(), ((p >= t) & (y == 0)).sum()
        r, q, f = tp / pos, tp / (tp + fp), fp / neg
        auprc += (r - r0) * (q + p0) / 2
        auroc += (f - f0) * (r + r0) / 2
        r0, p0, f0 = r, q, f
    f1 = []
    for k in (1, 0):
        hat = (p > 0.5).astype(int)
        tp, fp, fn = ((hat == k) & (y == k)).sum(), ((hat == k) & (y != k)).sum(), ((hat != k) & (y == k)).sum()
        f1.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
    c = np.clip(p, 1e-15, 1 - 1e-15)
    return {"auprc": auprc, "auroc": auroc, "f1_macro": sum(f1) / 2, "brier_score": ((p - y) ** 2).mean(),
            "log_loss": -(y * np.log(c) + (1 - y) * np.log(1 - c)).mean()}


@settings(max_examples=8, deadline=None)
@given(scores=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12)), min_size=3, max_size=40))
def test_classification_metrics(spark, scores):
    pairs = [(y, p / 12) for y, p in scores] + [(1, 0.25), (0, 0.75)]
    got = S.classification_metrics(frame(spark, pairs)).first()
    for name, value in brute(pairs).items():
        assert got[name] == pytest.approx(value, abs=1e-9), name


def test_auroc_is_the_share_of_ordered_pairs(spark):
    pairs = [(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (1, 0.2)]
    wins = sum((a > b) + 0.5 * (a == b) for y, a in pairs for z, b in pairs if y == 1 and z == 0)
    assert S.areas(S.cumulative(frame(spark, pairs))).first()["auroc"] == pytest.approx(wins / 6)


def test_pr_curve_stops_at_full_recall(spark):
    pairs = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (0, 0.5)]
    got = sorted(tuple(r) for r in S.pr_curve(S.cumulative(frame(spark, pairs))).select("recall", "precision").collect())
    assert got == [(0.5, pytest.approx((1 + 0.5) / 2)), (1.0, pytest.approx(2 / 3))]


def test_evaluation_table(spark):
    pairs = [(int(i % 3 == 0), (210 - i) / 211) for i in range(210)]
    rows = {r["step"]: r for r in S.evaluation_table(frame(spark, pairs)).collect()}
    assert sorted(rows) == list(range(1, 11))
    for k, r in rows.items():
        assert r["predicted_no_shows"] == 20 * k and r["total_appts"] == 210 and r["actual_no_shows"] == 70
        tp = sum(y for y, _ in pairs[:20 * k])
        assert r["ppv"] == pytest.approx(round(tp / (20 * k), 3)) and r["tpr"] == pytest.approx(round(tp / 70, 3))


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 1.0), (5.0, 7.0)], "y double, p double")
    r = S.regression_metrics(df, "y", "p").first()
    assert (r["mse"], r["mae"], r["median_absolute_error"]) == (pytest.approx(14 / 4), 1.5, 1.5)
    assert r["rmse"] == pytest.approx(math.sqrt(3.5)) and r["mape"] == pytest.approx((1 + 0 + 0.75 + 0.4) / 4)


@pytest.mark.parametrize("n, half", [(10, 5), (7, 4), (5, 2), (1, 0)])
def test_exact_half(spark, n, half):
    out = S.randomise_half(spark.range(n), ["id"], seed=1)
    assert out.filter("control = 'intervention'").count() == half == round(n / 2)
    assert out.count() == n


def test_thursday_overlap(spark):
    df = spark.createDataFrame([(day(i), 0.9) for i in range(7)], "start_time timestamp_ntz, score double")
    assert S.select_above(df, 0.5, dt.date(2019, 1, 3)).count() == 6  # a Thursday
    assert S.select_above(df, 0.5, dt.date(2019, 1, 7)).count() == 7
    assert S.select_above(df, 0.95, dt.date(2019, 1, 7)).count() == 0


def test_splits_and_folds(spark):
    df = spark.range(101).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    parts = dict(S.split_train_validation(df, ["id"], 0.2).groupBy("part").count().collect())
    assert parts == {"train": 80, "validation": 21}
    folds = S.assign_folds(df, "label", ["id"], 5)
    for label in (0, 1):
        sizes = [r[0] for r in folds.filter(F.col("label") == label).groupBy("fold").count().select("count").collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    train, test = S.fold_parts(folds, 2)
    assert train.count() + test.count() == 101 and train.join(test, "id").count() == 0
    assert S.assign_folds(df.repartition(5), "label", ["id"], 5).exceptAll(folds).count() == 0


@pytest.mark.parametrize("size", [0.0, 0.2, 0.5, 0.999, 1.0])
def test_split_without_moving_rows(spark, size):
    """The part of a row is that of its place in the order of hashes; of rows of one identity, as many as are still wanted."""
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5) for i in range(60)] + [(900, 1)] * 41, "id long, v long")
    out = S.split_train_validation(df, ["id", "v"], size)
    assert out.columns == ["id", "v", "part"]
    ranked = S.ordered.with_random_rank(df.withColumn("one", F.lit(1)), ["one"], ["id", "v"], 94).withColumn(
        "part", F.when(F.col("random_rank") < math.ceil(101 * size), "validation").otherwise("train")).select("id", "v", "part")
    assert sorted(map(str, out.collect())) == sorted(map(str, ranked.collect()))
    assert S.split_train_validation(df.limit(0), ["id", "v"], size).count() == 0
    alone = S.split_train_validation(df.filter("id < 60"), ["id", "v"], size)
    assert alone.filter("part = 'validation'").count() == math.ceil(60 * size)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


def test_top_per_file(spark):
    rows = [("f1.csv", dt.date(2019, 1, 7), i, day(6 + i % 5), i / 100) for i in range(60)]
    rows += [("f2.csv", dt.date(2019, 1, 10), i, day(9 + i % 2), i / 100) for i in range(20)]
    rows += [("f3.csv", dt.date(2019, 1, 8), 1, day(7), 0.9)]
    df = spark.createDataFrame(rows, "filename string, file_date date, FillerOrderNo long, start_time timestamp_ntz, score double")
    got = S.top_per_file(df).collect()
    assert sorted(r["FillerOrderNo"] for r in got if r["filename"] == "f1.csv") == [50, 51, 52, 55, 56, 57]
    assert sorted(r["FillerOrderNo"] for r in got if r["filename"] == "f2.csv") == [16, 17, 18, 19]
    assert not [r for r in got if r["filename"] == "f3.csv"]


def test_permutation_test(spark):
    mk = lambda n, flip: spark.createDataFrame(
        [(i, i % 2, (i % 2) if i % flip else 1 - i % 2) for i in range(n)], "id long, true int, pred int")
    same = S.permutation_test(mk(200, 5), mk(200, 5), ["id"], trials=40).first()
    assert same["observed_difference"] == pytest.approx(0) and 0.2 < same["alpha"] < 0.8 and same["trials"] == 40
    worse = S.permutation_test(mk(200, 50), mk(200, 2), ["id"], trials=40).first()
    assert worse["observed_difference"] > 0.3 and worse["alpha"] == 0


def test_permutation_test_log_loss(spark):
    mk = lambda p: spark.createDataFrame([(i, i % 2, p if i % 2 else 1 - p) for i in range(100)], "id long, true int, pred double")
    r = S.permutation_test(mk(0.9), mk(0.6), ["id"], trials=20, statistic="log_loss").first()
    assert r["observed_difference"] == pytest.approx(math.log(0.9) - math.log(0.6)) and r["alpha"] == 0


def experiment(spark, n=100):
    rng = np.random.default_rng(1)
    rows = [(i, *[int(x) for x in rng.integers(0, 100, 4)]) for i in range(n)]
    return spark.createDataFrame([(*r, int(r[1] > 50)) for r in rows], "id long, A int, B int, C int, D int, label int")


def test_experiment(spark):
    df = S.assign_folds(experiment(spark), "label", ["id"], 2).cache()
    stages = M.feature_stages(["A", "B", "C", "D"])
    table, model = M.cross_validate(df, stages, M.logistic(strength=0.0), 2)
    rows = table.collect()
    assert {(r["partition"], r["part"]) for r in rows} == {(k, p) for k in (0, 1) for p in ("train", "test")}
    assert all(r["auroc"] > 0.9 for r in rows)
    imp = M.permutation_importance(model, df, ["A", "B"], ["id"], repeats=2).collect()
    assert len(imp) == 4 and len({r["importance"] for r in imp if r["feature"] == "A"}) == 2
    assert min(r["importance"] for r in imp if r["feature"] == "A") > max(abs(r["importance"]) for r in imp if r["feature"] == "B")


def test_unknown_category_is_all_zero(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    fit = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "c string, x double")
    new = spark.createDataFrame([("a", 2.0), ("z", 2.0)], "c string, x double")
    out = Pipeline(stages=M.feature_stages(["x"], ["c"])).fit(fit).transform(new)
    assert [r[0] for r in out.select(vector_to_array("features")).collect()] == [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


def test_scores_by_expression_are_those_of_the_model(spark):
    rows = [(i, float(i % 7), float(i * i % 11), "abc"[i % 3], i % 12 + 1, int(i % 7 + i % 3 > 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, z double, k string, month int, label int")
    model = M.train(df, M.feature_stages(["x", "z"], ["k"], {"month": (12, 1)}), M.logistic())
    assert M._margin(model.stages) is not None
    new = df.unionByName(spark.createDataFrame([(900, 3.0, 1.0, "never seen", 5, 0), (901, 3.0, 1.0, None, 5, 0)], df.schema))
    both = M.scorer(model)(new).select("id", "score").join(S.positive_probability(model.transform(new), name="want").select("id", "want"), "id").collect()
    assert len(both) == 202 and all(r.score == pytest.approx(r.want, abs=1e-12) for r in both)
    with pytest.raises(Exception, match="null or NaN"):
        M.scorer(model)(df.withColumn("x", F.lit(None).cast("double"))).agg(F.sum("score")).collect()
    forest = M.train(df, M.feature_stages(["x", "z"]), M.random_forest(trees=2, depth=2, features="auto"))
    assert M._margin(forest.stages) is None and M.scorer(forest)(df).count() == 200


def test_logistic_training_reads_columns_by_plain_aggregates(spark, monkeypatch):
    """The stages and the model are those of a fitted pipeline, without its fits over assembled vectors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, StringIndexer

    rows = [(i, float(i % 7), float(i * i % 11), 3.0, [None, "a", "c", "b"][i % 4], i % 12 + 1, int(i % 7 + i % 3 > 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, z double, same double, k string, month int, label int")
    stages = M.feature_stages(["x", "z", "same"], ["k"], {"month": (12, 1)})
    want = Pipeline(stages=[*stages, M.logistic()]).fit(M.balanced_weights(df))
    for kind in (StandardScaler, StringIndexer):
        monkeypatch.setattr(kind, "_fit", lambda self, rows: 1 / 0)
    got = M.train(df, stages, M.logistic())
    assert [type(s) for s in got.stages] == [type(s) for s in want.stages]
    assert list(got.stages[1].labelsArray[0]) == list(want.stages[1].labelsArray[0]) == ["a", "b", "c"]
    for a, b in ((got.stages[4], want.stages[4]),):
        assert list(a.mean) == pytest.approx(list(b.mean)) and list(a.std) == pytest.approx(list(b.std))
    assert list(got.stages[-1].coefficients) == pytest.approx(list(want.stages[-1].coefficients), abs=1e-9)
    both = [[r[0] for r in m.transform(df).select(F.col("probability").cast("string")).orderBy("id").collect()] for m in (got, want)]
    assert [float(v.strip("[]").split(",")[1]) for v in both[0]] == pytest.approx([float(v.strip("[]").split(",")[1]) for v in both[1]], abs=1e-9)
    with pytest.raises(Exception, match="null or NaN"):
        M.train(df.withColumn("x", F.when(F.col("id") > 3, F.col("x"))), stages, M.logistic())


def test_search_settings_differ():
    found = M.search_settings({"a": [1, 2, 3], "b": (0.0, 1.0)}, 5)
    assert len({tuple(s.values()) for s in found}) == 5
    assert len(M.search_settings({"a": [1, 2]}, 5)) == 2


def test_balanced_weights(spark):
    df = M.balanced_weights(spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int"))
    assert dict(df.distinct().collect()) == {1: 2.0, 0: pytest.approx(4 / 6)}


def test_registered_importance_covers_all_features_and_repeats(spark, monkeypatch):
    from slotlog import registry
    from slotlog.registry import model_queries as Q

    seen = []
    found = spark.createDataFrame([("x", 0, 1.0)], "feature string, repeat long, importance double")
    monkeypatch.setattr(Q.M, "permutation_importance", lambda model, df, columns, identity, repeats=10: seen.append((df, columns, repeats)) or found)
    monkeypatch.setattr(Q.M, "train", lambda rows, *a: seen.append(rows))
    monkeypatch.setattr(Q, "halves", lambda spark, sf: {"train": "training rows", "test": "test rows"})
    registry.QUERIES["permutation_importance"](spark, "")
    every = [*Q.NUMERIC, *Q.CATEGORICAL, "month"]
    assert seen == ["training rows", ("training rows", every, 10), ("test rows", every, 10)]


def registered_estimator(spark, monkeypatch, name):
    """The estimator that a registered query trains, without training it."""
    from slotlog import registry
    from slotlog.registry import model_queries as Q

    seen = []
    monkeypatch.setattr(Q, "halves", lambda spark, sf: {"train": None})
    monkeypatch.setattr(Q.M, "train", lambda rows, stages, estimator: seen.append(estimator) or {}["stop"])
    with pytest.raises(KeyError, match="stop"):
        registry.QUERIES[name](spark, "")
    return seen[0]


def test_registered_boosted_trees_do_all_rounds(spark, monkeypatch):
    e = registered_estimator(spark, monkeypatch, "train_gbt")
    assert (e.getMaxIter(), e.getMaxDepth(), e.getStepSize(), e.getSubsamplingRate()) == (400, 3, 0.01, 0.7)


def test_boosted_trees_have_a_folder_for_their_rounds(spark):
    df = spark.createDataFrame([(float(i), int(i % 3 == 0)) for i in range(30)], "x double, label int")
    assert M.train(df, M.feature_stages(["x"]), M.boosted_trees(rounds=2)).stages[-1].getNumTrees == 2
    assert spark.sparkContext.getCheckpointDir()


def test_registered_forest_has_all_trees(spark, monkeypatch):
    e = registered_estimator(spark, monkeypatch, "train_random_forest")
    assert (e.getNumTrees(), e.getMaxDepth(), e.getFeatureSubsetStrategy(), e.getWeightCol()) == (400, 10, "6", M.WEIGHT)
