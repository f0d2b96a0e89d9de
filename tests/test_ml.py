"""Preparation, metrics and models."""

import statistics

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shopgrain.ml import (
    add_class_weights, best_threshold, binary_summary, build_delay_dataset, build_review_dataset,
    classification_report, confusion_matrix, delay_estimators, fit_preprocessor, regression_metrics, report_summary,
    roc_auc, score_classes, split_features, threshold_curve, train_binary_review_models,
    train_customer_value_model, train_delay_models, train_review_models,
)
from shopgrain.ml.train import binary_estimators, review_estimators


@pytest.fixture(scope="module")
def orders(spark):
    """Orders whose delay, score and satisfaction follow from their features."""
    n = F.col("id")
    # A whole number that looks random but is the same in every run.
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    return spark.range(1200).select(
        n.alias("order_id"),
        F.when(n % 10 == 3, None).otherwise((n % 37).cast("double")).alias("value"),
        (n % 5).cast("int").alias("n_items"),
        F.when(n % 7 == 0, None).otherwise(F.concat(F.lit("S"), n % 4)).alias("customer_state"),
        (n % 2 == 0).alias("is_weekend"),
        F.when(n % 11 == 0, None).otherwise(3.0 * (n % 5) + noise).alias("delivery_delay_days"),
        F.when(n % 13 == 0, None).otherwise((n % 5 + 1).cast("int")).alias("review_score_latest"),
        (n % 5 >= 3).cast("int").alias("review_binary"),
    )


NUMERIC, CATEGORICAL = ["value", "n_items"], ["customer_state", "is_weekend"]


def test_features_are_split_by_type(orders):
    assert split_features(orders, NUMERIC + CATEGORICAL) == (NUMERIC, CATEGORICAL)


def test_delay_dataset(orders):
    data = build_delay_dataset(orders, NUMERIC + CATEGORICAL)
    assert data.columns == ["order_id", "customer_state", "value", "n_items", "is_weekend", "label", "split"]
    assert data.count() == orders.dropna(subset=["delivery_delay_days"]).count()


def test_review_dataset_target(orders, spark):
    data = build_review_dataset(orders, NUMERIC)
    assert data.where("label is null").count() == 0
    # An explicit score column is preferred.
    both = build_review_dataset(orders.withColumn("review_score", F.lit(2.0)), NUMERIC)
    assert [r["label"] for r in both.select("label").distinct().collect()] == [2]
    with pytest.raises(KeyError):
        build_review_dataset(orders.drop("review_score_latest"), NUMERIC)


def test_preprocessing_constants(orders):
    fitted = fit_preprocessor(orders, NUMERIC, CATEGORICAL)
    values = [r["value"] for r in orders.collect()]
    present = [v for v in values if v is not None]
    median = statistics.median(present)
    filled = [median if v is None else v for v in values]
    assert fitted.medians["value"] == median
    assert fitted.means["value"] == pytest.approx(statistics.fmean(filled))
    assert fitted.scales["value"] == pytest.approx(statistics.pstdev(filled))
    assert fitted.modes["customer_state"] in {"S0", "S1", "S2", "S3"} and fitted.modes["is_weekend"] == "false"
    shown = orders.select(fitted.scaled("value").alias("v")).agg(F.avg("v"), F.stddev_pop("v")).first()
    assert shown[0] == pytest.approx(0, abs=1e-9) and shown[1] == pytest.approx(1)


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, None), (1.0, None, None)], "a double, b double, c string")
    fitted = fit_preprocessor(df, ["a", "b"], ["c"])
    assert fitted.scales == {"a": 1.0, "b": 1.0} and fitted.medians == {"a": 1.0, "b": 0.0} and fitted.modes == {"c": ""}


def test_unknown_category_is_all_zeros(spark):
    train = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (3.0, "it's"), (4.0, None)], "a double, c string")
    model = fit_preprocessor(train, ["a"], ["c"]).pipeline().fit(train)
    rows = spark.createDataFrame([(None, "new"), (2.5, "y"), (2.5, None)], "a double, c string")
    got = [r["v"] for r in model.transform(rows).select(vector_to_array("features").alias("v")).collect()]
    assert got == [[0, 0, 0, 0], [0, 0, 0, 1], [0, 1, 0, 0]]


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(1,)] * 6 + [(2,)] * 2, "label int")
    totals = {r["label"]: r["w"] for r in add_class_weights(df).groupBy("label").agg(F.sum("class_weight").alias("w")).collect()}
    assert totals == {1: pytest.approx(4.0), 2: pytest.approx(4.0)}


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)], "label double, prediction double")
    assert tuple(regression_metrics(df).first()) == (pytest.approx((5 / 3) ** 0.5), pytest.approx(1.0), pytest.approx(1 - 5 / 8))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "label double, prediction double")
    assert regression_metrics(flat).first()["r2"] is None


def test_report_of_classes_on_one_side_only(spark, rows):
    """Class 3 is never predicted and class 4 never occurs: ratios without a denominator are zero."""
    df = spark.createDataFrame([(1, 1), (1, 4), (3, 1)], "label int, prediction int")
    assert rows(classification_report(df)) == [
        (1, 0.5, 0.5, 0.5, 2), (3, 0.0, 0.0, 0.0, 1), (4, 0.0, 0.0, 0.0, 0)]
    summary = report_summary(classification_report(df)).first()
    assert summary["accuracy"] == pytest.approx(1 / 3) and summary["f1_macro"] == pytest.approx(1 / 6)
    assert summary["f1_weighted"] == pytest.approx(1 / 3)
    cells = {(a, p): n for a, p, n in rows(confusion_matrix(df))}
    assert len(cells) == 9 and cells[1, 1] == 1 and cells[3, 1] == 1 and cells[4, 4] == 0
    assert confusion_matrix(df, classes=[1, 2, 3, 4]).count() == 16


@pytest.mark.parametrize("buckets", [2, 256])
def test_auc_equals_the_evaluator(spark, buckets):
    df = spark.range(3000).select(
        (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("double").alias("label"),
        # A third of all rows share one score.
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.pmod(F.hash("id"), F.lit(500)) / 500.0).alias("score"),
    )
    expected = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(df)
    assert roc_auc(df, buckets=buckets).first()["roc_auc"] == pytest.approx(expected, abs=1e-9)
    assert roc_auc(df.where("label = 1")).first()["roc_auc"] is None


def test_best_threshold_rules(spark):
    tied = spark.createDataFrame([(1, 0.52), (0, 0.11)], "label int, score double")
    assert tuple(best_threshold(threshold_curve(tied)).first()) == (0.15, 1.0, 1.0, 1.0)
    none = spark.createDataFrame([(0, 0.9), (0, 0.2)], "label int, score double")
    assert tuple(best_threshold(threshold_curve(none)).first()) == (0.5, 0.0, 0.0, 0.0)
    at = spark.createDataFrame([(1, 0.1)], "label int, score double")
    curve = threshold_curve(at).orderBy("threshold").collect()
    assert len(curve) == 17 and curve[0]["recall"] == 1.0 and curve[1]["recall"] == 0.0


def test_binary_summary_without_tuning(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.1)], "label int, prediction int, score double")
    row = binary_summary(df).first()
    assert row["accuracy"] == row["roc_auc"] == row["f1_positive"] == 1.0 and row["best_threshold"] is None


def test_default_model_sizes():
    models = delay_estimators()
    assert models["RandomForest"].getNumTrees() == 150 and models["RandomForest"].getMaxDepth() == 30
    assert [models[n].rounds for n in ("GradientBoosting", "BoostedTrees")] == [100, 200]
    assert models["BoostedTrees"].rows == models["BoostedTrees"].columns == 0.8
    assert [m.rounds for m in binary_estimators().values()] == [300, 400]
    assert [(m.rounds, m.depth) for m in review_estimators().values()] == [(100, 3), (100, 6)]


def test_delay_models_learn_and_repeat(orders):
    data = build_delay_dataset(orders, NUMERIC + CATEGORICAL)
    small = delay_estimators({"RandomForest": 5, "GradientBoosting": 20, "BoostedTrees": 20}, forest_depth=6)
    metrics, models, scored = train_delay_models(data, NUMERIC, CATEGORICAL, small)
    got = {r["model"]: r for r in metrics.collect()}
    assert set(got) == set(models) == {"RandomForest", "GradientBoosting", "BoostedTrees"}
    assert all(r["r2"] > 0.6 for r in got.values())
    test_rows = data.where("split = 'test'")
    assert scored.groupBy("model").count().select("count").distinct().collect()[0][0] == test_rows.count()
    # The stored pipeline scores raw rows as the training run did.
    again = models["RandomForest"].transform(test_rows).select("order_id", F.col("prediction").alias("again"))
    joined = scored.where("model = 'RandomForest'").join(again, "order_id")
    assert joined.where("abs(prediction - again) > 1e-9").count() == 0
    repeat, _, _ = train_delay_models(data, NUMERIC, CATEGORICAL, {"RandomForest": small["RandomForest"]})
    assert repeat.first()["rmse"] == pytest.approx(got["RandomForest"]["rmse"])


def test_review_models_learn(orders):
    data = build_review_dataset(orders, NUMERIC + CATEGORICAL)
    small = {"GradientBoostingClassifier": review_estimators({"GradientBoostingClassifier": 2})["GradientBoostingClassifier"]}
    metrics, report, cells, models = train_review_models(data, NUMERIC, CATEGORICAL, small)
    assert metrics.first()["accuracy"] > 0.9 and report.count() == 5 and cells.count() == 25
    support = report.agg(F.sum("support")).first()[0]
    assert support == data.where("split = 'test'").count() == cells.agg(F.sum("n_rows")).first()[0]
    assert set(models) == set(small)


def test_stages_go_with_their_owner(spark, orders):
    from pathlib import Path

    from shopgrain.session import shared_dir, staged

    folder = Path(shared_dir(spark).removeprefix("file:")) / "shopgrain"

    def stages():
        return {x.name for x in folder.iterdir()} if folder.exists() else set()

    before = stages()
    small = {"GradientBoostingClassifier": binary_estimators({"GradientBoostingClassifier": 1})["GradientBoostingClassifier"]}
    with staged(spark):
        metrics, scored, _ = train_binary_review_models(orders, NUMERIC, estimators=small)
        assert metrics.count() == 1 and scored.count() > 0
        # the rows, their features and the scored rows: each written once, but for the split that reads its rows again
        assert 0 < len(stages() - before) <= 4
    assert stages() == before


def test_satisfaction_models_learn(orders):
    small = binary_estimators({"GradientBoostingClassifier": 4, "DeepBoostingClassifier": 2})
    metrics, scored, models = train_binary_review_models(
        orders, NUMERIC + CATEGORICAL, use_class_weight=True, tune_threshold=True, estimators=small
    )
    got = metrics.collect()
    assert set(models) == set(small)
    for name in small:
        rows = scored.where(F.col("model") == name)
        report = {r["class"]: r for r in classification_report(rows).collect()}
        assert sum(r["support"] for r in report.values()) == rows.count() == confusion_matrix(rows).agg(F.sum("n_rows")).first()[0]
        assert threshold_curve(rows).count() > 1
        again = score_classes(models[name], orders).where("score is null").count()
        assert again == 0
    assert [r["model"] for r in got] == ["DeepBoostingClassifier", "GradientBoostingClassifier"]
    for row in got:
        assert row["accuracy"] > 0.9 and row["roc_auc"] > 0.9 and 0.1 <= row["best_threshold"] <= 0.9


def test_customer_value_model(spark):
    value = spark.range(2000).select(
        F.col("id").alias("customer_id"), (F.col("id") % 4 + 1).alias("customer_n_orders"),
        F.col("id").cast("double").alias("customer_avg_order_value"),
        (F.col("id") * 2.0).alias("customer_total_revenue"),
    )
    metrics, scored, model = train_customer_value_model(value, trees=10)
    assert "prediction" in model.transform(value).columns
    row = metrics.first()
    assert scored.agg(F.min("label")).first()[0] >= 1900 * 2.0 - 2
    spread = scored.agg(F.stddev_pop("label")).first()[0]
    assert row["rmse"] < spread / 2 and row["mae"] <= row["rmse"]


def test_scores_are_probabilities(orders):
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["n_items"], outputCol="features").transform(
        orders.select("order_id", "n_items", F.col("review_binary").alias("label")))
    model = PipelineModel(stages=[GBTClassifier(maxIter=2, seed=1).fit(rows)])
    scored = score_classes(model, rows)
    assert dict(scored.dtypes)["prediction"] == "int"
    assert scored.where("(score >= 0.5) <> (prediction = 1)").count() == 0


def test_dictionary_of_many_categories(spark):
    from shopgrain.ml.prepare import category_dictionary, category_modes, category_positions
    from shopgrain.session import materialize

    n = F.col("id")
    train = spark.range(60_000).select(n.alias("order_id"), F.concat(F.lit("c"), n % 40_000).alias("c"), F.when(n % 3 > 0, "hot").alias("d"))
    found = category_dictionary(train, ["c", "d"], materialize)
    rows = {(r.feature, r.value): r.position for r in found.collect()}
    assert len(rows) == 40_001 and rows["d", "hot"] == 40_000
    by_position = [v for _, v in sorted((p, v) for (f, v), p in rows.items() if f == "c")]
    assert by_position == sorted(by_position)
    modes = category_modes(train, ["c", "d"]).first().asDict()
    odd = spark.createDataFrame([(1, "c7", "new"), (2, None, None)], "order_id long, c string, d string")
    got = {r.order_id: r.positions for r in category_positions(odd, ["order_id"], ["c", "d"], found, modes).collect()}
    assert got == {1: [rows["c", "c7"]], 2: [rows["c", modes["c"]], 40_000]}
