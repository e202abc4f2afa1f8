"""MLlib pipeline: bounds, not equality with another library (SURVEY §5 (4))."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.ml import model as ML
from churnspark.ml import score as SC
from churnspark.operators import clean as C

N = 600


def _customers(seed=11, n=N, snake=True):
    rng = np.random.default_rng(seed)
    data = {"customer_id": [f"C{i:05d}" for i in range(n)],
            "tenure_in_months": rng.integers(0, 72, n)}
    data["monthly_charge"] = np.round(rng.uniform(20, 120, n), 2)
    data["total_charges"] = np.round(data["monthly_charge"] * data["tenure_in_months"], 2)
    for feat in S.CATEGORICAL_FEATURES:
        opts = S.FEATURE_OPTIONS.get(feat, ["Yes", "No"])
        data[[k for k, v in S.FEATURE_ALIASES.items() if v == feat][0]] = rng.choice(opts, n)
    pdf = pd.DataFrame(data)
    risk = (pdf["contract"] == "Month-to-month") * 0.6 + (pdf["tenure_in_months"] < 12) * 0.3
    pdf["churn_value"] = (rng.random(n) < risk * 0.9 + 0.03).astype(int)
    if not snake:
        pdf = pdf.rename(columns=S.FEATURE_ALIASES)
    return pdf


@pytest.fixture(scope="module")
def trained(spark):
    df = spark.createDataFrame(_customers())
    return ML.train(df, num_trees=20, max_depth=6)


def test_train_metadata(trained):
    m = trained.metadata
    assert m["n_train_rows"] + m["n_test_rows"] == N
    assert m["n_test_rows"] == math.ceil(0.2 * N)
    assert m["model_version"].startswith("v") and m["trained_at"].endswith("Z")
    assert m["features"] == S.ALL_FEATURES
    assert set(m["metrics"]) == {"accuracy", "precision", "recall", "f1", "roc_auc"}
    assert all(0.0 <= v <= 1.0 for v in m["metrics"].values())
    assert m["metrics"]["roc_auc"] > 0.6                         # separable signal
    top = m["top_feature_importances"]
    assert 0 < len(top) <= 15 and list(top.values()) == sorted(top.values(), reverse=True)
    assert any(k.startswith("cat__Contract_") or k == "num__Tenure Months" for k in list(top)[:3])
    assert set(m["class_balance_pct"]) == {"0", "1"} and sum(m["class_balance_pct"].values()) == pytest.approx(100)


def test_save_load_same_scores(spark, trained, tmp):
    v = ML.save(trained, f"{tmp}/models")
    model, meta = ML.load(spark, f"{tmp}/models")
    assert meta["model_version"] == v and meta["metrics"]["roc_auc"] == trained.metadata["metrics"]["roc_auc"]
    assert meta["class_balance_pct"] == trained.metadata["class_balance_pct"]
    df = spark.createDataFrame(_customers(seed=99, n=50))
    a = {r.customer_id: r.churn_probability for r in ML.score(trained.model, df, v).collect()}
    b = {r.customer_id: r.churn_probability for r in ML.score(model, df, v).collect()}
    assert a == b


def test_a_lost_save_leaves_the_model_before(spark, trained, tmp, monkeypatch):
    base = f"{tmp}/kept"
    with pytest.raises(FileNotFoundError):
        ML.load(spark, base)
    v = ML.save(trained, base)
    later = ML.TrainResult(trained.model, {**trained.metadata, "model_version": "v9", "null_targets": 7}, trained.test_scores)

    def dies(*a, **k):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr("churnspark.sources.claims.claim", dies)
        with pytest.raises(RuntimeError):
            ML.save(later, base)
    assert ML.load(spark, base)[1]["model_version"] == v
    assert ML.save(later, base) == "v9"
    meta = ML.load(spark, base)[1]
    assert (meta["model_version"], meta["null_targets"]) == ("v9", 7) and ML.load(spark, base, v)[1]["model_version"] == v


def test_score_shapes_and_rules(spark, trained):
    pdf = _customers(seed=5, n=40, snake=False)        # model (Title Case) names
    pdf.loc[0, "Contract"] = "Month-to-Month"           # unseen spelling (T7) -> all-zero one-hot
    pdf.loc[1, "Tenure Months"] = None
    df = spark.createDataFrame(pdf.drop(columns=["Churn Value"]))
    out = ML.score(trained.model, df, "v1").toPandas()
    assert len(out) == 40 and out.columns.tolist() == ML.RESULT
    assert out.churn_probability.between(0, 1).all()
    band = np.where(out.churn_probability >= 0.7, "High", np.where(out.churn_probability >= 0.4, "Medium", "Low"))
    assert (out.risk_level == band).all()
    assert (out.prediction == np.where(out.predicted_churn, "Yes", "No")).all()
    no_id = ML.score(trained.model, df.drop("customer_id"), "v1").select("customer_id").toPandas()
    assert sorted(no_id.customer_id) == sorted(f"ROW_{i}" for i in range(1, 41))
    with pytest.raises(C.MissingColumnsError) as e:
        ML.score(trained.model, df.drop("Gender", "Contract"))
    assert e.value.missing == ["Gender", "Contract"]


def test_score_with_status(spark, trained):
    pdf = _customers(seed=6, n=10)
    pdf["gender"] = pdf["gender"].astype(object)
    pdf.loc[3, "gender"] = None
    df = spark.createDataFrame(pdf.drop(columns=["churn_value"]).rename(columns={"contract": "Contract"}))
    out = ML.score_with_status(trained.model, df, "v1").toPandas().set_index("customer_id")
    # a blank category is scored; a field the file lacks is an error on every row
    assert (out.status == "OK").all() and out.probability.between(0, 1).all()
    lacking = ML.score_with_status(trained.model, df.drop("Contract"), "v1").collect()
    assert len(lacking) == 10 and all(r.prediction == "Error" and r.probability is None and "Contract" in r.error for r in lacking)
    assert {r.customer_id for r in ML.score_with_status(trained.model, df.drop("customer_id"), "v1").collect()} == {"N/A"}


def test_whatif_and_log(spark, trained, tmp):
    base = spark.createDataFrame(_customers(seed=8, n=6)).drop("contract", *[k for k, v in S.FEATURE_ALIASES.items()
                                                                             if v in S.WHATIF_DEFAULTS])
    grid = SC.whatif_grid(base, {"Contract": S.FEATURE_OPTIONS["Contract"]})
    assert grid.count() == 18
    scored = ML.score(trained.model, grid, "v1")
    assert scored.count() == 18
    log = f"{tmp}/logs"
    res = ML.score_and_log(trained.model, spark.createDataFrame(_customers(seed=9, n=7)), log, None)
    assert res.count() == 7
    ML.score_and_log(trained.model, spark.createDataFrame(_customers(seed=10, n=5)), log, "v9")
    logs = spark.read.parquet(log).toPandas()
    assert sorted(logs.inference_id) == list(range(1, 13))            # high-water mark continues
    assert set(logs.model_version) == {"v1.0", "v9"}                    # default only when absent (T2)


def test_training_target_rules(spark):
    pdf = _customers(seed=12, n=200)
    pdf["churn_label"] = np.where(pdf.churn_value == 1, " YES ", "No")
    no_value = spark.createDataFrame(pdf.drop(columns=["churn_value"]))
    prepared = ML.prepare_training(no_value)
    assert prepared.agg(F.sum(S.TARGET)).first()[0] == int(pdf.churn_value.sum())
    with_null = pdf.astype({"churn_value": object})
    with_null.loc[0, "churn_value"] = None
    df = spark.createDataFrame(with_null)
    assert ML.null_targets(df) == 1
    assert ML.prepare_training(df).count() == 200
    with pytest.raises(C.MissingColumnsError):
        ML.prepare_training(spark.createDataFrame(pdf.drop(columns=["gender"])))


def test_exact_auc_matches_mllib_evaluator(spark, trained):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from churnspark.operators import metrics as MT
    scores = trained.test_scores.select(ML.LABEL, "_p", "_raw")
    ours = MT.roc_auc(scores, ML.LABEL, "_p", digits=None).first()[0]
    theirs = BinaryClassificationEvaluator(rawPredictionCol="_raw", labelCol=ML.LABEL,
                                           metricName="areaUnderROC", numBins=0).evaluate(scores)
    assert ours == pytest.approx(theirs, abs=1e-9)
    assert trained.metadata["metrics"]["roc_auc"] == round(ours, 4)


def test_training_tasks_follow_rows_not_input_partitions(spark, monkeypatch):
    """Every task sends the statistics of nearly all open nodes and, scoring, reads the whole
    forest: input in many small partitions must not multiply that; no row is lost by it."""
    fitted, build = [], ML.build_pipeline

    def recorded(*args):
        pipeline = build(*args)
        fit = pipeline.fit
        pipeline.fit = lambda df: (fitted.append((df.rdd.getNumPartitions(), df.count())), fit(df))[1]
        return pipeline

    monkeypatch.setattr(ML, "build_pipeline", recorded)
    cores = spark.sparkContext.defaultParallelism
    result = ML.train(spark.createDataFrame(_customers()).repartition(8 * cores), num_trees=3, max_depth=3)
    assert fitted == [(cores, result.metadata["n_train_rows"])]
    # the scored test rows are kept without the lineage that holds the forest
    assert result.test_scores.rdd.getNumPartitions() == cores
    assert "UDF" not in result.test_scores._jdf.queryExecution().executedPlan().toString()
    assert result.test_scores.count() == result.metadata["n_test_rows"]
    monkeypatch.setattr(ML, "ROWS_PER_TASK", 50)
    assert ML.training_tasks(spark, 0) == cores and ML.training_tasks(spark, 601) == max(cores, 13)
