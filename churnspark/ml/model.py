"""MLlib churn model: feature preparation, class-weighted random forest, evaluation,
importances, persistence and scoring (batch, per-row status, score-and-log).

Training is distributed by MLlib (tree levels are Spark jobs over the cached training
frame); evaluation uses the churnspark aggregate operators, never a collected score list.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.functions import scalars as X
from churnspark.operators import analytics as A
from churnspark.operators import clean as C
from churnspark.operators import metrics as MT
from churnspark.operators import quality as Q
from churnspark.operators import rows as R
from churnspark.session import cut_lineage
from churnspark.sources.readers import file_row_numbers, with_file_order

LABEL, WEIGHT, FEATURES = "_label", "_weight", "_features"
#: Rows of the training frame in one task (MLlib keeps two numbers per row and tree: about 2 kB at 200 trees).
ROWS_PER_TASK = 200_000


def _idx(c: str) -> str:
    return f"_idx_{c}"


def _oh(c: str) -> str:
    return f"_oh_{c}"


# -- shaping (B2, H1, H3, H4, B5, B8) -------------------------------------------------

def prepare_training(df: DataFrame, passthrough: tuple = ()) -> DataFrame:
    """Table -> model frame: aliases folded, numerics coerced (bad or NULL -> 0), target
    from ``Churn Value`` (bad or NULL -> 0) or, only when that column is missing, from
    ``churn_label``; required columns checked; rows with a NULL feature dropped.
    ``null_targets`` counts the NULL targets that became 0 (report it with a model)."""
    x = C.apply_aliases(df)
    x = C.coerce_numeric(x, S.NUMERIC_FEATURES, 0.0)
    if S.TARGET in x.columns:
        target = X.to_int_target(F.col(f"`{S.TARGET}`"))
    elif "churn_label" in x.columns:
        target = X.label_to_int(F.col("churn_label"))
    else:
        target = None
    C.require_columns(x if target is None else x.withColumn(S.TARGET, F.lit(0)), S.ALL_FEATURES + [S.TARGET])
    keep = ([S.KEY] if S.KEY in x.columns else []) + S.ALL_FEATURES + list(passthrough)
    out = x.select(*[F.col(f"`{c}`") for c in keep], target.alias(S.TARGET))
    return C.dropna_any(out, S.ALL_FEATURES + [S.TARGET])


def null_targets(df: DataFrame) -> int:
    x = C.apply_aliases(df)
    if S.TARGET not in x.columns:
        return 0
    return x.filter(F.col(f"`{S.TARGET}`").try_cast("double").isNull()).count()


def build_pipeline(num_trees: int = S.FOREST_PARAMS["num_trees"], max_depth: int = S.FOREST_PARAMS["max_depth"],
                   min_leaf: int = S.FOREST_PARAMS["min_leaf"], seed: int = S.FOREST_PARAMS["seed"],
                   max_bins: int = 64) -> Pipeline:
    """M1 + M2 + M4: scale 3 numerics, one-hot 16 categoricals (unseen or NULL -> all-zero
    vector, every known value keeps its slot), class-weighted random forest."""
    cats = S.CATEGORICAL_FEATURES
    indexer = StringIndexer(inputCols=cats, outputCols=[_idx(c) for c in cats], handleInvalid="keep",
                            stringOrderType="frequencyDesc")
    onehot = OneHotEncoder(inputCols=[_idx(c) for c in cats], outputCols=[_oh(c) for c in cats], dropLast=True,
                           handleInvalid="keep")
    nums = VectorAssembler(inputCols=S.NUMERIC_FEATURES, outputCol="_nums", handleInvalid="keep")
    scaler = StandardScaler(inputCol="_nums", outputCol="_nums_z", withMean=True, withStd=True)
    assemble = VectorAssembler(inputCols=["_nums_z"] + [_oh(c) for c in cats], outputCol=FEATURES)
    forest = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT,
                                    numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=min_leaf,
                                    featureSubsetStrategy="sqrt", seed=seed, maxBins=max_bins,
                                    maxMemoryInMB=1024, cacheNodeIds=True,
                                    probabilityCol="_probability", rawPredictionCol="_raw",
                                    predictionCol="_prediction")
    return Pipeline(stages=[indexer, onehot, nums, scaler, assemble, forest])


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the assembled feature slots: ``num__<feature>``, ``cat__<feature>_<value>``."""
    indexer = model.stages[0]
    names = [f"num__{c}" for c in S.NUMERIC_FEATURES]
    for c, labels in zip(S.CATEGORICAL_FEATURES, indexer.labelsArray):
        names += [f"cat__{c}_{v}" for v in labels]      # the "unseen" slot is the dropped last one
    return names


def top_importances(model: PipelineModel, k: int = S.TOP_IMPORTANCES, digits: int = 4) -> dict[str, float]:
    """The k largest importances (ties by name), rounded."""
    imp = model.stages[-1].featureImportances.toArray()
    names = feature_names(model)
    pairs = sorted(zip(names, imp), key=lambda t: (-t[1], t[0]))[:k]
    return {n: round(float(v), digits) for n, v in pairs}


# -- M5: fit and evaluate ----------------------------------------------------------------

def training_tasks(spark: SparkSession, rows: int) -> int:
    """Tasks over the training frame: enough for all cores and for ``ROWS_PER_TASK`` each, whatever
    the partitions of the input.  At each level every task makes, sends and reads the statistics
    of nearly all open nodes, and a task that scores reads the whole forest, so that small
    tasks multiply the cost."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


@dataclass
class TrainResult:
    model: PipelineModel
    metadata: dict
    test_scores: DataFrame = field(repr=False)


def probability_of_churn(scored: DataFrame) -> DataFrame:
    return scored.withColumn("_p", vector_to_array(F.col("_probability")).getItem(1))


def train(df: DataFrame, num_trees: int = S.FOREST_PARAMS["num_trees"], max_depth: int = S.FOREST_PARAMS["max_depth"],
          min_leaf: int = S.FOREST_PARAMS["min_leaf"], seed: int = S.FOREST_PARAMS["seed"],
          test_fraction: float = S.TEST_FRACTION, max_bins: int = 64) -> TrainResult:
    """Table -> fitted pipeline + metadata (version, sizes, features, metrics, top-15)."""
    source = C.apply_aliases(df)
    numbered = S.KEY not in source.columns
    if numbered:
        # no key: rows are numbered in file order (a plain position when the frame is not a scan)
        source = with_file_order(source, "_ord")
    used = [S.KEY, *S.ALL_FEATURES, S.TARGET, "churn_label", "_ord"]
    # the input is computed once: the checks, class counts, split ranks, fit and evaluation read this copy
    source = source.select(*[F.col(f"`{c}`") for c in used if c in source.columns]).persist(StorageLevel.MEMORY_AND_DISK)
    prepared = prepare_training(source, ("_ord",) if numbered else ())
    n_rows = prepared.count()
    if not n_rows:
        raise ValueError("0 customer records available for training")
    id_col = "_rid" if numbered else S.KEY
    if numbered:
        prepared = R.row_ids(prepared, ["_ord"], "_rid").drop("_ord")
    labelled = prepared.withColumn(LABEL, F.col(f"`{S.TARGET}`").cast("double"))
    split = R.stratified_split(labelled, LABEL, id_col, test_fraction, seed)
    # dealt evenly whatever the keys; ordered, so that a lost task is drawn again from the same rows
    dealt = split.repartition(training_tasks(df.sparkSession, n_rows)).sortWithinPartitions(id_col)
    train_df = A.with_class_weight(dealt.filter(F.col("part") == "train"), LABEL, WEIGHT)
    test_df = dealt.filter(F.col("part") == "test")
    model = build_pipeline(num_trees, max_depth, min_leaf, seed, max_bins).fit(train_df)
    scored = probability_of_churn(model.transform(test_df.withColumn(WEIGHT, F.lit(1.0))))
    # read for the confusion cells and again for the AUC: the forest scores the test set once, and
    # with its lineage cut no later task reads the forest again
    scored = cut_lineage(scored.select(id_col, LABEL, "_raw", "_probability", "_prediction", "_p",
                                       (F.col("_p") > 0.5).alias("_pred")))
    m = MT.binary_metrics(scored, LABEL, "_pred").first()
    n_classes = labelled.select(LABEL).distinct().count()
    auc = MT.roc_auc(scored, LABEL, "_p").first()[0] if n_classes > 1 else 0.0
    counts = split.groupBy("part").count().collect()
    sizes = {r["part"]: r["count"] for r in counts}
    # The class balance is reported with every model (one row per class)
    balance = {str(int(r[LABEL])): round(float(r["share_pct"]), 4)
               for r in A.class_balance(labelled, LABEL).collect()}
    now = dt.datetime.now(dt.timezone.utc)
    meta = {
        "model_version": now.strftime("v%Y%m%d-%H%M%S"),
        "trained_at": now.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "n_train_rows": sizes.get("train", 0),
        "n_test_rows": sizes.get("test", 0),
        "features": list(S.ALL_FEATURES),
        "metrics": {"accuracy": m["accuracy"], "precision": m["precision"], "recall": m["recall"],
                    "f1": m["f1"], "roc_auc": float(auc)},
        "top_feature_importances": top_importances(model),
        "class_balance_pct": balance,
        "null_targets": null_targets(source),
    }
    source.unpersist(blocking=False)
    R.release_caches()
    return TrainResult(model, meta, scored)


# -- A9 / A10: persistence ---------------------------------------------------------------

MODEL_SCHEMA = "model_version string, saved_at timestamp"


def save(result: TrainResult, model_dir: str) -> str:
    """Model under ``<dir>/<version>``, metadata next to it, then the next place in the append-only
    list of models: readers take the last one, so a half-written model is never used and a
    writer lost at any point leaves the model before it in place."""
    from churnspark.sources import tables as TB
    from churnspark.sources.claims import Taken, claim, settle
    spark = result.test_scores.sparkSession
    base = model_dir.rstrip("/")
    v = result.metadata["model_version"]
    result.model.write().overwrite().save(f"{base}/{v}/model")
    TB.write_metadata(spark, result.metadata, f"{base}/{v}/metadata")
    place = (_last_model(spark, base)[0] or 0) + 1
    while True:
        try:
            claim(spark, f"{base}/_models", place, (v, dt.datetime.now(dt.timezone.utc)), MODEL_SCHEMA)
            return v
        except Taken:
            settle(spark, f"{base}/_models", place, MODEL_SCHEMA, wait_seconds=30)
            place += 1


def _last_model(spark: SparkSession, base: str) -> tuple[int | None, str | None]:
    from churnspark.sources.claims import claims
    return tuple(claims(spark, f"{base}/_models", MODEL_SCHEMA).agg(F.max("n"), F.max_by("model_version", "n")).first())


def load(spark: SparkSession, model_dir: str, version: str | None = None) -> tuple[PipelineModel, dict | None]:
    from churnspark.sources import tables as TB
    base = model_dir.rstrip("/")
    version = version or _last_model(spark, base)[1]
    if version is None:
        raise FileNotFoundError("no trained model yet: train first")
    return PipelineModel.load(f"{base}/{version}/model"), TB.read_metadata(spark, f"{base}/{version}/metadata")


# -- M9: batch scoring -------------------------------------------------------------------

def _shape_for_scoring(df: DataFrame) -> DataFrame:
    x = C.apply_aliases(df)
    x = C.coerce_numeric(x, S.NUMERIC_FEATURES, 0.0)
    C.require_columns(x, S.ALL_FEATURES)
    if S.KEY not in x.columns:
        # ROW_i by file order (ingest sequence), numbered without a single-task window
        x = file_row_numbers(x, "_rn")
        x = x.withColumn(S.KEY, X.default_row_id(F.lit(None), "_rn")).drop("_rn")
    return x


def _result_columns(scored: DataFrame, model_version: str | None) -> DataFrame:
    p = F.col("_p")
    rp = X.round_prob(p)
    return scored.withColumns({
        "churn_probability": rp,
        "predicted_churn": p > 0.5,
        "prediction": X.yes_no(p > 0.5),
        "risk_level": X.risk_band(rp),
        "model_version": F.lit(model_version).cast("string"),
    })


RESULT = ["customer_id", "churn_probability", "predicted_churn", "prediction", "risk_level", "model_version"]


def score(model: PipelineModel, df: DataFrame, model_version: str | None = None) -> DataFrame:
    """File or table -> (customer_id, churn_probability, predicted_churn, prediction,
    risk_level, model_version).  One narrow pass (the fitted stages are per-row)."""
    x = _shape_for_scoring(df)
    scored = probability_of_churn(model.transform(x))
    return _result_columns(scored, model_version).select(*RESULT)


def score_with_status(model: PipelineModel, df: DataFrame, model_version: str | None = None) -> DataFrame:
    """Every row gets a result; rows of a file that lacks a required field get prediction
    "Error", no probability and the error text instead of failing the file.  A blank value in
    a field that is there is scored (an unknown category), and a blank id is "N/A"."""
    x = C.apply_aliases(C.normalise_headers(df))
    absent = [c for c in S.ALL_FEATURES if c not in x.columns]
    x = x.withColumns({c: F.lit(None).cast("string") for c in absent})
    no_id = F.lit(None).cast("string") if S.KEY not in x.columns else F.col(S.KEY).cast("string")
    x = x.withColumn(S.KEY, F.coalesce(F.when(F.trim(no_id) != "", no_id), F.lit("N/A")))
    error = F.lit(f"missing required value: {', '.join(absent)}" if absent else None).cast("string")
    checked = x.withColumn("error", error).withColumn("status", F.lit("Error" if absent else "OK"))
    shaped = _shape_for_scoring(checked)
    scored = _result_columns(probability_of_churn(model.transform(shaped)), model_version)
    ok = F.col("status") == "OK"
    return scored.select(
        "customer_id",
        F.when(ok, F.col("prediction")).otherwise(F.lit("Error")).alias("prediction"),
        F.when(ok, F.col("churn_probability")).alias("probability"),
        F.when(ok, F.col("risk_level")).alias("risk_level"),
        "status", "error", F.lit(model_version).cast("string").alias("model_version"))


# -- M12: score and log ------------------------------------------------------------------

def score_and_log(model: PipelineModel, df: DataFrame, log_path: str, model_version: str | None = None,
                  batch_id: int | None = None, source: str | None = None) -> DataFrame:
    """Score, keep rows with an id (B12), append them to the inference log."""
    from churnspark.sources import tables as TB
    res = score(model, df, model_version)
    TB.append_logs(df.sparkSession, log_path, C.loggable(res, S.KEY), model_version, batch_id, source)
    return res
