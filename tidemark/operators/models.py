"""Tree models on Spark ML (ML1-ML9).

The reference's four boosting / forest presets become Spark ML estimators
with the closest parameters; algorithms differ, so only the contract
(columns, determinism by seed, an early stop, better than the mean on a planted
signal) is tested, not the published scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sample import bottom_k
from tidemark.operators.series import SeriesSpec
from tidemark.operators.splits import ordered_split
from tidemark.operators.strategy import regression_metrics

# --- fixed values that must equal the reference (presets) ----------------------------
PRESETS = {
    "lightgbm": dict(kind="gbt", maxIter=500, stepSize=0.05, maxDepth=5, minInstancesPerNode=20,
                     subsamplingRate=0.8, featureSubsetStrategy="0.8", early_stop=50),
    "xgboost": dict(kind="gbt", maxIter=700, stepSize=0.01, maxDepth=5, minInstancesPerNode=3,
                    subsamplingRate=0.8, featureSubsetStrategy="0.8"),
    "catboost": dict(kind="gbt", maxIter=500, stepSize=0.05, maxDepth=5, early_stop=50),
    "random_forest": dict(kind="rf", numTrees=300, maxDepth=10, minInstancesPerNode=5, featureSubsetStrategy="sqrt"),
}
SEED = 42
# ---------------------------------------------------------------------------------------


def model(name: str, features: str = "features", label: str = "label", prediction: str = "prediction",
          validation_col: str | None = None, **overrides):
    """ML1-ML4: estimator for a preset; ``overrides`` replace preset values
    (e.g. fewer trees in tests).  With ``validation_col`` the GBT presets
    that early-stop in the reference use Spark's validation indicator."""
    if name not in PRESETS:
        raise ValueError(f"unknown model preset {name!r}")
    p = {**PRESETS[name], **overrides}
    kind = p.pop("kind")
    early = p.pop("early_stop", None)
    if kind == "rf":
        return RandomForestRegressor(featuresCol=features, labelCol=label, predictionCol=prediction, seed=SEED, **p)
    est = GBTRegressor(featuresCol=features, labelCol=label, predictionCol=prediction, seed=SEED, **p)
    if early and validation_col:
        est.setValidationIndicatorCol(validation_col)
    return est


def pipeline(name: str, cols: Sequence[str], label: str, **overrides) -> Pipeline:
    """ML5: assemble (nulls must be filled before) + estimator, so the fitted
    bundle saves and loads as one ``PipelineModel`` (S9)."""
    asm = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[asm, model(name, label=label, **overrides)])


@dataclass
class Validated:
    """A fitted pipeline, its error per round on both parts (``round, train_mse,
    valid_mse, best``; a forest has one row, that of all its trees) and its
    metrics on the validation part."""

    model: PipelineModel
    rounds: DataFrame
    metrics: DataFrame
    best: int


def fit_validated(name: str, rows: DataFrame, cols: Sequence[str], label: str, spec: SeriesSpec, frac: float = 0.8,
                  most_rows: int = 1_000_000, **overrides) -> Validated:
    """ML1, ML3, ML5: fits a preset on the first ``frac`` of the rows in series
    order and watches the error on the rest.

    Presets that stop early do so in the first round whose validation error no
    longer improves (Spark's ``validationTol``, relative to 0.01 at least), and
    keep the trees up to it; ``overrides`` may set that and the rounds.  Labelled
    rows above ``most_rows`` are sampled by ``bottom_k`` of their order value,
    since trees are fitted on rows that executors hold in memory; scoring is not
    bounded.  Nulls must be filled before."""
    sample = bottom_k(rows.where(F.col(label).isNotNull()), most_rows, [*spec.keys, spec.order])
    # positions have gaps in a sample: the split goes by rank
    d = ordered_split(sample.drop(*([spec.index] if spec.index and spec.index != spec.order else [])), SeriesSpec(spec.order, spec.key, spec.tiebreak), frac, "_part")
    d = d.withColumn("_valid", F.col("_part") == "test").persist()
    parts = [d.where(~F.col("_valid")), d.where("_valid")]
    boosts = PRESETS[name]["kind"] == "gbt"
    watches = boosts and "early_stop" in PRESETS[name]
    fitted = pipeline(name, cols, label, **({"validation_col": "_valid"} if watches else {}), **overrides).fit(d if watches else parts[0])
    last = fitted.stages[-1]
    if boosts:
        errors = [last.evaluateEachIteration(fitted.stages[0].transform(x), "squared") for x in parts]
    else:
        errors = [[(r["rmse"] or 0.0) ** 2] for r in (regression_metrics(fitted.transform(x), label, "prediction").first() for x in parts)]
    best = min(range(len(errors[1])), key=lambda i: errors[1][i]) + 1
    rounds = rows.sparkSession.createDataFrame([(i + 1, float(a), float(b), i + 1 == best) for i, (a, b) in enumerate(zip(*errors, strict=True))],
                                               "round int, train_mse double, valid_mse double, best boolean")
    metrics = regression_metrics(fitted.transform(parts[1]), label, "prediction").withColumn("rounds", F.lit(len(errors[1]))).withColumn("model", F.lit(name))
    return Validated(fitted, rounds, metrics, best)


def importance(fitted: PipelineModel, cols: Sequence[str]) -> DataFrame:
    """ML9/K8: feature importance table ranked descending."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    imp = fitted.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(cols, imp)), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature"))


def signal_classifier(cols: Sequence[str], label: str = "signal", trees: int = 100):
    """ML7: three-class signal classifier (bear / neutral / bull)."""
    asm = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[asm, RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees,
                                                        seed=SEED)])
