"""Models over records: a gate between on and off topic, grades with cross-validation, calibration."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.ranks import spearman
from granary.operators.statistics import area_under_curve
from granary.session import keep


def fold(key: Column, folds: int, seed: int = 42) -> Column:
    """The fold of a row by a hash of its key or its group's, the same in any partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def gate_probabilities(df: DataFrame, key: str, vector: str, label: str, folds: int = 5) -> DataFrame:
    """(key, label, p): out-of-fold probability of each row by logistic regression on its vector. One fit per fold over all other rows."""
    rows = keep(df.where(F.col(vector).isNotNull()).select(key, F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"), fold(F.col(key), folds).alias("fold")))
    out = None
    for f in range(folds):
        model = LogisticRegression(regParam=0.01, maxIter=50).fit(rows.where(F.col("fold") != f))
        part = model.transform(rows.where(F.col("fold") == f)).select(key, "label", vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def decide(p: Column, low: float = 0.2, high: float = 0.7) -> Column:
    return F.when(p >= high, "accept").when(p < low, "reject").otherwise("review")


def gate_report(scored: DataFrame) -> DataFrame:
    """(decision, n, n_good) over out-of-fold probabilities."""
    return scored.groupBy(decide(F.col("p")).alias("decision")).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("n_good"))


def gate_auc(scored: DataFrame) -> DataFrame:
    return area_under_curve(scored.withColumn("g", F.col("label").cast("int")), "p", "g")


def grade_models(df: DataFrame, features: list[str], targets: list[str], kind: str = "gbt") -> dict[str, object]:
    """A tree model per target dimension; missing features count as their mean."""
    means = df.agg(*[F.coalesce(F.avg(f), F.lit(0.0)).alias(f) for f in features]).first()
    rows = df.select(array_to_vector(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float(means[f]))) for f in features])).alias("features"), *targets)
    make = GBTRegressor if kind == "gbt" else RandomForestRegressor
    return {t: make(labelCol=t, maxDepth=3, seed=42).fit(rows.where(F.col(t).isNotNull())) for t in targets}


def cross_validated(df: DataFrame, key: str, group: str, features: list[str], target: str, folds: int = 4) -> DataFrame:
    """(key, target, prediction) where a row's model has not seen its group; predictions are clipped to 1..5."""
    rows = keep(df.where(F.col(target).isNotNull()).select(key, F.col(target).cast("double").alias(target), array_to_vector(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])).alias("features"), fold(F.col(group), folds).alias("fold")))
    out = None
    for f in sorted(r["fold"] for r in rows.select("fold").distinct().collect()):  # at most ``folds``
        train = rows.where(F.col("fold") != f)
        if train.isEmpty():
            continue
        model = GBTRegressor(labelCol=target, maxDepth=3, maxIter=20, seed=42).fit(train)
        part = model.transform(rows.where(F.col("fold") == f)).select(key, target, F.greatest(F.lit(1.0), F.least(F.lit(5.0), "prediction")).alias("prediction"))
        out = part if out is None else out.unionByName(part)
    return out


def regression_measures(scored: DataFrame, target: str) -> DataFrame:
    """One row: n, pearson, spearman, mae, rmse, bias."""
    e = F.col("prediction") - F.col(target)
    base = scored.agg(F.count("*").alias("n"), F.corr("prediction", target).alias("pearson"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))
    return base.crossJoin(spearman(scored, "prediction", target).select(F.col("rho").alias("spearman")))


def expected_calibration_error(scored: DataFrame, p: str, good: str, bins: int = 10) -> DataFrame:
    """One row: n, ece: mean distance between probability and frequency over equal-width bins, weighted by their rows."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = scored.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(F.col(good).cast("double")).alias("g"))
    return per.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("p") - F.col("g"))) / F.sum("n")).alias("ece"))
