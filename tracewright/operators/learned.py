"""The learned verifier: a logistic regression over trajectory features, with held-out report."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_seed


def split(df: DataFrame, key: str, label: str, held_out: float = 0.25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A stratified split by hash order within each label (in 16 parts, so no task sorts a whole label)."""
    place = F.percent_rank().over(Window.partitionBy(label, F.pmod(F.xxhash64(key), F.lit(16))).orderBy(stable_seed(F.lit(seed), F.col(key)), key))
    marked = df.withColumn("_p", place)
    return marked.filter(F.col("_p") >= held_out).drop("_p"), marked.filter(F.col("_p") < held_out).drop("_p")


def train(rows: DataFrame, features: list[str], label: str = "label") -> PipelineModel:
    """Fit on balanced classes; a single class is refused."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        raise ValueError("both classes are needed")
    total = sum(counts.values())
    weight = F.when(F.col(label) == 1, total / (2.0 * counts[1])).otherwise(total / (2.0 * counts[0]))
    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", maxIter=100, regParam=1.0 / total, standardization=False)]
    return Pipeline(stages=stages).fit(rows.withColumn("weight", weight))


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the ``probability`` of a pass."""
    out = model.transform(rows.withColumn("weight", F.lit(1.0)))
    return out.withColumn("probability", vector_to_array("probability")[1]).drop("raw", "scaled", "rawPrediction", "prediction", "weight")


def report(scored: DataFrame, label: str = "label") -> DataFrame:
    """Agreement, precision, recall and Brier score of held-out predictions."""
    hit, truth = F.col("probability") >= 0.5, F.col(label) == 1
    both, said, real = F.sum((hit & truth).cast("int")), F.sum(hit.cast("int")), F.sum(truth.cast("int"))
    return scored.agg(
        F.count("*").alias("n"), F.round(F.avg((hit == truth).cast("double")), 4).alias("agreement"), F.round(F.coalesce(F.try_divide(both, said), F.lit(0.0)), 4).alias("precision"),
        F.round(F.coalesce(F.try_divide(both, real), F.lit(0.0)), 4).alias("recall"), F.round(F.avg(F.pow(F.col("probability") - F.col(label), 2)), 4).alias("brier"),
    )


def calibration(scores: DataFrame, score: str = "score", label: str = "label", steps: int = 50, tolerance: float = 1e-10) -> tuple[float, float]:
    """``a, b`` of the calibrated chance 1 / (1 + exp(-(a score + b))), the fit of least log loss over all rows.

    Newton steps over five sums each. Targets are drawn in a little, by the
    numbers of both classes, so a score that parts them has a finite fit. Rows
    without a score or label don't count; with one class only, or one score, the
    slope is 0.
    """
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    rows = scores.filter(s.isNotNull() & ~F.isnan(s) & y.isin(0.0, 1.0)).select(s.alias("s"), y.alias("y"))
    n, wins, low, high = rows.agg(F.count("*"), F.sum("y"), F.min("s"), F.max("s")).first()
    if not n:
        return 0.0, 0.0
    top, bottom = (wins + 1) / (wins + 2), 1 / (n - wins + 2)
    target = F.when(F.col("y") == 1, top).otherwise(bottom)
    share = (wins * top + (n - wins) * bottom) / n
    a, b = 0.0, math.log(share / (1 - share))
    if low == high or wins in (0, n):
        return a, b
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(F.col("s") * a + b)))
        rest, weight = target - p, p * (1 - p)
        g1, g0, h11, h10, h00 = rows.agg(F.sum(rest * F.col("s")), F.sum(rest), F.sum(weight * F.col("s") * F.col("s")), F.sum(weight * F.col("s")), F.sum(weight)).first()
        det = h11 * h00 - h10 * h10
        if det <= 1e-12 * max(h11 * h00, 1e-300):
            break
        da, db = (h00 * g1 - h10 * g0) / det, (h11 * g0 - h10 * g1) / det
        a, b = a + da, b + db
        if abs(da) < tolerance * max(1.0, abs(a)) and abs(db) < tolerance * max(1.0, abs(b)):
            break
    return a, b


def calibrated(scores: DataFrame, fit: tuple[float, float], score: str = "score") -> DataFrame:
    """``scores`` with the ``probability`` that a fit of :func:`calibration` gives."""
    a, b = fit
    return scores.withColumn("probability", 1 / (1 + F.exp(-(F.col(score).cast("double") * a + b))))


def reliability_bins(scored: DataFrame, label: str = "label", bins: int = 10) -> DataFrame:
    """``bin, n, mean_probability, rate, brier`` of predictions by tenths of their probability; the last bin holds 1 too."""
    at = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("bigint")
    y = F.col(label).cast("double")
    return scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("probability"), 4).alias("mean_probability"), F.round(F.avg(y), 4).alias("rate"), F.round(F.avg(F.pow(F.col("probability") - y, 2)), 4).alias("brier"))
