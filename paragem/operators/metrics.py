"""Quality measures of classifiers and regressors, from prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASS_NAMES = {0: "Microparada", 1: "Breakdown"}


def classification_report(
    predictions: DataFrame, label: str = "Target", prediction: str = "prediction", names: dict[int, str] = CLASS_NAMES
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, and both averages.

    A measure without any case behind it is 0. One pass over the predictions.
    """
    truth, guess = F.col(label).cast("int"), F.col(prediction).cast("int")
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(truth == guess).alias("hits")]
    for k in names:
        counts += [
            F.count_if((truth == k) & (guess == k)).alias(f"tp{k}"),
            F.count_if(truth == k).alias(f"true{k}"),
            F.count_if(guess == k).alias(f"guess{k}"),
        ]
    totals = predictions.agg(*counts)

    rows, per_class = [], []
    for k, name in names.items():
        tp, true, guessed = F.col(f"tp{k}"), F.col(f"true{k}"), F.col(f"guess{k}")
        values = (_ratio(tp, guessed), _ratio(tp, true), _ratio(2 * tp, true + guessed), true)
        per_class.append(values)
        rows.append(_row(name, *values))
    accuracy = _ratio(F.col("hits"), F.col("n"))
    rows.append(_row("accuracy", accuracy, accuracy, accuracy, F.col("n")))
    for title in ("macro avg", "weighted avg"):
        weights = [F.lit(1) if title == "macro avg" else v[3] for v in per_class]
        total = F.lit(len(per_class)) if title == "macro avg" else F.col("n")
        means = [_ratio(sum(w * v[i] for w, v in zip(weights, per_class)), total) for i in range(3)]
        rows.append(_row(title, *means, F.col("n")))
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
    return F.struct(
        F.lit(name).alias("classe"),
        precision.cast("double").alias("precision"),
        recall.cast("double").alias("recall"),
        f1.cast("double").alias("f1_score"),
        support.cast("long").alias("support"),
    )


def regression_metrics(predictions: DataFrame, label: str = "RUL", prediction: str = "prediction") -> DataFrame:
    """Mean absolute error and coefficient of determination, in one pass.

    With a constant label R² is 1 for exact predictions and 0 otherwise.
    """
    y, p = F.col(label), F.col(prediction)
    sums = predictions.agg(
        F.avg(F.abs(y - p)).alias("mae"),
        F.sum((y - p) * (y - p)).alias("residual"),
        (F.var_pop(y) * F.count(y)).alias("spread"),
    )
    r2 = F.when(F.col("spread") > 0, 1 - F.col("residual") / F.col("spread")).when(F.col("residual") == 0, 1.0)
    return sums.select("mae", r2.otherwise(F.when(F.col("spread").isNotNull(), 0.0)).alias("r2"))
