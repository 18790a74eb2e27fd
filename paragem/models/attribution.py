"""Which features make the riskiest component risky.

Exact interventional Shapley values on the probability scale. A coalition is a set
of features taken from the explained component, the others from a background
component; its worth is the mean probability over all background components.
"""

from __future__ import annotations

from math import factorial

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragem.models.risk import FEATURES, RISK, highest_risk, probability


def explain_highest_risk(model: PipelineModel, scored: DataFrame, top: int = 10) -> DataFrame:
    """Value, Shapley value, mean and final probability per feature, strongest first."""
    explained = highest_risk(scored).head()
    if explained is None:
        return scored.sparkSession.createDataFrame([], _SCHEMA)
    return explain(model, scored, explained.asDict(), top)


_SCHEMA = "feature string, valor string, contribuicao double, base double, previsao double"


def explain(model: PipelineModel, background: DataFrame, component: dict, top: int = 10) -> DataFrame:
    """Each background component is scored once per coalition, all in one job.

    Coalitions are coded as bits over ``FEATURES``; their number depends on the
    features only (32), not on the data.
    """
    n = len(FEATURES)
    coalition = F.explode(F.sequence(F.lit(0), F.lit(2**n - 1))).alias("coalition")
    mixed = background.select(*FEATURES, coalition)
    for i, c in enumerate(FEATURES):
        chosen = F.col("coalition").bitwiseAND(F.lit(1 << i)) != 0
        mixed = mixed.withColumn(c, F.when(chosen, F.lit(component[c])).otherwise(F.col(c)))
    worth = probability(model, mixed).groupBy("coalition").agg(F.avg(RISK).alias("worth"))

    size = F.bit_count("coalition")
    sums = [
        F.sum(F.when(F.col("coalition") == 0, F.col("worth"))).alias("base"),
        F.sum(F.when(F.col("coalition") == 2**n - 1, F.col("worth"))).alias("previsao"),
    ]
    for i in range(n):
        joined = F.col("coalition").bitwiseAND(F.lit(1 << i)) != 0
        weight = F.when(joined, _weight(size - 1, n)).otherwise(-_weight(size, n))
        sums.append(F.sum(F.col("worth") * weight).alias(f"value{i}"))
    totals = worth.agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(component[c]).cast("string").alias("valor"),
                F.col(f"value{i}").alias("contribuicao"),
                F.col("base"),
                F.col("previsao"),
            )
            for i, c in enumerate(FEATURES)
        ]
    )
    out = totals.select(F.explode(rows).alias("r")).select("r.*")
    return out.orderBy(F.desc(F.abs("contribuicao")), "feature").limit(top)


def _weight(size, n: int):
    """Share of the feature orders in which a coalition of this size comes first."""
    out = F.lit(0.0)
    for k in range(n):
        out = F.when(size == k, F.lit(factorial(k) * factorial(n - k - 1) / factorial(n))).otherwise(out)
    return out
