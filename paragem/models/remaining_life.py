"""Remaining-useful-life regressor and the report of coming critical failures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragem import schemas as S
from paragem.functions import labels, time
from paragem.operators.metrics import regression_metrics
from paragem.operators.rul import latest_per_component
from paragem.operators.sampling import exact_split

#: Least partitions of the training rows, and rows of a partition beyond that.
PARTITIONS, PART_ROWS = 8, 1 << 18
#: Days are learned from in steps of this fraction (21 s), so that sums do not depend on the order of addition.
DAY_STEP = 2.0**-12

COMPONENT = "Componente em Risco"
DAYS = "Previsão (dias a partir de hoje)"
FAILURE_DAY = "Data Estimada da Falha Crítica"
BASED_ON = "Baseado em Dados de"


@dataclass
class RulTraining:
    model: PipelineModel
    metrics: DataFrame
    test: DataFrame


def train(features: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42) -> RulTraining:
    """Fit a random forest on 80 % of the feature rows and measure it on the rest.

    ``features`` is read many times; pass a stored table. The model does not depend on the
    cluster: rows are placed by their content.
    """
    training, test = exact_split(as_numbers(features), ["ElementDesc", "StartTime"], None, 0.2, seed)
    training = placed(training)
    assembler = VectorAssembler(inputCols=S.RUL_MODEL_COLUMNS, outputCol="features")
    forest = RandomForestRegressor(
        labelCol="RUL", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed
    )
    model = Pipeline(stages=[assembler, forest]).fit(training)
    return RulTraining(model, regression_metrics(model.transform(test)), test)


def placed(training: DataFrame) -> DataFrame:
    """``training`` in partitions and an order that follow from its rows alone."""
    parts = max(PARTITIONS, -(-training.count() // PART_ROWS))
    keys = ["ElementDesc", "StartTime", *S.RUL_MODEL_COLUMNS, "RUL"]
    days = F.round(F.col("RUL").cast("double") / DAY_STEP) * DAY_STEP
    rows = training.select(*keys[:-1], days.alias("RUL"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys)


def as_numbers(features: DataFrame) -> DataFrame:
    return features.withColumns({c: F.col(c).cast("double") for c in S.RUL_MODEL_COLUMNS})


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Latest row of each component with its predicted days, ``RUL_Previsto``."""
    latest = as_numbers(latest_per_component(features))
    scored = model.transform(latest)
    return scored.select(*latest.columns, F.col("prediction").alias("RUL_Previsto"))


def failure_report(predicted: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Coming critical failures, the nearest first; past ones are left out.

    ``as_of`` is the day the count starts from, today unless given.
    """
    as_of = F.current_date() if as_of is None else as_of
    status_day = F.to_date("StartTime")
    failure_day = time.add_whole_days(status_day, F.col("RUL_Previsto"))
    report = predicted.select(
        F.col("ElementDesc").alias(COMPONENT),
        time.days_until(failure_day, as_of).alias(DAYS),
        failure_day.alias(FAILURE_DAY),
        status_day.alias(BASED_ON),
    )
    return report.filter(F.col(DAYS) >= 0).orderBy(DAYS, COMPONENT)


def rul_report(model: PipelineModel, features: DataFrame, as_of: Column | None = None) -> DataFrame:
    return failure_report(predict(model, features), as_of)


def presentation(report: DataFrame) -> DataFrame:
    """The report as display texts."""
    return report.select(
        COMPONENT,
        F.format_string("%d", DAYS).alias(DAYS),
        labels.day_text(F.col(FAILURE_DAY)).alias(FAILURE_DAY),
        labels.day_text(F.col(BASED_ON)).alias(BASED_ON),
    )
