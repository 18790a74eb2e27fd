"""Display texts of the indicator cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragem.functions import labels
from paragem.operators import kpis


def reliability_cards(stops: DataFrame) -> DataFrame:
    """One row: mean MTBF and MTTR with two decimals, and all failures."""
    means = kpis.reliability_kpis(stops).select(
        labels.two_decimals(F.col("mtbf_minutos")).alias("mtbf"), labels.two_decimals(F.col("mttr_minutos")).alias("mttr")
    )
    total = kpis.failures_total(stops).select(F.col("total_falhas").cast("string").alias("total_falhas"))
    return beside(means, total)


def ope_cards(production: DataFrame) -> DataFrame:
    """One row: mean loss in whole pieces, OPE, mean production; best and worst line with their OPE, null without lines."""
    means = kpis.production_means(production).select(
        labels.thousands(F.col("perda_media")).alias("perda_media"),
        labels.two_decimals(F.col("producao_media")).alias("producao_media"),
    )
    ope = kpis.ope_kpis(production).select(whole_percent("ope").alias("ope"))
    highlights = kpis.best_and_worst_line(production)
    lines = highlights.agg(
        *[
            F.max(F.when(F.col("Destaque") == title, value)).alias(name)
            for title, name in (("MELHOR LINHA", "melhor"), ("PIOR LINHA", "pior"))
            for value, name in (
                (F.concat("Destaque", F.lit(": "), "LineDesc"), f"{name}_linha"),
                (whole_percent("ope"), f"{name}_ope"),
            )
        ]
    )
    return beside(beside(means, ope), lines)


def whole_percent(column: str):
    """A number that is a percentage already."""
    return F.format_string("%.2f%%", F.col(column).cast("double"))


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two tables of one row each as one row."""
    key = F.lit(1).alias("_one")
    return left.select(key, "*").join(right.select(key, "*"), "_one").drop("_one")
