"""Jobs that read tables, build one result and write it.

    python -m paragem.jobs calendar TEXT OUT      pairs of date and type as a calendar file
    python -m paragem.jobs features STOPS OUT     features of the remaining life
    python -m paragem.jobs risk STOPS OUT         breakdown model, with its report beside it
    python -m paragem.jobs life FEATURES OUT      remaining-life model, with its figures beside it

STOPS and FEATURES are stored tables; OUT is a new folder.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from paragem.models import remaining_life, risk
from paragem.models.store import save_model
from paragem.operators import rul
from paragem.session import build_session, staging
from paragem.sources import tables


def calendar(spark: SparkSession, text: str, out: str) -> None:
    tables.write_calendar_csv(tables.require_rows(tables.calendar_from_text(spark.read.text(text))), out)


def features(spark: SparkSession, stops: str, out: str) -> None:
    tables.write_features(rul.rul_features(tables.read_stops(spark, stops)), out)


def train_risk(spark: SparkSession, stops: str, out: str, **options) -> None:
    fitted = risk.train(tables.read_stops(spark, stops), **options)
    save_model(fitted.model, f"{out}/model")
    fitted.report.write.csv(f"{out}/report", header=True)


def train_life(spark: SparkSession, table: str, out: str, **options) -> None:
    fitted = remaining_life.train(tables.read_features(spark, table), **options)
    save_model(fitted.model, f"{out}/model")
    fitted.metrics.write.csv(f"{out}/metrics", header=True)


JOBS = {"calendar": calendar, "features": features, "risk": train_risk, "life": train_life}


def main(arguments: list[str]) -> None:
    if len(arguments) != 3 or arguments[0] not in JOBS:
        sys.exit(__doc__)
    spark = build_session(f"paragem-{arguments[0]}")
    with staging(spark):
        JOBS[arguments[0]](spark, *arguments[1:])
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
