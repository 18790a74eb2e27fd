"""All indicator tables of one selection.

The selection is condensed once and stored; each table then aggregates a small
table, so a page costs one pass over the stops and one over the production records.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame

from paragem import schemas as S
from paragem.models import attribution, remaining_life, risk
from paragem.operators import kpis, rul
from paragem.operators.filters import FilterSpec
from paragem.session import stage


@dataclass(frozen=True)
class Dashboard:
    selected_stops: DataFrame
    selected_production: DataFrame

    @classmethod
    def select(
        cls, spec: FilterSpec, grouped_stops: DataFrame, production: DataFrame, calendar: DataFrame
    ) -> Dashboard:
        """Apply the filters; each side is condensed and stored when it is first asked for."""
        return cls(*spec.apply(grouped_stops, production, calendar))

    @cached_property
    def stops(self) -> DataFrame:
        return stage(kpis.condense_stops(self.selected_stops), "dashboard-stops")

    @cached_property
    def production(self) -> DataFrame:
        return stage(kpis.condense_production(self.selected_production), "dashboard-production")

    def reliability(self) -> dict[str, DataFrame]:
        stops = self.stops
        daily = kpis.last_days(kpis.reliability_kpis(stops, kpis.day_key()))
        return {
            "global": kpis.reliability_kpis(stops),
            "diario": daily,
            "total_falhas": kpis.failures_total(stops),
            "falhas_diarias": kpis.last_days(kpis.failures_by_day(stops)),
            "mtbf_por_linha": kpis.lines_by(stops, "mtbf_minutos", "MTBF (minutos)"),
            "mttr_por_linha": kpis.lines_by(stops, "mttr_minutos", "MTTR (minutos)"),
            "mensal": kpis.by_month(kpis.reliability_kpis(stops, kpis.month_key())),
            "semanal": kpis.by_week(kpis.reliability_kpis(stops, kpis.week_key())),
            "mtbf_por_componente": kpis.components_by(stops, "mtbf_minutos", "MTBF", ascending=True),
            "mttr_por_componente": kpis.components_by(stops, "mttr_minutos", "MTTR", ascending=False),
            "top_falhas": kpis.top_alarms_by_count(stops),
            "top_mttr": kpis.top_alarms_by_mttr(stops),
        }

    def efficiency(self) -> dict[str, DataFrame]:
        records = self.production
        day, month, week = (key("EffectiveDate") for key in (kpis.day_key, kpis.month_key, kpis.week_key))
        return {
            "global": kpis.ope_kpis(records),
            "medias": kpis.production_means(records),
            "diario": kpis.last_days(kpis.ope_kpis(records, day)),
            "medias_diarias": kpis.last_days(kpis.production_means(records, day)),
            "mensal": kpis.by_month(kpis.ope_kpis(records, month)),
            "semanal": kpis.by_week(kpis.ope_kpis(records, week)),
            "por_linha": kpis.ope_kpis(records, "LineDesc"),
            "destaques": kpis.best_and_worst_line(records),
        }

    def risk(self, model: PipelineModel, shift: int | str = S.ALL_ROWS) -> dict[str, DataFrame]:
        """The selected components by their risk of a breakdown, and why the first is first."""
        scored = stage(risk.score_components(model, self.selected_stops, shift), "dashboard-risk")
        return {
            "relatorio": risk.presentation(risk.risk_report(scored)),
            "maior_risco": risk.highest_risk(scored),
            "fatores": attribution.explain_highest_risk(model, scored),
        }

    def remaining_life(
        self, model: PipelineModel, features: DataFrame, as_of: Column | None = None
    ) -> dict[str, DataFrame]:
        """Coming critical failures of the selected components."""
        report = remaining_life.rul_report(model, rul.eligible_components(features, self.selected_stops), as_of)
        return {"previsoes": report, "apresentacao": remaining_life.presentation(report)}
