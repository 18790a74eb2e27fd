"""Breakdown classifier: how likely the next stop of a component is a breakdown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, TargetEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragem import schemas as S
from paragem.functions.labels import is_breakdown, percent_text
from paragem.operators.filters import distinct_components
from paragem.operators.grouping import with_stop_ids
from paragem.operators.metrics import classification_report
from paragem.operators.sampling import class_weights, exact_split
from paragem.session import stage

FEATURES = ["LineGroupDesc", "LineDesc", "StationDesc", "ElementDesc", "ShiftId"]
MISSING = "N/A"
RISK = "Probabilidade de Breakdown"
DEFAULT_SHIFT = 1
SHARES = 1024
#: Hash bins that the categories of a feature fall into: what training keeps on the driver does not grow with them.
#: Categories that share a bin are told apart by the other features only.
CATEGORY_BINS = 1 << 14
#: Ordered bins of a feature that a tree chooses its cut from.
TREE_BINS = 64
#: Rows by which the rate of a category is drawn to the mean of all.
SMOOTHING = 4.0
#: Least partitions of the merged training rows, and rows of a partition beyond that.
PARTITIONS, PART_ROWS = 8, 1 << 18
#: Weights are rounded to this fraction, so that their sums do not depend on the order of addition.
WEIGHT_STEP = 2.0**-16


def as_features(df: DataFrame) -> DataFrame:
    """Every feature as a text, blanks as a category of their own."""
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in FEATURES}
    return df.withColumns(texts)


def training_rows(stops: DataFrame) -> DataFrame:
    """Features, target and the id the split goes by."""
    rows = as_features(with_stop_ids(stops))
    target = is_breakdown(F.col("Duration")).cast("int")
    return rows.select(S.STOP_ID.name, *FEATURES, target.alias("Target"))


@dataclass
class RiskTraining:
    model: PipelineModel
    report: DataFrame
    test: DataFrame


def merged_rows(training: DataFrame, shares: int = SHARES) -> DataFrame:
    """Training rows of equal features and target merged into at most ``shares`` weighted rows.

    All features are categories, so very many stops say the same thing. Forests draw
    rows at random: with about a thousand rows left per combination the draw varies
    as good as it would over single stops, and small combinations are hardly merged.
    """
    share = F.pmod(F.xxhash64(F.lit("share"), S.STOP_ID.name), F.lit(shares)).alias("share")
    return training.groupBy(*FEATURES, "Target", share).agg(F.count(F.lit(1)).alias("stops"))


def placed(merged: DataFrame) -> DataFrame:
    """``merged`` in a fixed placement and order.

    A forest draws by partition and row position, and a stored table is read in as many
    partitions as suit the cluster. Dealt anew, the same stops give the same model anywhere.
    """
    keys = [*FEATURES, "Target", "share"]
    parts = max(PARTITIONS, -(-merged.count() // PART_ROWS))
    return merged.repartition(parts, *keys).sortWithinPartitions(*keys).drop("share")


def binned() -> SQLTransformer:
    """Adds the hash bin of each feature's category."""
    bins = [f"CAST(pmod(xxhash64('{c}', {c}), {CATEGORY_BINS}) AS DOUBLE) AS {c}_bin" for c in FEATURES]
    return SQLTransformer(statement=f"SELECT *, {', '.join(bins)} FROM __THIS__")


def encoding(training: DataFrame) -> list:
    """Fitted stages that turn each category into the rate of breakdowns in its bin, unseen ones into the mean rate.

    For two classes the best split of a category's values is a cut in this order, so trees
    need no bin per category.
    """
    bins, rates = [f"{c}_bin" for c in FEATURES], [f"{c}_rate" for c in FEATURES]
    values = [f"{c}_value" for c in FEATURES]
    encoder = TargetEncoder(
        inputCols=bins, outputCols=rates, labelCol="Target", targetType="binary", handleInvalid="keep", smoothing=SMOOTHING
    )
    # The encoder marks its columns as categories; a computed column is a plain number again.
    numbers = ", ".join(f"{rate} + 0D AS {value}" for rate, value in zip(rates, values, strict=True))
    plain = SQLTransformer(statement=f"SELECT *, {numbers} FROM __THIS__")
    assembler = VectorAssembler(inputCols=values, outputCol="features")
    return [binned(), encoder.fit(binned().transform(training)), plain, assembler]


def train(
    stops: DataFrame, trees: int = 100, depth: int = 30, seed: int = 42, shares: int = SHARES
) -> RiskTraining:
    """Fit a balanced random forest on 80 % of the stops and report on the rest.

    The forest reads its rows once per group of tree nodes, so these are merged and
    stored in the shared folder first.
    """
    training, test = exact_split(training_rows(stops), [S.STOP_ID.name], "Target", 0.2, seed)
    merged = stage(merged_rows(training, shares), "risk-training")
    weights = {r["Target"]: r["peso"] for r in class_weights(merged, "Target", "stops").collect()}
    weight = F.round(F.col("stops") * _by_class(weights) / WEIGHT_STEP) * WEIGHT_STEP
    merged = placed(merged).withColumn("weight", weight)
    encoded = encoding(training)
    forest = RandomForestClassifier(
        labelCol="Target",
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        maxBins=TREE_BINS,
        featureSubsetStrategy="sqrt",
        seed=seed,
        cacheNodeIds=True,
    )
    model = PipelineModel([*encoded, forest.fit(PipelineModel(encoded).transform(merged))])
    return RiskTraining(model, classification_report(model.transform(test)), test)


def _by_class(weights: dict[int, float]) -> Column:
    out = F.lit(1.0)
    for label, weight in weights.items():
        out = F.when(F.col("Target") == label, F.lit(weight)).otherwise(out)
    return out


def probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the breakdown probability; unseen categories are scored too."""
    scored = model.transform(rows)
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias(RISK))


def score_components(model: PipelineModel, stops: DataFrame, shift: int | str = S.ALL_ROWS) -> DataFrame:
    """Breakdown probability of every distinct component, all features kept beside it."""
    shift = DEFAULT_SHIFT if shift == S.ALL_ROWS else shift
    components = distinct_components(stops).withColumn("ShiftId", F.lit(shift))
    return probability(model, as_features(components))


def risk_report(scored: DataFrame) -> DataFrame:
    """Components from the highest risk down, blanks shown as blanks."""
    shown = [F.nullif(F.col(c), F.lit(MISSING)).alias(c) for c in ("StationDesc", "ElementDesc")]
    return scored.select(*shown, RISK).orderBy(F.desc(RISK), "StationDesc", "ElementDesc")


def presentation(report: DataFrame) -> DataFrame:
    """The report as display texts, in its order; blanks stay blank."""
    return report.select("StationDesc", "ElementDesc", percent_text(F.col(RISK)).alias(RISK))


def highest_risk(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc(RISK), "StationDesc", "ElementDesc", "LineGroupDesc", "LineDesc").limit(1)
