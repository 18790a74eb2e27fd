"""Mixing of sources to target weights, by budgets in a domain-language-source tree.

The token budget goes down the tree by weight. A leaf can use its tokens as often as
``max_epochs``; what it cannot use goes to its siblings by weight, and to the
siblings of its parent only when the whole parent is used up. Each leaf then takes the
shortest prefix of its documents, shuffled by seed and epoch, that fills its budget.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragem.session import stage

LEVELS = ("domain", "lang", "source")
#: Domains that sources without a given one are dealt to.
DOMAINS = 4
#: Documents that share a step of the prefix search; a cut is exact inside one step.
STEP_ROWS = 256


@dataclass(frozen=True)
class Mix:
    """What to mix: ``share`` of all tokens as the budget, weights by path ("web", "web/en", "web/en/src1"; 1 if absent)."""

    share: float = 0.9
    max_epochs: int = 2
    seed: int = 0
    weights: Mapping[str, float] = field(default_factory=dict)
    domains: Mapping[str, str] = field(default_factory=dict)


def domain_of(source: Column, domains: Mapping[str, str]) -> Column:
    """The given domain of a source, else one of DOMAINS by its hash."""
    named = F.concat(F.lit("domain"), F.pmod(F.xxhash64(source), F.lit(DOMAINS)).cast("string"))
    for name, domain in domains.items():
        named = F.when(source == name, F.lit(domain)).otherwise(named)
    return named


def token_count(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def divided(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` with the ``budget`` of their parent divided among them; columns weight, capacity and budget are read.

    Children get the budget by weight. What one cannot hold goes to its siblings by
    weight: in the order of capacity to weight a child is full if the budget left before it
    fills it and, at that rate, all after it. Children of weight 0 only get what the others
    cannot hold, in proportion to their capacity. Siblings meet in one window, read row by
    row.
    """
    weight = F.when(F.col("capacity") > 0, F.col("weight")).otherwise(0.0)
    rows = children.withColumn("weight", weight).withColumn("rate", F.when(weight > 0, F.col("capacity") / weight))
    up = Window.partitionBy(*parent).orderBy(F.col("rate").asc_nulls_last(), name)
    down = Window.partitionBy(*parent).orderBy(F.col("rate").desc_nulls_first(), F.desc(name))
    all_of = Window.partitionBy(*parent)
    rows = rows.withColumns({
        "before": F.coalesce(F.sum("capacity").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(down.rowsBetween(Window.unboundedPreceding, 0)),
    })
    rows = rows.withColumn("full", (F.col("rate") * F.col("open") <= F.col("budget") - F.col("before")) & (weight > 0))
    rows = rows.withColumns({
        "rest": F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(all_of), F.lit(0.0)),
        "open": F.sum(F.when(~F.coalesce("full", F.lit(False)), F.col("weight"))).over(all_of),
        "spare": F.sum(F.when(F.col("weight") == 0, F.col("capacity"))).over(all_of),
    })
    got = (
        F.when(F.col("full"), F.col("capacity"))
        .when(F.col("weight") > 0, F.col("rest") * F.col("weight") / F.col("open"))
        .when(F.coalesce("open", F.lit(0.0)) > 0, 0.0)
        .when((F.col("rest") > 1e-9) & (F.col("spare") > 0),
              F.col("capacity") * F.least(F.lit(1.0), F.col("rest") / F.col("spare")))
        .otherwise(0.0)
    )
    return rows.withColumn("budget", got).drop("rate", "before", "open", "full", "rest", "spare", "weight")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (LEVELS, tokens) with the ``budget`` of each, divided level by level from the top."""
    rows = leaves.withColumn("root", F.lit(0)).withColumn("capacity", F.col("tokens") * F.lit(float(mix.max_epochs)))
    all_of = Window.partitionBy("root")
    known = None
    listed = [F.lit(x) for path, w in mix.weights.items() for x in (path, float(w))]
    for depth, name in enumerate(LEVELS):
        parent = ["root", *LEVELS[:depth]]
        nodes = rows.groupBy(*parent, name).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        path = F.concat_ws("/", *LEVELS[: depth + 1])
        weight = F.coalesce(F.try_element_at(F.create_map(*listed), path), F.lit(1.0)) if listed else F.lit(1.0)
        if known is None:  # the domains share the whole budget
            whole = F.sum("tokens").over(all_of).cast("double") * F.lit(mix.share)
            nodes = nodes.withColumn("budget", F.least(whole, F.sum("capacity").over(all_of)))
        else:
            nodes = nodes.drop("root").join(known, parent[1:]).withColumn("root", F.lit(0))
        nodes = nodes.withColumn("weight", weight)
        known = divided(nodes, parent, name).select(*parent[1:], name, "budget")
    return leaves.join(known, list(LEVELS))


def draws(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per document and epoch in which it is taken.

    Columns: doc_id, text_hash, domain, lang, source, tokens, epoch and copies, the number of
    rows that repeat id, text, lang and source; these are taken together.

    Null lang or source are a leaf of their own, named ``none``. Documents without words
    weigh nothing and come with the prefix they stand in; a leaf of such documents only
    has no budget and gives none. The last document of a prefix may run over the
    budget. An empty table gives an empty result. Nothing is sent to the driver.
    """
    counted = docs.select(
        F.col("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        domain_of(F.coalesce(F.col("source").cast("string"), F.lit("none")), mix.domains).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("none")).alias("source"),
        token_count(F.col("text")).alias("tokens"),
    )
    counted = stage(counted.groupBy(*counted.columns).agg(F.count(F.lit(1)).alias("copies")), "mix-tokens")
    weight = F.col("tokens") * F.col("copies")
    leaves = counted.groupBy(*LEVELS).agg(F.sum(weight).alias("tokens"), F.count(F.lit(1)).alias("rows"))
    times = F.coalesce(F.floor(F.try_divide("budget", "tokens")), F.lit(0)).cast("int")
    goal = leaf_budgets(stage(leaves, "mix-leaves", counted.count()), mix).select(
        *LEVELS, times.alias("times"), (F.col("budget") - times * F.col("tokens")).alias("goal"),
        F.ceil(F.col("rows") / STEP_ROWS).alias("steps"),
    )
    goal = stage(goal, "mix-goals")
    whole = counted.join(goal.filter("times > 0"), list(LEVELS))
    whole = whole.withColumn("epoch", F.explode(F.sequence(F.lit(1), "times")))

    # the order of an epoch is the hash of seed, epoch, id and text; steps are equal ranges of it
    part = counted.join(goal.filter("goal > 0"), list(LEVELS)).withColumn("epoch", F.col("times") + 1)
    part = part.withColumn("order", F.xxhash64(F.lit(mix.seed), "epoch", "doc_id", "text_hash"))
    part = part.withColumn("step", F.floor((F.shiftrightunsigned("order", 1) / F.lit(2.0**63)) * F.col("steps")))
    before = Window.partitionBy(*LEVELS).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy(*LEVELS, "step", "goal").agg(F.sum(weight).alias("own"))
    sums = sums.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0)))
    sums = sums.filter(F.col("before") < F.col("goal")).select(
        *LEVELS, "step", "before", (F.col("before") + F.col("own") >= F.col("goal")).alias("cut")
    )
    near = part.join(sums, [*LEVELS, "step"])
    inside = Window.partitionBy(*LEVELS, "step").orderBy(F.shiftrightunsigned("order", 1), "order")
    ahead = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = near.filter("cut").withColumn("so_far", F.col("before") + ahead)
    names = ["doc_id", "text_hash", *LEVELS, "tokens", "epoch", "copies"]
    return (
        whole.select(names)
        .unionByName(near.filter("not cut").select(names))
        .unionByName(last.filter(F.col("so_far") < F.col("goal")).select(names))
    )


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` once per epoch in which they are drawn, with their columns.

    Rows that repeat id, text, lang and source are drawn together; rows that share id and
    text only are drawn apart, each with its leaf. An empty table gives an empty one.
    """
    # draws has one row per id, text, lang, source and epoch
    times = draws(docs, mix).groupBy("doc_id", "text_hash", "lang", "source").agg(F.count(F.lit(1)).alias("times"))
    times = times.toDF("drawn_id", "hash", "drawn_lang", "drawn_source", "times")
    leaf = [F.coalesce(F.col(k).cast("string"), F.lit("none")).alias(f"own_{k}") for k in ("lang", "source")]
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.xxhash64("text").alias("own_hash"), *leaf)
    same = row["doc_id"].eqNullSafe(times["drawn_id"]) & (row["own_hash"] == times["hash"])
    same &= (row["own_lang"] == times["drawn_lang"]) & (row["own_source"] == times["drawn_source"])
    return row.join(times, same).select(F.explode(F.array_repeat("row", F.col("times").cast("int"))).alias("row")).select("row.*")
