import random
from collections import Counter

import pytest
from corpus import documents, with_clashing_columns
from pyspark.sql import functions as F

from paragem.llm import mixing as M

DOMAINS = {"a": "web", "b": "web", "c": "code"}


def docs(spark):
    rows = [(i, "w " * (1 + i % 9), "en", "a") for i in range(300)]
    rows += [(1000 + i, "w " * 5, "de", "b") for i in range(60)] + [(2000 + i, "w " * 4, "en", "c") for i in range(40)]
    return documents(spark, *rows)


def filled(budget: float, children: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Divide ``budget`` among children {name: (weight, capacity)} by weight, passing on what a child cannot hold.

    Children of weight 0 only get what the others cannot hold, in proportion to their capacity.
    """
    got = dict.fromkeys(children, 0.0)
    for weighted in (True, False):
        taking = {n: w if weighted else c for n, (w, c) in children.items() if (w > 0) == weighted and c > 0}
        while taking and budget > 1e-9:
            total = sum(taking.values())
            full = [n for n, w in taking.items() if budget * w / total >= children[n][1]]
            if not full:
                return got | {n: budget * w / total for n, w in taking.items()}
            for n in full:
                got[n] = children[n][1]
                budget -= got[n]
                del taking[n]
    return got


def leaf_budgets(leaves: dict[tuple[str, ...], int], mix) -> dict[tuple[str, ...], float]:
    """Tokens that each leaf has to give; ``leaves`` has the tokens of each path."""
    capacity: dict[tuple[str, ...], float] = {(): 0.0}
    below: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    for path, tokens in leaves.items():
        for depth in range(len(path) + 1):
            capacity[path[:depth]] = capacity.get(path[:depth], 0.0) + tokens * mix.max_epochs
        for depth in range(len(path)):
            below.setdefault(path[:depth], set()).add(path[: depth + 1])
    budgets = {(): min(mix.share * sum(leaves.values()), capacity[()])}
    for depth in range(len(M.LEVELS)):
        for path in [p for p in budgets if len(p) == depth]:
            children = {"/".join(p): p for p in sorted(below.get(path, ()))}
            room = {n: (float(mix.weights.get(n, 1.0)), capacity[p]) for n, p in children.items()}
            budgets |= {children[n]: b for n, b in filled(budgets[path], room).items()}
    return {p: b for p, b in budgets.items() if len(p) == len(M.LEVELS)}


def test_filling_passes_on_what_a_child_cannot_hold():
    assert filled(100, {"a": (1, 10), "b": (1, 1000), "c": (2, 1000)}) == {"a": 10, "b": 30, "c": 60}
    assert filled(100, {"a": (1, 10), "b": (1, 20)}) == {"a": 10, "b": 20}
    assert filled(50, {"a": (0, 100), "b": (1, 20)}) == {"a": 30, "b": 20}
    assert filled(5, {}) == {}


def test_siblings_take_a_shortage_before_the_parents_siblings():
    leaves = {("web", "en", "a"): 1000, ("web", "en", "b"): 10, ("code", "en", "c"): 1000}
    budgets = leaf_budgets(leaves, M.Mix(share=0.5, max_epochs=1))
    assert budgets[("web", "en", "b")] == 10
    assert budgets[("web", "en", "a")] == pytest.approx(502.5 - 10)
    assert budgets[("code", "en", "c")] == pytest.approx(502.5)
    few = leaf_budgets({**leaves, ("web", "en", "a"): 100}, M.Mix(share=0.5, max_epochs=1))
    assert few[("web", "en", "a")] == 100 and few[("code", "en", "c")] == pytest.approx(555 - 110)


@pytest.mark.parametrize("share", [0.2, 0.9, 1.7])
def test_each_leaf_gets_the_shortest_prefix_of_its_epochs(spark, monkeypatch, share):
    monkeypatch.setattr(M, "STEP_ROWS", 16)
    mix = M.Mix(share=share, max_epochs=2, seed=4, domains=DOMAINS, weights={"web": 2.0})
    table = docs(spark)
    tokens = {r.doc_id: len(r.text.split()) for r in table.collect()}
    leaf = {r.doc_id: (DOMAINS[r.source], r.lang, r.source) for r in table.collect()}
    held = Counter()
    for i, n in tokens.items():
        held[leaf[i]] += n
    budgets = leaf_budgets(dict(held), mix)
    drawn = M.draws(table, mix).collect()
    assert len({(r.doc_id, r.epoch) for r in drawn}) == len(drawn)
    for path, budget in budgets.items():
        own = [r for r in drawn if (r.domain, r.lang, r.source) == path]
        total = sum(r.tokens for r in own)
        assert budget - 1e-6 <= total < budget + 10
        whole = int(budget // held[path])
        for epoch in range(1, whole + 1):
            assert sum(r.epoch == epoch for r in own) == sum(p == path for p in leaf.values())
        assert all(r.epoch <= whole + 1 for r in own)


def test_prefixes_against_plain_python(spark, monkeypatch):
    """Budgets worked out by hand, rows of each leaf laid out one by one in the order of their epoch."""
    monkeypatch.setattr(M, "STEP_ROWS", 8)
    mix = M.Mix(share=0.9, max_epochs=2, seed=11, domains=DOMAINS, weights={"web": 3.0})
    table = docs(spark)
    # 300 rows of 1 to 9 words (1 491 in all), 300 words and 160 words; 0.9 of 1 951 are 1 755.9.
    # code gets a quarter but holds 160 * 2, web the other 1 435.9, of which de and en half each; de holds 300 * 2.
    budgets = {"c": 320.0, "b": 600.0, "a": 0.9 * 1951 - 320 - 600}
    rows = table.collect()
    assert sum(len(r.text.split()) for r in rows if r.source == "a") == 1491
    hashes = table.withColumn("epoch", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "doc_id", "epoch", F.xxhash64(F.lit(11), "epoch", "doc_id", F.xxhash64("text")).alias("h")
    )
    place = {(r.doc_id, r.epoch): r.h & (1 << 64) - 1 for r in hashes.collect()}
    want = set()
    for source, budget in budgets.items():
        taken = 0
        for epoch in (1, 2):
            own = [r for r in rows if r.source == source]
            for r in sorted(own, key=lambda r: place[r.doc_id, epoch]):
                if taken < budget - 1e-9:
                    want.add((r.doc_id, epoch))
                    taken += len(r.text.split())
    got = [(r.doc_id, r.epoch) for r in M.draws(table, mix).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_same_seed_same_rows_another_seed_others(spark):
    table, draw = docs(spark), lambda d, s: {(r.doc_id, r.epoch) for r in M.draws(d, M.Mix(0.3, seed=s)).collect()}
    assert draw(table, 1) == draw(table.repartition(7), 1) != draw(table, 2)


def test_stage_repeats_rows_and_keeps_columns(spark):
    table = with_clashing_columns(documents(spark, (1, "a b", "en", "x"), (1, "a b", "en", "x"), (2, "c d", None, None)))
    out = M.mixed(table, M.Mix(share=2.0, max_epochs=2))
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 1, 1, 1, 2, 2]


def test_no_words_and_no_rows(spark):
    assert M.draws(documents(spark, None, "", " ")).collect() == []
    assert M.mixed(documents(spark, "a").filter("doc_id > 0")).collect() == []


def test_budgets_in_spark_equal_the_plain_ones(spark):
    """Trees of random weights and sizes, with weights of 0, leaves without words, and many sources."""
    rng = random.Random(8)
    for round_ in range(6):
        names = [f"s{i}" for i in range(rng.choice([1, 4, 400]))]
        leaves = {
            (f"d{rng.randrange(4)}", rng.choice(["en", "de", "none"]), s): rng.choice([0, 1, rng.randrange(10**6)])
            for s in names
            for _ in range(2)
        }
        weights = {"d0": 3.0, "d1": 0.0, "d2/en": 0.5, "d2/de": 0.0}
        weights |= {"/".join(p): rng.choice([0.0, 0.1, 2.0, 9.0]) for p in list(leaves)[::3]}
        mix = M.Mix(share=rng.choice([0.1, 0.7, 1.3, 5.0]), max_epochs=2, weights=weights if round_ else {})
        table = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "domain string, lang string, source string, tokens long")
        got = {(r.domain, r.lang, r.source): r.budget for r in M.leaf_budgets(table, mix).collect()}
        want = leaf_budgets(leaves, mix)
        assert got.keys() == leaves.keys()
        assert all(got[p] == pytest.approx(want.get(p, 0.0), rel=1e-9, abs=1e-6) for p in leaves)
        total = sum(leaves.values())
        assert sum(got.values()) == pytest.approx(min(mix.share * total, 2 * total))


def test_rows_of_one_id_and_text_are_drawn_with_their_own_leaf(spark):
    table = documents(spark, (1, "a b", "en", "a"), (1, "a b", "en", "c"), (2, "e f", "en", "a"))
    mix = M.Mix(share=4 / 6, max_epochs=1, domains=DOMAINS, weights={"code": 0.0})
    out = M.mixed(table, mix).collect()
    assert sorted((r.doc_id, r.source) for r in out) == [(1, "a"), (2, "a")]


def test_budgets_need_no_cross_join(spark):
    table = spark.createDataFrame([("d", "en", "a", 3), ("e", "de", "b", 5)], "domain string, lang string, source string, tokens long")
    plan = M.leaf_budgets(table, M.Mix())._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
