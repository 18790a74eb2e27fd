import random

import numpy as np
from corpus import documents, with_clashing_columns

from paragem.llm import toxicity as T

BAD, GOOD = ["vilia", "grott", "snarp"], ["sol", "luna", "mar", "ventus", "arbor", "via"]


def table(spark, n=500):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(GOOD, k=rng.randrange(5, 40))
        if toxic := int(rng.random() < 0.3):
            words += rng.choices(BAD, k=rng.randrange(1, 4))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_grades(spark):
    rows, labels, label_table = table(spark)
    odd = [(900, None), (901, ""), (902, "sol VILIA, grott! " * 9000), (None, "snarp"), (903, "sol"), (903, "sol")]
    out = T.severity(with_clashing_columns(documents(spark, *rows, *odd)), label_table)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 506
    assert all(got[i].toxic == bool(t) for i, t in labels)
    assert not got[900].toxic and not got[901].toxic and got[902].toxic and got[None].toxic
    assert all(r.toxic == (r.grade > 0) and 0 <= r.severity <= T.GRADES - 1 for r in got.values())
    many = [len(set(text.split()) & set(BAD)) for _, text in rows]
    mean = [np.mean([got[i].severity for i, n in enumerate(many) if n == k]) for k in range(4)]
    assert mean == sorted(mean)


def test_fit_recovers_ordered_grades():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (2000, 3))
    total = x @ np.array([3.0, 1.0, 0.0]) + rng.logistic(size=2000)
    grades = np.digitize(total, [1.0, 3.5])
    rows, slots = np.nonzero(x)
    weights, cuts = T.ordinal_fit(rows, slots, grades, 3, steps=1500)
    assert np.allclose(weights, [3, 1, 0], atol=0.4) and np.allclose(cuts, [1, 3.5], atol=0.4)
    assert (np.diff(cuts) > 0).all()


def test_without_both_labels_all_is_clean(spark):
    docs = documents(spark, "vilia")
    labels = spark.createDataFrame([(0, 1), (0, None), (None, 0)], "doc_id long, toxic int")
    assert [tuple(r) for r in T.severity(docs, labels).collect()] == [(0, False, 0, 0.0)]
    assert T.severity(docs.filter("doc_id > 0"), labels).collect() == []


def few(spark, toxic, clean, good=GOOD, bad=BAD, first=0):
    """(id, text) rows and (id, toxic) labels."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(first, first + toxic + clean):
        words = rng.choices(good, k=rng.randrange(5, 40))
        rows.append((i, " ".join([*words, *(rng.sample(bad, 2) if i < first + toxic else [])])))
        labels.append((i, int(i < first + toxic)))
    return rows, labels


def test_few_labels_are_enough(spark):
    rows, labels = few(spark, 10, 60)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in T.severity(documents(spark, *rows), table).collect()}
    assert got == {i: bool(t) for i, t in labels}


def test_a_rare_language_is_learned(spark):
    rows, labels = few(spark, 100, 600)
    other = few(spark, 5, 60, ["haus", "baum", "wald", "see"], ["blodi", "dumpf", "krassl"], 1000)
    table = spark.createDataFrame(labels + other[1], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in T.severity(documents(spark, *rows, *other[0]), table).collect()}
    assert got == {i: bool(t) for i, t in labels + other[1]}
