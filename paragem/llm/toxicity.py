"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(cut[k] - w x): one weight vector for all grades and ordered cuts
between them. The labels only say toxic or not, so a toxic sample is graded by how
many of its words lean to the toxic class, in thirds of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragem.llm.tables import LOWER_BYTES, is_held_out, lowest

GRADES = 4
#: Slots for hashed features; lengths of word beginnings that are features beside the word.
SLOTS, BEGINNINGS = 1 << 18, (4, 5, 6)
#: Bounds of the fit: texts per label, bytes that a sampled text may have.
SAMPLE, SAMPLE_BYTES = 2000, 20_000
#: A feature is used if this share of the sampled toxic texts, and two of them, have it and its log odds reach LEAN.
LEAST_SHARE, LEAST_TEXTS, LEAN = 0.004, 2, 2.5
#: The penalty on the squared weights counts as much beside any number of texts.
STEPS, RATE, RIDGE = 400, 0.2, 0.4
#: All bytes but letters, digits and what is not ASCII become spaces.
WORD_BYTES = bytes(
    c if 48 <= (c := LOWER_BYTES[b]) <= 57 or 97 <= c <= 122 or c >= 128 else 32 for b in range(256)
)


def features(text: str | None) -> list[int]:
    """Distinct slots of a text's words and of their beginnings."""
    words = set((text or "").encode().translate(WORD_BYTES).split())
    parts = words.union(*({w[:n] + b"*" for w in words if len(w) > n} for n in BEGINNINGS))
    digest = xxhash.xxh3_64_intdigest
    return list({digest(p) % SLOTS for p in parts})


@dataclass(frozen=True)
class SeverityModel:
    """Weight of each used slot, and the cuts between grades in ascending order."""

    weights: dict[int, float]
    cuts: tuple[float, ...]

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each cut."""
        total = sum(self.weights.get(slot, 0.0) for slot in features(text))
        return 1 / (1 + np.exp(np.clip(np.array(self.cuts) - total, -50, 50)))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` (toxic, text) rows per label, those whose id has the least hash.

    Rows of the held-out fifth and texts that are null, empty or of more than SAMPLE_BYTES
    bytes are left out; of ids with several labels the largest counts.
    """
    own = labels.filter(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("toxic"))
    short = docs.filter(F.octet_length("text").between(1, SAMPLE_BYTES)).select(F.col("doc_id").alias("labelled"))
    known = own.join(short.distinct(), "labelled").withColumn("h", F.xxhash64("labelled"))
    picked = lowest(known, "toxic", "h", sample).drop("h")
    texts = docs.filter(F.octet_length("text").between(1, SAMPLE_BYTES)).select(F.col("doc_id").alias("labelled"), "text")
    # at most ``sample`` rows per label
    return texts.join(F.broadcast(picked), "labelled").groupBy("labelled", "toxic").agg(F.min("text").alias("text"))


def ordinal_fit(
    rows: np.ndarray, slots: np.ndarray, grades: np.ndarray, n_slots: int, steps: int = STEPS
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of greatest likelihood; ``rows`` and ``slots`` are the ones of a 0/1 matrix."""
    levels = int(grades.max())
    weights, scale_w = np.zeros(n_slots), np.full(n_slots, 1e-8)
    shares = np.array([(grades <= k).mean() for k in range(levels)]).clip(1e-6, 1 - 1e-6)
    first = np.log(shares / (1 - shares))
    # ordered by construction: the first cut, then the logarithms of the gaps
    free = np.concatenate(([first[0]], np.log(np.maximum(np.diff(first), 1e-3))))
    scale_f = np.full(levels, 1e-8)
    for _ in range(steps):
        cuts = np.cumsum(np.concatenate(([free[0]], np.exp(free[1:]))))
        total = np.bincount(rows, weights[slots], len(grades))
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        upper, lower = edges[grades + 1] - total, edges[grades] - total
        below_up, below_low = 1 / (1 + np.exp(-upper.clip(-50, 50))), 1 / (1 + np.exp(-lower.clip(-50, 50)))
        inside = np.maximum(below_up - below_low, 1e-12)
        slope_up, slope_low = below_up * (1 - below_up) / inside, below_low * (1 - below_low) / inside
        by_row = (slope_up - slope_low) / len(grades)
        grad_w = np.bincount(slots, by_row[rows], n_slots) + RIDGE / len(grades) * weights
        by_cut = np.array(
            [slope_low[grades == k + 1].sum() - slope_up[grades == k].sum() for k in range(levels)]
        ) / len(grades)
        onward = np.cumsum(by_cut[::-1])[::-1]
        grad_f = np.concatenate(([onward[0]], onward[1:] * np.exp(free[1:])))
        scale_w += grad_w**2
        scale_f += grad_f**2
        weights -= RATE * grad_w / np.sqrt(scale_w)
        free -= RATE * grad_f / np.sqrt(scale_f)
    return weights, np.cumsum(np.concatenate(([free[0]], np.exp(free[1:]))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> SeverityModel | None:
    """Learn from a bounded sample, on the driver; None without both labels in it."""
    counts = dict(labels.filter(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect())
    sampled = sorted(map(tuple, training_rows(docs, labels, sample).select("labelled", "toxic", "text").collect()))
    toxic = np.array([t for _, t, _ in sampled], dtype=np.int64)
    if len(set(toxic.tolist())) < 2:
        return None
    held = [features(text) for *_, text in sampled]
    rows = np.repeat(np.arange(len(held)), [len(h) for h in held])
    slots = np.concatenate([np.array(h, np.int64) for h in held])
    with_toxic = np.bincount(slots, toxic[rows], SLOTS)
    with_clean = np.bincount(slots, 1 - toxic[rows], SLOTS)
    n_toxic, n_clean = toxic.sum(), (1 - toxic).sum()
    odds = np.log((with_toxic + 0.5) / (n_toxic + 1)) - np.log((with_clean + 0.5) / (n_clean + 1))
    least = max(LEAST_TEXTS, int(np.ceil(LEAST_SHARE * n_toxic)))
    used = np.flatnonzero((with_toxic >= least) & (odds >= LEAN))
    place = np.full(SLOTS, -1)
    place[used] = np.arange(len(used))
    hit = place[slots] >= 0
    rows, slots = rows[hit], place[slots[hit]]
    leaning = np.bincount(rows, minlength=len(held))
    cuts = np.quantile(leaning[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + (leaning > cuts[0]) + (leaning > cuts[1]), 0).astype(np.int64)
    weights, between = ordinal_fit(rows, slots, grades, len(used))
    # the sample has more of the rarer label than all labels have; the cuts move by the ratio of the odds
    between += np.log(counts[0] / counts[1]) - np.log(n_clean / n_toxic)
    return SeverityModel({int(s): float(w) for s, w in zip(used, weights, strict=True)}, tuple(map(float, between)))


def severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, toxic, grade, severity.

    ``severity`` is the expected grade, ``grade`` the largest that is reached with a
    probability of one half, and ``toxic`` says that this is not 0. All depend on the whole
    text alone; null and empty texts have no features. Without a sample of both labels
    every row is clean with severity 0. Repeated rows come back once each, ids may be null;
    an empty table gives an empty result.
    """
    model = fit(docs, labels)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return known.select(
            "doc_id", F.lit(False).alias("toxic"), F.lit(0).alias("grade"), F.lit(0.0).alias("severity")
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the slots

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            above = np.array([shared.value.above(text) for text in batch["text"]]).reshape(len(batch), -1)
            reached = (above >= 0.5).sum(axis=1)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "toxic": reached > 0,
                    "grade": reached,
                    "severity": above.sum(axis=1),
                }
            )

    return known.mapInPandas(grade, "doc_id long, toxic boolean, grade int, severity double")
