"""Language identification with string kernels.

Two texts are compared by the blended-spectrum presence kernel: the number of
hashed character n-grams (of 1 to ``LONGEST`` bytes) present in both, divided by the
geometric mean of their own numbers. Landmark texts give Nystroem features, ridge
regression one weight vector per language against the rest. Both are folded into one
matrix, so that a batch of texts is scored by two matrix products. A long text is scored
in parts no longer than the texts learned from, and their values are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragem.llm.tables import LOWER_BYTES, is_held_out, lowest

LONGEST = 4
#: Slots for hashed n-grams; texts per batch of products.
SLOTS, BATCH = 1 << 13, 256
#: Bytes of a long text looked at together; n-grams across the border count.
SEGMENT = 1 << 20
#: Bounds of the fit: sampled texts and landmarks per language, bytes that a sampled text may have.
SAMPLE, LANDMARKS, SAMPLE_BYTES = 400, 48, 20_000
#: The same over all languages together: with more of them each gets fewer, one at least.
ALL_SAMPLED, ALL_LANDMARKS = 8_000, 960
#: Bytes of a text scored together. The slots fill up in more than that.
PART = SAMPLE_BYTES
RIDGE = 1e-3
UNKNOWN = "und"
#: Least score of a text whose language counts as recognised; below it no language is near.
MIN_SCORE = 0.2


def presence(texts: list[bytes]) -> np.ndarray:
    """One row of 0 and 1 per text: which slots its n-grams, lower-cased in A-Z, fall into."""
    rows = np.zeros((len(texts), SLOTS), np.float32)
    for row, text in zip(rows, texts, strict=True):
        for at in range(0, len(text), SEGMENT):
            segment = text[at : at + SEGMENT + LONGEST - 1].translate(LOWER_BYTES)
            letters = np.frombuffer(segment, np.uint8).astype(np.uint32)
            key = np.zeros(len(letters), np.uint32)
            for n in range(1, min(LONGEST, len(letters)) + 1):
                key = key[: len(letters) - n + 1] * np.uint32(257) + letters[n - 1 :] + np.uint32(1)
                mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                row[(mixed ^ (mixed >> np.uint32(12))) % np.uint32(SLOTS)] = 1
    return rows


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows divided by the root of their n-gram number, so that products are kernel values."""
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


def parts(text: bytes) -> Iterator[tuple[bytes, float]]:
    """Equal parts of PART bytes at most and their shares of the text; n-grams across the border count."""
    wide = max(1, -(-len(text) // max(1, -(-len(text) // PART))))
    for at in range(0, max(1, len(text)), wide):
        yield text[at : at + wide + LONGEST - 1], min(wide, len(text) - at) / len(text) if text else 1.0


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: slots x landmarks, landmarks x languages
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One regression value per text and language, near 1 for its own and 0 for others.

        That of a long text is the mean over its parts.
        """
        values = np.zeros((len(texts), len(self.languages)))
        every = ((i, *part) for i, text in enumerate(texts) for part in parts(text))
        for batch in batched(every, BATCH):
            own, pieces, share = zip(*batch, strict=True)
            scored = scaled(presence(list(pieces))) @ self.landmarks @ self.weights
            np.add.at(values, list(own), scored * np.array(share)[:, None])
        return values


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` learnable (lang, text) rows per language, those whose id has the least hash.

    Learnable are rows outside the held-out fifth with a lang and a text that is not
    empty. A text of more than ``SAMPLE_BYTES`` bytes stands for itself with as many
    characters as are sure to fit, from a place that the hash names.
    """
    fit = docs.filter(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    fit = fit.filter(F.octet_length("text") > 0)
    marked = fit.select("lang", F.xxhash64("doc_id", F.octet_length("text")).alias("h"), "text")
    # at most ``sample`` rows per language
    picked = lowest(marked.select("lang", "h").distinct(), "lang", "h", sample)
    wide = SAMPLE_BYTES // 4
    start = F.pmod("h", F.greatest(F.char_length("text") - wide, F.lit(0)) + 1) + 1
    excerpt = F.col("text").substr(start.cast("int"), F.lit(wide))
    text = F.when(F.octet_length("text") <= SAMPLE_BYTES, F.col("text")).otherwise(excerpt)
    rows = marked.join(F.broadcast(picked), ["lang", "h"]).withColumn("text", text)
    return rows.groupBy("lang", "h").agg(F.min("text").alias("text")).drop("h")


def shared_out(bound: int, most: int, languages: int) -> int:
    """How many of ``bound`` each language gets: ``most`` at most, one at least."""
    return max(1, min(most, bound // max(1, languages)))


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel | None:
    """Learn from a bounded sample, on the driver; None if no row can be learned from."""
    languages = docs.agg(F.count_distinct("lang")).head()[0]
    rows = sorted(map(tuple, training_rows(docs, shared_out(ALL_SAMPLED, sample, languages)).collect()))
    return learned(rows, shared_out(ALL_LANDMARKS, landmarks, languages), ridge) if rows else None


def learned(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """The model of sorted (lang, text) rows."""
    languages = tuple(sorted({lang for lang, _ in rows}))
    texts = [text.encode() for _, text in rows]
    named = np.array([languages.index(lang) for lang, _ in rows])
    # spread over the sorted sample of each language
    chosen = [
        own[np.linspace(0, len(own) - 1, min(landmarks, len(own))).astype(int)]
        for own in (np.flatnonzero(named == k) for k in range(len(languages)))
    ]
    marks = scaled(presence([texts[i] for i in np.concatenate(chosen)])).T
    kernel = np.vstack([scaled(presence(texts[at : at + BATCH])) @ marks for at in range(0, len(texts), BATCH)])
    kernel, among = kernel.astype(np.float64), (marks.T @ marks).astype(np.float64)
    target = (named[:, None] == np.arange(len(languages))).astype(np.float64)
    penalty = ridge * len(texts) * (among + 1e-6 * np.eye(len(among)))
    weights = np.linalg.solve(kernel.T @ kernel + penalty, kernel.T @ target)
    return LanguageModel(languages, np.ascontiguousarray(marks), weights.astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the whole text alone.

    A text that is null, empty or has no letter is ``und`` with score 0, and so is
    every text when there is no model. Equal values go to the language first by name.
    Columns of ``docs`` that bear these names are replaced.
    """
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: slots x landmarks

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        model, best = shared.value, []
        for at in range(0, len(texts), BATCH):
            values = model.scores([(t or "").encode() for t in texts.iloc[at : at + BATCH]])
            first = values.argmax(axis=1)
            best += zip(first.tolist(), values[np.arange(len(first)), first].tolist(), strict=True)
        known = texts.notna()
        names = [model.languages[k] if ok else UNKNOWN for (k, _), ok in zip(best, known, strict=True)]
        scores = [min(1.0, max(0.0, v)) if ok else 0.0 for (_, v), ok in zip(best, known, strict=True)]
        return pd.DataFrame({"lang_pred": names, "score": scores})

    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    guessed = docs.withColumn("lang_pred", guess(lettered))
    return guessed.withColumns({"lang_pred": F.col("lang_pred.lang_pred"), "score": F.col("lang_pred.score")})


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a model learned from the rows that are not held out.

    Repeated rows come back once each. A null doc_id is not held out and not learned
    from. Other columns are not read.
    """
    model = fit(docs)
    known = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(known, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of MIN_SCORE or more, with their columns."""
    row = docs.select(F.struct("*").alias("row"), "text")
    named = predict(row, fit(docs))
    return named.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("row.*")
