"""Licenses in texts: fixed phrases, and an exact set-similarity join with templates, notices or whole licences.

A text is cut into blocks, a new one every half. Blocks for a template have BLOCK words,
doubled until half a block takes the whole template, so that an unchanged copy lies
inside one block wherever it stands. A block matches a template when it holds THRESHOLD
of the template's distinct words. The join orders the template words by how many texts
hold them, rarest first. A block is looked at only if it holds a word of the template's
prefix; it must be long enough, and the words after the first common one must be able to
make up the threshold on both sides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragem.llm.license_texts import PHRASES, TEMPLATES

THRESHOLD = 0.8
#: Words of the shortest blocks.
BLOCK = 32

#: Word signs are digits, a-z after lower-casing A-Z, and all that is not ASCII; every other byte becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def block_words(template: str, block: int = BLOCK) -> int:
    """Words of the blocks that are compared with a template: ``block``, doubled until half of them takes it whole."""
    size = len(words_of(template))
    while block < 2 * size:
        block *= 2
    return block


def needed(size: int, threshold: float) -> int:
    """Fewest words of ``size`` that are ``threshold`` of it."""
    return next(n for n in range(size + 1) if n >= threshold * size - 1e-9)


class TemplateIndex:
    """The templates' words in the order of a frequency table, and the prefixes by word."""

    def __init__(self, templates: Mapping[str, str], texts_with: Mapping[bytes, int], threshold: float):
        names = {name: frozenset(words_of(name)) for name in templates}
        order = sorted(frozenset().union(*names.values()), key=lambda w: (texts_with.get(w, 0), w))
        self.rank = {word: k for k, word in enumerate(order)}
        self.entries, self.prefixes = [], {}
        for name, words in names.items():
            ranked = sorted(words, key=self.rank.__getitem__)
            need = needed(len(ranked), threshold)
            if not ranked or not need:
                continue
            self.entries.append((templates[name], words, ranked, need))
            for place, word in enumerate(ranked[: len(ranked) - need + 1]):
                self.prefixes.setdefault(word, []).append((len(self.entries) - 1, place))

    def matches(self, block: set[bytes]) -> Iterator[tuple[str, float]]:
        """(label, containment) of each template that ``block`` holds enough of."""
        common = sorted((w for w in block if w in self.rank), key=self.rank.__getitem__)
        met = set()
        for at, word in enumerate(common):
            for entry, place in self.prefixes.get(word, ()):
                label, words, ranked, need = self.entries[entry]
                if entry in met or len(block) < need:
                    continue
                met.add(entry)
                # words before this one are not common to both
                if 1 + min(len(ranked) - place - 1, len(common) - at - 1) >= need:
                    held = len(words & block)
                    if held >= need:
                        yield label, held / len(words)


def blocks_with(words: list[bytes], wanted: frozenset[bytes], block: int) -> Iterator[list[bytes]]:
    """The blocks of a text that hold a wanted word; the last begins where words are left."""
    half = block // 2
    starts = set()
    for place, word in enumerate(words):
        if word in wanted:
            starts |= {place // half * half, max(place // half - 1, 0) * half}
    for start in sorted(starts):
        yield words[start : start + block]


def phrase_places(words: list[bytes], phrases: Mapping[str, str]) -> list[tuple[int, str]]:
    """(start, label) of all places where the words of a phrase stand one after the other."""
    found = []
    for phrase, label in phrases.items():
        parts = words_of(phrase)
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                found.append((at, label))
    return found


def texts_with_words(docs: DataFrame, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """How many texts hold each of the wanted words; as many rows as there are wanted words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                total.update(wanted.intersection(words_of(text)))
        yield pd.DataFrame(list(total.items()), columns=["word", "n"])

    counted = docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n"))
    return {bytes(word): n for word, n in counted.collect()}


def scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs`` with its phrases, labels and score.

    Columns: doc_id, n_words, n_base (places of phrases), first_word and last_word (their
    smallest and largest start; null without one), base_labels, labels (of phrases and
    of matching templates; distinct, sorted, comma-joined, empty if there are none) and
    score: 1 with a phrase, else the largest containment of a match, else 0. Templates
    may have any length; ``block`` is the least number of words in a block. A null text
    has no words. Repeated rows come back once each, ids may be null; an empty table gives
    an empty result.
    """
    vocabulary = frozenset(w for t in templates for w in words_of(t))
    texts_with = texts_with_words(docs, vocabulary)  # bounded by the templates
    by_length: dict[int, dict[str, str]] = {}
    for template, label in templates.items():
        by_length.setdefault(block_words(template, block), {})[template] = label
    indexes = {wide: TemplateIndex(own, texts_with, threshold) for wide, own in by_length.items()}
    starts = frozenset(words_of(p)[0] for p in phrases)
    wanted = {wide: frozenset(index.prefixes) for wide, index in indexes.items()}

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                distinct = set(words)
                base = phrase_places(words, phrases) if distinct & starts else []
                matched = []
                for wide, index in indexes.items():
                    if distinct & wanted[wide]:
                        for part in blocks_with(words, wanted[wide], wide):
                            matched += index.matches(set(part))
                places = [at for at, _ in base]
                own, more = {label for _, label in base}, {label for label, _ in matched}
                score = 1.0 if base else max((s for _, s in matched), default=0.0)
                labels = ",".join(sorted(own)), ",".join(sorted(own | more))
                first, last = (min(places), max(places)) if places else (None, None)
                rows.append((doc_id, len(words), len(base), first, last, *labels, score))
            columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            whole = dict.fromkeys(("doc_id", "first_word", "last_word"), "Int64")
            yield pd.DataFrame(rows, columns=columns).astype(whole)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        look,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double",
    )


def scan_sql(
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> str:
    """The same result from ``documents`` in SQL, comparing every block with every template."""
    listed = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    phrase_rows = ", ".join(f"({listed(words_of(p))}, '{label}')" for p, label in phrases.items())
    template_rows = ", ".join(
        f"({listed(sorted(set(words_of(t))))}, '{label}', {needed(len(set(words_of(t))), threshold)}, "
        f"{block_words(t, block)})"
        for t, label in templates.items()
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
phrase(parts, label) AS (VALUES {phrase_rows}),
template(parts, label, need, wide) AS (VALUES {template_rows}),
place AS (
  SELECT r, s - 1 AS pos, label FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS s FROM d) w, phrase
  WHERE words[s] = parts[1] AND words[s : s + len(parts) - 1] = parts),
base AS (
  SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS own
  FROM place GROUP BY r),
blocks AS (
  SELECT r, wide, list_distinct(words[s + 1 : s + wide]) AS held
  FROM (SELECT r, words, wide, unnest(range(0, len(words), wide // 2)) AS s
        FROM d, (SELECT DISTINCT wide FROM template) w)),
matched AS (
  SELECT r, list(DISTINCT label) AS more, max(n_common / len(parts)) AS score
  FROM (SELECT r, label, parts, need, len(list_intersect(held, parts)) AS n_common
        FROM blocks JOIN template USING (wide))
  WHERE n_common >= need GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '')
         AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(score, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN matched USING (r)
"""
