"""Phrase collocations from count streams that are merged in prefix and in suffix order.

Texts become blocks of word numbers. Counts of one to three words that occur often enough
form a stream. Sorted by first words, each phrase follows its own beginnings; sorted by
last words, it follows its own endings. So one pass in lockstep over either order sets
beside a phrase the counts of all its beginnings, or of all its endings, and shows which
phrases an extension nearly exhausts. Streams are cut into ranges of keys, so no word,
however frequent, has its phrases gathered in one task; what is open where a range begins
is carried over from the ranges before.

What occurs fewer than ``least`` times cannot be part of a phrase that occurs so often.
Such words and phrases are dropped as soon as their counts are whole.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paragem.llm.tables import LOWER, UPPER
from paragem.session import stage

LEAST, TOP, COVERED = 10, 2000, 50
UNKNOWN = "und"
#: Places of a block, to which those of one slice may come: at most 2**20, whose third power fits 64 bits.
BLOCK = 1 << 19
#: Rows of counts handed on at once.
ROWS = 1 << 16
#: Bytes of a text cut into words at once.
SLICE = 1 << 20
#: Places that an open block counts beside its own when blocks are closed to save memory.
OPEN = 1000
#: Bytes that end a piece; "." stands for all of them once texts are folded.
ENDS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(UPPER.encode() + b"\t" + ENDS, LOWER.encode() + b" " + b"." * len(ENDS))
#: The number of an end of a piece among a block's words, and a missing word of a phrase.
END, NONE = 0, -1

BLOCKS = "block string, lang string, context int, words array<string>, counts array<long>, places binary"


def tokens(text: str, size: int | None = None) -> Iterator[list[bytes]]:
    """The words of ``text`` in order, with b"." where a piece ends, in lists of about ``size`` bytes."""
    size = size or SLICE
    folded = text.encode().translate(FOLD)
    at = 0
    while at < len(folded):
        stops = [p for p in (folded.find(b" ", at + size), folded.find(b".", at + size)) if p >= 0]
        end = min(stops, default=len(folded))
        yield folded[at:end].replace(b".", b" . ").split(b" ")
        at = end


class Block:
    """Numbers of the words of one language in order of text; ends of pieces and texts are ``END``.

    A block that begins within a text repeats the two places before as ``context``.
    """

    def __init__(self, context: list[bytes] = ()):
        self.numbers: defaultdict[bytes, int] = defaultdict(itertools.count(1).__next__)
        self.numbers[b"."] = END
        self.places: list[np.ndarray] = []
        self.size, self.tail, self.context = 0, [], len(context)
        self.add(list(context))

    def add(self, words: list[bytes]) -> None:
        self.places.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)
        self.tail = (self.tail + words[-2:])[-2:]

    def row(self, lang: str) -> tuple:
        places = np.concatenate(self.places)
        counts = np.bincount(places[self.context :], minlength=len(self.numbers) + 1)
        names = sorted(self.numbers, key=self.numbers.__getitem__)[1:]
        own = [counts[self.numbers[w]] for w in names]
        return uuid.uuid4().hex, lang, self.context, [w.decode() for w in names], own, packed(places)


def packed(places: np.ndarray) -> bytes:
    """Place numbers, compressed byte by byte of their four: early numbers are frequent, so most high bytes are zero."""
    return zstandard.compress(places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel().astype(np.int32)


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per block: its language, words by number from 1, their counts, and the numbers of all places."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_blocks: dict[str, Block] = {}

        def closed(lang: str) -> pd.DataFrame:
            return pd.DataFrame([open_blocks.pop(lang).row(lang)], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                block = open_blocks.setdefault(lang, Block())
                for words in tokens(text or ""):
                    block.add([w for w in words if w])
                    if block.size >= size:
                        tail = block.tail
                        yield closed(lang)
                        block = open_blocks[lang] = Block(tail)  # the text may go on
                block.add([b"."])
            while sum(b.size + OPEN for b in open_blocks.values()) > 2 * size:
                yield closed(max(open_blocks, key=lambda lang: open_blocks[lang].size))
        for lang in list(open_blocks):
            yield closed(lang)

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    return texts.mapInPandas(cut, BLOCKS)


def frequent_words(cut: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, n): words of ``least`` occurrences in their language, with ids in that order."""
    each = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counts = each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    ordered = counts.filter(F.col("n") >= least).repartitionByRange("lang", "word").sortWithinPartitions("lang", "word")
    return stage(ordered.withColumn("id", F.monotonically_increasing_id()), "frequent-words")


def phrase_counts(cut: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(w1, w2, w3, n): phrases of two and three frequent words and ``least`` occurrences; w3 is NONE for two."""
    named = cut.select("block", "lang", F.posexplode("words").alias("at", "word"))
    named = named.join(words.select("lang", "word", "id"), ["lang", "word"])
    # at most as many as a block has words
    known = named.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("id", (F.col("at") + 1).alias("number")))).alias("known")
    )
    ids = known.select("block", F.col("known.id").alias("ids"), F.col("known.number").alias("numbers"))
    numbered = cut.select("block", "context", "places").join(ids, "block").select("context", "places", "ids", "numbers")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for context, places, ids, numbers in batch.itertuples(index=False):
                yield from block_phrases(context, unpacked(places), np.asarray(ids), np.asarray(numbers))

    found = numbered.mapInPandas(count, "w1 long, w2 long, w3 long, n long")
    return found.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def block_phrases(context: int, places: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> Iterator[pd.DataFrame]:
    """Distinct phrases of a block that end behind its context, with their counts."""
    code = np.full(max(places.max(initial=0), numbers.max(initial=0)) + 1, NONE, np.int64)
    code[numbers] = np.arange(len(ids))
    codes, base = code[places], len(ids)
    known = codes != NONE
    for size in (2, 3):
        ends = np.arange(max(context, size - 1), len(codes))
        ends = ends[np.logical_and.reduce([known[ends - k] for k in range(size)])]
        key = np.zeros(len(ends), np.int64)
        for k in reversed(range(size)):
            key = key * base + codes[ends - k]
        key, n = np.unique(key, return_counts=True)
        columns = {"w3": np.full(len(key), NONE, np.int64)}
        for k in reversed(range(size)):
            key, place = np.divmod(key, base)
            columns[f"w{k + 1}"] = ids[place]
        frame = pd.DataFrame(columns | {"n": n})[["w1", "w2", "w3", "n"]]
        for at in range(0, len(frame), ROWS):
            yield frame.iloc[at : at + ROWS]


def lockstep(stream: DataFrame, keys: list[str], one: str, two: str) -> DataFrame:
    """``stream`` with the counts ``n`` of each phrase's first word and first two words in the order of ``keys``.

    Ranges of keys are stored with their number. A summary of one row per range tells what
    stands open at its end; then each range is read once, in order, in batches.
    """
    ranged = stream.repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "ranged")
    a, b, c = keys
    is_one, is_two = F.col(b) == NONE, (F.col(b) != NONE) & (F.col(c) == NONE)
    ends = ranged.groupBy("part").agg(
        F.max(F.when(is_one, F.struct(a, "n")))["n"].alias("one"), F.max(F.when(is_two, F.struct(a, b, "n")))["n"].alias("two")
    )
    opened: dict[int, tuple[int, int]] = {}
    carry = (0, 0)
    for row in sorted(ends.collect()):  # a row per range
        opened[row["part"]] = carry
        carry = (row["one"] or carry[0], row["two"] or carry[1])
    names = stream.columns

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, carried = None, (0, 0)
        for batch in batches:
            for own, rows in batch.groupby("part", sort=True):
                carried = carried if own == part else opened[own]
                part, n = own, rows["n"].to_numpy()
                second, third = (rows[k].to_numpy() != NONE for k in (b, c))
                heads = {}
                for name, is_head, before in ((one, ~second, carried[0]), (two, second & ~third, carried[1])):
                    last = np.maximum.accumulate(np.where(is_head, np.arange(len(n)), -1))
                    heads[name] = np.where(last < 0, before, n[last])
                carried = tuple(int(h[-1]) for h in heads.values())
                yield rows[names].assign(**heads)

    schema = ", ".join(f"{name} long" for name in [*names, one, two])
    ordered = ranged.repartition("part").sortWithinPartitions("part", *keys)
    return ordered.mapInPandas(merge, schema)


def share(a: str, left: str, right: str) -> str:
    """SQL of floor(1 000 000 a a / (left right)) in exact decimals; counts may have 16 digits."""
    wide = "CAST({} AS DECIMAL(19, 0))".format
    return f"(1000000 * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})"


def scored(phrases: DataFrame) -> DataFrame:
    """Phrases with l, r and score of their lowest-scoring cut; without those that an extension covers."""
    three = F.col("w3") != NONE
    early, late = F.expr(share("n", "l1", "r2")), F.expr(share("n", "l2", "r1"))
    cuts = phrases.filter(F.col("w2") != NONE).withColumns(
        {"early": F.when(three, early).otherwise(F.expr(share("n", "l1", "r1"))), "late": F.when(three, late)}
    )
    by_late = F.coalesce(F.col("late") < F.col("early"), F.lit(False))
    return cuts.select(
        "w1", "w2", "w3", F.col("n").alias("a"),
        F.when(by_late, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(three & ~by_late, F.col("r2")).otherwise(F.col("r1")).alias("r"),
        F.when(by_late, F.col("late")).otherwise(F.col("early")).alias("score"),
    )


def covered(phrases: DataFrame, percent: int) -> DataFrame:
    """(w1, w2) of pairs that occur in one longer phrase ``percent`` of the time or more."""
    longer = phrases.filter(F.col("w3") != NONE)
    parts = [("w1", "w2", "l2"), ("w2", "w3", "r2")]
    found = [longer.filter(100 * F.col("n") >= percent * F.col(n)).select(x, y).toDF("w1", "w2") for x, y, n in parts]
    return found[0].union(found[1]).distinct()


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = COVERED) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Pieces end at ``.,;:!?`` and line breaks, words at spaces and tabs; A-Z are lowered. A
    phrase of two or three words occurs ``a`` times, at least ``least``. Its score is
    floor(1 000 000 a a / (l r)) for the cut into two parts, of counts ``l`` and ``r``, that
    makes it lowest, the first such cut. A pair goes if a longer phrase has ``percent`` of its
    occurrences. Order is by score and ``a`` from the highest, then by phrase; ``n`` counts the
    words of the language. A null language is ``und``. Null and empty texts hold no words;
    repeated rows count as often as they come; other columns and ids are not read. Texts of
    any length are taken whole, in slices. An empty table gives an empty result.
    """
    cut = stage(blocks(docs), "blocks")
    words = frequent_words(cut, least)
    single = words.select(F.col("id").alias("w1"), F.lit(NONE).cast("long").alias("w2"), F.lit(NONE).cast("long").alias("w3"), "n")
    stream = stage(phrase_counts(cut, words, least), "phrases").unionByName(single)
    forward = lockstep(stream, ["w1", "w2", "w3"], "l1", "l2")
    first = F.when(F.col("w2") == NONE, F.col("w1")).when(F.col("w3") == NONE, F.col("w2")).otherwise(F.col("w3"))
    then = F.when(F.col("w2") == NONE, NONE).when(F.col("w3") == NONE, F.col("w1")).otherwise(F.col("w2"))
    last = F.when(F.col("w3") == NONE, NONE).otherwise(F.col("w1"))
    backward = forward.withColumns({"s1": first, "s2": then.cast("long"), "s3": last.cast("long")})
    phrases = stage(lockstep(backward, ["s1", "s2", "s3"], "r1", "r2").drop("s1", "s2", "s3"), "merged")
    kept = scored(phrases).join(
        covered(phrases, percent).withColumn("w3", F.lit(NONE).cast("long")), ["w1", "w2", "w3"], "left_anti"
    )
    names = words.select("id", "word")
    text = kept.join(words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("x")), "w1")
    text = text.join(names.toDF("w2", "y"), "w2").join(names.toDF("w3", "z"), "w3", "left")
    text = text.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = text.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = cut.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n"))
    totals = totals.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def collocations_sql() -> str:
    """``collocations`` of ``documents``."""
    score = "(1000000::HUGEINT * c.f * c.f) // (({l})::HUGEINT * ({r}))".format
    return rf"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
g AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM pieces),
c1 AS (SELECT lang, w[i] AS x, count(*) AS f FROM g GROUP BY ALL),
c2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM g WHERE i < len(w) GROUP BY ALL),
c3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM g WHERE i + 1 < len(w) GROUP BY ALL
       HAVING f >= {LEAST}),
two AS (SELECT c.lang, c.x, c.y, c.x || ' ' || c.y AS phrase, c.f AS a, p.f AS l, q.f AS r, {score(l="p.f", r="q.f")} AS score
        FROM c2 c JOIN c1 p ON (p.lang, p.x) = (c.lang, c.x) JOIN c1 q ON (q.lang, q.x) = (c.lang, c.y)
        WHERE c.f >= {LEAST}),
cuts AS (SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z AS phrase, c.f AS a, p1.f AS l1, q1.f AS r1, p2.f AS l2, q2.f AS r2,
                {score(l="p1.f", r="q1.f")} AS s1, {score(l="p2.f", r="q2.f")} AS s2
         FROM c3 c JOIN c1 p1 ON (p1.lang, p1.x) = (c.lang, c.x) JOIN c2 q1 ON (q1.lang, q1.x, q1.y) = (c.lang, c.y, c.z)
         JOIN c2 p2 ON (p2.lang, p2.x, p2.y) = (c.lang, c.x, c.y) JOIN c1 q2 ON (q2.lang, q2.x) = (c.lang, c.z)),
every AS (
  SELECT lang, phrase, a, l, r, score FROM two t WHERE NOT EXISTS (
    SELECT 1 FROM c3 WHERE c3.lang = t.lang AND c3.x = t.x AND c3.y = t.y AND 100 * c3.f >= {COVERED} * t.a) AND NOT EXISTS (
    SELECT 1 FROM c3 WHERE c3.lang = t.lang AND c3.y = t.x AND c3.z = t.y AND 100 * c3.f >= {COVERED} * t.a)
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM cuts)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       n::BIGINT AS n, score::BIGINT AS score
FROM every JOIN (SELECT lang, sum(f) AS n FROM c1 GROUP BY lang) USING (lang) QUALIFY rank <= {TOP}
"""
