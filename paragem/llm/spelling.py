"""Spelling variants: words one edit apart, found through an index of variable-length grams.

Words are cut into variable grams of a dictionary pruned by frequency. One edit can change
at most so many grams of a word; all others stand in its variant too, on the left of the
edit as far from the beginning and on the right as far from the end, with all that lies
between them and that end of the word. So of the grams of a word, ranked from the rarest,
it is enough to look into the lists of the first ``affected + 1``: any variant shares one
of them within its own first ones. A list is kept by the gram together with the word's
beginning up to it, and with its rest from it on. The words of a list are merged in order
of length and each pair is verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragem.llm.variable_grams import LEAST_WORD, LONGEST, SHORTEST, GramDictionary
from paragem.session import stage

LEAST_COUNT, RATIO, DELETED = 5, 5, 199
#: A gram is frequent, and is lengthened, if it is one of more than 1 / SHARE of all places; fewer than SHARE grams are.
SHARE = 2000
#: Bytes of a text cut into words at once, and bytes of words held by a task before it hands on their counts.
SLICE, HELD = 1 << 20, 1 << 25
#: Words of a list that meet in a task; longer lists are dealt to tiles that meet in pairs.
TILE = 4096
#: Rows compared at once, and the longest words compared as a matrix.
ROWS, WIDTH = 1 << 16, 32

IN_RUN = {*range(65, 91), *range(97, 123), *range(0xC0, 0x100)}
#: Latin-1 bytes: A-Z lowered, other symbols of runs kept, all else a space.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c in IN_RUN else 32 for c in range(256))


def slices(folded: bytes, size: int = SLICE) -> Iterator[bytes]:
    """``folded`` in parts of about ``size``, cut at spaces."""
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        yield folded[at:end]
        at = end


def counted_words(doc_id: int | None, text: str, deleted: int = DELETED) -> Iterator[tuple[bytes, int, int]]:
    """(run, dropped place or -1, times) of each distinct run of a text and slice, in Latin-1 bytes."""
    seed = None if doc_id is None else zlib.crc32(b"%d:" % doc_id)
    for part in slices(text.encode("latin-1", "replace").translate(FOLD)):
        for run, n in Counter(part.split()).items():
            if seed is None:
                yield run, -1, n
            else:
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                yield run, h % len(run) if h % deleted == 0 else -1, n


def counts_frame(name: str, texts: Iterable[str], counts: Iterable[int]) -> pd.DataFrame:
    """Columns ``name`` and ``n``; an empty column of texts keeps its type only as objects."""
    out = pd.DataFrame({name: pd.Series(list(texts), dtype=object)})
    return out.assign(n=np.fromiter(counts, np.int64, len(out)))


def word_counts(docs: DataFrame, least_length: int = LEAST_WORD, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of ``docs`` of at least ``least_length`` symbols and ``least_count`` occurrences."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        held = 0

        def rows() -> pd.DataFrame:
            return counts_frame("word", (w.decode("latin-1") for w in counts), counts.values())

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for run, place, n in counted_words(None if pd.isna(doc_id) else int(doc_id), text or ""):
                    word = run if place < 0 else run[:place] + run[place + 1 :]
                    if len(word) >= least_length:
                        if word not in counts:
                            held += len(word) + 100
                        counts[word] += n
                if held > HELD:
                    yield rows()
                    counts.clear()
                    held = 0
        yield rows()

    # ids as texts, so that a null among them does not turn the others into floats
    found = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def gram_dictionary(words: DataFrame) -> GramDictionary:
    """Grams of up to LONGEST symbols whose beginning is frequent among all places of ``words``.

    Fewer than SHARE grams of a length are frequent, so the dictionary holds at most
    SHARE times the alphabet for each length, however many words there are.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        places = 0
        for batch in batches:
            for word in batch["word"]:
                places += len(word)
                for size in range(SHORTEST, LONGEST + 1):
                    counts.update(word[at : at + size] for at in range(len(word) - size + 1))
            if len(counts) > 1_000_000:
                yield counts_frame("gram", counts, counts.values())
                counts.clear()
        counts[""] = places
        yield counts_frame("gram", counts, counts.values())

    counts = words.select("word").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = stage(counts, "grams")
    row = counts.filter("gram = ''").head()
    if row is None:
        return GramDictionary(())
    often = counts.filter((F.col("gram") != "") & (F.col("n") * SHARE > F.lit(row["n"]))).select("gram")
    size = F.length("gram")
    longer = counts.filter(size > SHORTEST).withColumn("beginning", F.substr("gram", F.lit(1), size - 1))
    kept = longer.join(often.toDF("beginning"), "beginning", "left_semi").select("gram")
    return GramDictionary(r[0] for r in kept.collect())


def list_lengths(words: DataFrame, grams: GramDictionary) -> dict[str, int]:
    """How many places of the words each gram in use has: grams of the dictionary and those of SHORTEST symbols."""
    shared = words.sparkSession.sparkContext.broadcast(grams)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for word in batch["word"]:
                counts.update(word[i:j] for i, j in shared.value.spans(word))
        yield counts_frame("gram", counts, counts.values())

    lengths = words.select("word").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in lengths.collect()}


def index_rows(words: DataFrame, grams: GramDictionary, lengths: dict[str, int]) -> DataFrame:
    """(list, size, word, n): each word in the lists of its rarest grams, both ways, as many as one edit can change and one."""
    shared = words.sparkSession.sparkContext.broadcast((grams, lengths))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, often = shared.value
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            lists, sizes, texts, counts = [], [], [], []
            for word, n in zip(batch["word"], batch["n"], strict=True):
                spans = known.spans(word)
                ranked = sorted(spans, key=lambda s: (often[word[s[0] : s[1]]], word[s[0] : s[1]], s[0]))
                for start, end in ranked[: known.most_affected(word, spans) + 1]:
                    gram = (end - start).to_bytes()
                    lists.append(digest(b"<" + gram + word[:end].encode()) - (1 << 63))
                    lists.append(digest(b">" + gram + word[start:].encode()) - (1 << 63))
                own = len(lists) - len(texts)
                sizes += [len(word)] * own
                texts += [word] * own
                counts += [n] * own
            yield counts_frame("word", texts, counts).assign(list=lists, size=sizes)

    return words.mapInPandas(entries, "list long, size int, word string, n long")


def dealt(index: DataFrame, tile: int = TILE) -> DataFrame:
    """``index`` with the pair of tiles, ``tiles``, and the ``side`` (0: first, 1: second) each row is compared in.

    A list of at most ``tile`` words is one tile facing itself. The words of a longer one are
    dealt to tiles by hash and sent to each pair with theirs.
    """
    lengths = index.groupBy("list").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    parts = F.ceil(F.col("length") / F.lit(tile)).cast("int")
    known = index.join(lengths, "list").withColumn("parts", parts)
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    facing = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(
            F.least("part", other).alias("a"),
            F.greatest("part", other).alias("b"),
            (F.col("part") > other).cast("int").alias("side"),
        ),
    )
    rows = known.withColumn("part", part).select("list", "size", "word", "n", F.explode(facing).alias("at"))
    return rows.select("list", "at.a", "at.b", "at.side", "size", "word", "n")


def one_edit_apart(x: str, y: str) -> bool:
    """Whether exactly one symbol inserted, deleted or replaced makes ``x`` into ``y``."""
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    longest = max(len(x), len(y))
    at = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    return x[at + (len(x) == longest) :] == y[at + (len(y) == longest) :]


def symbol_masks(words: list[str]) -> np.ndarray:
    """A 64-bit set of each word's symbols; one edit changes at most two bits of it."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    bits = np.uint64(1) << (codes % 64).astype(np.uint64)
    starts = np.cumsum([0, *map(len, words[:-1])])
    return np.bitwise_or.reduceat(bits, starts)


def matrix(words: list[str], reverse: bool) -> np.ndarray:
    """The words' symbols, one word a row; rows of words beyond WIDTH are not used."""
    padded = "".join((w[:WIDTH][::-1] if reverse else w[:WIDTH]).ljust(WIDTH, "\0") for w in words)
    return np.frombuffer(padded.encode("utf-32-le"), np.uint32).reshape(-1, WIDTH)


def variants_in(group: np.ndarray, side: np.ndarray, facing: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of ``words`` that share a group and are one edit apart.

    Rows are sorted by ``group`` and length. ``facing`` groups compare the rows of side 0 with
    those of side 1 only. A row meets the row next to it, then the one after, until the lengths
    differ by two or the group ends.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    masks, ahead, back = symbol_masks(words), matrix(words, False), matrix(words, True)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    end_of = np.repeat(ends, np.diff(np.append(0, ends)))
    left, step, found = np.arange(len(words)), 0, [np.zeros((2, 0), np.int64)]
    while len(left):
        step += 1
        left = left[left + step < end_of[left]]
        left = left[size[left + step] - size[left] <= 1]
        right = left + step
        alike = np.bitwise_count(masks[left] ^ masks[right]) <= 2
        alike &= ~facing[left] | (side[left] != side[right])
        i, j = left[alike], right[alike]
        short = size[j] <= WIDTH
        a, b = i[short], j[short]
        # the word of two equal rows differs nowhere: argmax gives 0 for both ways, and 0 + 0 is less than any length
        common = (ahead[a] != ahead[b]).argmax(axis=1) + (back[a] != back[b]).argmax(axis=1)
        good = common >= size[b] - 1
        found.append(np.stack((a[good], b[good])))
        a, b = i[~short], j[~short]
        good = np.fromiter((one_edit_apart(words[x], words[y]) for x, y in zip(a, b, strict=True)), bool, len(a))
        found.append(np.stack((a[good], b[good])))
    pairs = np.concatenate(found, axis=1)
    return pairs[0], pairs[1]


def merged_lists(dealt_rows: DataFrame) -> DataFrame:
    """(word, near, near_n): both ways, the verified pairs of each list; a pair comes once for each list it shares."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def compared(rows: pd.DataFrame) -> pd.DataFrame:
            keys = rows[["list", "a", "b"]].to_numpy()
            group = np.cumsum(np.append(False, (keys[1:] != keys[:-1]).any(axis=1)))
            words, n = rows["word"].tolist(), rows["n"].to_numpy()
            facing = (rows["a"] != rows["b"]).to_numpy()
            i, j = variants_in(group, rows["side"].to_numpy(), facing, words)
            both, other = np.concatenate((i, j)), np.concatenate((j, i))
            text = np.array(words, dtype=object)
            texts = {"word": text[both], "near": text[other]}
            return pd.DataFrame(texts, dtype=object).assign(near_n=n[other]).drop_duplicates()

        count = 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count < ROWS:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = rows.iloc[-1]
            same = (rows["list"] == last["list"]) & (rows["a"] == last["a"]) & (rows["b"] == last["b"])
            begin = int(np.flatnonzero(same.to_numpy())[0])  # rows are sorted, so the open group is the tail
            if begin:
                yield compared(rows.iloc[:begin])
            held, count = [rows.iloc[begin:]], len(rows) - begin
        if count:
            yield compared(pd.concat(held, ignore_index=True))

    ordered = dealt_rows.repartition("list", "a", "b").sortWithinPartitions("list", "a", "b", "size")
    return ordered.mapInPandas(merge, "word string, near string, near_n long")


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, near, near_n): each ordered pair of ``words`` (word, n) one edit apart, once.

    Words must have LEAST_WORD symbols, so that a gram is left of each whatever the edit.
    """
    grams = gram_dictionary(words)
    index = stage(index_rows(words, grams, list_lengths(words, grams)), "gram-lists")
    return merged_lists(dealt(index, tile)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of ``forms`` (word, form) that each word begins.

    Counts grow along a chain, so it ends. Each round doubles the steps taken.
    """
    left = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = left.toDF("root", "next")
        moved = stage(left.join(onward, "root", "left").select("word", "root", "next"), "roots")
        if moved.filter("next is not null").isEmpty():
            return moved.select("word", "root")
        left = moved.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """One row per word of ``docs``: word, form, root, n, n_near, form_n.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lowered, of at least
    LEAST_WORD symbols and ``least_count`` occurrences. Some runs lose a symbol, as chosen by
    the hash of id and run; of a row without an id none does. ``n_near`` counts the words one
    edit apart. ``form`` is the most frequent of them, of equally frequent ones the first, if
    it has ``ratio`` times the word's occurrences, else null; ``root`` is the last form
    reached from the word. Null texts hold no words; repeated rows count as often as they
    come; other columns are not read. Texts and words of any length are taken whole. An empty
    table gives an empty result.
    """
    words = stage(word_counts(docs, LEAST_WORD, least_count), "words")
    order = F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))
    best = near_words(words, tile).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(order).alias("best"))
    told = words.join(best, "word", "left")
    takes = -F.col("best.less") >= ratio * F.col("n")
    told = stage(
        told.select(
            "word",
            F.when(takes, F.col("best.near")).alias("form"),
            F.when(takes, -F.col("best.less")).alias("form_n"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        ),
        "forms",
    )
    ends = roots(told.filter("form is not null"))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
