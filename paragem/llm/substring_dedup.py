"""Removal of every byte that a repeated string of SPAN bytes covers, across and inside documents.

Equal strings of SPAN bytes must meet without shuffling every one of them. Each has
an anchor: the leftmost of its GRAM-byte grams with the least hash, at the same place
in equal strings. Strings of one text that follow each other mostly share it, so a text
is a sequence of overlapping fragments, one for each anchor. Fragments meet by anchor,
and only those whose anchor stands in two places are built at all. Where an anchor is
frequent, its fragments are cut to STEP starts each and meet by what these all contain.

Aligned at their anchors, the fragments of a partition are a collection of strings for
``column_bwt``. Its input and output are sequential files, shuffled and sorted by Spark.
Fragments over the edge of a passage in very many texts share their meeting key and
differ outside it, so they do not collapse. Where GATHERED different ones or more
would meet, they are cut to single starts: aligned strings of SPAN bytes, of which
different ones need not meet at all and equal ones are summed up before they are
shuffled.

Passages that are counted in words find each other in the same way: a text is then the
sequence of its words' hashes. They are marked only; bytes go by SPAN alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragem.llm.column_bwt import repeated_runs
from paragem.session import stage

SPAN, GRAM = 400, 100
#: Words of a passage that is marked where another row has it too.
PASSAGE = 51
#: Places of an anchor from which its fragments are cut finer, and starts in such a fragment.
FREQUENT, STEP = 1024, 64
#: Starts of a text looked at together.
SEGMENT = 1 << 19
#: Texts whose fragments are handed on together; fragments in a collection.
TEXTS, COLLECTION = 64, 2048
#: Strings of words in a row of them; those handed on together.
STRINGS, HANDED = 4096, 1 << 17
#: Different fragments with one meeting key that no longer meet in one task.
GATHERED = 256

#: A gap between words, and the beginning of a text of PASSAGE words or more when filled in.
SPACE = re.compile(rb"[\x20\x09-\x0D]")
WORDY = r"\A[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]"

WRAP = 0xFFFFFFFFFFFFFFFF
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, for each place in a segment."""
    n = SEGMENT + SPAN
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for factor in (BASE, inverse):
        row = np.full(n, factor, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def anchors(text: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchor of each string of ``span`` bytes that starts in one segment of text."""
    up, down = powers()
    n = len(text) - gram + 1
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
    grams = (sums[gram:] - sums[:-gram]) * down[:n]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    # the place in the low bits makes the leftmost of equal grams the least
    low = np.uint64((1 << 20) - 1)
    keyed = (grams & ~low) | np.arange(n, dtype=np.uint64)
    wide = span - gram + 1
    padded = np.full(-(-n // wide) * wide, WRAP, np.uint64)
    padded[:n] = keyed
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(text) - span + 1
    place = (np.minimum(behind[:starts], ahead[wide - 1 : wide - 1 + starts]) & low).astype(np.int64)
    return place, grams[place]


def runs(text: bytes | np.ndarray, span: int = SPAN, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(first start, last start, anchor place, anchor hash) of the starts that follow each other with one anchor."""
    letters = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    for at in range(0, len(text) - span + 1, SEGMENT):
        place, hashed = anchors(letters[at : at + SEGMENT + span - 1], span, gram)
        begin = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        end = np.concatenate((begin[1:], [len(place)])) - 1
        signed = hashed[begin].view(np.int64)
        yield from zip(
            (begin + at).tolist(), (end + at).tolist(), (place[begin] + at).tolist(), signed.tolist(), strict=True
        )


def fragments(
    text: bytes, repeated: set[int], frequent: set[int], span: int = SPAN, gram: int = GRAM, wide: int = STEP
) -> dict[tuple[int, int, bytes], list[int]]:
    """Starts of each distinct fragment (meeting key, place of the anchor in it, bytes) with a repeated anchor."""
    found: dict[tuple[int, int, bytes], list[int]] = {}
    for first, last, place, hashed in runs(text, span, gram):
        if hashed not in repeated:
            continue
        if hashed not in frequent:
            found.setdefault((hashed, place - first, text[first : last + span]), []).append(first)
            continue
        while first <= last:
            step = (place - first) // wide
            until = min(last, place - step * wide)
            # the bytes that all starts of this step hold, whichever of them the run has
            common = text[place - step * wide : place - step * wide - wide + 1 + span]
            key = xxhash.xxh64_intdigest(common, hashed & WRAP) ^ step
            key -= (key >> 63) << 64
            found.setdefault((key, place - first, text[first : until + span]), []).append(first)
            first = until + 1
    return found


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words, which white space of ASCII parts."""
    found, at = [np.empty(0, np.uint64)], 0
    while at < len(text):
        gap = SPACE.search(text, at + SEGMENT)
        until = gap.start() if gap else len(text)
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, text[at:until].split()), np.uint64))
        at = until
    return np.concatenate(found)


def word_runs(words: np.ndarray, passage: int) -> Iterator[tuple[int, int, int, int]]:
    """``runs`` of the strings of ``passage`` words."""
    return runs(words, passage, max(1, passage // 5))


def passages(text: bytes, repeated: set[int], passage: int) -> Iterator[list[bytes]]:
    """128-bit hashes of the strings of ``passage`` words with a repeated anchor, in lists without repeats."""
    words = word_hashes(text)
    own, wide = words.tobytes(), words.itemsize
    found: set[bytes] = set()
    for first, last, _, hashed in word_runs(words, passage):
        if hashed in repeated:
            found.update(xxhash.xxh128_digest(own[at * wide : (at + passage) * wide]) for at in range(first, last + 1))
        if len(found) >= STRINGS:
            yield list(found)
            found = set()
    if found:
        yield list(found)


def anchor_counts(texts: DataFrame, span: int, gram: int, passage: int | None) -> DataFrame:
    """(key, mark, gram, n): how often each text has each anchor, of bytes and, with a ``passage``, of words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part, keys, marks, grams = batch.iloc[at : at + TEXTS], [], [], []
                for key, mark, text in zip(part["key"], part["mark"], part["text"], strict=True):
                    own = [hashed for *_, hashed in runs(text.encode(), span, gram)]
                    if passage:
                        own += [hashed for *_, hashed in word_runs(word_hashes(text.encode()), passage)]
                    keys += [key] * len(own)
                    marks += [mark] * len(own)
                    grams += own
                rows = pd.DataFrame({"key": keys, "mark": marks, "gram": grams})
                yield rows.groupby(["key", "mark", "gram"], sort=False).size().rename("n").reset_index()

    return texts.select("key", "mark", "text").mapInPandas(count, "key binary, mark long, gram long, n long")


def fragment_rows(texts: DataFrame, span: int, gram: int, wide: int, passage: int | None) -> DataFrame:
    """(meet, left, bytes, key, starts) of each distinct fragment of each text; needs ``repeated`` and ``frequent``.

    With a ``passage`` a text may have more rows, with ``passages`` and its key only.
    """
    columns = ["meet", "left", "bytes", "key", "starts", "passages"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part, rows, handed = batch.iloc[at : at + TEXTS], [], 0
                for key, text, some, many in zip(
                    part["key"], part["text"], part["repeated"], part["frequent"], strict=True
                ):
                    found = fragments(text.encode(), set(some), set(many), span, gram, wide)
                    rows += [(meet, left, own, key, starts, None) for (meet, left, own), starts in found.items()]
                    for strings in passages(text.encode(), set(some), passage) if passage else ():
                        rows.append((0, 0, None, key, None, strings))
                        handed += len(strings)
                        if handed >= HANDED:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, handed = [], 0
                yield pd.DataFrame(rows, columns=columns)

    return texts.select("key", "text", "repeated", "frequent").mapInPandas(
        cut, "meet long, left int, bytes binary, key binary, starts array<int>, passages array<binary>"
    )


def repeated_in_fragments(distinct: DataFrame, span: int) -> DataFrame:
    """(id_a, id_b, first, last): runs of repeated starts in each fragment that has one."""

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        group = pd.factorize(rows["meet"])[0]
        own, first, last = repeated_runs(list(rows["bytes"]), rows["left"].to_numpy(np.int64), group, span)
        several = rows["n"].to_numpy() > 1
        alone = ~several[own]
        sizes = rows["bytes"].map(len).to_numpy()
        own = np.concatenate((own[alone], np.flatnonzero(several)))
        return pd.DataFrame(
            {
                "id_a": rows["id_a"].to_numpy()[own],
                "id_b": rows["id_b"].to_numpy()[own],
                "first": np.concatenate((first[alone], np.zeros(several.sum(), np.int64))),
                "last": np.concatenate((last[alone], sizes[several] - span)),
            }
        )

    def collections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            meet = batch["meet"].to_numpy()
            begin = np.flatnonzero(np.concatenate(([True], meet[1:] != meet[:-1]))) if len(meet) else meet
            done = 0
            for at in begin:
                # the group that ends here may have begun in an earlier batch
                size = sum(map(len, held)) + at - done
                closed = bool(at) or bool(held) and held[-1]["meet"].iloc[-1] != meet[0]
                if closed and size >= COLLECTION:
                    yield mark(pd.concat([*held, batch.iloc[done:at]]))
                    held, done = [], at
            held.append(batch.iloc[done:])
        if sum(map(len, held)):
            yield mark(pd.concat(held))

    together = distinct.repartition("meet").sortWithinPartitions("meet")
    return together.mapInPandas(collections, "id_a long, id_b long, first int, last int")


def summed(cut: DataFrame) -> DataFrame:
    """Each different fragment of ``cut`` with the number ``n`` of its places."""
    return cut.groupBy("meet", "left", "bytes", "id_a", "id_b").agg(F.sum(F.size("starts")).alias("n"))


def crowded_keys(cut: DataFrame, gathered: int) -> DataFrame:
    """(meet): the keys of ``gathered`` different fragments or more, from their identities alone."""
    different = cut.select("meet", "id_a", "id_b").distinct().groupBy("meet").count()
    return different.filter(F.col("count") >= gathered).select("meet")


def repeated_starts(distinct: DataFrame, span: int) -> DataFrame:
    """(id_a, id_b, first, last) of each repeated start of each fragment; strings of ``span`` bytes meet by identity."""
    starts = F.explode(F.sequence(F.lit(0), F.length("bytes") - span)).alias("first")
    own = F.substring("bytes", F.col("first") + 1, F.lit(span))
    strings = distinct.select("id_a", "id_b", "n", "bytes", starts).select(
        "id_a", "id_b", "n", "first", F.xxhash64(F.lit(3), own).alias("string_a"), F.xxhash64(F.lit(4), own).alias("string_b")
    )
    strings = stage(strings, "strings")
    several = strings.groupBy("string_a", "string_b").agg(F.sum("n").alias("places")).filter("places > 1")
    hits = strings.join(several.drop("places"), ["string_a", "string_b"])
    return hits.select("id_a", "id_b", "first", F.col("first").alias("last"))


def shared_passages(cut: DataFrame) -> DataFrame:
    """(key, shared): the texts that share one of their ``passages`` with another text."""
    strings = cut.filter("passages is not null").select("key", F.explode("passages").alias("string"))
    mark = F.xxhash64("key")
    several = strings.groupBy("string").agg(F.min(mark).alias("least"), F.max(mark).alias("most"))
    # stored, so that the join may split the places of a frequent passage
    several = stage(several.filter("least <> most").select("string"), "passages")
    return strings.join(several, "string").select("key").distinct().withColumn("shared", F.lit(True))


def repeated_spans(
    docs: DataFrame,
    span: int = SPAN,
    gram: int = GRAM,
    frequent: int = FREQUENT,
    wide: int = STEP,
    gathered: int = GATHERED,
    passage: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats (whether a byte is removed).

    Removed is each byte of a text (UTF-8, null as empty) inside a string of ``span``
    bytes that starts anywhere else too, in any row or the same one; overlapping starts
    count. Texts shorter than ``span`` stay as they are, repeated or not. Equal texts of
    ``span`` bytes or more go entirely. Ids may be null or repeat: rows are told apart by
    their text only. Texts of any length are read in segments. Other columns are not
    read; an empty table gives an empty result.

    With ``passage`` the column shares_passage follows: whether that many words of the
    text (parted by white space of ASCII) stand in a row in another row's text too,
    however many bytes they have. It removes nothing.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"))
    known = known.withColumn("key", F.unhex(F.substring("digest", 1, 32)))
    wordy = F.col("text").rlike(WORDY % (passage - 1)) if passage else F.lit(False)
    size = F.octet_length("text").cast("long").alias("n_bytes")
    marks = stage(known.select("doc_id", "key", "digest", size, wordy.alias("wordy")), "marks")
    # words have a byte each and one between them at least
    least = min(span, 2 * passage - 1) if passage else span
    long = known.filter(F.octet_length("text") >= least).select("key", F.xxhash64("digest").alias("mark"), "text")

    counted = stage(anchor_counts(long, span, gram, passage), "anchors")
    several = counted.groupBy("gram").agg(
        F.min("mark").alias("least"), F.max("mark").alias("most"), F.max("n").alias("own"), F.sum("n").alias("places")
    )
    several = several.filter("least <> most or own > 1").select("gram", (F.col("places") >= frequent).alias("often"))
    wanted = counted.join(several, "gram").groupBy("key").agg(
        F.collect_set("gram").alias("repeated"), F.collect_set(F.when(F.col("often"), F.col("gram"))).alias("frequent")
    )
    texts = long.select("key", "text").dropDuplicates(["key"])
    rows = fragment_rows(texts.join(wanted, "key"), span, gram, wide, passage)
    identity = [F.xxhash64(F.lit(seed), "meet", "left", "bytes").alias(name) for seed, name in ((1, "id_a"), (2, "id_b"))]
    both = stage(rows.select("*", *identity), "fragments")
    cut = both.filter("bytes is not null").drop("passages")

    crowded = stage(crowded_keys(cut, gathered), "crowded")
    hits = repeated_in_fragments(summed(cut.join(crowded, "meet", "left_anti")), span)
    hits = hits.unionByName(repeated_starts(summed(cut.join(crowded, "meet", "left_semi")), span))
    hits = hits.groupBy("id_a", "id_b").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    covered = F.flatten(
        F.transform(
            "starts",
            lambda s: F.transform(
                "runs", lambda r: F.struct((s + r["first"]).alias("first"), (s + r["last"] + span).alias("end"))
            ),
        )
    )
    spans = cut.select("id_a", "id_b", "key", "starts").join(hits, ["id_a", "id_b"]).select("key", covered.alias("spans"))
    spans = stage(spans.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, own in zip(batch["key"], batch["text"], batch["spans"], strict=True):
                letters = np.frombuffer(text.encode(), np.uint8)
                depth = np.zeros(len(letters) + 1, np.int64)
                np.add.at(depth, [s["first"] for s in own], 1)
                np.add.at(depth, [s["end"] for s in own], -1)
                gone = np.cumsum(depth[:-1]) > 0
                begins = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                kept = hashlib.sha256(letters[~gone].tobytes()).hexdigest()
                rows.append((key, int(gone.sum()), begins, kept))
            yield pd.DataFrame(rows, columns=["key", "n_removed", "n_spans", "kept_sha256"])

    copies = marks.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    single = spans.join(copies.filter("copies = 1"), "key", "left_semi")
    cleaned = texts.join(single, "key").select("key", "text", "spans")
    cleaned = cleaned.mapInPandas(remove, "key binary, n_removed long, n_spans long, kept_sha256 string")
    # stored, so that the join with all rows may split the rows of a frequent text
    found = copies.join(cleaned, "key", "left")
    found = stage(found.join(shared_passages(both), "key", "left") if passage else found, "removed")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= span)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    removed = F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    columns = [
        F.col("doc_id"),
        F.col("n_bytes"),
        removed.alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        (removed > 0).alias("repeats"),
    ]
    if passage:
        shares = F.when(F.col("copies") > 1, F.col("wordy")).otherwise(F.coalesce("shared", F.lit(False)))
        columns.append(shares.alias("shares_passage"))
    return marks.join(found, "key").select(columns)
