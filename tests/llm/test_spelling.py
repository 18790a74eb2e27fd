"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from corpus import documents, with_clashing_columns

from paragem.llm import spelling
from paragem.llm.spelling import one_edit_apart, variants
from paragem.llm.variable_grams import GramDictionary

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def edits(word, letters):
    for k in range(len(word) + 1):
        yield from (word[:k] + c + word[k:] for c in letters)
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            yield from (word[:k] + c + word[k + 1 :] for c in letters)


def plain_variants(rows):
    counts = plain_words(rows)
    letters = sorted(set("".join(counts)))
    near = {w: {v for v in edits(w, letters) if v in counts and v != w} for w in counts}
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda v: (-counts[v], v), default=None)
        form[word] = best if best and counts[best] >= 5 * n else None
    out = []
    for word, n in counts.items():
        root = word
        while form[root]:
            root = form[root]
        out.append((word, form[word], root, n, len(near[word]), counts.get(form[word])))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed, texts):
    """Words of few syllables, so that many are near, each with some misspelt copies."""
    rng = random.Random(seed)
    parts = ["the", "re", "an", "tion", "é", "ss", "ou", "ing", "ñ", "er"]
    words = ["".join(rng.choices(parts, k=rng.randint(3, 6))) for _ in range(250)]
    out = []
    for i in range(texts):
        chosen = rng.choices(words[: 1 + int(rng.paretovariate(0.5)) % 250], k=120)
        some = [w.upper() if rng.random() < 0.1 else w for w in chosen]
        some += [rng.choice(list(edits(w, "anñ"))) for w in chosen[:12] for _ in range(2)]
        out.append((i * 7, rng.choice([" ", ", ", "-", "中", "\n", "9"]).join(some)))
    return [*out, (5, "chained " * 130 + "chainex " * 25 + "chainyx " * 5)]


@pytest.mark.parametrize("share, tile", [(spelling.SHARE, spelling.TILE), (20, 7), (1, 3)])
def test_equal_to_plain_comparison(spark, monkeypatch, share, tile):
    monkeypatch.setattr(spelling, "SHARE", share)
    rows = corpus(share, 60)
    want = plain_variants(rows)
    assert sum(r[4] for r in want) > 300 and any(r[1] for r in want) and any(r[1] != r[2] and r[1] for r in want)
    assert got(variants(documents(spark, *rows), tile=tile)) == want


def test_chunks_and_slices_change_nothing(spark, monkeypatch):
    rows = corpus(3, 30)
    want = plain_variants(rows)
    for name, value in (("SLICE", 50), ("HELD", 5000), ("ROWS", 10), ("WIDTH", 8)):
        monkeypatch.setattr(spelling, name, value)
    assert list(spelling.slices(b"ab cd ef", 1)) == [b"ab", b" cd", b" ef"]
    assert got(variants(documents(spark, *rows))) == want


def test_affected_grams_bound_what_any_edit_changes():
    rng = random.Random(1)
    for _ in range(300):
        grams = ["".join(rng.choices("abc", k=3)) for _ in range(rng.randint(0, 14))]
        known = GramDictionary(grams)
        word = "".join(rng.choices("abc", k=rng.randint(6, 11)))
        spans = known.spans(word)
        most = known.most_affected(word, spans)
        assert len(spans) - most >= 1
        for other in set(edits(word, "abcd")) - {word}:
            theirs = {(other[i:j], i) for i, j in known.spans(other)}
            behind = {(other[i:j], len(other) - i) for i, j in known.spans(other)}
            at = next((k for k, (p, q) in enumerate(zip(word, other)) if p != q), min(len(word), len(other)))
            kept = [
                (i, j) for i, j in spans
                if (j <= at and (word[i:j], i) in theirs) or (i >= at and (word[i:j], len(word) - i) in behind)
            ]
            assert len(kept) >= len(spans) - most


def test_one_edit():
    rng = random.Random(2)
    words = ["".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(60)]
    for x in words:
        for y in words:
            assert one_edit_apart(x, y) == (x != y and y in set(edits(x, "ab")))


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark):
    long = "verylong" * 300
    rows = [
        (None, "Wonder wonder WONDER wonder wonder"), (None, None), (1, ""), (1, "123 中"),
        *[(2, "wonders " * 30 + "wonderz")] * 5, (3, "yonder " * 30), (3, f"{long} {long}x " * 5),
        (4, "a " * 500_000 + "wondert " * 30),
    ]
    docs = with_clashing_columns(documents(spark, *rows)).selectExpr("*", "'x' AS word", "1 AS n", "'x' AS near", "1 AS size")
    result = got(variants(docs))
    assert result == plain_variants(rows)
    by_word = {r[0]: r for r in result}
    assert by_word["wonder"][1] == "wonders" and by_word["wonderz"][2] == "wonders"
    assert by_word[long][4] == by_word[long + "x"][4] == 1


def test_no_words(spark):
    assert got(variants(documents(spark))) == []
    assert got(variants(documents(spark, "short words only, each once"))) == []
