import hashlib
import random

import numpy as np
import pytest

from paragem.llm import substring_dedup as S
from paragem.llm.column_bwt import columns, repeated_runs


def brute(texts: list[str | None], span: int) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    places: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - span + 1):
            places[r[i : i + span]] = places.get(r[i : i + span], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - span + 1):
            if places[r[i : i + span]] > 1:
                gone[i : i + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1)
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest()))
    return out


def random_texts(seed: int, n: int) -> list[str | None]:
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcé ", k=rng.choice([20, 39, 40, 41, 90, 200]))) for _ in range(6)]
    texts: list[str | None] = [None, "", "short", "short", "la " * 60, "x" * 300, passages[5], passages[5]]
    for _ in range(n):
        parts = [rng.choice([rng.choice(passages), "".join(rng.choices("abcdé ", k=rng.randrange(60)))]) for _ in range(4)]
        texts.append("".join(parts))
    return texts


def test_columns_sort_and_share_like_the_suffixes():
    rng = random.Random(3)
    strings = ["".join(rng.choices("ab", k=rng.randrange(1, 14))).encode() for _ in range(60)]
    left = np.array([rng.randrange(len(s)) for s in strings])
    group = np.array(sorted(rng.randrange(4) for _ in strings))
    before: dict[int, int] = {}
    for column in columns(strings, left, group):
        suffix = {i: strings[i][column.at + left[i] :] for i in column.order}
        assert set(suffix) == {i for i in range(60) if 0 <= column.at + left[i] < len(strings[i])}
        keys = [(group[i], suffix[i]) for i in column.order]
        assert keys == sorted(keys)
        for k, (a, b) in enumerate(zip(column.order, column.order[1:], strict=False)):
            same = next((n for n, (x, y) in enumerate(zip(suffix[a], suffix[b], strict=False)) if x != y), None)
            same = min(len(suffix[a]), len(suffix[b])) if same is None else same
            assert column.shared[k + 1] == (same if group[a] == group[b] else 0)
        # the symbols inserted, in the order of the round before, strings that enter first
        kept = [i for i in before if i in suffix]
        old = [i for i in suffix if i not in before]
        assert sorted(column.transform[: len(old)]) == sorted(suffix[i][0] for i in old)
        assert list(column.transform[len(old) :]) == [suffix[i][0] for i in kept]
        before = dict.fromkeys(column.order)


def test_repeated_runs_need_the_same_columns():
    own, first, last = repeated_runs([b"xabcdef", b"abcdeg", b"zzz"], np.array([1, 0, 0]), np.array([0, 0, 0]), 4)
    assert list(zip(own, first, last, strict=True)) == [(0, 1, 2), (1, 0, 1)]


@pytest.mark.parametrize(("frequent", "gathered"), [(3, 1000), (1000, 1000), (3, 2), (1000, 5)])
def test_against_all_strings(spark, frequent, gathered):
    texts = random_texts(frequent, 60)
    docs = spark.createDataFrame(
        [(None if i == 9 else i // 2 * 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int"
    )
    got = S.repeated_spans(docs, span=40, gram=10, frequent=frequent, wide=7, gathered=gathered).collect()
    want = brute(texts, 40)
    assert sorted(tuple(r)[1:] for r in got) == sorted((*row, row[1] > 0) for row in want)
    by_id = {(r.doc_id, r.kept_sha256, r.n_bytes) for r in got}
    assert all((None if i == 9 else i // 2 * 2, w[3], w[0]) in by_id for i, w in enumerate(want))


def test_a_passage_in_a_third_of_all_texts_gathers_nowhere(spark, monkeypatch):
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=520))

    def other(k):
        return "".join(rng.choices("abcdefgh ", k=k))

    texts = [other(rng.randrange(300)) + (passage if i % 3 == 0 else other(500)) + other(rng.randrange(300)) for i in range(3000)]
    groups = []
    crowded = S.crowded_keys

    def watched(cut, gathered):
        keys = crowded(cut, gathered)
        rest = S.summed(cut.join(keys, "meet", "left_anti")).groupBy("meet").count()
        groups.append((keys.count(), max(r["count"] for r in rest.collect())))
        return keys

    monkeypatch.setattr(S, "crowded_keys", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = S.repeated_spans(docs, frequent=100).collect()
    assert sorted(tuple(r)[1:5] for r in got) == sorted(brute(texts, S.SPAN))
    [(keys, largest)] = groups
    assert keys > 0 and largest < S.GATHERED


def test_segments_do_not_change_the_result(monkeypatch):
    text = "".join(random.Random(1).choices("abc", k=3000)).encode()
    whole = {(s, p, h) for a, b, p, h in S.runs(text, 40, 10) for s in range(a, b + 1)}
    monkeypatch.setattr(S, "SEGMENT", 97)
    S.powers.cache_clear()
    assert whole == {(s, p, h) for a, b, p, h in S.runs(text, 40, 10) for s in range(a, b + 1)}
    S.powers.cache_clear()


def test_text_of_several_segments(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnop"
    passage = "".join(rng.choices(letters, k=900))
    long = "".join(rng.choices(letters, k=S.SEGMENT - 450))
    texts = [long + passage + "".join(rng.choices(letters, k=S.SEGMENT)), "é" + passage]
    got = S.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}
    rest = [texts[0].replace(passage, ""), "é"]
    assert found == {
        i: (len(t.encode()), 900, 1, hashlib.sha256(rest[i].encode()).hexdigest()) for i, t in enumerate(texts)
    }


def test_empty_table(spark):
    assert S.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def sharing(texts: list[str | None], words: int) -> list[bool]:
    places: dict[tuple[bytes, ...], set[int]] = {}
    for i, text in enumerate(texts):
        own = (text or "").encode().split()
        for at in range(len(own) - words + 1):
            places.setdefault(tuple(own[at : at + words]), set()).add(i)
    several = set().union(*(rows for rows in places.values() if len(rows) > 1))
    return [i in several for i in range(len(texts))]


@pytest.mark.parametrize("words", [1, 6, 51])
def test_shared_passages_against_all_strings_of_words(spark, words):
    rng = random.Random(words)

    def some(k, letters="abcdé|"):
        gaps = [" ", " ", "\n", "\t ", "\x0b"]
        return "".join(rng.choice(["", *letters]) + rng.choice(letters) + rng.choice(gaps) for _ in range(k))

    # the longest has one word less than a passage, so it is shared only with an equal word beside it
    passages = [some(k) for k in (words - 1, words, words, words + 1, 3 * words)]
    texts: list[str | None] = [None, None, "", "one", "two words", "two words", some(words + 2), some(words - 1), "no gap" * 200]
    texts += [texts[6], texts[7], " ".join("a" * 120), " ".join("a" * 120)]
    texts += ["la " * (words + 3), "la " * (2 * words), " " * 90, "\n" + " " * 95]
    for _ in range(70):
        own = [[rng.choice(passages), some(rng.randrange(40)), some(rng.randrange(words + 9), "pqrst")] for _ in range(3)]
        texts.append("".join(map(rng.choice, own)))
    rows = [(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.repeated_spans(docs, span=40, gram=10, passage=words).collect()
    want = [(*row, row[1] > 0, shares) for row, shares in zip(brute(texts, 40), sharing(texts, words), strict=True)]
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)
    assert {row[-1] for row in want} == {True, False}


def test_words_of_a_text_in_several_segments(monkeypatch):
    text = "".join(random.Random(4).choices("ab \n\té", k=4000)).encode()
    whole = S.word_hashes(text)
    assert len(whole) == len(text.split())
    monkeypatch.setattr(S, "SEGMENT", 53)
    assert (S.word_hashes(text) == whole).all()


def test_shared_passages_of_an_empty_table_and_of_nulls(spark):
    schema = "doc_id long, text string"
    assert S.repeated_spans(spark.createDataFrame([], schema), passage=6).collect() == []
    got = S.repeated_spans(spark.createDataFrame([(None, None), (None, None)], schema), passage=6).collect()
    assert [r.shares_passage for r in got] == [False, False]


def test_strings_of_words_come_in_bounded_lists(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefgh", k=700)) for _ in range(2)]
    words = [t.encode().split() for t in texts]
    anchors = {hashed for t in texts for *_, hashed in S.word_runs(S.word_hashes(t.encode()), 20)}
    whole = [set().union(*S.passages(t.encode(), anchors, 20)) for t in texts]
    assert [len(w) for w in whole] == [len({tuple(w[i : i + 20]) for i in range(681)}) for w in words]
    monkeypatch.setattr(S, "STRINGS", 50)
    lists = [list(S.passages(t.encode(), anchors, 20)) for t in texts]
    assert all(len(own) < 50 + 20 for found in lists for own in found)
    assert [set().union(*found) for found in lists] == whole


def test_query_marks_shared_passages_under_400_bytes(spark, tmp_path):
    from paragem.llm.queries import op3_substring_dedup

    rng = random.Random(6)

    def some(k):
        return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(k))

    passage = some(55)
    texts = [f"{some(80)}\n{passage}\n{some(9)}", f"{passage} {some(200)}", some(300), f"{some(70)} {passage[:300]}"]
    assert len(passage) < S.SPAN
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.shares_passage) for r in op3_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, False), 3: (0, False)}
