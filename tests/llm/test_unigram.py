import random
import tracemalloc

import public_tokenizers
import pytest
from corpus import documents, with_clashing_columns

from paragem.llm import unigram as U

PATH = public_tokenizers.path("piece_bpe_32k.model")


def best_cut(word, pieces, byte):
    """(score, tokens) of the best way to cut ``word``, all ways tried from the left."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        ways = [(best[end - 1][0] + byte * size, best[end - 1][1] - size)]
        ways += [
            (best[start][0] + pieces[word[start:end]], best[start][1] - 1)
            for start in range(end)
            if word[start:end] in pieces
        ]
        best.append(max(ways))
    return -best[-1][1], best[-1][0]


def test_trie_equals_each_word_alone():
    pieces = U.vocabulary(PATH)
    trie = U.ForwardTrie(pieces)
    rng = random.Random(4)
    stems = ["the", "inter", "nation", "al", "é", "日本", "zq", "123", "▁"]
    words = ["".join(rng.choices(stems, k=rng.randrange(1, 6))) for _ in range(400)]
    for word in words:
        assert trie.insert(U.SPACE + word) == best_cut(U.SPACE + word, pieces, trie.byte)
    assert len(trie) < sum(len(w) + 1 for w in words)


@pytest.mark.parametrize("long", [1, 3, 40])
def test_long_words_equal_each_word_alone(monkeypatch, long):
    monkeypatch.setattr(U, "LONG", long)
    pieces = U.vocabulary(PATH)
    trie = U.ForwardTrie(pieces)
    rng = random.Random(5)
    stems = ["the", "inter", "nation", "al", "é", "日本", "zq", "123", "▁", "aaaa"]
    for _ in range(200):
        word = U.SPACE + "".join(rng.choices(stems, k=rng.randrange(1, 30)))
        assert trie.insert(word) == best_cut(word, pieces, trie.byte)
    assert max(len(word) for word in pieces) == trie.longest


def test_a_word_of_any_length_takes_fixed_memory():
    trie = U.ForwardTrie({"a": -1.0, "ab": -1.5, "abc": -1.7})
    word = "abcabx" * 50_000
    tracemalloc.start()
    tokens, score = trie.insert(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens == 150_000 and score == pytest.approx(50_000 * (-1.7 - 1.5 + trie.byte))
    assert peak < 1 << 20 and len(trie) <= U.LONG + 1


def test_rows_looked_at_together(monkeypatch):
    monkeypatch.setattr(U, "TEXTS", 3)
    monkeypatch.setattr(U, "AT_ONCE", 10)
    assert list(U.together([])) == []
    assert list(U.together([1, 1, 1, 1, 20, 0, 5, 5, 0])) == [(0, 3), (3, 5), (5, 8), (8, 9)]


def test_counts_of_texts(spark, monkeypatch):
    texts = [None, "", "  ", "the nation", "The\tnation\nthe", "日本 é " * 5000, "\x00 ok", "inter" * 500]
    rows = [*enumerate(texts), (None, "the"), (3, "the nation"), (3, "the nation")]
    got = U.token_counts(with_clashing_columns(documents(spark, *rows)), PATH).collect()
    pieces = U.vocabulary(PATH)
    byte = min(pieces.values()) - 1

    def counted(text):
        cuts = [best_cut(U.SPACE + w, pieces, byte) for w in (text or "").split()]
        return len(cuts), sum(n for n, _ in cuts), sum(s for _, s in cuts)

    want = sorted(((i, *counted(t)) for i, t in rows), key=repr)
    found = sorted(map(tuple, got), key=repr)
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in want])
    assert U.token_counts(documents(spark, "a").filter("doc_id > 0"), PATH).collect() == []
