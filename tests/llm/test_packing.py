import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from corpus import documents, with_clashing_columns
from tokenizers import Tokenizer

from paragem.llm import packing as P
from paragem.llm.packing_plan import plan
from paragem.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", "a", "It's isn't 's ''s", "x  y\n\n z \t", "<|endoftext|> in a text", "日本 ½ x² ٣", "é ü" * 900,
    "word " * 3000, "word " * 3000, "\x1c a\x85b _a_b 12ab", "short text", "x" * 5000,
]


def test_ids_equal_the_tokenizer():
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    encode = Encoder(PATH)
    for _ in range(2):
        assert [i.tolist() for i in encode.ids([t or "" for t in TEXTS])] == want


def check(docs, rows, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = [tuple(r) for r in P.pack(docs, PATH, capacity).collect()]
    assert Counter(r[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r[5]].append((r[6], r[3]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_round_trip(spark, capacity):
    rng = random.Random(capacity)
    rows = [*enumerate(TEXTS), (None, "null id"), (3, "again"), (3, "again")]
    rows += [(100 + k, "tok " * rng.randrange(40)) for k in range(200)]
    check(with_clashing_columns(documents(spark, *rows)), rows, capacity)


def test_empty_table(spark):
    assert P.pack(documents(spark, "a").filter("doc_id > 0"), PATH).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram_up_and_wastes_little(seed):
    rng = random.Random(seed)
    low, high = [(1, 1024), (100, 600), (1, 300), (20, 1000)][seed]
    histogram = {n: rng.randrange(1, 10 ** rng.randrange(1, 6)) for n in range(low, high, 3)}
    used = Counter()
    for contents, count in (found := plan(histogram, 1024)):
        assert count > 0 and sum(n * k for n, k in contents) <= 1024
        for n, k in contents:
            used[n] += k * count
    assert used == histogram
    least = max(sum(n * c for n, c in histogram.items()) / 1024, sum(c for n, c in histogram.items() if n > 512))
    assert sum(c for _, c in found) <= 1.05 * least + 1
    assert len(found) < 5000


@pytest.mark.parametrize("histogram, sequences", [({}, 0), ({1024: 3}, 3), ({513: 7}, 7), ({600: 9, 400: 9, 24: 9}, 9)])
def test_plans_that_are_known(histogram, sequences):
    assert sum(c for _, c in plan(histogram, 1024)) == sequences


def test_sequences_do_not_depend_on_partitions(spark):
    docs = documents(spark, *["tok " * (k % 7) for k in range(100)])
    one, other = (sorted(map(tuple, P.pack(d, PATH, 16).collect())) for d in (docs.coalesce(1), docs.repartition(9)))
    assert one == other


def test_long_texts_are_encoded_in_parts(monkeypatch):
    from paragem.llm import tokens

    texts = [t or "" for t in TEXTS] + ["some words, 12 more; é è  and so on\n" * 50, "<|endoftext|> a b c d e f g " * 9, "日本 a b c " * 30]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    for part, at_once in ((1, 1), (7, 50), (40, 10_000)):
        monkeypatch.setattr(tokens, "PART", part)
        monkeypatch.setattr(tokens, "AT_ONCE", at_once)
        monkeypatch.setattr(tokens, "REMEMBERED", 1000 * part)
        encode = Encoder(PATH)
        assert [i.tolist() for i in encode.ids(texts)] == want


def test_text_of_megabytes(spark):
    rows = [(0, "long text here " * 200_000), (1, None), (2, "x" * 300_000)]
    check(documents(spark, *rows), rows, 1024)


@pytest.mark.parametrize("seed", range(3))
def test_ids_of_texts_with_any_white_space_and_signs(seed):
    rng = random.Random(seed)
    units = [*" \n\t\r'._-12aZéſ", "  ", "\n\n", " word", " l'eau", " it's", "don't", "'ll", "...", " 3.14", "日", "\x0b", "×", "\0", "\x85"]
    texts = ["".join(rng.choices(units[: rng.choice([3, 12, 25, 30])], k=rng.randrange(40))) for _ in range(4000)]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    encode = Encoder(PATH)
    got = [ids.tolist() for at in range(0, len(texts), 500) for ids in encode.ids(texts[at : at + 500])]
    assert got == want


def test_words_of_texts_encoded_together_are_split_once(monkeypatch):
    from paragem.llm import tokens

    class Counted:
        words = 0

        def findall(self, text):
            found = tokens_pattern.findall(text)
            Counted.words += len(found)
            return found

    tokens_pattern = tokens.PRE_TOKEN
    monkeypatch.setattr(tokens, "PRE_TOKEN", Counted())
    encode = Encoder(PATH)
    texts = [f"The same words, again and again: it's number {k % 3}.\n\nNext " * 20 for k in range(50)]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [i.tolist() for i in encode.ids(texts)] == want
    different = {word for text in texts for word in tokens_pattern.findall(text)}
    assert Counted.words < 4 * len(different)  # of 32 100 in all


def test_words_of_many_texts_are_looked_up_once(monkeypatch):
    encoder, looked_up = Encoder(PATH), []
    chunk_ids = encoder._chunk_ids
    monkeypatch.setattr(encoder, "_chunk_ids", lambda chunks: looked_up.extend(chunks) or chunk_ids(chunks))
    rng = random.Random(3)
    words = ["a", "Ġ", "Zebra", "élan", "qxzj" * 9, "the", "don't", "12", "_", "ß", "I"]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(800)]
    plain = Tokenizer.from_file(PATH)
    found = encoder.ids(texts)
    assert len(looked_up) == len(set(looked_up))
    assert all(own.tolist() == plain.encode(t, add_special_tokens=False).ids for own, t in zip(found, texts, strict=True))
