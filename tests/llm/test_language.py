import random
import zlib

import numpy as np
from corpus import documents, with_clashing_columns

from paragem.llm import language as L

WORDS = {
    "aa": ["bela", "dona", "mika", "lona"],
    "bb": ["strum", "krent", "wolst", "grimp"],
    "cc": ["üñe", "éça", "îlo", "ûra"],
}


def rows(n=240):
    rng = random.Random(2)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(5, 30))), lang, "s"))
    return out


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_columns(spark):
    data = rows()
    got = {r.doc_id: r for r in L.language_of(documents(spark, *data)).collect()}
    assert all(got[i].held_out == held_out(i) for i, *_ in data)
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang, _ in data if held_out(i))


def test_unknown_texts_nulls_and_long_texts(spark):
    odd = [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 34 !", "bb", "s"), (None, "bela dona", None, None)]
    odd += [(903, "strum krent " * 200_000, None, "s"), (904, "bela", "aa", "s"), (904, "bela", "aa", "s")]
    out = L.language_of(with_clashing_columns(documents(spark, *rows(), *odd)))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == 247
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in out.collect()}
    assert all(got[i][1:] == ("und", 0.0) for i in (900, 901, 902))
    assert got[None][:2] == (False, "aa") and got[903][1] == "bb"


def test_only_texts_outside_the_held_out_fifth_are_learned(spark):
    data = [(i, text, lang if not held_out(i) else "zz", "s") for i, text, lang, _ in rows()]
    model = L.fit(documents(spark, *data))
    assert model.languages == ("aa", "bb", "cc")
    assert L.training_rows(documents(spark, *data), 5).groupBy("lang").count().filter("count <> 5").count() == 0


def test_nothing_to_learn_from(spark):
    docs = documents(spark, (1, "words", None, "s"))
    assert [tuple(r)[2:] for r in L.language_of(docs).collect()] == [("und", 0.0)]
    assert L.language_of(docs.filter("doc_id > 1")).collect() == []


def test_stage_keeps_rows_with_a_language(spark):
    docs = with_clashing_columns(documents(spark, *rows(), (900, "123", "aa", "s"), (901, None, None, None)))
    kept = L.keep_known(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(240))


def test_presence_across_segments(monkeypatch):
    text = b"abcdefghij" * 30
    whole = L.presence([text])
    monkeypatch.setattr(L, "SEGMENT", 7)
    assert (L.presence([text]) == whole).all()


def test_megabytes_of_varied_text_keep_their_language():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    syllables = {k: ["".join(rng.choices(letters, k=2)) for _ in range(40)] for k in ("aa", "bb", "cc", "dd")}

    def prose(lang, n):
        strange = ["".join(rng.choices(letters, k=6)) for _ in range(n // 3)]
        known = ["".join(rng.choices(syllables[lang], k=3)) for _ in range(n - n // 3)]
        words = strange + known
        rng.shuffle(words)
        return " ".join(words)

    rows = [(lang, prose(lang, 150)) for lang in syllables for _ in range(60)]
    model = L.learned(rows)
    for k, lang in enumerate(model.languages):
        short, long = model.scores([prose(lang, L.PART // 7).encode(), prose(lang, 450_000).encode()])
        assert short.argmax() == long.argmax() == k
        assert abs(short[k] - long[k]) < 0.05


def grams(text):
    """Slots of the n-grams of a text, one n-gram after the other."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    out = set()
    for n in range(1, L.LONGEST + 1):
        for at in range(len(raw) - n + 1):
            key = 0
            for b in raw[at : at + n]:
                key = (key * 257 + b + 1) % 2**32
            mixed = (key ^ (key >> 15)) * 0x2C1B3C6D % 2**32
            out.add((mixed ^ (mixed >> 12)) % L.SLOTS)
    return out


def test_scores_against_plain_kernel_ridge_regression():
    """With every text a landmark, the scores are those of ridge regression on the whole kernel."""
    known = sorted((lang, text) for _, text, lang, _ in rows(60))
    new = ["bela strum", "Mika Lona", "krent wolst grimp", "üñe ûra", "x"]
    model = L.learned(known, landmarks=len(known), ridge=0.01)
    own, others = [grams(t) for _, t in known], [grams(t) for t in new]

    def kernel(many, few):
        return np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in few] for a in many])

    target = np.array([[float(lang == name) for name in model.languages] for lang, _ in known])
    weights = np.linalg.solve(kernel(own, own) + 0.01 * len(known) * np.eye(len(known)), target)
    want = kernel(others, own) @ weights
    got = model.scores([t.encode() for t in new])
    assert np.abs(got - want).max() < 1e-3
    assert [model.languages[k] for k in got[1:4].argmax(axis=1)] == ["aa", "bb", "cc"]  # the first is of two


def test_parts_cover_a_text():
    for n in (0, 1, L.PART, L.PART + 1, 5 * L.PART + 3):
        text = bytes(i % 251 for i in range(n))
        cut = list(L.parts(text))
        assert abs(sum(share for _, share in cut) - 1) < 1e-9
        assert all(len(part) <= L.PART + L.LONGEST - 1 for part, _ in cut)
        assert (L.presence([text]) == np.maximum.reduce([L.presence([part]) for part, _ in cut])).all()


def test_a_language_of_long_texts_only_is_learned(spark):
    """Its texts stand in the sample with an excerpt from anywhere; no sampled text passes the bound."""
    rng = random.Random(6)
    long = [(1000 + i, "é1" * rng.randrange(9) + " ".join(rng.choices(WORDS["cc"], k=6000)), "cc", "s") for i in range(12)]
    docs = documents(spark, *[r for r in rows() if r[2] != "cc"], *long)
    picked = L.training_rows(docs).collect()
    assert {r.lang for r in picked} == {"aa", "bb", "cc"}
    assert all(0 < len(r.text.encode()) <= L.SAMPLE_BYTES for r in picked)
    texts = dict((i, t) for i, t, *_ in long)
    assert all(any(r.text in t for t in texts.values()) for r in picked if r.lang == "cc")
    got = {r.doc_id: r.lang_pred for r in L.language_of(docs).collect()}
    assert all(got[i] == "cc" for i in texts)


def test_many_languages_share_the_bounds(spark, monkeypatch):
    monkeypatch.setattr(L, "ALL_SAMPLED", 60)
    monkeypatch.setattr(L, "ALL_LANDMARKS", 7)
    model = L.fit(documents(spark, *rows()))
    assert model.languages == ("aa", "bb", "cc") and model.landmarks.shape[1] == 6
    assert L.shared_out(60, 400, 3) == 20 and L.shared_out(60, 400, 100) == 1 and L.shared_out(60, 10, 0) == 10
    got = {r.doc_id: r.lang_pred for r in L.language_of(documents(spark, *rows())).collect()}
    assert all(got[i] == lang for i, _, lang, _ in rows() if held_out(i))
