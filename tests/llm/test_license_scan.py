import random

import duckdb
from corpus import documents, with_clashing_columns

from paragem.llm import license_scan as L

TEXTS = [
    None, "", "...", "MIT License and mit-license, MITLICENSE mit é license", "The Apache  License; General PUBLIC license.",
    "licensed under the Apache thing version 2 0", "reserved all rights", "Licensed under CC BY-NC 4.0.",
    "x " * 14 + "released under the MIT licence", "mit " * 40 + "license", " mit license",
    "permission is hereby granted free charge any person obtaining copy",
]


def random_texts(n):
    rng = random.Random(9)
    words = sorted({w.decode() for t in L.TEMPLATES for w in L.words_of(t)})
    return [" ".join(rng.choices([*words, "other", "wörter"], k=rng.randrange(120))) for _ in range(n)]


def test_against_sql_on_awkward_texts(spark, tmp_path):
    rows = [*enumerate(TEXTS + random_texts(150)), (None, "mit license"), (3, TEXTS[3]), (3, TEXTS[3])]
    docs = documents(spark, *rows)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    out = L.scan(with_clashing_columns(docs))
    want = con.sql(f"SELECT {', '.join(out.columns)} FROM ({L.scan_sql()})").fetchall()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_known_places(spark):
    got = {r.doc_id: tuple(r)[1:] for r in L.scan(documents(spark, *TEXTS)).collect()}
    assert got[0] == got[1] == got[2] == (0, 0, None, None, "", "", 0.0)
    assert got[3][1:5] == (2, 0, 3, "mit")
    assert got[4][1:5] == (2, 1, 3, "apache,gpl")
    assert got[6][5:] == ("reserved", 1.0) and got[7][5:] == ("cc-by-nc", 1.0)
    assert got[9][1:4] == (1, 39, 39)
    assert L.scan(documents(spark, "a").filter("doc_id > 0")).collect() == []


def test_filters_lose_no_block():
    index = L.TemplateIndex(L.TEMPLATES, {}, L.THRESHOLD)
    for text in random_texts(300):
        words = L.words_of(text)
        for block in [set(words[at : at + 32]) for at in range(0, len(words), 16)]:
            every = {
                (label, len(parts & block) / len(parts))
                for parts, label in ((frozenset(L.words_of(t)), label) for t, label in L.TEMPLATES.items())
                if len(parts & block) >= L.needed(len(parts), L.THRESHOLD)
            }
            assert set(index.matches(block)) == every


def test_whole_licenses_in_long_texts(spark):
    """A licence anywhere in a text is found, with a tenth of its words replaced too; half of it is not."""
    rng = random.Random(5)
    filler = [f"filler{i}" for i in range(5000)]
    whole = {t: label for t, label in L.TEMPLATES.items() if len(L.words_of(t)) > L.BLOCK}
    assert max(L.block_words(t) for t in whole) > 256
    rows, want = [], {}
    for k, (template, label) in enumerate(whole.items()):
        words = [w.decode() for w in L.words_of(template)]
        worn = [f"x{i}" if i % 10 == 3 else w for i, w in enumerate(words)]
        for j, inside in enumerate((words, worn, words[: len(words) // 2])):
            before, after = (rng.choices(filler, k=rng.randrange(900)) for _ in range(2))
            rows.append((10 * k + j, " ".join([*before, *inside, *after])))
            want[10 * k + j] = label if j < 2 else None
    got = {r.doc_id: r for r in L.scan(documents(spark, *rows), phrases={}, templates=whole).collect()}
    assert {i: r.labels or None for i, r in got.items()} == want
    assert all((r.score >= L.THRESHOLD) == bool(want[i]) for i, r in got.items())


def test_blocks_follow_the_template(spark):
    """A copy lies inside one block wherever it begins, and blocks of megabytes of text are all looked at."""
    template = " ".join(f"w{i}" for i in range(100))
    assert L.block_words(template) == 256 and L.block_words("all rights reserved") == L.BLOCK
    rows = [(n, "x " * n + template + " y" * 50) for n in (0, 1, 127, 128, 129, 300)]
    rows.append((1000, "x " * 2_000_000 + template))
    out = L.scan(documents(spark, *rows), phrases={}, templates={template: "t"}, threshold=1.0).collect()
    assert all(r.labels == "t" and r.score == 1.0 for r in out) and len(out) == 7
