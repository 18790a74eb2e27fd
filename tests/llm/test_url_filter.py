"""URL rules and classes of aliases against plain Python."""

import re
from urllib.parse import urljoin, urlsplit

import pytest
from compare import connect, rows_of

from paragem.llm import url_filter
from paragem.llm.queries import op12_url_filter

SCHEMA = "page_id long, url string, html string"


def canonical(target):
    return f'<html><link href="{target}" rel="canonical"></html>'


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    query = rest[len(host) + len(path) :].split("#")[0]
    return host.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), path, query


def address(url):
    host, path, query = parts(url)
    return host + ("" if path.startswith("/") else "/") + path + query if host else None


def plain_rule(host, path):
    fits = [
        (len(h + p), len(h), v == "allow", h + p, v)
        for h, p, v in url_filter.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[3:] if fits else (None, None)


def plain_judge(rows, links):
    """``links``: pairs of absolute urls."""
    member = {}
    for a, b in links:
        if address(a) is None or address(b) is None:
            continue
        joined = member.get(address(a), {address(a)}) | member.get(address(b), {address(b)})
        member.update(dict.fromkeys(joined, joined))
    out = []
    for page_id, url in rows:
        host, path, _ = parts(url)
        rule, verdict = plain_rule(host, path)
        own = member.get(address(url), set())
        told = {plain_rule(*parts("x://" + a)[:2])[1] for a in own} - {None}
        by = "rule" if verdict else "class" if told else "default"
        verdict = verdict or ("allow" if "allow" in told or not told else "block")
        out.append((page_id, host, path, rule, verdict, min(own, default=None), by))
    return sorted(out, key=repr)


def judged(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_random_links_equal_plain_python(spark):
    import random

    rng = random.Random(5)
    hosts = ["a.org", "www.example.com", "b.net", "c.b.net", "example.com", "x.example.com", "d.org:80", "E.ORG"]
    paths = ["", "/", "/en/1", "/es/2", "/fr/", "/en", "/q/r", "/q/r/s"]
    url = lambda: f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=1', '#x'])}"
    rows, links = [], []
    for i in range(150):
        own, html = url(), None
        if i % 2:
            target = rng.choice([url(), "../z", "/en/9", "s?t=2", "./", "//k.org/v"])
            html = canonical(target)
            whole = urljoin(own, target)
            links.append((own, whole if urlsplit(whole).path else whole))
        rows.append((i, own, html))
    got = judged(url_filter.judge(spark.createDataFrame(rows, SCHEMA), url_filter.rules_table(spark)))
    assert got == plain_judge([r[:2] for r in rows], links)


def test_block_passes_over_a_chain_and_allow_goes_before(spark):
    pages = [
        (0, "https://a.org/1", canonical("https://b.org/2")),
        (1, "https://b.org/2", '<meta http-equiv="refresh" content="0; url=http://c.net/es/3">'),
        (2, "https://c.net/es/3", None),
        (3, "https://d.org/1", canonical("https://e.com/")),
        (4, "https://d.org/2", canonical("https://d.org/1")),
        (5, "https://f.net/fr/", canonical("https://d.org/1")),
    ]
    got = {r[0]: (r[4], r[6]) for r in judged(url_filter.judge(spark.createDataFrame(pages, SCHEMA), url_filter.rules_table(spark)))}
    assert got == {
        0: ("block", "class"), 1: ("block", "class"), 2: ("block", "rule"),
        3: ("allow", "class"), 4: ("allow", "class"), 5: ("block", "rule"),
    }


def test_redirect_table(spark):
    pages = spark.createDataFrame([(0, "http://a.org/x", None), (1, "http://a.org/y", None)], SCHEMA)
    moved = spark.createDataFrame(
        [("http://a.org/x", "http://b.net/es/"), (None, "http://b.net/es/"), ("http://a.org/y", None)],
        "from_url string, to_url string",
    )
    got = judged(url_filter.judge(pages, url_filter.rules_table(spark), moved))
    assert [r[4] for r in got] == ["block", "allow"]


def test_links_that_are_not_followed(spark):
    htmls = [
        "<!-- " + canonical("http://b.net/es/") + " -->",
        "<script>x='" + canonical("http://b.net/es/") + "'</script>",
        canonical("mailto:x@b.net"),
        canonical("#top"),
        canonical(""),
        '<link rel="stylesheet" href="http://b.net/es/">',
        '<link rel="canonical">',
        '<link data-rel="canonical" href="http://b.net/es/">',
        "<link rel='canonical' href='http://b.net/es/",
    ]
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", h) for i, h in enumerate(htmls)], SCHEMA)
    got = judged(url_filter.judge(pages, url_filter.rules_table(spark)))
    assert {(r[4], r[6]) for r in got} == {("allow", "default")}


def test_nulls_long_texts_repeats_and_clashing_columns(spark):
    long = "http://" + "a." * 50_000 + "com/" + "p" * 1_000_000
    html = "<p>" * 300_000 + canonical("http://b.net/es/") + "x" * 2_000_000
    rows = [(0, long, html), (0, long, html), (None, None, None), (1, "", ""), (2, "://", canonical("http://b.net/es/"))]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "'x' AS host", "'x' AS rule", "'x' AS address", "'x' AS root", "'x' AS targets", "'x' AS best"
    )
    got = judged(url_filter.judge(pages, url_filter.rules_table(spark)))
    assert len(got) == 5
    by_id = {r[0]: r for r in got}
    assert by_id[0][3:] == ("com/", "allow", min(address(long), "b.net/es/"), "rule")
    assert by_id[None][1:] == by_id[1][1:] == by_id[2][1:] == ("", "", None, "allow", None, "default")


@pytest.mark.parametrize("rules", [[], url_filter.RULES])
def test_empty_tables(spark, rules):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(0, "http://b.net/es/", canonical("http://a.com/"))], SCHEMA)
    assert url_filter.judge(none, url_filter.rules_table(spark, rules)).count() == 0
    assert judged(url_filter.judge(one, url_filter.rules_table(spark, rules)))[0][4] == ("block" if rules else "allow")


def test_no_python_worker_in_the_plan(spark, tmp_path):
    pages = spark.createDataFrame([(0, "http://a.org/1", canonical("http://b.net/es/"))], SCHEMA)
    plan = url_filter.judge(pages, url_filter.rules_table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_query_equals_its_sql_with_links(spark, tmp_path):
    rows = [(i, f"https://h{i % 7}.{'net' if i % 3 else 'org'}/{'es' if i % 2 else 'it'}/{i}", None) for i in range(40)]
    rows += [(40 + i, f"http://z{i}.org/", canonical(f"https://h{i % 7}.net/es/{i}?a=1")) for i in range(20)]
    rows += [(60 + i, f"http://y{i}.org/?b", canonical(f"http://z{i}.org/")) for i in range(20)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    con = connect("/none")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    result = con.execute(url_filter.judge_sql())
    want = rows_of([d[0] for d in result.description], result.fetchall())
    df = op12_url_filter(spark, str(tmp_path))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
