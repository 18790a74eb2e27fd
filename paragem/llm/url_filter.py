"""URL rules whose block decisions follow redirects and canonical links, in DataFrame functions only.

A page and the address that its canonical link or refresh names are aliases. Aliases form
classes, the connected components of these links. A rule that fits a page's own address
decides alone. Any other page follows its class: allowed if a rule allows an address of the
class, else blocked if a rule blocks one, else allowed.

The address of a url is its host, path and query; scheme and fragment do not tell addresses
apart. Rules meet hosts, not urls: each distinct host is joined with the rules of its parent
domains once, so a host with very many urls costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paragem.llm.components import components
from paragem.llm.tables import LOWER, UPPER, lower_ascii
from paragem.session import stage

ALLOW, BLOCK = "allow", "block"
RULES = [
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
]
RULE_SCHEMA = "host string, path string, verdict string"

#: Host, path and query of what follows the first ``://``; Spark's ``.`` needs (?s) to pass line breaks.
AFTER_SCHEME = r"(?s)^.*?://(.*)$"
HOST, PATH, QUERY = r"^[^/?#]*", r"^[^?#]*", r"^[^?#]*(\?[^#]*)?"

TAG = r"(?i)<(?:link|meta)\b[^>]*>"
#: What a reader of the page does not follow.
UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script"
CANONICAL = r"""(?i)^<link\b.*\srel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s>/])"""
HREF = r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH = r"""(?i)^<meta\b.*\shttp-equiv\s*=\s*["']?refresh\b"""
CONTENT = r"""(?i)\scontent\s*=\s*(?:"[^"]*?url\s*=\s*['\s]*([^"']*)|'[^']*?url\s*=\s*["\s]*([^'"]*))"""


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for a null and for a text without it."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), AFTER_SCHEME, 1)


def host_of(rest: Column) -> Column:
    return lower_ascii(F.regexp_extract(rest, HOST, 0))


def path_of(rest: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(rest, HOST, ""), PATH, 0)


def address_of(rest: Column) -> Column:
    """Host, path and query; an empty path counts as ``/``. Null where there is no host."""
    after = F.regexp_extract(F.regexp_replace(rest, HOST, ""), QUERY, 0)
    path = F.when(after.startswith("/"), after).otherwise(F.concat(F.lit("/"), after))
    return F.when(host_of(rest) != "", F.concat(host_of(rest), path))


def _first_group(text: Column, pattern: str, groups: int) -> Column:
    return F.trim(F.concat(*[F.regexp_extract(text, pattern, k) for k in range(1, groups + 1)]))


def link_targets(html: Column) -> Column:
    """The addresses, as written, that canonical links and refreshes of ``html`` name."""
    tags = F.regexp_extract_all(F.regexp_replace(html, UNREAD, ""), F.lit(TAG), F.lit(0))
    named = F.transform(
        tags,
        lambda tag: F.when(tag.rlike(CANONICAL), _first_group(tag, HREF, 3)).when(
            tag.rlike(REFRESH), _first_group(tag, CONTENT, 2)
        ),
    )
    plain = F.transform(F.filter(named, lambda x: x.isNotNull() & (x != "")), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    # Most pages have neither; their tags are not cut out.
    likely = F.lower(html).contains("canonical") | F.lower(html).contains("http-equiv")
    return F.when(likely, plain).otherwise(F.array().cast("array<string>"))


def without_dots(path: Column) -> Column:
    """``path`` with its ``.`` and ``..`` steps taken."""
    steps = F.slice(F.split(path, "/"), 2, 1 << 30)
    last = F.element_at(steps, -1)
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, step: F.when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(step == ".", done)
        .otherwise(F.concat(done, F.array(step))),
    )
    folder = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), folder)


def resolved(target: Column, rest: Column) -> Column:
    """What follows the scheme in ``target`` as named by a page whose own url has ``rest`` after it.

    Null where the target is no web address (``mailto:`` and the like).
    """
    host = F.regexp_extract(rest, HOST, 0)
    path = path_of(rest)
    folder = F.concat(F.regexp_extract(path, r"^(.*)/", 1), F.lit("/"))
    steps = F.regexp_extract(target, PATH, 0)
    query = F.regexp_extract(F.regexp_replace(target, PATH, ""), QUERY, 0)
    joined = (
        F.when(target.rlike(r"(?i)^https?://"), F.regexp_extract(target, AFTER_SCHEME, 1))
        .when(target.startswith("//"), F.substr(target, F.lit(3)))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("/"), F.concat(host, without_dots(steps), query))
        .when(target.startswith("?"), F.concat(host, path, target))
        .when(target.startswith("#"), F.lit(None))
        .otherwise(F.concat(host, without_dots(F.concat(folder, steps)), query))
    )
    return F.when(host != "", joined).when(target.rlike(r"(?i)^https?://"), joined)


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of each of the distinct ``hosts`` and of its parent domains."""
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).head()[0] or 1
    names = F.split("host", r"\.")
    depth = F.least(F.size(names), F.lit(most))
    domains = F.transform(
        F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(names, F.size(names) - k + 1, k), ".")
    )
    named = rules.select(
        F.col("host").alias("domain"),
        # Compared field by field: the longest rule wins, of equally long ones the longest host, then allow.
        F.struct(
            F.length(F.concat("host", "path")).alias("length"),
            F.length("host").alias("host_length"),
            (F.col("verdict") == ALLOW).alias("allows"),
            "path",
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("rule"),
    )
    fitting = hosts.select("host", F.explode(domains).alias("domain")).join(named, "domain")
    return fitting.groupBy("host").agg(F.collect_list("rule").alias("rules"))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, others) with ``rule`` and ``verdict`` of the longest fitting rule, else nulls."""
    fitting = rules_by_host(urls.select("host").distinct(), rules)
    path = F.col("path")
    best = F.array_max(F.filter("rules", lambda r: path.startswith(r["path"])))
    return (
        urls.join(fitting, "host", "left")
        .withColumn("best", best)
        .select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )


def alias_links(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(a, b): addresses linked by ``pages`` (rest, targets) and ``redirects`` (from_url, to_url)."""
    target = F.explode("targets").alias("target")
    links = pages.filter(F.size("targets") > 0).select("rest", target)
    links = links.select(F.col("rest").alias("rest_a"), resolved(F.col("target"), F.col("rest")).alias("rest_b"))
    if redirects is not None:
        moved = redirects.select(
            after_scheme(F.col("from_url")).alias("rest_a"),
            resolved(F.trim("to_url"), after_scheme(F.col("from_url"))).alias("rest_b"),
        )
        links = links.union(moved)
    a, b = address_of(F.col("rest_a")).alias("a"), address_of(F.col("rest_b")).alias("b")
    return links.select(a, b).filter("a is not null and b is not null")


def class_verdicts(links: DataFrame, rules: DataFrame) -> DataFrame:
    """(address, alias_class, allowed, blocked) for each linked address; the flags hold for its whole class."""
    address = F.explode(F.array("a", "b")).alias("address")
    known = links.select(address).distinct()
    known = known.select("address", host_of(F.col("address")).alias("host"), path_of(F.col("address")).alias("path"))
    rooted = ruled(known, rules).join(components(links).toDF("address", "root"), "address", "left")
    rooted = stage(rooted.select("address", F.coalesce("root", "address").alias("root"), "verdict"), "aliases")
    flags = rooted.groupBy("root").agg(
        F.min("address").alias("alias_class"),
        F.coalesce(F.bool_or(F.col("verdict") == ALLOW), F.lit(False)).alias("allowed"),
        F.coalesce(F.bool_or(F.col("verdict") == BLOCK), F.lit(False)).alias("blocked"),
    )
    return rooted.select("address", "root").join(flags, "root").drop("root")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, alias_class, decided_by.

    ``rules`` has host, path and verdict (allow or block) and fits a host and its
    subdomains where the path starts with the rule's; the longest wins, of equal ones
    the one with the longer host, then allow. ``redirects`` (from_url, to_url) adds links
    to those the pages hold. ``decided_by`` is ``rule``, ``class`` or ``default``;
    ``alias_class`` is the first address of the class, null for a page without links.

    A null url, one without ``://`` and one without a host fit no rule, are in no class
    and are allowed. A null html holds no links; base elements are not read. Repeated rows
    come back once each, null ids too; other columns are not read. Without rules, or
    without pages, nothing is blocked. The length of a url or a html is not bounded.
    """
    rest, targets = after_scheme(F.col("url")).alias("rest"), link_targets(F.col("html")).alias("targets")
    parsed = pages.select("page_id", rest, targets)
    parts = {"host": host_of(F.col("rest")), "path": path_of(F.col("rest")), "address": address_of(F.col("rest"))}
    parsed = stage(parsed.withColumns(parts), "urls")
    own = ruled(parsed.select("page_id", "host", "path", "address"), rules)
    links = stage(alias_links(parsed.select("rest", "targets"), redirects), "alias-links")
    if links.isEmpty():
        nothing = {"alias_class": F.lit(None).cast("string"), "allowed": F.lit(False), "blocked": F.lit(False)}
        joined = own.withColumns(nothing)
    else:
        joined = own.join(stage(class_verdicts(links, rules), "class-verdicts"), "address", "left")
    follows = F.when(F.col("allowed"), F.lit(ALLOW)).when(F.col("blocked"), F.lit(BLOCK))
    by = F.when(F.col("verdict").isNotNull(), "rule").when(follows.isNotNull(), "class").otherwise("default")
    verdict = F.coalesce("verdict", follows, F.lit(ALLOW))
    return joined.select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "alias_class", by.alias("decided_by")
    )


def judge_sql() -> str:
    """``judge`` of ``pages`` under RULES; of the links, canonical ones with a quoted absolute address."""
    rules = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
    after = "regexp_extract({0}, '^[^/?#]*([^?#]*([?][^#]*)?)', 1)"
    host = f"translate(regexp_extract({{0}}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
    address = (
        f"CASE WHEN {host} <> '' THEN {host} || CASE WHEN {after} LIKE '/%' THEN '' ELSE '/' END || {after} END"
    )
    path = "regexp_extract({0}, '^[^/?#]*([^?#]*)', 1)"
    best = """(SELECT max(struct_pack(n := length(r.host || r.path), h := length(r.host), y := r.verdict = 'allow',
                      rule := r.host || r.path, verdict := r.verdict))
               FROM rules r WHERE (x.host = r.host OR suffix(x.host, '.' || r.host)) AND prefix(x.path, r.path))"""
    return rf"""
WITH RECURSIVE rules(host, path, verdict) AS (VALUES {rules}),
p AS (SELECT page_id, coalesce(html, '') AS html,
             CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
x AS (SELECT page_id, html, {host.format("rest")} AS host, {path.format("rest")} AS path,
             {address.format("rest")} AS address FROM p),
own AS (SELECT *, {best} AS best FROM x),
tags AS (SELECT address, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script', '', 'g'),
                                '(?i)<link\b[^>]*>')) AS tag FROM x WHERE html ILIKE '%canonical%'),
named AS (SELECT address AS a, replace(regexp_extract(tag, '(?i)\shref\s*=\s*"\s*https?://([^"]*)"', 1), '&amp;', '&') AS rest
          FROM tags WHERE regexp_matches(tag, '(?i)\srel\s*=\s*"([^"]*\s)?canonical(\s[^"]*)?"')),
links AS (SELECT a, {address.format("trim(rest)")} AS b FROM named WHERE a IS NOT NULL),
ends AS (SELECT a, b FROM links WHERE b IS NOT NULL UNION SELECT b, a FROM links WHERE b IS NOT NULL),
reach(a, b) AS (SELECT a, a FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b),
x2 AS (SELECT a, b AS address, {host.format("b")} AS host, {path.format("b")} AS path FROM reach),
told AS (SELECT a, address, {best.replace("x.", "x2.")}.verdict AS verdict FROM x2),
classes AS (SELECT a, min(address) AS alias_class, bool_or(verdict = 'allow') AS allowed,
                   bool_or(verdict = 'block') AS blocked FROM told GROUP BY a)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict,
       alias_class,
       CASE WHEN best.verdict IS NOT NULL THEN 'rule' WHEN coalesce(allowed, false) OR coalesce(blocked, false) THEN 'class'
            ELSE 'default' END AS decided_by
FROM own LEFT JOIN classes ON own.address = classes.a
"""
