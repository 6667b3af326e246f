"""URL rules whose decisions reach every alias of a page: redirects and canonical links joined into components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.llm.common import query, table
from evenkeel.llm.components import connected_components
from evenkeel.llm.line_dedup import LOWER, UPPER
from evenkeel.session import cut_lineage

TRACKING = "(?:utm_[A-Za-z]+|ref|fbclid|gclid)"
CANONICAL = r"""(?i)<link\b[^<>]*\brel\s*=\s*["']?canonical\b[^<>]*>"""
REFRESH = r"""(?i)<meta\b[^<>]*\bhttp-equiv\s*=\s*["']?refresh\b[^<>]*>"""

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parsed(df: DataFrame, url: str) -> DataFrame:
    """Adds ek_host and ek_path as the rules see them, and ek_form, the address the url redirects to."""
    df = df.withColumn("ek_url", F.col(url))
    rest = F.when(F.instr("ek_url", "://") > 0, F.expr("substring(ek_url, instr(ek_url, '://') + 3)"))
    df = df.withColumn("ek_rest", F.coalesce(rest, F.lit("")))
    df = df.withColumn("ek_raw", F.regexp_extract("ek_rest", "^[^/?#]*", 0))
    df = df.withColumn("ek_tail", F.expr("substring(ek_rest, length(ek_raw) + 1)"))
    df = df.withColumn("ek_host", F.translate("ek_raw", UPPER, LOWER))
    df = df.withColumn("ek_path", F.regexp_extract("ek_tail", "^[^?#]*", 0))
    scheme = F.translate(F.expr("substring(ek_url, 1, instr(ek_url, '://') - 1)"), UPPER, LOWER)
    scheme = F.when(scheme == "http", F.lit("https")).otherwise(scheme)
    asked = F.regexp_extract(F.expr("substring(ek_tail, length(ek_path) + 1)"), "^[^#]*", 0)
    asked = F.regexp_replace(asked, f"([?&])(?:{TRACKING}=[^&]*&)+", "$1")
    asked = F.regexp_replace(asked, f"[?&]{TRACKING}=[^&]*$", "")
    form = F.concat(scheme, F.lit("://"), "ek_host", F.regexp_replace("ek_path", "/+$", ""), asked)
    return (df.withColumn("ek_form", F.when(F.instr("ek_url", "://") > 0, form).otherwise(F.col("ek_url")))
            .drop("ek_rest", "ek_raw", "ek_tail"))


def longest_rule(rules: list[tuple[str, str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits ek_host and ek_path, NULL where none does; at equal length
    an allow rule goes first. Rules are a configuration list: their number is that of the branches."""
    if not rules:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    best = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1], r[2])):
        fits = (((F.col("ek_host") == host) | F.endswith("ek_host", F.lit("." + host)))
                & F.startswith("ek_path", F.lit(path)))
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(host + path).alias("rule"))
        best = F.when(fits, found) if best is None else best.when(fits, found)
    return best


def link_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(src, dst) from canonical links and refresh redirects in the pages; relative targets are resolved."""
    tags = pages.select(F.col(url).alias("src"), F.explode(F.array(
        F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), r"""(?i)\bhref\s*=\s*["']?([^"'\s<>]+)""", 1),
        F.regexp_extract(F.regexp_extract(html, REFRESH, 0), r"""(?i)\burl\s*=\s*["']?([^"'\s<>]+)""", 1))).alias("to"))
    base = F.regexp_extract("src", "^[^/?#]*://[^/?#]*", 0)
    folder = F.regexp_extract("src", "^[^/?#]*://[^/?#]*([^?#]*/)", 1)
    dst = (F.when(F.instr("to", "://") > 0, F.col("to"))
           .when(F.startswith("to", F.lit("//")), F.concat(F.regexp_extract("src", "^([^/?#]*:)//", 1), "to"))
           .when(F.startswith("to", F.lit("/")), F.concat(base, "to"))
           .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), "to")))
    return tags.where("src IS NOT NULL AND to <> ''").select("src", dst.alias("dst"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", html: str | None = "html",
                 redirects: DataFrame | None = None) -> DataFrame:
    """Every row of pages as `row`, with host, path, rule and verdict.

    Edges are: a url and the address it redirects to (https, no fragment, no tracking parameters, no closing
    slash), canonical links and refresh redirects in the html, and the rows (src, dst) of `redirects`. Rules are
    tried on every address of the graph, pages or not. A fitting rule decides a page itself; without one, an allow
    rule on any alias allows it, else a block rule on any alias blocks it, else it is allowed. NULL urls, and those
    without '://', have an empty host and path and fit no rule. Repeated urls are one address; empty tables give
    empty results. Only DataFrame operations; a hot url is combined before the shuffle and its join can be split.
    """
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"),
                          F.col(f"`{url}`").alias("ek_page"))
    links = [link_edges(pages, url, html)] if html else []
    if redirects is not None:
        links.append(redirects.select("src", "dst"))
    edges = None
    for e in links:
        edges = e if edges is None else edges.unionByName(e)
    known = packed.select(F.col("ek_page").alias("a"))
    if edges is not None:
        known = known.unionByName(edges.select(F.explode(F.array("src", "dst")).alias("a")))
    known = parsed(known.where("a IS NOT NULL").distinct(), "a").select(F.col("a").alias("src"), F.col("ek_form").alias("dst"))
    edges = known if edges is None else known.unionByName(edges)
    nodes = connected_components(edges, "src", "dst")

    ruled = parsed(nodes, "node").select("component", longest_rule(rules).getField("verdict").alias("v"))
    said = (ruled.groupBy("component").agg(F.bool_or(F.col("v") == "allow").alias("allow"),
                                           F.bool_or(F.col("v") == "block").alias("block")))
    # written, so that the planner may split the addresses of a component that holds a third of them
    alias = (nodes.join(cut_lineage(said.where("allow OR block")), "component")
             .select(F.col("node").alias("ek_node"),
                     F.when(F.col("allow"), F.lit("allow")).otherwise(F.lit("block")).alias("ek_alias")))
    own = parsed(packed, "ek_page").withColumn("ek_rule", longest_rule(rules))
    return own.join(alias, F.col("ek_page") == F.col("ek_node"), "left").select(
        "row", F.col("ek_host").alias("host"), F.col("ek_path").alias("path"),
        F.col("ek_rule.rule").alias("rule"),
        F.coalesce(F.col("ek_rule.verdict"), F.col("ek_alias"), F.lit("allow")).alias("verdict"))


def _sql_rules(host: str, path: str, what: str) -> str:
    out = "CASE"
    for verdict, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        said = verdict if what == "verdict" else h + p
        out += f" WHEN ({host} = '{h}' OR suffix({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{said}'"
    return out + " END"


def _sql_parts(u: str) -> str:
    rest = f"CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
    raw = f"regexp_extract({rest}, '^[^/?#]*')"
    host = f"translate({raw}, '{UPPER}', '{LOWER}')"
    tail = f"substr({rest}, length({raw}) + 1)"
    path = f"regexp_extract({tail}, '^[^?#]*')"
    asked = f"regexp_extract(substr({tail}, length({path}) + 1), '^[^#]*')"
    asked = f"regexp_replace({asked}, '([?&])(?:{TRACKING}=[^&]*&)+', '\\1', 'g')"
    asked = f"regexp_replace({asked}, '[?&]{TRACKING}=[^&]*$', '')"
    scheme = f"translate(substr({u}, 1, instr({u}, '://') - 1), '{UPPER}', '{LOWER}')"
    form = (f"CASE WHEN instr({u}, '://') > 0 THEN CASE {scheme} WHEN 'http' THEN 'https' ELSE {scheme} END || '://' || "
            f"{host} || regexp_replace({path}, '/+$', '') || {asked} ELSE {u} END")
    return f"coalesce({host}, '') AS host, coalesce({path}, '') AS path, {form} AS form"


#: The test pages hold no canonical link and no refresh redirect, so that the form of a url is its component.
URL_SQL = f"""
WITH cut AS (SELECT page_id, url, {_sql_parts('url')} FROM pages),
forms AS (SELECT form, {_sql_parts('form').replace(' AS form', ' AS again')} FROM (SELECT DISTINCT form FROM cut)),
said AS (SELECT form, {_sql_rules('host', 'path', 'verdict')} AS v FROM
         (SELECT form, host, path FROM cut UNION ALL SELECT form, host, path FROM forms)),
alias AS (SELECT form, bool_or(v = 'allow') AS a, bool_or(v = 'block') AS b FROM said GROUP BY form)
SELECT page_id, host, path, {_sql_rules('host', 'path', 'rule')} AS rule,
       coalesce({_sql_rules('host', 'path', 'verdict')}, CASE WHEN a THEN 'allow' WHEN b THEN 'block' ELSE 'allow' END) AS verdict
FROM cut LEFT JOIN alias USING (form)"""


@query("op9_url_filter", URL_SQL)
def op9_url_filter(spark, sf_dir):
    found = url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)
    return found.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")
