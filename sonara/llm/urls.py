"""URL rules with redirect equivalence.

Pages that redirect to each other or name one canonical address are aliases. A page's own rule decides first. What no rule
fits takes the decision of its class of aliases: allowed if an explicit allow rule fits one of them, else blocked if a block
rule does, else allowed. Classes are connected components over addresses, found by joins (see components.py).
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonara.llm.common import map_arrow, written
from sonara.llm.components import components

#: (verdict, host, path) of the rules in force (fixed values).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Pages of one address are dealt out to so many tasks; answers of aliases are as often.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VALUE = r"""(?:"\s*([^">]*)|'\s*([^'>]*)|([^"'\s>]+))"""
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*""" + _VALUE
_META = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*(?:"([^">]*)|'([^'>]*)|([^\s"'>][^\s>]*(?:\s+url\s*=[^\s>]*)?))"""
_REFRESH_URL = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""


def after_scheme(url: str) -> Column:
    """What follows the first ://; empty for a null url and one without."""
    at = F.locate("://", F.col(url))
    return F.coalesce(F.when(at > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")), F.lit(""))


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, null if none does; of equal lengths the first named."""
    held = F.array(*(F.struct(F.lit(len(h + p)).alias("length"), F.lit(-n).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for n, (v, h, p) in enumerate(rules)))
    fits = F.filter(held, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(fits)


def query_of(url: str) -> Column:
    """The query with its question mark; empty without one."""
    return F.regexp_extract(after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)


def address(host: Column, path: Column, query: Column) -> Column:
    """A page's address without scheme and fragment: the node of the alias graph. Null without a host. Rules read no query."""
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "?", F.lit("")).otherwise(query)))


def address_of(url: str) -> Column:
    return address(host_of(url), path_of(url), query_of(url))


def _targets(column: str, pattern: str) -> Column:
    """What any of a pattern's three ways to write a value took, of all its matches."""
    ways = [F.regexp_extract_all(column, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    return F.flatten(F.array(*ways))


def complete(base: str | None, target: str | None) -> str | None:
    """A target as a whole URL, by the page's URL (RFC 3986); null where there is none."""
    target = html.unescape(target or "").strip()
    if not target or not base or "://" not in base:
        return target if "://" in target.split("?")[0].split("#")[0] else None
    try:
        whole = urljoin(re.sub(r"^[^:/?#]*(?=://)", "http", base), target)
    except ValueError:
        return None
    return whole if "://" in whole.split("?")[0].split("#")[0] else None


def link_edges(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(from_url, to_url) of all canonical links and refresh redirects in the pages' markup; relative targets are completed
    by the page's URL."""
    pages = df.select(df[url_col].cast("string").alias("from_url"), F.coalesce(df[html_col].cast("string"), F.lit("")).alias("html"))
    pages = pages.filter(F.col("html").rlike("(?i)canonical|refresh"))
    refresh = F.transform(_targets("html", _META), lambda x: F.regexp_extract(x, _REFRESH_URL, 1))
    links = pages.select("from_url", F.explode(F.concat(_targets("html", _CANONICAL), refresh)).alias("to")).filter(F.trim("to") != "")

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            found = map(complete, batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield {"from_url": batch.column(0), "to_url": pa.array(list(found), pa.string())}

        return each

    return map_arrow(links, start, "from_url string, to_url string").filter(F.col("to_url").isNotNull())


def judge_urls(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, host, path, rule, verdict) of every row.

    redirects adds edges (from_url, to_url) of a crawl log to those in the markup. A null url and one without :// have
    empty host and path, no rule and no aliases, and are allowed. Repeated rows each get a verdict. Columns besides the
    three are not read.
    """
    edges = link_edges(df, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("from_url", "to_url"))
    ends = edges.select(address_of("from_url").alias("a"), address_of("to_url").alias("b"))
    # addresses are text; components take any ordered type
    classes, _ = written(components(ends, "a", "b"), "aliases")
    pages = df.select(df[id_col].cast("bigint").alias("id"), df[url_col].cast("string").alias("url"))
    pages = pages.select("id", host_of("url").alias("host"), path_of("url").alias("path"), address_of("url").alias("node"))
    pages = pages.select("id", "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("fit"), "node")
    # every address of a class counts, a page of the table or not
    node_host, node_path = F.regexp_extract("node", "^([^/]*)", 1), F.regexp_extract("node", r"(?s)^[^/]*([^?]*)", 1)
    judged = classes.select("node", "component", fitting_rule(node_host, node_path, rules)["verdict"].alias("verdict"))
    of_class = judged.groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    decided = of_class.select("component", F.when(F.col("allowed"), F.lit("allow")).when(F.col("blocked"), F.lit("block")).alias("by_class"))
    by_node = judged.join(decided, "component").select("node", "by_class").filter(F.col("by_class").isNotNull())
    # only pages without a rule need their class, and those without an address have none
    asks = F.col("fit").isNull() & F.col("node").isNotNull()
    salted = pages.filter(asks).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    answers = by_node.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    by_alias = salted.join(answers, ["node", "salt"], "left").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("by_class", F.lit("allow")).alias("verdict"))
    others = pages.filter(~asks).select("id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit("allow")).alias("verdict"))
    return others.unionByName(by_alias).withColumnRenamed("id", id_col)
