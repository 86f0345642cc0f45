"""URL filter: host-suffix and path-prefix expressions looked up by hash.

Every URL is expanded into expressions (a suffix of its host's labels, a prefix of its path),
for exactly the shapes (label count, path length) that some rule has: no other expression can
match. Expressions and rules meet in an equi-join on a 4-byte prefix of their SHA-256; the
full digest then confirms, and the longest rule of a URL wins (ties: block before allow).
Built-in functions only; the html column is never read. URLs are judged once each and expressions looked up once
each, both counted, so that those with a third of all rows add no work and their rows are not
brought together; a URL's expressions are bounded by the shapes.

Defined results: null, empty or scheme-less urls have an empty host and path, fit no rule and
get the default verdict; repeated rows give repeated results; an empty table an empty result;
an empty rule set gives every url the default. A rule's empty path fits any path. Columns
other than page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import join_hot, materialize

#: hot urls and expressions, whose rows are broadcast
HOT_URLS = 1 << 12
#: (action, host, path)
DEFAULT_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def compile_rules(rules: DataFrame) -> DataFrame:
    """rules (action, host, path) with their text, shape, digest and digest prefix."""
    r = rules.select("action", F.translate("host", _UPPER, _LOWER).alias("host"), "path")
    r = r.withColumn("rule", F.concat("host", "path")).withColumn("labels", F.size(F.split("host", r"\.")))
    r = r.withColumn("path_len", F.length("path")).withColumn("digest", _digest(F.col("host"), F.col("path")))
    return r.withColumn("short", F.substring("digest", 1, 8))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for every row of pages."""
    compiled = compile_rules(rules)
    shapes = compiled.select("labels", "path_len").distinct().agg(F.collect_set(F.struct("labels", "path_len")).alias("shapes"))  # bounded by labels x path lengths
    urls = pages.where("url is not null").groupBy("url").agg(F.count("*").alias("n"))
    urls = materialize(urls.select("url", "n", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''"), "url-hosts")
    labels = F.size(F.split("host", r"\."))
    suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("s.labels"))
    prefix = F.substring(F.col("path"), F.lit(1), F.col("s.path_len"))
    expanded = (
        urls.crossJoin(F.broadcast(shapes))  # one row of shapes
        .select("url", "n", "host", "path", F.explode("shapes").alias("s"))
        .where((F.col("s.labels") <= labels) & (F.col("s.path_len") <= F.length("path")))
        .select("url", "n", _digest(suffix, prefix).alias("u_digest"))
    )
    rank = lambda r, a: F.struct(F.length(r), (F.col(a) == "block").cast("int"), F.col(r))
    asked = expanded.groupBy("u_digest").agg(F.count("*").alias("w")).withColumn("short", F.substring("u_digest", 1, 8))
    known = asked.join(compiled, "short").where("u_digest = digest").groupBy("u_digest").agg(F.max_by(F.struct("rule", "action"), rank("rule", "action")).alias("win"), F.max("w").alias("w"))
    hits = join_hot(expanded, materialize(known, "url-known", True), "u_digest", "w", most=HOT_URLS)
    verdicts = hits.groupBy("url").agg(F.max_by("win", rank("win.rule", "win.action")).alias("win"), F.max("n").alias("w"))
    judged = join_hot(pages.select("page_id", "url"), materialize(verdicts, "url-verdicts", True), "url", "w", "left", HOT_URLS)
    return judged.select(
        "page_id", "url",
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
        F.col("win.rule").alias("rule"),
        F.coalesce("win.action", F.lit(default)).alias("verdict"),
    )
