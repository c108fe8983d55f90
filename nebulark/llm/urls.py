"""URL filters by host-suffix and path-prefix expressions.

Each URL is expanded into the expressions that a rule could have been written for; these meet the rules by a short prefix
of their digests, are confirmed by the full digest, and the longest confirmed rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.llm.common import stash

#: Bytes of a digest on which rules and expressions are joined.
PREFIX_BYTES = 4
#: Rules that are broadcast, about 20 MB; a longer list is joined by a shuffle on the prefix.
BROADCAST_RULES = 200_000


def rules(spark: SparkSession, listed: list[tuple[str, str]]) -> DataFrame:
    """host, path and verdict of rules given as (verdict, host with path)."""
    rows = [(rule[: rule.find("/")] if "/" in rule else rule, rule[rule.find("/") :] if "/" in rule else "", verdict) for verdict, rule in listed]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A to Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end; empty if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column, most: int) -> Column:
    """The host and the domains that it belongs to, of `most` labels at most."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def prefixes(path: Column, most: int, lengths: list[int]) -> Column:
    """The empty prefix, those that end with one of the first `most` slashes, and those of the given lengths."""
    parts = F.split(path, "/", most + 1)
    ended = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    found = F.concat(F.array(F.lit("")), F.coalesce(ended, F.array().cast("array<string>")))
    if lengths:
        cut = F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(F.length(path) >= n, F.substr(path, F.lit(1), n)))
        found = F.concat(found, F.filter(cut, lambda x: x.isNotNull()))
    return F.array_distinct(found)


def digested(expression: Column) -> list[Column]:
    """The digest of an expression and its first bytes, as columns digest and prefix."""
    digest = F.sha2(expression.cast("binary"), 256)
    return [F.unhex(digest).alias("digest"), F.substring(digest, 1, 2 * PREFIX_BYTES).alias("prefix")]


def compiled(listed: DataFrame) -> DataFrame:
    """One row a rule with rule, verdict, digest and prefix; of a rule listed with several verdicts the greatest stays.

    Rules that can fit no URL, without a host or with a path that doesn't start with a slash, are left out.
    """
    host, path = F.col("host"), F.coalesce("path", F.lit(""))
    ok = listed.where((F.coalesce(host, F.lit("")) != "") & ((path == "") | path.startswith("/")) & F.col("verdict").isNotNull())
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = ok.groupBy(lower.alias("host"), path.alias("path")).agg(F.max("verdict").alias("verdict"))
    return each.select("host", "path", F.concat("host", "path").alias("rule"), "verdict", *digested(F.concat("host", "path")))


def judge(pages: DataFrame, listed: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict of each URL.

    listed: host, path and verdict of each rule. A rule fits its host and all subdomains if the URL's path starts with the
    rule's path, by characters. Of the rules that fit, the one with the most characters decides, then the one with the
    longer host; a rule listed with several verdicts has the greatest of them (block before allow). Where none fits, rule
    is null and the verdict `default`. A URL that is null or has no :// has an empty host and path, which no rule fits.
    Each distinct URL is judged once, and repeated rows come back as often as they were; other columns of pages stay,
    those named as the result are replaced.

    A URL has as many expressions as the rules need and no more: host suffixes of up to the labels of the longest rule's
    host, path prefixes that end with a slash up to the slashes of the deepest rule, and prefixes of the lengths of those
    rules' paths that end with something else.
    """
    made = ["host", "path", "rule", "verdict"]
    book = stash(compiled(listed))
    slashes = F.size(F.split("path", "/")) - 1
    ragged = F.when((F.col("path") != "") & ~F.col("path").endswith("/"), F.length("path"))
    n, labels, deepest, lengths = book.agg(F.count("*"), F.max(F.size(F.split("host", r"\."))), F.max(slashes), F.sort_array(F.collect_set(ragged))).first()
    parsed = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    urls = parsed.select("host", "path").where(F.col("host") != "").distinct()
    every = F.explode(F.flatten(F.transform(suffixes(F.col("host"), labels or 1), lambda h: F.transform(prefixes(F.col("path"), deepest or 0, lengths or []), lambda p: F.concat(h, p)))))
    expressions = urls.select("host", "path", every.alias("expression")).select("host", "path", *digested(F.col("expression")))
    named = book.select("prefix", F.col("digest").alias("full"), "rule", "verdict", F.struct(F.length("rule").alias("n"), F.length("host").alias("m"), "rule", "verdict").alias("weight")).drop("rule", "verdict")
    met = expressions.join(F.broadcast(named) if n <= BROADCAST_RULES else named, "prefix").where(F.col("digest") == F.col("full"))
    # Written, so that both sides of the last join are plain shuffles and Spark can split a URL that many pages share.
    best = stash(met.groupBy("host", "path").agg(F.max("weight").alias("__best")))
    keep = [c for c in pages.columns if c not in made]
    return parsed.join(best, ["host", "path"], "left").select(*keep, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))
