"""URL filters: host-suffix and path-prefix expressions joined with a rule table.

A URL becomes the expressions that a rule could be written as: the suffixes of
its host with as many labels as some rule has, with the prefixes of its path of a
length that some rule has. Expressions meet rules in an equi-join on the first bytes of a digest;
the full digest confirms a meeting, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PREFIX_DIGITS = 8
SALTS = 16


class UrlRule(NamedTuple):
    """Fits `host` and its subdomains where the url's path starts with `path`."""

    verdict: str
    host: str
    path: str


RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def rule_table(spark: SparkSession, rules: Iterable[UrlRule] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def url_host(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def _key(host: Column, path: Column) -> Column:
    # A host holds no slash, so the text is as good as the pair.
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Suffixes and prefixes of the sizes that rules have, so linear in the url."""
    n_labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.array_compact(
        F.array(*(F.when(n_labels >= k, F.substring_index(host, ".", -k)) for k in labels))
        if labels
        else F.array().cast("array<string>")
    )
    fitting = F.filter(
        F.array(*(F.lit(n) for n in lengths)).cast("array<int>"),
        lambda n: n <= F.length(path),
    )
    pairs = F.transform(
        suffixes,
        lambda s: F.transform(
            fitting,
            lambda n: F.struct(s.alias("host"), F.substring(path, F.lit(1), n).alias("path")),
        ),
    )
    return F.flatten(pairs)


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id: str = "page_id",
    url: str = "url",
    default: str = "allow",
    salts: int = SALTS,
) -> DataFrame:
    """page_id, url, host, path, rule and verdict for every row of `pages`.

    Among the rules that fit, the longest text of host and path wins, then the
    longer host, then "allow". Without one, `rule` is null and the verdict is
    `default`. A null url, or one without `://`, has an empty host and path; a
    path that is empty starts with no rule's `/`. Rules with a null are ignored,
    repeated rules count once. Repeated rows of `pages` give as many results.

    The driver learns only which label counts and path lengths occur in the rules;
    hosts and paths of any length cost their own length. An expression
    that a third of all pages share meets its rule in `salts` places.
    """
    clean = rules.select(
        F.lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ).dropna()
    sizes = clean.select(F.size(F.split("r_host", r"\.", -1)), F.length("r_path")).distinct().collect()
    labels, lengths = (sorted({r[k] for r in sizes}) for k in (0, 1))
    digest = _key(F.col("r_host"), F.col("r_path"))
    index = (
        clean.distinct()
        .withColumn("r_digest", digest)
        .withColumn("r_prefix", F.substring(digest, 1, PREFIX_DIGITS))
        .withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    parts = pages.select(
        F.col(id).alias("page_id"),
        F.col(url).alias("url"),
        url_host(F.col(url)).alias("host"),
        url_path(F.col(url)).alias("path"),
        F.spark_partition_id().alias("_part"),
    )
    # Rows alike in one input partition are judged once; equal rows of other
    # partitions stay apart, so that no page is a hot key.
    alike = ("_part", "page_id", "url", "host", "path")
    counted = parts.groupBy(*alike).agg(F.count("*").alias("_copies"))
    expressed = counted.withColumn(
        "_expr", F.explode_outer(_expressions(F.col("host"), F.col("path"), labels, lengths))
    ).withColumn("_digest", _key(F.col("_expr.host"), F.col("_expr.path")))
    met = expressed.join(
        index,
        (F.substring("_digest", 1, PREFIX_DIGITS) == F.col("r_prefix"))
        & (F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)) == F.col("r_salt"))
        & (F.col("_digest") == F.col("r_digest")),
        "left",
    )
    best = F.max(
        F.when(
            F.col("r_host").isNotNull(),
            F.struct(
                (F.length("r_host") + F.length("r_path")).alias("size"),
                F.length("r_host").alias("host_size"),
                (F.col("r_verdict") == "allow").alias("allows"),
                F.concat("r_host", "r_path").alias("rule"),
                F.col("r_verdict").alias("verdict"),
            ),
        )
    )
    judged = met.groupBy(*alike, "_copies").agg(best.alias("_best"))
    return judged.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"),
    ).drop("_copy")
