"""URL filter: allow and block rules on hosts and paths, matched by hashed expressions.

A rule is a host and a path. It fits a URL whose host is the rule's or a subdomain
of it and whose path starts with the rule's. Such a URL has the rule among its own
expressions: a suffix of the host (whole labels) followed by a prefix of the path.
Suffixes and prefixes are only taken in the pairs of sizes that some rule has, since
no other expression can be a rule; nothing is lost by that.

    distinct (host, path) -> expressions -> equi-join on the first 32 bits of
    SHA-256 -> the whole digest confirms -> the longest rule of each (host, path)

and the verdicts are joined back to the rows. Hosts that a third of the rows share
are one row per distinct path before anything is expanded, and the join back is a
plain left join, whose large side AQE splits. The rules may be a table of any size:
no broadcast is asked for.

Between rules that fit, the longest wins (code points of host and path), then the
longer host, then ``block``.

Defined cases: a null URL or one without ``://`` has an empty host and path and no
rule; so has a rule with a null host, a null verdict or one other than allow and
block no effect; a null path is an empty one; rules that repeat count once. URLs of any
length and any character are read whole. Repeated rows and null ids are kept; extra
columns are ignored; empty tables give no rule and no rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.staging import stage

VERDICTS = ("allow", "block")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.position(F.lit("://"), url) + 3))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def hashed(expression: Column) -> list[Column]:
    """The short key that is joined on, and the digest that confirms."""
    digest = F.sha2(expression, 256)
    return [F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("long").alias("short"), digest.alias("digest")]


def prepared(rules: DataFrame) -> DataFrame:
    """One row for each distinct rule: rule, verdict, short, digest, length, labels and path_length."""
    path = F.coalesce("path", F.lit(""))
    usable = rules.filter(F.col("host").isNotNull() & F.col("verdict").isin(*VERDICTS)).select("host", path.alias("path"), "verdict")
    # "block" is the greater word: it wins where both are asked for.
    one = usable.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    return one.select(
        rule.alias("rule"), "verdict", *hashed(rule), F.length(rule).cast("long").alias("length"),
        _labels(F.col("host")).alias("labels"), F.length("path").alias("path_length"),
    )


def expressions(urls: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """``urls`` exploded into its expressions of the given (labels, path length)."""
    if not sizes:
        return urls.select("host", "path", F.lit("").alias("expression")).limit(0)
    labels, length = (F.array(*[F.lit(pair[i]) for pair in sizes]) for i in (0, 1))
    # One lambda over the list: the plan does not grow with the sizes.
    fitting = F.filter(F.arrays_zip(labels.alias("labels"), length.alias("length")), lambda s: (s["labels"] <= F.col("_labels")) & (s["length"] <= F.col("_length")))
    cut = F.transform(fitting, lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.left(F.col("path"), s["length"])))
    sized = urls.select("host", "path", _labels(F.col("host")).alias("_labels"), F.length("path").alias("_length"))
    return sized.select("host", "path", F.explode(cut).alias("expression"))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict of every row."""
    if otherwise not in VERDICTS:
        raise ValueError(f"unknown verdict {otherwise!r}")
    rules = stage(prepared(rules), "url-rules")
    # Sizes, not rules: a few pairs, however many rules there are.
    sizes = [tuple(r) for r in rules.select("labels", "path_length").distinct().orderBy("labels", "path_length").collect()]
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    asked = expressions(rows.select("host", "path").distinct(), sizes)
    told = rules.select("short", F.col("digest").alias("_digest"), "rule", "verdict", "length", "labels")
    fitting = asked.select("host", "path", *hashed(F.col("expression"))).join(told, "short").filter(F.col("digest") == F.col("_digest"))
    best = fitting.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("length", "labels")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules written in the program: (host, path, verdict)."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")
