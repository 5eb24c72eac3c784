"""URL filters: expressions of host suffix and path prefix, joined on hash prefixes.

Each URL is expanded into the expressions (host suffix + path prefix) that a rule could
have: suffixes of as many labels, and prefixes of as many characters, as occur among the
rules.  Expressions meet rules in an equi-join on the first four bytes of their SHA-256;
the full digest confirms a hit.  Of the rules that fit, the longest wins; of equally long
ones the one with the longer host, then ``block`` before ``allow``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path): the stated rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: (verdict, host, path): the list that decides where no stated rule fits; else a URL is allowed.
LISTED = [
    ("block", "spam-farm.example.org", "/"),
    ("block", "cheap-pills.example.com", "/"),
    ("block", "casino-bonus.example.com", "/"),
    ("block", "free-downloads.example.org", "/"),
]
#: Hex digits of a digest that rules and expressions are joined on.
PREFIX = 8


def rule_table(spark: SparkSession, stated=RULES, listed=LISTED) -> DataFrame:
    rows = [(h, p, v, True) for v, h, p in stated] + [(h, p, v, False) for v, h, p in listed]
    rules = spark.createDataFrame(rows, "rule_host string, rule_path string, rule_verdict string, stated boolean")
    return with_digest(rules, F.concat("rule_host", "rule_path"))


def with_digest(df: DataFrame, expression: F.Column) -> DataFrame:
    full = F.sha2(expression, 256)
    return df.withColumn("digest", full).withColumn("prefix", F.substring("digest", 1, PREFIX))


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(whole, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, pattern, 2)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns, host, path, rule and verdict for every row of ``pages``.

    ``rules`` is a table of :func:`rule_table`'s form and may be of any size: Spark
    broadcasts it only if it is under the session's limit, and else shuffles both sides.
    Distinct (host, path) pairs are judged once and joined back, so a URL that holds a third
    of all rows is judged once; null, empty and malformed URLs have no expressions and are
    allowed.  Ties between rules: see above; repeated rows are answered each, no pages give no
    rows, no rules allow every page.  Columns of ``pages`` beside ``keep`` are not read.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    # The widths that occur among rules: at most a few dozen numbers, whatever the list's size.
    found = rules.agg(F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("widths")).first()
    labels, widths = sorted(found["labels"] or []), sorted(found["widths"] or [])
    distinct = rows.select("host", "path").filter("host <> ''").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(*[F.when(F.size(parts) >= n, F.concat_ws(".", F.slice(parts, -n, n))) for n in labels] or [F.lit(None).cast("string")]))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in widths] or [F.lit(None).cast("string")]))
    opened = distinct.select("host", "path", F.explode(suffixes).alias("s"), prefixes.alias("ps")).select("host", "path", "s", F.explode("ps").alias("p"))
    asked = with_digest(opened, F.concat("s", "p")).withColumnRenamed("digest", "asked").drop("s", "p")
    hits = asked.join(rules, "prefix").filter("asked = digest")
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"))
    best = lambda cond: F.max(F.when(cond, F.struct(rank.alias("r"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("v"))))
    decided = hits.groupBy("host", "path").agg(best(F.col("stated")).alias("own"), best(~F.col("stated")).alias("other"))
    return rows.join(decided, ["host", "path"], "left").select(*keep, "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.v", "other.v", F.lit("allow")).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


def _values(rules, stated: str) -> str:
    return ", ".join(f"('{h}', '{p}', '{v}', {stated})" for v, h, p in rules)


OP5_SQL = rf"""
WITH r(h, p, v, stated) AS (VALUES {_values(RULES, "true")}, {_values(LISTED, "false")}),
u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT page_id,
        translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
f AS (SELECT s.page_id, r.h || r.p AS rule, r.v, r.stated,
        row_number() OVER (PARTITION BY s.page_id, r.stated ORDER BY length(r.h || r.p) DESC, length(r.h) DESC, r.v DESC) AS k
      FROM s JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p))
SELECT s.page_id, s.host, s.path, a.rule, coalesce(a.v, b.v, 'allow') AS verdict
FROM s LEFT JOIN f a ON a.page_id = s.page_id AND a.stated AND a.k = 1
       LEFT JOIN f b ON b.page_id = s.page_id AND NOT b.stated AND b.k = 1
"""
