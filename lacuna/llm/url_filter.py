"""URL filters by host-suffix and path-prefix expressions, in DataFrame functions only.

Each URL is expanded into the expressions (a suffix of its host's labels + a prefix of its path) that a rule
could have. Expressions and rules meet in an equi-join on the first 32 bits of a digest; the full digest
confirms; the longest rule wins. Suffixes are made only for the label counts, and prefixes only for the lengths,
that occur in the rules, so that the expansion of a URL is bounded by the rules and not by the URL, and "starts
with" is exact for rules that don't end in a slash as well.

Defined results: a null URL, or one without `://`, has an empty host and path and fits no rule; repeated rows are
judged one by one; a null page_id is kept; an empty table gives an empty result; further columns of the input are
not read. Of two rules of one length the one with the longer host wins; of equal rules, `block`.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path) of the contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Rules are broadcast up to so many; beyond it they are joined by a shuffle.
BROADCAST_RULES = 50_000
PREFIX_HEX = 8


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows, made in the JVM."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    kind = "array<struct<verdict:string,host:string,path:string>>"
    listed = F.array(*rows) if rows else F.from_json(F.lit("[]"), kind)
    return spark.range(1, numPartitions=1).select(F.explode(listed).alias("r")).select("r.*")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased. Path: then up to `?`, `#` or end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({_sql(url)}, instr({_sql(url)}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _sql(c: Column) -> str:
    return c._jc.toString()


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host + path; null where none fits) and verdict for each row of pages(page_id, url)."""
    known = rules.select(
        "verdict",
        F.length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("path_size"),
    ).withColumn("digest", F.sha2("rule", 256))
    # Two facts about the rules, whatever their number: their label counts and path lengths.
    shape = known.agg(F.count("*").alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("path_size").alias("sizes")).first()
    url = pages.select("page_id", F.col("url"))
    host, path = host_and_path(F.col("url"))
    url = url.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    suffixes = [
        F.when(F.size(F.split("host", r"\.")) >= n, F.substring_index("host", ".", -n)) for n in sorted(shape["labels"])
    ]
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["sizes"])]
    pairs = [F.struct(s.alias("s"), p.alias("p")) for s in suffixes for p in prefixes]
    none = F.from_json(F.lit("[]"), "array<struct<s:string,p:string>>")
    fit = F.filter(F.array(*pairs) if pairs else none, lambda x: x["s"].isNotNull() & x["p"].isNotNull() & (x["s"] != ""))
    texts = F.transform(fit, lambda x: F.sha2(F.concat(x["s"], x["p"]), 256))
    exploded = url.select("*", F.explode_outer(texts).alias("digest")).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    known = known.select(
        F.substring("digest", 1, PREFIX_HEX).alias("short"),
        F.col("digest").alias("full"),
        F.struct(
            (F.length("rule")).alias("size"), "host_size", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict"
        ).alias("found"),
    )
    if shape["n"] <= BROADCAST_RULES:
        known = F.broadcast(known)
    met = exploded.join(known, "short", "left")
    best = met.groupBy("row", "page_id", "host", "path").agg(
        F.max(F.when(F.col("digest") == F.col("full"), F.col("found"))).alias("found")
    )
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
    )


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages, rule_table(spark, RULES))


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), k(verdict, h, q) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), f AS (
  SELECT r, first(h || q ORDER BY length(h || q) DESC, length(h) DESC) AS rule,
         first(verdict ORDER BY length(h || q) DESC, length(h) DESC) AS verdict
  FROM p JOIN k ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY r
)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (r)
"""
