"""URL filter by host-suffix and path-prefix expressions, in DataFrame functions only.

A URL expands into every host suffix that has as many labels as some rule's host, combined with
every path prefix as long as some rule's path.  Expressions meet rules in an equi-join on a short
prefix of their SHA-256; the full digests then confirm.  Of the rules that fit, the longest wins,
among equals the one with the longer host.

Rules are counted first.  Up to `most_broadcast` go to every task: expressions meet them where
they were made and are collapsed there, so the only shuffle carries one row per page.  More rules
are joined by a shuffle in which every expression is dealt over `salts` parts and the rules are
repeated for each, because an expression like a whole top-level domain is made by most pages;
those rows carry the row's number and the digest, and the page's host and path stay behind.

Null URLs and URLs without "://" have an empty host and path and get the default verdict, as do
URLs that no rule fits.  Repeated rows stay repeated; page ids may be null; extra columns are
ignored; an empty table gives an empty result, and without rules all rows get the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyloom.llm.common import materialize

#: (action, host, path) of the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Hex digits of the digest that the join uses.
PREFIX_DIGITS = 8
#: Rules that a task may hold (about 200 bytes each), and parts of an expression beyond that.
MOST_BROADCAST, SALTS = 200_000, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(spark, rules=RULES) -> DataFrame:
    """(action, rule_host, rule_path, digest, prefix); a rule given twice with both actions blocks."""
    made = spark.createDataFrame(list(rules), "action string, rule_host string, rule_path string")
    made = made.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))
    made = made.withColumn("digest", expression(F.col("rule_host"), F.col("rule_path")))
    return made.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))


def judge(df: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most_broadcast: int = MOST_BROADCAST, salts: int = SALTS) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of df.  rules: as rule_table makes them."""
    shape = rules.agg(
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths"), F.count(F.lit(1)).alias("n")
    ).first()
    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])  # as many as a host has labels and a path characters
    rows = df.select(F.monotonically_increasing_id().alias("__row"), df[id_col].alias("id"), df[url_col].alias("__url"))
    rows = rows.select("__row", "id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    if not labels:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    fits = rules.select("prefix", "digest", F.length("rule_host").cast("long").alias("hn"), F.length("rule_path").cast("long").alias("pn"), (F.col("action") == "block").cast("long").alias("block"))
    # the longest rule wins, then the longer host: both lengths and the verdict in one number
    best = F.max(F.shiftleft(F.col("hn") + F.col("pn"), 32) + F.shiftleft("hn", 1) + F.col("block")).alias("best")
    if shape["n"] <= most_broadcast:
        met = expressions(rows, labels, lengths).join(F.broadcast(fits), ["prefix", "digest"], "left")
        told = met.groupBy("__row", "id", "host", "path").agg(best)
    else:
        rows = materialize(rows, "urls")
        asked = expressions(rows, labels, lengths).select("__row", "prefix", "digest", F.pmod(F.xxhash64("__row"), F.lit(salts)).alias("salt"))
        many = fits.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        told = rows.join(asked.join(many, ["prefix", "digest", "salt"]).groupBy("__row").agg(best), "__row", "left")
    hn = F.shiftright("best", 1).bitwiseAND((1 << 31) - 1).cast("int")
    pn = (F.shiftright("best", 32) - hn).cast("int")
    rule = F.concat(F.right("host", hn), F.left("path", pn))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best").bitwiseAND(1) == 1, "block").otherwise("allow")
    return told.select(F.col("id").alias(id_col), "host", "path", F.when(F.col("best").isNotNull(), rule).alias("rule"), verdict.alias("verdict"))


def expressions(rows: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """rows with (prefix, digest) of each expression that some rule's shape allows; a row without any stays once, with nulls."""
    n_labels = F.size(F.split("host", r"\."))
    hosts = F.filter(F.array(*[F.when(n_labels >= k, F.substring_index("host", ".", -k)) for k in labels]), lambda x: x.isNotNull())
    paths = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring(F.col("path"), 1, k)) for k in lengths]), lambda x: x.isNotNull())
    digests = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: expression(h, p))))
    asked = rows.withColumn("digest", F.explode_outer(F.when(F.col("host") != "", digests)))
    return asked.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(action, rh, rp) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fit AS (
  SELECT n, rh || rp AS rule, action, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (n)
"""
