"""Registered queries of screening as users run it: modifiers, recall, worked scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partyloom.functions import similarity
from partyloom.functions.batch_similarity import name_score_column
from partyloom.functions.text import name_tokens
from partyloom.plans import recall, screening
from partyloom.queries import query, table
from partyloom.record_queries import PLACES, records

# Latin capitals and the Cyrillic letters that transliterate to them.
LATIN, CYRILLIC = "ABDEFGIKLMNOPRSTUVZ", "АБДЕФГИКЛМНОПРСТУВЗ"


def native_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Party records whose suppliers also have a name in Cyrillic."""
    r = records(spark, sf_dir)
    native = lambda n: F.when(F.col("authority") == "SUP", F.translate(F.upper(n["name"]), LATIN, CYRILLIC)).otherwise(n["native"])
    return r.withColumn("names", F.transform("names", lambda n: n.withField("native", native(n))))


#: Hits that a comparison has to have seen, on the smallest tables too.
MANY = 200
FAMILIES = "SELECT family, 0::BIGINT AS lost, 0::BIGINT AS gained, true AS many_hits FROM (VALUES ('typo'), ('acronym'), ('verbatim'), ('native')) t(family)"


def verdict(told: DataFrame) -> DataFrame:
    """A row a family; many_hits: all four rows together compared MANY hits or more."""
    return told.select("family", "lost", "gained", (F.sum("compared").over(Window.partitionBy()) >= MANY).alias("many_hits"))


@query(FAMILIES)
def q6_recall(spark, sf_dir):
    """Perturbed names of all parties, by the lanes and by a full scan."""
    r = native_records(spark, sf_dir)
    return verdict(recall.differential(recall.perturbed(r), r))


@query(FAMILIES)
def j7_m17_modified_recall(spark, sf_dir):
    """The same with a year of birth and a country, which lift and lower scores: by the word lane and by a full scan."""
    r = native_records(spark, sf_dir)
    year = F.concat(F.lit("19"), F.lpad((recall.draw(F.col("q"), 5, 40) + 50).cast("string"), 2, "0"))
    country = F.element_at(F.array(F.lit(""), F.lit("France"), F.lit("Kenya"), F.lit("JP")), recall.draw(F.col("q"), 6, 4) + 1)
    asked = recall.perturbed(r).withColumns({"yob": F.when(recall.draw(F.col("q"), 4, 3) > 0, year).otherwise(""), "country": country})
    return verdict(recall.differential(asked, r))


# Fixed values: (query, name, low quality, score) worked out by hand from the definitions of the scores.
WORKED = (
    ("RED PLATE", "RED PLATE", False, 1.0),  # equal words
    ("PLATE RED", "RED PLATE", False, 1.0),  # every word has its partner, in any order
    ("RED PLATE", "RED PLATE CO", False, 1.0),  # words of the query count, not those of the name
    ("RED", "RED PLATE", False, 0.96),  # one exact word of several
    ("R PLATE", "RED PLATE", False, 0.94),  # (0.88 for the initial + 1) / 2; the whole strings have 0.925
    ("MARTHA", "MARHTA", False, 17 / 18 + 0.3 / 18),  # Jaro (1 + 1 + 5/6) / 3 = 17/18, three equal letters at the start
    ("PHILIP", "FILIP", False, 0.95),  # both fold to FILIP, which counts 0.95 at most
    ("CML", "CASPIAN MARITIME LOGISTICS", False, 0.97 * 0.9),  # initials, one word against several
    ("CM", "CASPIAN MARITIME LOGISTICS", False, 0.9 * 0.9),  # initials that go on
    ("KHAN", "MUHAMMAD ALI KHAN", False, 0.75 * 0.9),  # a common name alone is capped, then damped
    ("RED PLATE", "RED PLATE", True, 0.97),  # a weak alias
    ("ABCD", "WXYZ", False, 0.0),  # nothing in common
    ("AB CD", "AB", False, 0.5 * 0.5 + 0.5 * (5 / 6 + 0.2 / 6)),  # average 1/2; ABCD and AB: Jaro (1/2 + 1 + 1) / 3 = 5/6, two equal letters at the start
)


@query(
    "SELECT p_partkey, score FROM part JOIN (VALUES " + ", ".join(f"({k}, {score!r}::DOUBLE)" for k, (*_, score) in enumerate(WORKED)) + f") t(k, score) ON p_partkey % {len(WORKED)} = k"
)
def m1_m15_worked_scores(spark, sf_dir):
    """Every part with a pair of names whose score was worked out by hand."""
    pick = lambda at: F.element_at(F.array(*[F.lit(w[at]) for w in WORKED]), (F.col("p_partkey") % len(WORKED) + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", name_tokens(pick(0)).alias("q"), name_tokens(pick(1)).alias("c"), pick(2).alias("low"))
    weights = F.transform("q", lambda t: F.lit(1.0))
    return p.select("p_partkey", name_score_column(F.col("q"), F.col("c"), weights, F.col("low")).alias("score"))


#: The first free place of b within reach that holds the character e.c.
_FREE = "list_filter(range(greatest(1, e.i - reach), least(length(b), e.i + reach) + 1), lambda j: NOT s.used[j] AND substr(b, j, 1) = e.c)[1]"
KERNELS_SQL = f"""
WITH n AS (
  SELECT DISTINCT upper(p_name) AS a, 'RED PLATE' AS b FROM part
), r AS (
  SELECT a, b, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS reach FROM n
), j AS (
  SELECT a, b, list_reduce(
    list_prepend({{'i': 0, 'c': '', 'used': list_transform(range(length(b)), lambda k: false), 'met': ''}},
      list_transform(range(1, length(a) + 1), lambda k: {{'i': k, 'c': substr(a, k, 1), 'used': CAST([] AS BOOLEAN[]), 'met': ''}})),
    lambda s, e: {{'i': 0, 'c': '', 'used': list_transform(range(1, length(b) + 1), lambda k: s.used[k] OR coalesce(k = {_FREE}, false)), 'met': s.met || CASE WHEN {_FREE} IS NULL THEN '' ELSE e.c END}}) AS z
  FROM r
), m AS (
  SELECT a, b, length(z.met) AS m, z.met AS x, array_to_string(list_transform(list_filter(range(1, length(b) + 1), lambda k: z.used[k]), lambda k: substr(b, k, 1)), '') AS y FROM j
), jaro AS (
  SELECT a, b, CASE WHEN m = 0 THEN 0 ELSE (m / length(a) + m / length(b) + (m - len(list_filter(range(1, m + 1), lambda k: substr(x, k, 1) <> substr(y, k, 1))) / 2) / m) / 3 END AS jaro,
         len(list_filter(range(1, 5), lambda k: k <= length(a) AND k <= length(b) AND substr(a, 1, k) = substr(b, 1, k))) AS prefix
  FROM m
), bigrams AS (
  SELECT a, b, side, substr(t, k, 2) AS g, count(*) AS c FROM (SELECT a, b, unnest(['a', 'b']) AS side, unnest([a, b]) AS t FROM n), range(1, 40) r(k) WHERE k < length(t) GROUP BY ALL
), dice AS (
  SELECT x.a, sum(CASE WHEN y.c IS NULL THEN 0 ELSE least(x.c, y.c) END) * 2 / (length(x.a) + length(x.b) - 2) AS dice FROM bigrams x LEFT JOIN bigrams y ON y.a = x.a AND y.g = x.g AND y.side = 'b' WHERE x.side = 'a' GROUP BY x.a, x.b
), osa AS (
  SELECT a, b, list_reduce(
    list_prepend({{'i': 0, 'older': CAST([] AS DOUBLE[]), 'old': list_transform(range(0, length(b) + 1), lambda k: CAST(k AS DOUBLE))}},
      list_transform(range(1, length(a) + 1), lambda k: {{'i': k, 'older': CAST([] AS DOUBLE[]), 'old': CAST([] AS DOUBLE[])}})),
    lambda s, e: {{'i': 0, 'older': s.old, 'old': list_reduce(
      list_prepend([CAST(e.i AS DOUBLE)], list_transform(range(1, length(b) + 1), lambda k: [CAST(k AS DOUBLE)])),
      lambda row, w: list_append(row, least(s.old[CAST(w[1] AS INT) + 1] + 1, row[CAST(w[1] AS INT)] + 1,
        s.old[CAST(w[1] AS INT)] + CASE WHEN substr(a, e.i, 1) = substr(b, CAST(w[1] AS INT), 1) THEN 0 ELSE 1 END,
        CASE WHEN e.i > 1 AND w[1] > 1 AND substr(a, e.i, 1) = substr(b, CAST(w[1] AS INT) - 1, 1) AND substr(a, e.i - 1, 1) = substr(b, CAST(w[1] AS INT), 1)
             THEN s.older[CAST(w[1] AS INT) - 1] + 1 ELSE 1e9 END)))}}) AS z
  FROM n
)
SELECT a AS n, round(CASE WHEN a = b THEN 1 ELSE jaro + prefix * 0.1 * (1 - jaro) END, 9) AS jw, round(1 - z.old[length(b) + 1] / greatest(length(a), length(b)), 9) AS es, round(CASE WHEN a = b THEN 1 ELSE dice END, 9) AS dc
FROM jaro JOIN dice USING (a) JOIN osa USING (a, b)
"""


@query(KERNELS_SQL)
def m1_m3_kernels_in_sql(spark, sf_dir):
    """Jaro-Winkler, edit similarity and bigram Dice of distinct part names against one name, by the functions registered for SQL."""
    similarity.register(spark)
    names = table(spark, sf_dir, "part").select(F.upper("p_name").alias("n")).distinct()
    return spark.sql("SELECT n, round(jaro_winkler(n, 'RED PLATE'), 9) AS jw, round(edit_sim(n, 'RED PLATE'), 9) AS es, round(dice_bigram(n, 'RED PLATE'), 9) AS dc FROM {names}", names=names)


TURNS = "s_suppkey % 3 AS y, (s_suppkey // 3) % 3 AS c"


@query(
    f"WITH s AS (SELECT s_suppkey AS k, {TURNS} FROM supplier JOIN customer ON c_custkey = s_suppkey),"
    " r AS (SELECT k, y, c, CASE y WHEN 2 THEN 0.94 ELSE 1.0 END AS after_year FROM s),"
    " f AS (SELECT k, y, c, CASE c WHEN 1 THEN least(1.0, after_year + 0.04) WHEN 2 THEN after_year - 0.04 ELSE after_year END AS score FROM r)"
    " SELECT 'CUST-' || k AS party_id, round(score, 4)::DOUBLE AS score, 'exact' AS match_type, y = 1 OR c = 1 AS corroborated, y = 2 OR c = 2 AS conflict FROM f WHERE score >= 0.91"
)
def m16_m17_modified_scores(spark, sf_dir):
    """Customers that suppliers belong to, asked by name with the right, a wrong or no year and country: the score of each one's own record."""
    r = records(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3).alias("y"), F.expr("cast(floor(s_suppkey / 3) as bigint) % 3").alias("c"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    met = s.join(c, s["s_suppkey"] == c["c_custkey"])
    born = 1950 + F.col("c_custkey") % 40
    year = F.when(F.col("y") == 1, born).when(F.col("y") == 2, born - 1)
    place = lambda k: F.element_at(F.array(*map(F.lit, PLACES)), (k % 5 + 1).cast("int"))
    country = F.when(F.col("c") == 1, place(F.col("c_custkey"))).when(F.col("c") == 2, place(F.col("c_custkey") + 1)).otherwise("")
    asked = met.select(F.concat(F.lit("CUST-"), "c_custkey").alias("qid"), F.col("c_name").alias("q"), F.coalesce(year.cast("string"), F.lit("")).alias("yob"), country.alias("country"))
    hits = screening.screen(asked, r, 0.91, among=asked.select("qid", F.col("qid").alias("party_id")))
    return hits.select("party_id", "score", "match_type", "corroborated", "conflict")
