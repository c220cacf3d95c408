"""Registered queries that run the library's own operators on party records made from the driver's tables.

Suppliers own papers in common with the customer of their number, customers form a tree of
subsidiaries, parts stand alone.  The SQL twins work out the same answers from the flat tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partyloom.functions.dates import covers_year, parse_date_values
from partyloom.functions.text import norm_name
from partyloom.operators import crosslist, graph, ownership, present, quality, stats
from partyloom.plans import below_the_line, screening
from partyloom.plans import snapshot as snap
from partyloom.queries import query, table
from partyloom.schema import conform

# Countries of the made-up records, by key.
PLACES = ("France", "Germany", "Japan", "Brazil", "Kenya")

FLAT = (
    "SELECT 'SUP-' || s_suppkey AS id, 'SUP' AS authority, 'Entity' AS kind, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'SDN List' ELSE 'Consolidated List' END AS list,"
    " CAST(s_nationkey AS VARCHAR(9)) AS program, s_suppkey % 5 AS place, '' AS born, 'Tax ID No.' AS paper, 'TX-000' || s_suppkey AS number, 'Owned or Controlled By' AS rel, 'CUST-' || s_suppkey AS rid FROM supplier"
    " UNION ALL SELECT 'CUST-' || c_custkey, 'CUST', 'Individual', c_name, CASE WHEN c_custkey % 7 = 0 THEN 'SDN List' ELSE c_mktsegment END,"
    " CAST(c_nationkey AS VARCHAR(9)), c_custkey % 5, CAST(1950 + c_custkey % 40 AS VARCHAR(9)), 'VAT / Tax ID', 'tx000 ' || c_custkey, CASE WHEN c_custkey > 1 THEN 'Subsidiary of' ELSE '' END, 'CUST-' || CAST(floor(c_custkey / 2) AS BIGINT) FROM customer"
    " UNION ALL SELECT 'PART-' || p_partkey, 'PART', 'Vessel', p_name, p_brand, p_type, p_partkey % 5, '', 'IMO', '' || (9000000 + p_partkey), '', '' FROM part"
)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat rows as party records."""
    names = ("supplier", "customer", "part")
    sql = re.sub(rf"FROM ({'|'.join(names)})\b", r"FROM {\1}", FLAT)
    flat = spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names})
    some = lambda c, item: F.when(c != "", F.array(item)).otherwise(F.array())
    return conform(
        flat.select(
            "id", "authority", "name", "list", F.array("list").alias("lists"), F.col("kind").alias("type"), F.array("program").alias("programs"),
            F.array(F.struct("name", F.lit("Primary").alias("type"), F.lit(True).alias("primary"), F.lit(False).alias("lowQuality"), F.lit("Latin").alias("script"), F.lit("").alias("native"), F.array().cast("array<string>").alias("parts"))).alias("names"),
            F.array(F.struct(F.lit("").alias("full"), F.element_at(F.array(*map(F.lit, PLACES)), (F.col("place") + 1).cast("int")).alias("country"))).alias("addresses"),
            some(F.col("born"), F.struct(F.lit("Identity").alias("group"), F.lit("Date of Birth").alias("label"), F.col("born").alias("value"))).alias("attributes"),
            F.array(F.struct(F.col("paper").alias("type"), F.col("number").alias("value"))).alias("identifiers"),
            some(F.col("rel"), F.struct(F.col("rel").alias("type"), F.col("rid").alias("relatedId"), F.lit("").alias("relatedName"), F.lit(None).cast("boolean").alias("inSnapshot"))).alias("relationships"),
        )
    )


@query(f"SELECT id, count(*) AS copies, max(list) AS list, list_sort(list(DISTINCT l)) AS lists FROM (SELECT id, list, list AS l FROM ({FLAT}) UNION ALL SELECT id, list, 'Other ' || authority FROM ({FLAT}) WHERE place = 0 UNION ALL SELECT id, list, list FROM ({FLAT}) WHERE place <> 0) GROUP BY id")
def a23_u2_merge_by_id(spark, sf_dir):
    """Each record twice, some the second time with another membership: one stays, memberships are united."""
    r = records(spark, sf_dir)
    again = r.withColumn("lists", F.when(F.col("addresses")[0]["country"] == PLACES[0], F.array(F.concat(F.lit("Other "), "authority"))).otherwise(F.col("lists")))
    return snap.merge_by_id(r.unionByName(again)).select("id", F.lit(2).cast("long").alias("copies"), "list", F.array_sort("lists").alias("lists"))


@query(f"WITH r AS ({FLAT}) SELECT a.id, a.rid AS related, coalesce(b.name, 'Entity ' || a.rid || ' (unlisted)') AS name, b.id IS NOT NULL AS inside FROM r a LEFT JOIN r b ON b.id = a.rid WHERE a.rel <> ''")
def j2_relationship_names(spark, sf_dir):
    return snap.resolve_relationships(records(spark, sf_dir)).select("id", F.explode("relationships").alias("x")).select("id", F.col("x.relatedId").alias("related"), F.col("x.relatedName").alias("name"), F.col("x.inSnapshot").alias("inside"))


@query(f"SELECT id AS party_id, 0 AS ord, name, true AS is_primary, 'Primary' AS alias_type, false AS low_quality FROM ({FLAT})")
def n10_candidate_names(spark, sf_dir):
    return snap.candidate_names(records(spark, sf_dir))


WORDS = f"SELECT id, authority, unnest(string_split(trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')), ' ')) AS token FROM ({FLAT})"


@query(f"SELECT token, count(DISTINCT id) AS df FROM ({WORDS}) GROUP BY 1")
def a11_n8_token_frequencies(spark, sf_dir):
    return snap.token_frequencies(records(spark, sf_dir))


@query(f"SELECT list_sort(list(DISTINCT list)) AS lists, list_sort(list(DISTINCT program)) AS programs, list_sort(list(DISTINCT authority)) AS authorities FROM ({FLAT})")
def a12_snapshot_facets(spark, sf_dir):
    return snap.facets(records(spark, sf_dir))


@query(f"SELECT CASE WHEN place = 1 THEN 'added' ELSE 'removed' END AS change, id, name, authority, list, kind AS type FROM ({FLAT}) WHERE place IN (1, 2)")
def j13_snapshot_delta(spark, sf_dir):
    r = records(spark, sf_dir)
    at = F.col("addresses")[0]["country"]
    return snap.delta(r.where(at != PLACES[1]), r.where(at != PLACES[2]), most=1 << 30)


@query("SELECT ['BIS', 'EU'] AS missing, ['PART'] AS regression, false AS publishable")
def q1_u3_coverage(spark, sf_dir):
    r = records(spark, sf_dir)
    return snap.coverage(["SUP", "CUST", "EU", "BIS"], r, r.where("authority <> 'PART'"))


@query(f"SELECT id, authority FROM ({FLAT}) WHERE authority IN ('SUP', 'PART')")
def j14_carried_forward(spark, sf_dir):
    return snap.carry_forward(records(spark, sf_dir), spark.createDataFrame([("SUP",), ("PART",), ("NONE",)], "authority string")).select("id", "authority")


@query(f"SELECT ['France', 'Germany', 'Japan', 'Brazil', 'Kenya'][CAST(place AS INT) + 1] AS name, count(*) AS count FROM ({FLAT}) GROUP BY 1")
def a4_c1_count_by_country(spark, sf_dir):
    return stats.by_country(records(spark, sf_dir), None)


@query(f"SELECT paper AS type, count(*) AS carriers, CASE WHEN paper = 'IMO' THEN 'imo' ELSE 'tax_id' END AS kind FROM ({FLAT}) GROUP BY 1")
def a10_v2_identifier_coverage(spark, sf_dir):
    return below_the_line.identifier_coverage(records(spark, sf_dir))


@query(
    f"SELECT authority, count(*) AS count, 0.0::DOUBLE AS \"aliasRate\", 1.0::DOUBLE AS \"addressRate\", 1.0::DOUBLE AS \"identifierRate\", avg(CASE WHEN born <> '' THEN 1.0 ELSE 0 END)::DOUBLE AS \"birthDateRate\","
    f" 0.0::DOUBLE AS \"nationalityRate\", sum(CASE WHEN rel <> '' THEN 1 ELSE 0 END)::BIGINT AS \"relationshipEdges\" FROM ({FLAT}) GROUP BY 1"
)
def a15_quality_profile(spark, sf_dir):
    return quality.profile(records(spark, sf_dir))


@query(f"SELECT 1.0::DOUBLE AS dob, 1.0::DOUBLE AS country, 0.0::DOUBLE AS attribute, 0.0::DOUBLE AS identifier, (SELECT count(*) FROM customer) AS births, count(*) AS places FROM ({FLAT})")
def q3_c2_derived_rates(spark, sf_dir):
    d = quality.derived(records(spark, sf_dir))
    return d.select(F.col("dobParseRate").alias("dob"), F.col("countryResolveRate").alias("country"), F.col("attributeUnclassifiedRate").alias("attribute"), F.col("identifierUnclassifiedRate").alias("identifier"), F.col("dobValues").alias("births"), F.col("countryValues").alias("places"))


@query(
    "SELECT 'regression' AS severity, 'SUP.count' AS metric, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0)::DOUBLE AS value, (SELECT count(*) FROM supplier)::DOUBLE AS reference"
    " UNION ALL SELECT 'regression', 'SUP.relationshipEdges', (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0), (SELECT count(*) FROM supplier) WHERE (SELECT count(*) FROM supplier) > 100"
)
def q3_j18_quality_compare(spark, sf_dir):
    """Half of one authority's records are gone."""
    r = records(spark, sf_dir)
    now = r.where((F.col("authority") != "SUP") | (F.substring_index("id", "-", -1).cast("long") % 2 == 0))
    return quality.compare(quality.profile(now), quality.profile(r), quality.derived(now), quality.derived(r))


KEYS = f"SELECT id, CASE WHEN paper = 'IMO' THEN 'imo:' ELSE 'tax_id:' END || regexp_replace(upper(number), '[^A-Z0-9]', '', 'g') AS key FROM ({FLAT})"


@query(f"WITH k AS ({KEYS}), c AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 4) SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.key = b.key AND a.id < b.id JOIN c ON c.key = a.key")
def j8_w6_identifier_pairs(spark, sf_dir):
    return crosslist._pairs(crosslist.facts(records(spark, sf_dir)), "keys", crosslist.MOST_PER_KEY)


@query(
    f"WITH k AS ({KEYS}), w AS (SELECT DISTINCT id, token FROM ({WORDS}) WHERE length(token) >= 4), f AS (SELECT token FROM w GROUP BY token HAVING ln(((SELECT count(*) FROM ({FLAT})) + 1.0) / (count(*) + 1)) + 1 >= 6.5),"
    " p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.key = b.key AND a.id < b.id JOIN w x ON x.id = a.id JOIN w y ON y.id = b.id AND y.token = x.token JOIN f ON f.token = x.token)"
    " SELECT a AS id, a AS cluster_id, 'identifier' AS basis FROM p UNION SELECT b, a, 'identifier' FROM p"
    f" UNION SELECT id, min(id) OVER (PARTITION BY who, place), 'name+country' FROM (SELECT *, count(*) OVER (PARTITION BY who, place) AS n FROM (SELECT id, place, list_sort(string_split(upper(name), ' ')) AS who, count(*) OVER (PARTITION BY list_sort(string_split(upper(name), ' '))) AS held FROM ({FLAT}) WHERE authority = 'PART') WHERE held BETWEEN 2 AND 40) WHERE n > 1"
)
def g9_r6_clusters(spark, sf_dir):
    """An identifier and a rare word in common link a supplier to a customer, the same words and country parts; names held by over 40 parties link none."""
    return crosslist.clusters(records(spark, sf_dir))


@query(
    f"WITH RECURSIVE r AS ({FLAT}), e AS (SELECT id AS owned, rid AS owner FROM r WHERE rel <> ''), b AS (SELECT id FROM r WHERE list = 'SDN List'), up(id, owner, hops) AS (SELECT owned, owner, 1 FROM e UNION SELECT up.id, e.owner, hops + 1 FROM up JOIN e ON e.owned = up.owner WHERE hops < 6 AND e.owner <> up.id),"
    " h AS (SELECT up.id, list_sort(list(CAST(hops AS VARCHAR) || ':' || owner)) AS blocked_owners, sum(CASE WHEN hops = 1 THEN 1 ELSE 0 END)::BIGINT AS direct, count(*) AS n FROM up JOIN b ON b.id = up.owner GROUP BY up.id),"
    " s AS (SELECT owner AS id, count(*) AS n FROM e GROUP BY 1)"
    " SELECT r.id, r.list = 'SDN List' AS self_blocked, coalesce(h.blocked_owners, []) AS blocked_owners, coalesce(h.direct, 0) AS direct, coalesce(h.n - h.direct, 0) AS indirect, coalesce(h.n, 0) > 1 AS aggregation_candidate, coalesce(s.n, 0) AS subsidiaries, h.n IS NOT NULL AS reaches"
    " FROM r LEFT JOIN h ON h.id = r.id LEFT JOIN s ON s.id = r.id"
)
def g5_g7_ownership_profile(spark, sf_dir):
    p = ownership.profile(records(spark, sf_dir))
    said = F.array_sort(F.transform("blocked_owners", lambda x: F.concat_ws(":", x["hops"], x["owner"])))
    return p.select("id", "self_blocked", said.alias("blocked_owners"), "direct", "indirect", "aggregation_candidate", F.size("subsidiaries").cast("long").alias("subsidiaries"), (F.col("note") == ownership.REACHES).alias("reaches"))


@query(f"SELECT id, rid AS dst, rel AS type, true AS ownership, 'owned_by' AS role, 'up' AS dir FROM ({FLAT}) WHERE rel <> ''")
def g1_g4_edges_and_roles(spark, sf_dir):
    return graph.edges(records(spark, sf_dir)).select(F.col("src").alias("id"), "dst", "type", "ownership", "role", graph.relation_direction(F.col("type")).alias("dir"))


@query(f"WITH e AS (SELECT id AS a, rid AS b FROM ({FLAT}) WHERE rel <> '') SELECT id, count(*) AS degree, 2 * count(*) AS weighted FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1")
def a16_weighted_degrees(spark, sf_dir):
    return graph.degrees(graph.edges(records(spark, sf_dir)))


@query(f"SELECT id, born, '' AS birthplace, ['France', 'Germany', 'Japan', 'Brazil', 'Kenya'][CAST(place AS INT) + 1] AS nationality FROM ({FLAT})")
def p4_identity_facts(spark, sf_dir):
    return present.identity_facts(records(spark, sf_dir)).select("id", F.coalesce("born", F.lit("")).alias("born"), F.coalesce("birthplace", F.lit("")).alias("birthplace"), "nationality")


@query(f"SELECT id, CASE WHEN list = 'SDN List' THEN 'Block' ELSE 'Potential block: review' END AS word, list = 'SDN List' AS blocking FROM ({FLAT})")
def p3_f11_determination(spark, sf_dir):
    blocking = ownership.is_blocking(F.col("lists"), F.col("list"), F.col("sanctionsTypes"))
    return records(spark, sf_dir).select("id", present.determination(F.col("authority"), F.col("lists"), blocking).alias("word"), blocking.alias("blocking"))


@query("SELECT c_custkey, 1950 + c_custkey % 40 BETWEEN 1955 AND 1960 AS covered FROM customer")
def d3_d5_birth_years(spark, sf_dir):
    """Whether some year from 1955 to 1960 lies in a stated birth interval."""
    born = F.array(F.concat(F.lit("circa "), F.lit(1950) + F.col("c_custkey") % 40))
    covered = F.exists(F.array(*[F.lit(str(y)) for y in range(1955, 1961)]), lambda y: F.exists("births", lambda d: covers_year(d, y)))
    return table(spark, sf_dir, "customer").withColumn("births", parse_date_values(born)).select("c_custkey", covered.alias("covered"))


@query("SELECT doc_id, trim(regexp_replace(upper(strip_accents(replace(replace(replace(text, 'ß', 'SS'), 'œ', ' '), 'æ', ' '))), '[^A-Z0-9]+', ' ', 'g')) AS norm FROM documents")
def n1_n5_normalised_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", norm_name(F.col("text")).alias("norm"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as hits: an order is a query, a part a party, the discount its distance from 1."""
    li = table(spark, sf_dir, "lineitem")
    field = F.when(F.col("l_returnflag") == "N", "primary name").otherwise("alias (A.K.A.)")
    return li.select(F.col("l_orderkey").alias("qid"), F.concat_ws("-", "l_partkey", "l_linenumber").alias("party_id"), F.round(1 - F.col("l_discount") * 2, 4).alias("score"), field.alias("matched_field"))


HITS = "SELECT l_orderkey AS qid, l_partkey || '-' || l_linenumber AS party_id, round(1 - l_discount * 2, 4) AS score, CASE WHEN l_returnflag = 'N' THEN 'primary name' ELSE 'alias (A.K.A.)' END AS matched_field FROM lineitem"
ORDER = "ORDER BY score DESC, matched_field <> 'primary name', party_id"


@query(
    f"WITH h AS ({HITS}), r AS (SELECT *, row_number() OVER (PARTITION BY qid {ORDER}) AS rank, count(*) OVER (PARTITION BY qid) AS total, max(score) OVER (PARTITION BY qid) AS top FROM h), t AS (SELECT *, count(*) FILTER (score = top) OVER (PARTITION BY qid) AS tied_at_top FROM r)"
    " SELECT qid, party_id, score, rank, total, tied_at_top, total > 3 AS truncated FROM t WHERE rank <= 3"
)
def w2_l1_a14_ranked_hits(spark, sf_dir):
    r = screening.rank(_hits(spark, sf_dir), 3)
    return r.select("qid", "party_id", "score", F.col("rank").cast("long").alias("rank"), "total", F.col("tied_at_top").cast("long").alias("tied_at_top"), "truncated")


@query(f"WITH h AS ({HITS}), r AS (SELECT *, row_number() OVER (PARTITION BY qid {ORDER}) AS rank FROM h WHERE score < 0.95 AND score >= 0.8) SELECT qid, party_id, rank FROM r WHERE rank <= 50")
def l3_p2_marginal_hits(spark, sf_dir):
    return below_the_line.marginal(_hits(spark, sf_dir), 0.95).select("qid", "party_id", F.col("rank").cast("long").alias("rank"))


@query(
    f"WITH h AS ({HITS}), t AS (SELECT qid, party_id FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM h) WHERE score = top), m AS (SELECT qid, count(*) AS tied, count(DISTINCT CASE WHEN split_part(party_id, '-', 2) = '1' THEN 'one' END) AS k, sum(CASE WHEN split_part(party_id, '-', 2) = '1' THEN 0 ELSE 1 END) AS lone FROM t GROUP BY qid)"
    " SELECT qid, tied, CASE WHEN k = 1 AND lone = 0 THEN 'one party' ELSE 'several parties' END AS note FROM m WHERE tied >= 3"
)
def p10_tie_notes(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    first = hits.where(F.substring_index("party_id", "-", -1) == "1").select(F.col("party_id").alias("id"), F.lit("one").alias("cluster_id")).distinct()
    return present.tie_note(hits, first)


@query(f"SELECT id, name FROM ({FLAT}) WHERE authority = 'CUST' AND contains(lower(name || ' ' || list || ' ' || program), 'building')")
def f9_f10_recent_filter(spark, sf_dir):
    return present.recent_filter(records(spark, sf_dir), "CUST", words=" Building ").select("id", "name")


def _bare(name: Column) -> Column:
    return present.short_name(F.concat(F.lit("JSC "), name, F.lit(", Ltd.")))


@query(f"SELECT id, CASE WHEN length(name) >= 3 THEN name ELSE 'JSC ' || name || ', Ltd.' END AS short FROM ({FLAT})")
def p8_short_names(spark, sf_dir):
    return records(spark, sf_dir).select("id", _bare(F.col("name")).alias("short"))


@query(
    f"WITH r AS ({FLAT}), f AS (SELECT id, unnest([{{'f': 'id', 'v': id}}, {{'f': 'authority', 'v': authority}}, {{'f': 'list', 'v': list}}, {{'f': 'type', 'v': kind}}, {{'f': 'name', 'v': name}}, {{'f': 'lists', 'v': list}}, {{'f': 'programs', 'v': program}}, {{'f': 'Date of Birth', 'v': born}}]) AS x FROM r)"
    " SELECT id, x.f AS field, x.v AS value FROM f WHERE x.v <> ''"
)
def k3_record_rows(spark, sf_dir):
    return present.record_rows(records(spark, sf_dir)).select("id", "field", "value")


@query("SELECT s_suppkey AS qid, 'SUP-' || s_suppkey AS party_id, 'Tax ID No.' AS id_type FROM supplier UNION ALL SELECT s_suppkey, 'CUST-' || c_custkey, 'VAT / Tax ID' FROM supplier JOIN customer ON c_custkey = s_suppkey")
def j4_m14_identifier_lane(spark, sf_dir):
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.concat(F.lit(" tx.000/"), "s_suppkey").alias("q"))
    return screening.identifier_lane(screening.query_table(asked), records(spark, sf_dir))


INITIALS = f"SELECT id, string_agg(substr(token, 1, 1), '' ORDER BY k) AS initials, count(*) AS n FROM (SELECT id, generate_subscripts(t, 1) AS k, unnest(t) AS token FROM (SELECT id, string_split(trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')), ' ') AS t FROM ({FLAT}))) GROUP BY id"


@query(f"WITH i AS ({INITIALS}), q AS (SELECT DISTINCT initials FROM i WHERE id LIKE 'PART-%') SELECT q.initials AS qid, i.id AS party_id FROM q JOIN i USING (initials) WHERE n BETWEEN 2 AND 6")
def j5_acronym_lane(spark, sf_dir):
    names = screening.names_table(records(spark, sf_dir))
    short = names.where("party_id like 'PART-%'").select(F.array_join(F.transform("tokens", lambda t: F.substring(t, 1, 1)), "").alias("q")).distinct()
    return screening.acronym_lane(screening.query_table(short.withColumn("qid", F.col("q"))), names)


TOKENS = f"SELECT DISTINCT id, token FROM ({WORDS}) WHERE length(token) BETWEEN 3 AND 7"


@query(
    f"WITH t AS ({TOKENS}), o AS (SELECT DISTINCT token FROM t), g AS (SELECT DISTINCT token, substr(token, CAST(unnest(range(1, length(token))) AS INT), 2) AS b FROM o), q AS (SELECT DISTINCT token FROM t WHERE id LIKE 'PART-%'),"
    " p AS (SELECT a.token AS x, b.token AS y FROM g a JOIN g b USING (b) JOIN q ON q.token = a.token WHERE abs(length(a.token) - length(b.token)) <= 1 GROUP BY 1, 2 HAVING count(*) >= 2) SELECT DISTINCT x AS qid, t.id AS party_id FROM p JOIN t ON t.token = p.y"
)
def j6_short_token_lane(spark, sf_dir):
    names = screening.names_table(records(spark, sf_dir))
    words = names.where("party_id like 'PART-%'").select(F.explode("tokens").alias("q")).where(F.length("q").between(3, 7)).distinct()
    return screening.short_token_lane(screening.query_table(words.withColumn("qid", F.col("q"))), names)
