"""Registered queries of what users read: guidance, roles, quality rates, groups, exports, changes and dates."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from partyloom.functions.dates import age_text, normalize_date, short_date
from partyloom.functions.similarity import DIGRAPHS
from partyloom.functions.text import Lexicon, name_tokens, other_script, reading_order
from partyloom.functions.vocab import can_be_identifier
from partyloom.operators import crosslist, graph, ownership, present, quality, stats
from partyloom.operators.shared import shared_dir
from partyloom.plans import below_the_line, screening
from partyloom.plans import snapshot as snap
from partyloom.queries import nation_edges, query, table
from partyloom.record_queries import FLAT, KEYS, PLACES, WORDS, records


def by_turn(key: str, values: list, kind: str = "string") -> Column:
    """The value for each row by its number."""
    many = F.array(*[F.lit(v).cast(kind) for v in values])
    return F.element_at(many, (F.col(key) % len(values) + 1).cast("int"))


def rows_sql(rows) -> str:
    """(k, ...) of a fixed table."""
    said = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({k}, {', '.join(map(said, r))})" for k, r in enumerate(rows)) + ")"


# Every branch: (authority, lists, measure, guidance).
DETERMINATIONS = (
    ("BIS", "BIS Denied Persons List", "", "Export privileges denied"), ("BIS", "BIS Unverified List", "", "Extra due diligence before export"), ("BIS", "BIS Military End-User List", "", "Military end-user licence required"),
    ("State", "ITAR Debarred List", "", "Debarred from defence trade"), ("State", "Nonproliferation Sanctions", "Block", "Nonproliferation restrictions"), ("BIS", "BIS Entity List", "Block", "Export licence required"),
    ("EU", "SDN List", "Block", "EU asset freeze"), ("UN", "UN List", "", "UN asset freeze"), ("UK", "UK List", "", "UK asset freeze"), ("OFAC", "Non-SDN CMIC List|SDN List", "", "Block"), ("OFAC", "Sectoral List", "BLOCK", "Block"),
    ("OFAC", "Non-SDN CMIC List", "", "Securities restriction"), ("OFAC", "CAPTA List", "", "Correspondent account restriction"), ("OFAC", "FSE List|Sectoral List", "", "Foreign sanctions evader"), ("OFAC", "Sectoral Sanctions", "", "Sectoral restriction"),
    ("OFAC", "Non-SDN Palestinian Legislative Council List", "", "Reject, don't block"), ("OFAC", "Non-SDN Menu-Based Sanctions List", "", "Menu-based restrictions"), ("OFAC", "Consolidated List", "", "Potential block: review"),
)


@query(f"SELECT p_partkey, authority, word FROM part JOIN {rows_sql([(a, w) for a, _, _, w in DETERMINATIONS])} t(k, authority, word) ON p_partkey % {len(DETERMINATIONS)} = k")
def p3_every_determination(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", *[by_turn("p_partkey", [d[k] for d in DETERMINATIONS]).alias(c) for k, c in enumerate(("authority", "lists", "measure"))])
    p = p.withColumns({"lists": F.split("lists", r"\|"), "measures": F.filter(F.array("measure"), lambda m: m != "")})
    return p.select("p_partkey", "authority", present.determination(F.col("authority"), F.col("lists"), ownership.is_blocking(F.col("lists"), F.lit(""), F.col("measures"))).alias("word"))


# Relationship types: (type, role, direction, ownership).
ROLES = (
    ("Owner of (50%+)", "owns", "down", True), ("Owns, controls, or operates", "owns", "down", True), ("Parent of", "owns", "down", True), ("Owned 50%+ by", "owned_by", "up", True), ("Owned or Controlled By", "owned_by", "up", True),
    ("Subsidiary of", "owned_by", "up", True), ("Property in the interest of", "owned_by", "up", False), ("Family member of", None, "peer", False), ("Associate of", None, "peer", False), ("Acting for or on behalf of", None, "up", False),
    ("Beneficial interest in", None, "up", True), ("", None, "up", False),
)


@query(f"SELECT 'CUST-' || c_custkey AS src, 'CUST-' || (c_custkey + 1) AS dst, type, role, dir, ownership FROM customer JOIN {rows_sql(ROLES)} t(k, type, role, dir, ownership) ON c_custkey % {len(ROLES)} = k")
def g1_g4_every_role(spark, sf_dir):
    r = records(spark, sf_dir).where("authority = 'CUST'").withColumn("key", F.substring_index("id", "-", -1).cast("long"))
    linked = F.struct(by_turn("key", [x[0] for x in ROLES]).alias("type"), F.concat(F.lit("CUST-"), F.col("key") + 1).alias("relatedId"), F.lit("").alias("relatedName"), F.lit(None).cast("boolean").alias("inSnapshot"))
    e = graph.edges(r.withColumn("relationships", F.array(linked)))
    return e.select("src", "dst", "type", "role", graph.relation_direction(F.col("type")).alias("dir"), "ownership")


def uneven(spark, sf_dir):
    """Party records of which some lack what others have, by number."""
    r = records(spark, sf_dir).withColumn("key", F.substring_index("id", "-", -1).cast("long"))
    again = F.concat("names", F.transform("names", lambda n: n.withField("primary", F.lit(False)).withField("name", F.concat(n["name"], F.lit(" II")))))
    told = lambda label, value: F.struct(F.lit("Identity").alias("group"), F.lit(label).alias("label"), value.alias("value"))
    facts = F.array(
        told("Date of Birth", F.when(F.col("key") % 3 == 0, "about then").otherwise("1960")),
        told("Nationality", F.when(F.col("key") % 4 == 0, "Nowhere").otherwise("France")),
        told("Shoe size", F.lit("44")),
    )
    return r.withColumns({
        "names": F.when(F.col("key") % 2 == 0, again).otherwise(F.col("names")),
        "addresses": F.when(F.col("key") % 4 == 1, F.slice("addresses", 1, 0)).otherwise(F.col("addresses")),
        "attributes": F.when(F.col("key") % 5 > 0, facts).otherwise(F.slice(facts, 1, 0)),
        "identifiers": F.when(F.col("key") % 7 == 0, F.slice("identifiers", 1, 0)).when(F.col("key") % 7 == 1, F.transform("identifiers", lambda i: i.withField("type", F.lit("Thing")))).otherwise(F.col("identifiers")),
    }).drop("key")


NUMBERED = f"SELECT *, CAST(split_part(id, '-', 2) AS BIGINT) AS key FROM ({FLAT})"
_SHARE = lambda c: f"avg(CASE WHEN {c} THEN 1.0 ELSE 0 END)::DOUBLE"


@query(
    f"SELECT authority, count(*) AS count, round({_SHARE('key % 2 = 0')}, 9) AS alias, round({_SHARE('key % 4 <> 1')}, 9) AS address, round({_SHARE('key % 7 > 0')}, 9) AS identifier,"
    f" round({_SHARE('key % 5 > 0 AND key % 3 > 0')}, 9) AS birth, round({_SHARE('key % 5 > 0')}, 9) AS nationality FROM ({NUMBERED}) GROUP BY 1"
)
def a15_uneven_profile(spark, sf_dir):
    p = quality.profile(uneven(spark, sf_dir))
    return p.select("authority", "count", *[F.round(c, 9).alias(n) for c, n in (("aliasRate", "alias"), ("addressRate", "address"), ("identifierRate", "identifier"), ("birthDateRate", "birth"), ("nationalityRate", "nationality"))])


@query(
    f"SELECT round(sum(CASE WHEN key % 5 > 0 AND key % 3 > 0 THEN 1 ELSE 0 END) / sum(CASE WHEN key % 5 > 0 THEN 1 ELSE 0 END), 9) AS dob,"
    f" round((sum(CASE WHEN key % 5 > 0 AND key % 4 > 0 THEN 1 ELSE 0 END) + sum(CASE WHEN key % 4 <> 1 THEN 1 ELSE 0 END)) / (sum(CASE WHEN key % 5 > 0 THEN 1 ELSE 0 END) + sum(CASE WHEN key % 4 <> 1 THEN 1 ELSE 0 END)), 9) AS country,"
    f" round(1 / 3, 9) AS attribute, round(sum(CASE WHEN key % 7 = 1 THEN 1 ELSE 0 END) / sum(CASE WHEN key % 7 > 0 THEN 1 ELSE 0 END), 9) AS identifier FROM ({NUMBERED})"
)
def q3_c2_uneven_rates(spark, sf_dir):
    d = quality.derived(uneven(spark, sf_dir))
    return d.select(*[F.round(c, 9).alias(n) for c, n in (("dobParseRate", "dob"), ("countryResolveRate", "country"), ("attributeUnclassifiedRate", "attribute"), ("identifierUnclassifiedRate", "identifier"))])


@query(
    "WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),"
    " u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(id, hop) AS (SELECT 'n3', 0 UNION SELECT u.b, hop + 1 FROM w JOIN u ON u.a = w.id WHERE hop < 3)"
    " SELECT id, min(hop) AS hop FROM w GROUP BY id ORDER BY 2, 1 LIMIT 300"
)
def g2_l6_capped_ego(spark, sf_dir):
    """Three hops, nearest first, up to the cap."""
    return graph.ego_nodes(nation_edges(spark, sf_dir), "n3", 3).select("id", F.col("hop").cast("long").alias("hop"))


@query(
    f"SELECT * FROM (SELECT 'added' AS change, id, name FROM ({FLAT}) WHERE place = 1 ORDER BY lower(name), id LIMIT 40) UNION ALL SELECT * FROM (SELECT 'removed', id, name FROM ({FLAT}) WHERE place = 2 ORDER BY lower(name), id LIMIT 40)"
)
def j13_l5_capped_delta(spark, sf_dir):
    """The first 40 changes of either kind, by name in reading order."""
    r = records(spark, sf_dir)
    at = F.col("addresses")[0]["country"]
    return snap.delta(r.where(at != PLACES[1]), r.where(at != PLACES[2]), most=40).select("change", "id", "name")


@query(
    "SELECT 0 AS at, chr(65279) || '\"n_nationkey\",\"n_name\",\"n_regionkey\"' AS line UNION ALL SELECT 1 + n_nationkey, '\"' || n_nationkey || '\",\"' || n_name || ' \"\"X\"\"\",\"' || n_regionkey || '\"' FROM nation"
    " UNION ALL SELECT 1 + (SELECT count(*) FROM nation), '\"Retrieved\",\"2024-01-02\"' UNION ALL SELECT 2 + (SELECT count(*) FROM nation), '\"Publication\",\"77\"' UNION ALL SELECT 3 + (SELECT count(*) FROM nation), '\"Threshold\",\"0.95\"'"
)
def k4_k5_csv_lines(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("n_name", F.concat("n_name", F.lit(' "X"')))
    lines = present.csv_lines(n, ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"], present.provenance("2024-01-02", "77", 0.95))
    return lines.coalesce(1).select(F.monotonically_increasing_id().alias("at"), "line")


@query(
    "WITH a AS (SELECT o_orderpriority AS authority, max(o_orderdate) AS as_of FROM orders GROUP BY 1), n AS (SELECT max(as_of) + INTERVAL 30 HOUR AS now FROM a)"
    " SELECT authority, floor(date_diff('minute', as_of, now) / 60)::BIGINT AS age_hours, floor(date_diff('minute', as_of, now) / 60) >= 24 AS stale FROM a, n"
)
def q2_freshness(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("authority")).agg(F.max("o_orderdate").alias("as_of"))
    last = a.agg(F.max("as_of")).first()[0]
    return snap.freshness(a, F.lit(last) + F.expr("INTERVAL 30 HOURS")).select("authority", "age_hours", "stale")


@query("SELECT o_orderkey AS publication_id FROM orders WHERE year(o_orderdate) = 1998 ORDER BY 1 DESC LIMIT 12")
def s14_publications(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("publication_id"), F.col("o_orderdate").alias("published_at"))
    return snap.publications(o, F.lit(1998)).select("publication_id")


SHAPES = (("IMO 9345678", "imo"), ("9345678", "imo"), ("273000111", "mmsi"), ("0x" + "aB" * 20, "crypto"), ("1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "crypto"), ("bc1qxy2kgdygjrsqtzq2n0yrf2493p83kkfj", ""), ("hello", ""), ("12345678", ""))


@query(f"SELECT p_partkey, q, shape FROM part JOIN {rows_sql(SHAPES)} t(k, q, shape) ON p_partkey % {len(SHAPES)} = k")
def f8_query_shapes(spark, sf_dir):
    q = by_turn("p_partkey", [s for s, _ in SHAPES])
    return table(spark, sf_dir, "part").select("p_partkey", q.alias("q"), below_the_line.query_shape(q).alias("shape"))


# (name, tokens, whether it has letters of another script); a title is dropped, a mixed word is disguised Latin.
SCRIPTS = (
    ("Владимир Путин", "VLADIMIR PUTIN", True), ("ЩУКИН", "SHCHUKIN", True), ("РАYPAL", "PAYPAL", True), ("Ελλάδα", "ELLADA", True), ("Prof Dr José Núñez-O'Neil", "JOSE NUNEZ O NEIL", False),
    ("Mr Smith", "SMITH", False), ("Mr", "MR", False), ("中国ABC銀行", "中国 ABC 銀行", True), ("ｆｕｌｌ １２", "FULL 12", False), ("  a--b  ", "A B", False),
)


@query(f"SELECT c_custkey, tokens, other FROM customer JOIN {rows_sql([(t, o) for _, t, o in SCRIPTS])} t(k, tokens, other) ON c_custkey % {len(SCRIPTS)} = k")
def n2_n7_scripts_and_titles(spark, sf_dir):
    raw = by_turn("c_custkey", [s for s, _, _ in SCRIPTS])
    titles = Lexicon(titles=(("PROF", "DR"), ("MR",)))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(name_tokens(raw, titles), " ").alias("tokens"), other_script(raw).alias("other"))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS shown, CASE WHEN o_orderkey % 50 < 1 THEN 'just now' WHEN o_orderkey % 50 < 24 THEN (o_orderkey % 50) || ' h ago' ELSE (o_orderkey % 50) // 24 || ' d ago' END AS age FROM orders"
)
def d6_short_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", short_date(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("shown"), age_text(F.col("o_orderkey") % 50).alias("age"))


@query(
    f"WITH e AS (SELECT id AS owned, rid AS owner FROM ({FLAT}) WHERE rel <> ''), n AS (SELECT owned AS id FROM e UNION SELECT owner FROM e), g AS (SELECT id, CASE WHEN id IN ('CUST-0', 'SUP-0') THEN 'CUST-0' ELSE 'CUST-1' END AS group_id FROM n),"
    f" k AS (SELECT g.id, g.group_id, (SELECT count(*) FROM e WHERE e.owner = g.id) AS owned, coalesce(f.name, g.id) AS name FROM g LEFT JOIN ({FLAT}) f ON f.id = g.id),"
    " l AS (SELECT group_id, count(*) AS size, first(name ORDER BY owned DESC, name) AS label FROM k GROUP BY 1)"
    " SELECT g.id, group_id, size, label FROM g JOIN l USING (group_id)"
)
def g8_a18_ownership_groups(spark, sf_dir):
    """Customers are one tree of subsidiaries with suppliers at its members; number 0 stands apart."""
    return ownership.groups(records(spark, sf_dir))


@query(
    f"WITH k AS ({KEYS}), w AS (SELECT DISTINCT id, token FROM ({WORDS}) WHERE length(token) >= 4), f AS (SELECT token FROM w GROUP BY token HAVING ln(((SELECT count(*) FROM ({FLAT})) + 1.0) / (count(*) + 1)) + 1 >= 6.5),"
    " p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.key = b.key AND a.id < b.id JOIN w x ON x.id = a.id JOIN w y ON y.id = b.id AND y.token = x.token JOIN f ON f.token = x.token)"
    " SELECT a AS id, 'SUP' AS also_listed_by, b AS other, 'high' AS confidence FROM p UNION ALL SELECT b, 'CUST', a, 'high' FROM p"
)
def g11_cross_listing(spark, sf_dir):
    """Suppliers and customers that are one party: who else lists each."""
    r = records(spark, sf_dir)
    seen = crosslist.cross_listing(r, crosslist.clusters(r)).where(F.size("also_listed_by") > 0)
    return seen.select("id", F.array_join("also_listed_by", ",").alias("also_listed_by"), F.get("others", 0)["id"].alias("other"), "confidence")


@query("SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 30 OFFSET 60")
def l7_l8_named_page(spark, sf_dir):
    """The third page of parts by name in reading order, some in capitals."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    shout = p.withColumn("shown", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return present.page(shout, [reading_order(F.lower("shown")), F.col("p_partkey")], 60, 30).select("p_partkey", "p_name")


LABELLED = (("Passport", True), ("Nationality Country", False), ("Place of Birth:", False), ("Gender", False), ("Tax ID No.", True), ("Executive Order 13662", False), ("Whatever", True))


@query(f"SELECT p_partkey, able FROM part JOIN {rows_sql([(a,) for _, a in LABELLED])} t(k, able) ON p_partkey % {len(LABELLED)} = k")
def v3_f12_identifying_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", can_be_identifier(by_turn("p_partkey", [x for x, _ in LABELLED])).alias("able"))


_DIGRAPHED = reduce(lambda x, pair: f"replace({x}, '{pair[0]}', '{pair[1]}')", DIGRAPHS, "token")


def _once(s: str) -> str:
    """s without repeats of a character next to itself, in SQL."""
    return f"array_to_string(list_transform(range(1, length({s}) + 1), lambda k: CASE WHEN k > 1 AND substr({s}, k, 1) = substr({s}, k - 1, 1) THEN '' ELSE substr({s}, k, 1) END), '')"


GRAM_SETS = (
    f"WITH t AS (SELECT id, k, token FROM (SELECT id, generate_subscripts(t, 1) AS k, unnest(t) AS token FROM (SELECT id, string_split(trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')), ' ') AS t FROM ({FLAT})))),"
    f" d AS (SELECT id, k, token, {_DIGRAPHED} AS f FROM t), o AS (SELECT id, k, token, translate({_once('f')}, 'EYJOHW', 'IIIU') AS f FROM d),"
    f" w AS (SELECT id, string_agg(token, '' ORDER BY k) AS whole, string_agg(regexp_replace({_once('f')}, '[^A-Z0-9]', '', 'g'), '' ORDER BY k) AS fold FROM o GROUP BY id),"
    " g AS (SELECT DISTINCT id, substr(whole, i, 3) AS gram FROM w, range(1, 200) r(i) WHERE i <= length(whole) - 2 UNION SELECT DISTINCT id, '~' || substr(fold, i, 3) FROM w, range(1, 200) r(i) WHERE i <= length(fold) - 2),"
    " n AS (SELECT id, greatest(1, floor(count(*) * 0.25)) AS need FROM g GROUP BY id)"
)


@query(
    GRAM_SETS + f", q AS (SELECT name AS qid, min(id) AS id FROM ({FLAT}) WHERE authority <> 'CUST' GROUP BY name)"
    " SELECT q.qid, b.id AS party_id FROM q JOIN g a ON a.id = q.id JOIN g b USING (gram) JOIN n ON n.id = q.id GROUP BY q.qid, b.id, need HAVING count(*) >= need"
)
def j3_m7_library_gram_lane(spark, sf_dir):
    """Distinct supplier and part names through the library's gram lane, against all parties."""
    r = records(spark, sf_dir)
    asked = r.where("authority <> 'CUST'").select(F.col("name").alias("qid"), F.col("name").alias("q")).distinct()
    return screening.gram_lane(screening.query_table(asked), screening.names_table(r))


REGION = "SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'n' || n_nationkey, 'r1' FROM nation WHERE n_regionkey = 1"


@query(
    f"WITH e AS ({REGION}), d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)"
    " SELECT (SELECT count(*) FROM d) AS nodes, (SELECT count(*) FROM e) AS edges, 0 AS ownership_edges, (SELECT list(id ORDER BY degree DESC, id) FROM (SELECT * FROM d ORDER BY degree DESC, id LIMIT 5)) AS top"
)
def a17_j15_ego_metrics(spark, sf_dir):
    """The region r1 with its nations and their customers: the induced edges and the five heaviest nodes."""
    e = nation_edges(spark, sf_dir).withColumns({"ownership": F.lit(False), "type": F.lit("Linked to")})
    near = graph.ego_nodes(e, "r1", 2, None)
    return graph.ego_metrics(near, graph.induced_edges(e, near)).select("nodes", "edges", "ownership_edges", "top")


@query(f"WITH e AS ({REGION}) SELECT 'r1' AS id, 0 AS level UNION ALL SELECT src, CASE WHEN dst = 'r1' THEN 1 ELSE 2 END FROM e")
def g12_levels(spark, sf_dir):
    """Nations stand below their region, customers below their nation."""
    e = nation_edges(spark, sf_dir).withColumn("type", F.lit("Subsidiary of"))
    return graph.assign_levels(e, "r1").select("id", F.col("level").cast("int").alias("level"))


@query(
    f"WITH c AS (SELECT id, name, list, place FROM ({FLAT})), v AS (SELECT * FROM c WHERE place <> 2)"
    " SELECT 'record' AS what, id, list AS detail FROM v UNION ALL SELECT 'change', id, 'added' FROM c WHERE place = 1 UNION ALL SELECT 'change', id, 'removed' FROM c WHERE place = 2"
    f" UNION ALL SELECT 'profile', authority, '' || count(*) FROM ({FLAT}) WHERE place <> 2 GROUP BY authority"
)
def k1_k2_published_snapshot(spark, sf_dir):
    """A version published with its profile and its changes, and read back by the pointer."""
    r = records(spark, sf_dir)
    at = F.col("addresses")[0]["country"]
    now, root = r.where(at != PLACES[2]), f"{shared_dir(spark)}/partyloom/published-{uuid.uuid4().hex}"
    snap.write_aside(quality.profile(now), root, "quality", "v2")
    snap.write_aside(snap.delta(r.where(at != PLACES[1]), now, most=1 << 30), root, "changes", "v2")
    snap.write_snapshot(now, root, "v2")
    version, parties, _ = snap.current(spark, root)
    changed, told = (snap.read_aside(spark, root, k, version) for k in ("changes", "quality"))
    out = parties.select(F.lit("record").alias("what"), "id", F.col("list").alias("detail"))
    out = out.unionByName(changed.select(F.lit("change").alias("what"), "id", F.col("change").alias("detail")))
    return out.unionByName(told.select(F.lit("profile").alias("what"), F.col("authority").alias("id"), F.col("count").cast("string").alias("detail")))


@query(
    f"WITH r AS ({FLAT}), e AS (SELECT id AS owned, rid AS owner FROM r WHERE rel <> ''), m AS (SELECT owned AS id FROM e UNION SELECT owner FROM e),"
    f" k AS ({KEYS}), w AS (SELECT DISTINCT id, token FROM ({WORDS}) WHERE length(token) >= 4), f AS (SELECT token FROM w GROUP BY token HAVING ln(((SELECT count(*) FROM ({FLAT})) + 1.0) / (count(*) + 1)) + 1 >= 6.5),"
    " p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.key = b.key AND a.id < b.id JOIN w x ON x.id = a.id JOIN w y ON y.id = b.id AND y.token = x.token JOIN f ON f.token = x.token)"
    " SELECT r.id AS party_id, name, list, CASE WHEN m.id IS NULL THEN NULL WHEN r.id IN ('CUST-0', 'SUP-0') THEN 'CUST-0' ELSE 'CUST-1' END AS group_id, CASE WHEN x.a IS NOT NULL THEN 'SUP' WHEN y.b IS NOT NULL THEN 'CUST' END AS also_listed_by"
    " FROM r LEFT JOIN m ON m.id = r.id LEFT JOIN p x ON x.a = r.id LEFT JOIN p y ON y.b = r.id"
)
def p1_j16_enriched_hits(spark, sf_dir):
    """Every party as a hit, with its record, its ownership group and its other listings."""
    r = records(spark, sf_dir)
    hits = r.select(F.lit(0).alias("qid"), F.col("id").alias("party_id"), F.lit(1.0).alias("score"))
    rich = present.enriched(hits, r, ownership.profile(r), ownership.groups(r), crosslist.cross_listing(r, crosslist.clusters(r)))
    return rich.select("party_id", "name", "list", F.col("cluster.group_id").alias("group_id"), F.get("cross_listed.also_listed_by", 0).alias("also_listed_by"))


def dated(spark, sf_dir):
    """Party records with a day of listing each, some in the other way of writing, some without."""
    r = records(spark, sf_dir).withColumn("key", F.substring_index("id", "-", -1).cast("int"))
    day = F.date_add(F.lit("2001-01-01").cast("date"), (F.col("key") % 1500).cast("int"))
    written = F.when(F.col("key") % 7 == 0, "").when(F.col("key") % 2 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd'T'00:00:00"))
    return r.withColumn("datePublished", written).drop("key")


DATED = f"SELECT *, CASE WHEN key % 7 > 0 THEN (DATE '2001-01-01' + CAST(key % 1500 AS INT)) END AS day FROM ({NUMBERED})"


@query(
    f"SELECT count(*) AS parties, 0::BIGINT AS with_aliases, count(*) AS with_identifiers, count(*) FILTER (rel <> '') AS with_relationships, count(*) FILTER (rel <> '') AS edges, count(*) FILTER (rel <> '') AS ownership_edges,"
    f" count(day) AS dated, min(day) AS oldest, max(day) AS newest, count(*) FILTER (DATE '2003-06-01' - day BETWEEN 0 AND 30) AS added_30, count(*) FILTER (DATE '2003-06-01' - day BETWEEN 0 AND 90) AS added_90, count(*) FILTER (DATE '2003-06-01' - day BETWEEN 0 AND 365) AS added_365 FROM ({DATED})"
)
def a5_a8_totals(spark, sf_dir):
    return stats.totals(dated(spark, sf_dir), F.lit("2003-06-01").cast("date"))


@query(
    f"WITH d AS ({DATED}), l AS (SELECT date_trunc('month', max(day)) AS last FROM d), m AS (SELECT unnest(generate_series(last - INTERVAL 23 MONTH, last, INTERVAL 1 MONTH)) AS m FROM l), a AS (SELECT DISTINCT authority FROM d WHERE day IS NOT NULL)"
    " SELECT strftime(m, '%Y-%m') AS month, a.authority, count(d.day) AS count FROM m CROSS JOIN a LEFT JOIN d ON date_trunc('month', d.day) = m AND d.authority = a.authority GROUP BY 1, 2"
    " UNION ALL SELECT '' || y, 'year', count(day) FROM (SELECT unnest(range(year(last) - 15, year(last) + 1)) AS y FROM l) LEFT JOIN d ON year(day) = y GROUP BY 1, 2"
)
def a7_a9_months_and_years(spark, sf_dir):
    rows = dated(spark, sf_dir).withColumn("date", normalize_date(F.col("datePublished")))
    months = stats.monthly(rows, by="authority").select("month", "authority", "count")
    return months.unionByName(stats.yearly(rows).select(F.col("year").cast("string").alias("month"), F.lit("year").alias("authority"), "count"))


@query(f"SELECT id, name FROM ({FLAT}) WHERE starts_with(upper(name), 'RED') OR contains(upper(name), ' RED') ORDER BY lower(name), id LIMIT 25")
def l4_library_prefix_hits(spark, sf_dir):
    return below_the_line.prefix_hits(records(spark, sf_dir), "red")


@query(
    "WITH h AS (SELECT l_orderkey AS qid, l_partkey || '-' || l_linenumber || '-' || l_suppkey AS party_id, round(1 - l_discount * 2, 4) AS score, CASE WHEN l_suppkey % 3 > 0 THEN 'G' || (l_suppkey % 3) END AS group_id FROM lineitem),"
    " c AS (SELECT *, CASE WHEN group_id IS NOT NULL THEN count(*) OVER (PARTITION BY qid, group_id) END AS group_hits FROM h)"
    " SELECT qid, party_id, group_hits, row_number() OVER (PARTITION BY qid ORDER BY group_id IS NULL, group_hits DESC, group_id, score DESC, party_id) AS place FROM c"
)
def a22_w3_group_sorted(spark, sf_dir):
    """Line items as hits of their orders, in groups by supplier."""
    li = table(spark, sf_dir, "lineitem")
    party = F.concat_ws("-", "l_partkey", "l_linenumber", "l_suppkey")
    hits = li.select(F.col("l_orderkey").alias("qid"), F.concat_ws("/", "l_orderkey", party).alias("party_id"), party.alias("shown"), F.round(1 - F.col("l_discount") * 2, 4).alias("score"))
    groups = li.where("l_suppkey % 3 > 0").select(F.concat_ws("/", "l_orderkey", party).alias("id"), F.concat(F.lit("G"), F.col("l_suppkey") % 3).alias("group_id")).distinct()
    return present.group_sorted(hits, groups).select("qid", F.col("shown").alias("party_id"), "group_hits", F.col("place").cast("long").alias("place"))


@query(
    f"SELECT id, 'Identity' AS grp, 2 AS n, list || ' last' AS lists FROM ({FLAT}) WHERE list <> 'Consolidated List' UNION ALL SELECT id, 'Documents', 1, list || ' last' FROM ({FLAT}) WHERE list <> 'Consolidated List'"
    f" UNION ALL SELECT id, unnest(['Identity', 'Documents']), unnest([2, 1]), 'A List last' FROM ({FLAT}) WHERE list = 'Consolidated List'"
)
def p5_p6_groups_and_lists(spark, sf_dir):
    """Attributes by display group, in order, and lists with the umbrella list last."""
    r = records(spark, sf_dir)
    told = lambda g, k: F.struct(F.lit(g).alias("group"), F.lit(k).alias("label"), F.lit("v").alias("value"))
    r = r.withColumn("attributes", F.array(told("Identity", "Gender"), told("Documents", "Passport"), told("Identity", "Nationality")))
    first = F.when(F.col("list") == "Consolidated List", "A List").otherwise(F.col("list"))
    lists = r.select("id", F.replace(F.array_join(present.ordered_lists(F.array(F.lit("Consolidated List"), first)), " "), F.lit("Consolidated List"), F.lit("last")).alias("lists"))
    groups = present.attribute_groups(r).where("position > 0 AND attributes[0].label IN ('Gender', 'Passport')")
    return groups.join(lists, "id").select("id", F.col("group").alias("grp"), F.size("attributes").alias("n"), "lists")


@query(
    f"WITH r AS ({FLAT}) SELECT authority, count(*) AS n, authority <> 'CUST' AND authority <> 'SUP' AS fresh FROM r WHERE authority = 'PART' OR place <> 3 GROUP BY 1"
)
def s15_s16_assembly(spark, sf_dir):
    """Three sources: one broken, one too short, one sound; the first two keep the previous snapshot's records."""
    r = records(spark, sf_dir)
    previous = r.where(F.col("addresses")[0]["country"] != PLACES[3])
    of = lambda a: r.where(F.col("authority") == a)
    broken = lambda: of("SUP").withColumn("name", F.raise_error(F.lit("gone")))
    done = snap.assemble([snap.Source("a", ("SUP",), broken, 1), snap.Source("b", ("CUST",), lambda: of("CUST").limit(3), 4), snap.Source("c", ("PART",), lambda: of("PART"), 1)], previous)
    sound = [a for x in done.log if x["ok"] for a in x["authorities"]]
    return done.parties.groupBy("authority").agg(F.count(F.lit(1)).alias("n")).withColumn("fresh", F.col("authority").isin(*sound))
