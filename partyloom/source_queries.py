"""Registered queries of the readers: given tables written in each published layout into the shared folder, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partyloom.operators.shared import dealt, shared_dir
from partyloom.queries import query, table
from partyloom.record_queries import FLAT, records
from partyloom.screening_queries import CYRILLIC, LATIN, native_records
from partyloom.sources import csl_json, eu_xml, ofac_flat, ofac_xml, party_json, table_functions, uk_csv, un_xml


def folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/partyloom/{tag}-{uuid.uuid4().hex}"


def filled(template: str) -> Column:
    """A text with {column} or {expression} in it."""
    parts = []
    for k, piece in enumerate(template.replace("{", "}").split("}")):
        if piece:
            parts.append(F.expr(piece).cast("string") if k % 2 else F.lit(piece))
    return F.concat(*parts)


def written(df: DataFrame, template: str, tag: str) -> str:
    """A text file of one line a row."""
    path = folder(df.sparkSession, tag)
    df.select(filled(template).alias("value")).write.text(path)
    return path


#: Records of a document, about.
DOCUMENT = 1000


def documents(df: DataFrame, value: Column, key: str, begin: str, end: str, tag: str, between: str = "\n") -> str:
    """A folder of documents of about DOCUMENT records: begin, the records' texts, end."""
    path = folder(df.sparkSession, tag)
    files = max(1, df.count() // DOCUMENT)
    rows = df.groupBy(F.pmod(F.xxhash64(key), F.lit(files)).alias("file")).agg(F.array_join(F.collect_list(value), between).alias("body"))
    rows.select("file", F.concat(F.lit(begin), "body", F.lit(end)).alias("value")).write.partitionBy("file").text(path)
    return path


value_of = lambda column, label: F.get(F.transform(F.filter(column, lambda a: a["label"] == label), lambda a: a["value"]), 0)
number_of = lambda kind: F.get(F.transform(F.filter("identifiers", lambda i: i["type"] == kind), lambda i: i["value"]), 0)


@query(
    "SELECT '' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' List' ELSE 'Consolidated List' END AS list, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS lists, CASE WHEN c_custkey % 3 = 0 THEN '2021-02-03' ELSE '2020-01-01' END AS published,"
    " ['P-' || c_nationkey] AS programs, '1970 to 1979 (range 1970-01-01–1979-12-31)' AS born, 'TX' || c_custkey AS tax, CASE WHEN c_custkey > 1 THEN '' || (c_custkey - 1) END AS related, CASE WHEN c_custkey % 2 = 0 THEN 'Old & ' || c_name END AS alias,"
    " 'Pier ' || c_custkey || ', Oslo, Norway' AS place FROM customer"
)
def s4_s6_ofac_xml(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    alias = "{CASE WHEN c_custkey % 2 = 0 THEN concat('<name><isPrimary>false</isPrimary><aliasType>A.K.A.</aliasType><translations><translation><isPrimary>true</isPrimary><script>Latin</script><formattedFullName>Old &amp; ', c_name, '</formattedFullName></translation></translations></name>') ELSE '' END}"
    path = documents(
        c,
        filled('<entity id="{c_custkey}"><generalInfo><entityType>Individual</entityType></generalInfo><sanctionsLists><sanctionsList datePublished="2020-01-01">Consolidated List</sanctionsList>'
        "{CASE WHEN c_custkey % 3 = 0 THEN concat('<sanctionsList datePublished=\"2021-02-03\">', c_mktsegment, ' List</sanctionsList>') ELSE '' END}</sanctionsLists>"
        "<sanctionsPrograms><sanctionsProgram>P-{c_nationkey}</sanctionsProgram></sanctionsPrograms>"
        "<names><name><isPrimary>true</isPrimary><translations><translation><isPrimary>true</isPrimary><script>Latin</script><formattedFullName>{c_name}</formattedFullName></translation></translations></name>" + alias + "</names>"
        "<addresses><address><country>Norway</country><translations><translation><address1>Pier {c_custkey}</address1><city>Oslo</city></translation></translations></address></addresses>"
        "<features><feature><type>Birthdate</type><value>1970 to 1979</value><valueDate><isApproximate>false</isApproximate><isDateRange>true</isDateRange><fromDateBegin>1970-01-01</fromDateBegin><toDateEnd>1979-12-31</toDateEnd></valueDate></feature>"
        "<feature><type>Tax ID No.</type><value>TX{c_custkey}</value></feature></features>"
        "{CASE WHEN c_custkey > 1 THEN concat('<relationships><relationship><type>Owner of (50%+)</type><relatedEntity entityId=\"', c_custkey - 1, '\"/></relationship></relationships>') ELSE '' END}</entity>"),
        "c_custkey",
        "<sanctionsData><entities>",
        "</entities></sanctionsData>",
        "ofac-xml",
    )
    r = ofac_xml.read(spark, path)
    return r.select(
        "id", "name", "list", F.size("lists").alias("lists"), F.col("datePublished").alias("published"), "programs", value_of("attributes", "Birthdate").alias("born"), number_of("Tax ID").alias("tax"),
        F.get("relationships", 0)["relatedId"].alias("related"), F.get("names", 1)["name"].alias("alias"), F.get("addresses", 0)["full"].alias("place"),
    )


REMARKS = "DOB {1950 + s_suppkey % 40}; Passport P{s_suppkey} (Iran); nationality France; Digital Currency Address - XBT 1abc{s_suppkey}; odd note {s_suppkey}"


@query(
    "SELECT '' || s_suppkey AS id, s_name || ' \"SEA\" LINES' AS name, ['A', 'B' || s_nationkey] AS programs, CASE WHEN s_suppkey % 2 = 0 THEN ['FIRST ' || s_suppkey, 'SECOND ' || s_suppkey] ELSE ['SECOND ' || s_suppkey] END AS aliases,"
    " 'Pier ' || s_suppkey || E'\\nGate, Oslo 1, Norway' AS place, '' || (1950 + s_suppkey % 40) AS born, 'P' || s_suppkey || ' (Iran)' AS document, 'P' || s_suppkey AS passport, '1abc' || s_suppkey AS coin, 'odd note ' || s_suppkey AS note FROM supplier"
)
def s3_s7_s8_flat_csv(spark, sf_dir):
    """Doubled quotes, a line break inside quotes, ragged lines, aliases out of order and of nobody."""
    s = table(spark, sf_dir, "supplier")
    prim = written(s, '{s_suppkey},"{s_name} ""SEA"" LINES","-0- ","A; B{s_nationkey}","-0-","-0-","Tanker","-0-","-0-","-0-","-0-","' + REMARKS + '"{CASE WHEN s_suppkey % 9 = 0 THEN \'\\nx,bad,-0-,-0-\' ELSE \'\' END}', "flat-prim")
    first = "{CASE WHEN s_suppkey % 2 = 0 THEN concat('\\n', s_suppkey, ',1,\"fka\",\"FIRST ', s_suppkey, '\",\"-0-\"') ELSE '' END}"
    alt = written(s, '{s_suppkey},2,"aka","SECOND {s_suppkey}","weak"' + first + "{CASE WHEN s_suppkey % 9 = 0 THEN '\\n-5,1,\"aka\",\"NOBODY\",\"-0-\"' ELSE '' END}", "flat-alt")
    add = written(s, '{s_suppkey},1,"Pier {s_suppkey}\nGate","Oslo 1","Norway","-0-"', "flat-add")
    r = ofac_flat.read(spark, prim, alt, add, "SDN List")
    return r.select(
        "id", "name", "programs", F.transform(F.slice("names", 2, 9), lambda n: n["name"]).alias("aliases"), F.get("addresses", 0)["full"].alias("place"), value_of("attributes", "Date of Birth").alias("born"),
        value_of("attributes", "Passport").alias("document"), number_of("Passport").alias("passport"), number_of("Crypto XBT").alias("coin"), value_of("attributes", "Remark").alias("note"),
    )


@query(
    "SELECT 'EU-' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'An ' || c_custkey END AS alias, 'circa ' || (1950 + c_custkey % 40) AS born, 'P' || c_custkey AS passport, 'Street ' || c_custkey || ', Minsk, BELARUS' AS place,"
    " '2022-01-' || lpad('' || (1 + c_custkey % 28), 2, '0') AS published, 'EU.' || c_custkey AS reference FROM customer"
)
def s9_eu_xml(spark, sf_dir):
    path = documents(
        table(spark, sf_dir, "customer"),
        filled('<sanctionEntity logicalId="{c_custkey}" euReferenceNumber="EU.{c_custkey}" designationDate="2022-01-{lpad(1 + c_custkey % 28, 2, \'0\')}"><subjectType code="person"/>'
        '<nameAlias wholeName="{c_name}" strong="true" function="Head"/><nameAlias wholeName="{upper(c_name)}" strong="false"/>{CASE WHEN c_custkey % 4 = 0 THEN concat(\'<nameAlias firstName="An" lastName="\', c_custkey, \'" strong="false"/>\') ELSE \'\' END}'
        '<birthdate year="{1950 + c_custkey % 40}" circa="true" city="Minsk" countryDescription="BELARUS"/><citizenship countryDescription="UNKNOWN"/>'
        '<address street="Street {c_custkey}" city="Minsk" countryDescription="BELARUS"/><identification number="P{c_custkey}" identificationTypeDescription="National passport" countryDescription="BELARUS"/></sanctionEntity>'),
        "c_custkey",
        "<export>",
        "</export>",
        "eu-xml",
    )
    r = eu_xml.read(spark, path)
    return r.select(
        "id", "name", F.get("names", 1)["name"].alias("alias"), value_of("attributes", "Date of Birth").alias("born"), number_of("Passport").alias("passport"), F.get("addresses", 0)["full"].alias("place"),
        F.col("datePublished").alias("published"), value_of("attributes", "EU reference").alias("reference"),
    )


@query(
    "SELECT 'UN-C' || c_custkey AS id, c_name || ' Bin' AS name, 'Individual' AS type, '1950–' || (1952 + c_custkey % 5) AS born, 'N' || c_custkey AS passport, 'Ab ' || c_custkey AS alias, '' AS place FROM customer"
    " UNION ALL SELECT 'UN-S' || s_suppkey, s_name, 'Entity', NULL, NULL, NULL, 'Paris, France' FROM supplier"
)
def s10_un_xml(spark, sf_dir):
    people = documents(
        table(spark, sf_dir, "customer"),
        filled("<INDIVIDUAL><DATAID>C{c_custkey}</DATAID><FIRST_NAME>{c_name}</FIRST_NAME><SECOND_NAME>Bin</SECOND_NAME><UN_LIST_TYPE>X</UN_LIST_TYPE><REFERENCE_NUMBER>R{c_custkey}</REFERENCE_NUMBER><LISTED_ON>2001-01-01</LISTED_ON>"
        "<INDIVIDUAL_ALIAS><QUALITY>Low</QUALITY><ALIAS_NAME>Ab {c_custkey}</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_DATE_OF_BIRTH><FROM_YEAR>1950</FROM_YEAR><TO_YEAR>{1952 + c_custkey % 5}</TO_YEAR></INDIVIDUAL_DATE_OF_BIRTH>"
        "<INDIVIDUAL_DOCUMENT><TYPE_OF_DOCUMENT>Passport</TYPE_OF_DOCUMENT><NUMBER>N{c_custkey}</NUMBER></INDIVIDUAL_DOCUMENT></INDIVIDUAL>"),
        "c_custkey",
        "<LIST><INDIVIDUALS>",
        "</INDIVIDUALS></LIST>",
        "un-people",
    )
    firms = documents(table(spark, sf_dir, "supplier"), filled("<ENTITY><DATAID>S{s_suppkey}</DATAID><FIRST_NAME>{s_name}</FIRST_NAME><ENTITY_ADDRESS><CITY>Paris</CITY><COUNTRY>France</COUNTRY></ENTITY_ADDRESS></ENTITY>"), "s_suppkey", "<LIST><ENTITIES>", "</ENTITIES></LIST>", "un-firms")
    r = un_xml.read(spark, people).unionByName(un_xml.read(spark, firms))
    return r.select("id", "name", "type", value_of("attributes", "Date of Birth").alias("born"), number_of("Passport").alias("passport"), F.get("names", 1)["name"].alias("alias"), F.coalesce(F.get("addresses", 0)["full"], F.lit("")).alias("place"))


@query(
    "SELECT 'UK-' || s_suppkey AS id, s_name || ' MAIN' AS name, s_name || ' ALSO, \"x\"' AS alias, '03/02/2020' AS published, ['R' || s_nationkey] AS programs, '01/01/' || (1950 + s_suppkey % 40) AS born, 'P' || s_suppkey AS passport, 'Rd ' || s_suppkey || ', x, UK' AS place FROM supplier"
)
def s11_uk_csv(spark, sf_dir):
    """A banner, a header and two lines a party; the layout is one file, so it is written as one."""
    s = table(spark, sf_dir, "supplier")
    line = filled('{s_suppkey},Individual,{s_name},"ALSO, ""x""",AKA,Low,R{s_nationkey},01/02/2020,"Rd {s_suppkey}, x",UK,01/01/{1950 + s_suppkey % 40},P{s_suppkey}')
    main = filled("{s_suppkey},Individual,{s_name},MAIN,Primary name,,R{s_nationkey},03/02/2020,,,01/01/{1950 + s_suppkey % 40},P{s_suppkey}")
    head = ["Last Updated,01/01/2024", "Group ID,Group Type,Name 1,Name 6,Alias Type,Alias Quality,Regime,Listed On,Address 1,Country,DOB,Passport Number"]
    lines = s.select(F.col("s_suppkey").alias("k"), F.posexplode(F.array(line, main)).alias("at", "value"))
    top = spark.createDataFrame([(-2, 0, head[0]), (-1, 0, head[1])], "k long, at int, value string")
    path = folder(spark, "uk")
    top.unionByName(lines).coalesce(1).sortWithinPartitions("k", "at").select("value").write.text(path)
    r = uk_csv.read(spark, path)
    return r.select("id", "name", F.get("names", 1)["name"].alias("alias"), F.col("datePublished").alias("published"), "programs", value_of("attributes", "Date of Birth").alias("born"), number_of("Passport").alias("passport"), F.get("addresses", 0)["full"].alias("place"))


@query(
    "SELECT CASE p_partkey % 3 WHEN 0 THEN 'BIS' WHEN 1 THEN 'BIS' ELSE 'State' END || '-' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'BIS Entity List' WHEN 1 THEN 'BIS Denied Persons List' ELSE 'ITAR Debarred List' END AS list, p_name AS name,"
    " CASE WHEN p_partkey % 2 = 0 THEN 'Vessel' ELSE 'Listed party' END AS type, 'Alt ' || p_partkey AS alias, 'Oslo, NO' AS place, 'X' || p_partkey AS passport, CASE WHEN p_partkey % 2 = 0 THEN 'CS' || p_partkey END AS sign FROM part WHERE p_partkey % 4 < 3"
)
def s12_csl_json(spark, sf_dir):
    """Documents of up to 1,000 results; every fourth comes from a source that isn't kept."""
    p = table(spark, sf_dir, "part")
    labels = [csl_json.SOURCES[k][0] for k in (0, 1, 4)]
    source = F.when(F.col("p_partkey") % 4 == 3, "Other").otherwise(F.element_at(F.array(*map(F.lit, labels)), (F.col("p_partkey") % 3 + 1).cast("int")))
    paper = F.array(F.struct(F.lit("Passport No").alias("type"), F.concat(F.lit("X"), "p_partkey").alias("number")))
    item = F.struct(
        source.alias("source"), F.col("p_partkey").cast("string").alias("id"), F.replace("p_name", F.lit(" "), F.lit("  ")).alias("name"), F.array(F.upper("p_name"), F.concat(F.lit("Alt "), "p_partkey")).alias("alt_names"),
        F.array(F.struct(F.lit("Oslo").alias("city"), F.lit("NO").alias("country"))).alias("addresses"), paper.alias("ids"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("CS"), "p_partkey")).alias("call_sign"),
    )
    path = documents(p, F.to_json(item), "p_partkey", '{"results":[', "]}", "csl", ",")
    r = csl_json.read(spark, path)
    return r.select("id", "list", "name", "type", F.get("names", 1)["name"].alias("alias"), F.get("addresses", 0)["full"].alias("place"), number_of("Passport").alias("passport"), number_of("Call Sign").alias("sign"))


@query(f"SELECT id, name, list, kind AS type, program, paper AS id_type, number FROM ({FLAT})")
def s1_s2_party_json(spark, sf_dir):
    """Party records as JSON documents of up to 1,000 entities, and as JSON lines: read both ways, they agree."""
    r = records(spark, sf_dir)
    lines = folder(spark, "lines")
    r.write.json(lines)
    whole = documents(r, F.to_json(F.struct(*r.columns)), "id", '{"entities":[', "]}", "entities", ",")
    a, b = party_json.read_lines(spark, lines), party_json.read_document(spark, whole)
    both = a.join(b.select(F.col("id").alias("again"), F.xxhash64(*[c for c in a.columns if c != "id"]).alias("h")), (F.col("id") == F.col("again")) & (F.xxhash64(*[c for c in a.columns if c != "id"]) == F.col("h")))
    return both.select("id", "name", "list", "type", F.get("programs", 0).alias("program"), F.get("identifiers", 0)["type"].alias("id_type"), F.get("identifiers", 0)["value"].alias("number"))


@query(
    "SELECT s_suppkey, place, grp, label, value, id_type, id_value FROM supplier, LATERAL (VALUES (0, 'Identity', 'Date of Birth', '' || (1950 + s_suppkey % 40), '', ''), (1, 'Documents', 'Passport', 'P' || s_suppkey || ' (Iran)', 'Passport', 'P' || s_suppkey),"
    " (2, 'Identity', 'Nationality', 'France', '', ''), (3, 'Digital & Contact', 'Digital Currency (XBT)', '1abc' || s_suppkey, 'Crypto XBT', '1abc' || s_suppkey), (4, 'Other', 'Remark', 'odd note ' || s_suppkey, '', '')) t(place, grp, label, value, id_type, id_value)"
)
def s8_remark_rows(spark, sf_dir):
    """Remarks as a table function, in SQL."""
    table_functions.register(spark)
    s = dealt(table(spark, sf_dir, "supplier").select("s_suppkey", filled(REMARKS).alias("remarks")))
    return spark.sql("SELECT s_suppkey, r.at AS place, r.`group` AS grp, r.label, r.value, r.id_type, r.id_value FROM {s}, LATERAL remark_rows(remarks) r", s=s)


@query(
    f"SELECT id, 0 AS ord, name, true AS is_primary, 'Primary' AS alias_type, false AS low_quality FROM ({FLAT}) UNION ALL"
    f" SELECT id, 1, translate(upper(name), '{LATIN}', '{CYRILLIC}'), false, 'Primary (native script)', false FROM ({FLAT}) WHERE authority = 'SUP'"
)
def n10_name_rows(spark, sf_dir):
    """Searchable names as a table function, in SQL, native forms too."""
    table_functions.register(spark)
    return spark.sql("SELECT id, n.* FROM {r}, LATERAL name_rows(name, names) n", r=dealt(native_records(spark, sf_dir).select("id", "name", "names")))
