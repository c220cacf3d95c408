"""The Consolidated Screening List's export-control sources as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partyloom.schema import conform, joined

# The sources kept, with their authority and list.
SOURCES = (
    ("Entity List (EL) - Bureau of Industry and Security", "BIS", "BIS Entity List"),
    ("Denied Persons List (DPL) - Bureau of Industry and Security", "BIS", "BIS Denied Persons List"),
    ("Unverified List (UVL) - Bureau of Industry and Security", "BIS", "BIS Unverified List"),
    ("Military End User (MEU) List - Bureau of Industry and Security", "BIS", "BIS Military End-User List"),
    ("ITAR Debarred (DTC) - State Department", "State", "ITAR Debarred List"),
    ("Nonproliferation Sanctions (ISN) - State Department", "State", "Nonproliferation Sanctions"),
)
TEXTS = "source id name title start_date end_date license_requirement license_policy federal_register_notice standard_order vessel_type vessel_flag call_sign remarks".split()
LISTS = "programs alt_names dates_of_birth places_of_birth nationalities citizenships".split()
PLACE, PAPER = "struct<address:string,city:string,state:string,postal_code:string,country:string>", "struct<type:string,number:string,country:string>"
RECORD = ",".join([*[f"{t}:string" for t in TEXTS], *[f"{t}:array<string>" for t in LISTS], f"addresses:array<{PLACE}>", f"ids:array<{PAPER}>"])


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def read(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"results array<struct<{RECORD}>>").option("multiLine", True).json(path).select(F.inline("results"))
    return from_rows(rows)


def from_rows(rows: DataFrame) -> DataFrame:
    known = rows.sparkSession.createDataFrame(list(SOURCES), "source string, authority string, list string")
    rows = rows.join(F.broadcast(known), "source").where(clean(F.col("name")) != "")
    many = lambda k: F.filter(F.transform(F.coalesce(F.col(k), F.array().cast("array<string>")), clean), lambda x: x != "")
    attr = lambda group, label, value: F.struct(F.lit(group).alias("group"), F.lit(label).alias("label"), value.alias("value"))
    stated = lambda label: lambda v: attr("Identity", label, v)
    name = clean(F.col("name"))
    shape = lambda n, t, main: F.struct(n.alias("name"), F.lit(t).alias("type"), F.lit(main).alias("primary"), F.lit(False).alias("lowQuality"), F.lit("Latin").alias("script"), F.lit("").alias("native"), F.array().cast("array<string>").alias("parts"))
    vessel = F.greatest(*[F.length(clean(F.col(k))) for k in ("vessel_type", "call_sign", "vessel_flag")]) > 0
    person = F.greatest(*[F.size(F.coalesce(F.col(k), F.array().cast("array<string>"))) for k in ("dates_of_birth", "places_of_birth", "nationalities", "citizenships")]) > 0
    order = clean(F.col("standard_order"))
    attributes = F.concat(
        *[F.transform(many(k), stated(label)) for k, label in (("dates_of_birth", "Date of Birth"), ("places_of_birth", "Place of Birth"), ("nationalities", "Nationality"), ("citizenships", "Citizenship"))],
        F.filter(
            F.array(
                attr("Program", "Licence requirement", clean(F.col("license_requirement"))),
                attr("Program", "Licence policy", clean(F.col("license_policy"))),
                attr("Program", "Federal Register notice", clean(F.col("federal_register_notice"))),
                attr("Program", "Standard order", F.when(order == "Y", "Yes").otherwise(order)),
                attr("Program", "End date", clean(F.col("end_date"))),
                attr("Vessel / Aircraft", "Vessel Type", clean(F.col("vessel_type"))),
                attr("Vessel / Aircraft", "Call Sign", clean(F.col("call_sign"))),
                attr("Vessel / Aircraft", "Vessel Flag", clean(F.col("vessel_flag"))),
            ),
            lambda a: a["value"] != "",
        ),
    )
    papers = F.filter(
        F.transform(
            F.coalesce(F.col("ids"), F.array().cast(f"array<{PAPER}>")),
            lambda d: F.struct(F.coalesce(F.nullif(clean(d["type"]), F.lit("")), F.lit("Document")).alias("type"), clean(d["number"]).alias("number"), clean(d["country"]).alias("issuingCountry"), F.lit("").alias("issueDate"), F.lit("").alias("expirationDate")),
        ),
        lambda d: d["number"] != "",
    )
    sign = F.filter(F.array(F.struct(F.lit("Call Sign").alias("type"), clean(F.col("call_sign")).alias("value"))), lambda x: x["value"] != "")
    places = F.transform(F.coalesce(F.col("addresses"), F.array().cast(f"array<{PLACE}>")), lambda a: F.struct(joined(*[clean(a[k]) for k in ("address", "city", "state", "postal_code", "country")]).alias("full"), clean(a["country"]).alias("country")))
    bis = F.col("authority") == "BIS"
    out = rows.select(
        F.concat(F.col("authority"), F.lit("-"), F.when(F.coalesce(F.col("id"), F.lit("")) != "", F.substring("id", 1, 12)).otherwise(F.concat(F.lit("x"), F.hex(F.xxhash64("source", "name"))))).alias("id"),
        "authority",
        "list",
        F.array("list").alias("lists"),
        F.when(vessel, "Vessel").when(person, "Individual").otherwise("Listed party").alias("type"),
        name.alias("name"),
        clean(F.col("title")).alias("title"),
        many("programs").alias("programs"),
        F.array(F.when(bis & F.col("list").contains("Denied Persons"), "Denial of export privileges").otherwise("Export licence requirement")).alias("sanctionsTypes"),
        F.array(F.when(bis, "Export Administration Regulations (EAR)").otherwise("Arms Export Control Act / ITAR")).alias("legalAuthorities"),
        clean(F.col("start_date")).alias("datePublished"),
        clean(F.col("remarks")).alias("remarks"),
        F.concat(F.array(shape(name, "Primary", True)), F.transform(F.filter(many("alt_names"), lambda a: F.upper(a) != F.upper(name)), lambda a: shape(a, "a.k.a.", False))).alias("names"),
        F.filter(places, lambda p: p["full"] != "").alias("addresses"),
        attributes.alias("attributes"),
        papers.alias("idDocuments"),
        F.concat(sign, F.transform(papers, lambda d: F.struct(F.when(d["type"].rlike("(?i)passport"), "Passport").otherwise(d["type"]).alias("type"), d["number"].alias("value")))).alias("identifiers"),
    )
    return conform(out)


def assert_unique_ids(df: DataFrame) -> None:
    """Shortened ids must not collide: a later merge by id would drop a party."""
    twice = df.groupBy("id").agg(F.count_distinct("name").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids that stand for several parties: {[r['id'] for r in twice]}")
