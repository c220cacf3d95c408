"""The UN consolidated list: individuals and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partyloom.schema import COLUMNS, conform, joined, text

ALIAS, PLACE = "struct<ALIAS_NAME:string,QUALITY:string>", "struct<STREET:string,CITY:string,STATE_PROVINCE:string,COUNTRY:string,NOTE:string>"
BIRTH, BIRTHPLACE = "struct<DATE:string,YEAR:string,FROM_YEAR:string,TO_YEAR:string>", "struct<CITY:string,STATE_PROVINCE:string,COUNTRY:string>"
PAPER = "struct<NUMBER:string,TYPE_OF_DOCUMENT:string,ISSUING_COUNTRY:string>"
SCHEMA = (
    "DATAID string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string, UN_LIST_TYPE string, REFERENCE_NUMBER string, LISTED_ON string,"
    f"COMMENTS1 string, GENDER string, INDIVIDUAL_ALIAS array<{ALIAS}>, ENTITY_ALIAS array<{ALIAS}>, INDIVIDUAL_ADDRESS array<{PLACE}>, ENTITY_ADDRESS array<{PLACE}>,"
    f"NATIONALITY array<struct<VALUE:array<string>>>, INDIVIDUAL_DATE_OF_BIRTH array<{BIRTH}>, INDIVIDUAL_PLACE_OF_BIRTH array<{BIRTHPLACE}>, INDIVIDUAL_DOCUMENT array<{PAPER}>"
)


def _many(name: str, kind: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(f"array<{kind}>"))


def _attr(group: str, label: str, value: Column) -> Column:
    return F.struct(F.lit(group).alias("group"), F.lit(label).alias("label"), value.alias("value"))


def from_rows(rows: DataFrame, kind: str) -> DataFrame:
    """kind: Individual or Entity."""
    pre = kind.upper()
    own = joined(F.col("FIRST_NAME"), F.col("SECOND_NAME"), F.col("THIRD_NAME"), F.col("FOURTH_NAME"), sep=" ")
    name = F.when(own != "", own).otherwise(F.concat(F.lit("UN entity "), text(F.col("DATAID"))))
    shape = lambda n, t, main, low: F.struct(n.alias("name"), F.lit(t).alias("type"), F.lit(main).alias("primary"), low.alias("lowQuality"), F.lit("Latin").alias("script"), F.lit("").alias("native"), F.array().cast("array<string>").alias("parts"))
    aliases = F.transform(F.filter(_many(f"{pre}_ALIAS", ALIAS), lambda a: text(a["ALIAS_NAME"]) != ""), lambda a: shape(text(a["ALIAS_NAME"]), "a.k.a.", False, text(a["QUALITY"]).rlike("(?i)low|weak")))
    places = F.transform(_many(f"{pre}_ADDRESS", PLACE), lambda a: F.struct(joined(*[a[k] for k in ("STREET", "CITY", "STATE_PROVINCE", "COUNTRY", "NOTE")]).alias("full"), text(a["COUNTRY"]).alias("country")))
    attributes = [F.array(_attr("Program", "UN reference", text(F.col("REFERENCE_NUMBER"))), _attr("Identity", "Gender", text(F.col("GENDER"))))]
    papers = F.array().cast(COLUMNS["idDocuments"])
    identifiers = F.array().cast(COLUMNS["identifiers"])
    if kind == "Individual":
        nations = F.flatten(F.transform(_many("NATIONALITY", "struct<VALUE:array<string>>"), lambda n: F.coalesce(n["VALUE"], F.array().cast("array<string>"))))
        years = lambda d: F.array_join(F.filter(F.array(text(d["FROM_YEAR"]), text(d["TO_YEAR"])), lambda x: x != ""), "–")
        born = lambda d: F.coalesce(F.nullif(text(d["DATE"]), F.lit("")), F.nullif(text(d["YEAR"]), F.lit("")), years(d))
        attributes += [
            F.transform(nations, lambda n: _attr("Identity", "Nationality", text(n))),
            F.transform(_many("INDIVIDUAL_DATE_OF_BIRTH", BIRTH), lambda d: _attr("Identity", "Date of Birth", born(d))),
            F.transform(_many("INDIVIDUAL_PLACE_OF_BIRTH", BIRTHPLACE), lambda p: _attr("Identity", "Place of Birth", joined(p["CITY"], p["STATE_PROVINCE"], p["COUNTRY"]))),
        ]
        held = F.filter(_many("INDIVIDUAL_DOCUMENT", PAPER), lambda d: text(d["NUMBER"]) != "")
        typed = lambda d: F.coalesce(F.nullif(text(d["TYPE_OF_DOCUMENT"]), F.lit("")), F.lit("Document"))
        papers = F.transform(held, lambda d: F.struct(typed(d).alias("type"), text(d["NUMBER"]).alias("number"), text(d["ISSUING_COUNTRY"]).alias("issuingCountry"), F.lit("").alias("issueDate"), F.lit("").alias("expirationDate")))
        identifiers = F.transform(held, lambda d: F.struct(F.when(typed(d).rlike("(?i)passport"), "Passport").otherwise(typed(d)).alias("type"), text(d["NUMBER"]).alias("value")))
    out = rows.select(
        F.concat(F.lit("UN-"), text(F.col("DATAID"))).alias("id"),
        F.lit("UN").alias("authority"),
        F.lit("UN Consolidated List").alias("list"),
        F.array(F.lit("UN Consolidated List")).alias("lists"),
        F.lit(kind).alias("type"),
        name.alias("name"),
        F.filter(F.array(text(F.col("UN_LIST_TYPE"))), lambda x: x != "").alias("programs"),
        F.array(F.lit("Asset freeze")).alias("sanctionsTypes"),
        F.array(F.lit("UN Security Council Resolution")).alias("legalAuthorities"),
        text(F.col("LISTED_ON")).alias("datePublished"),
        text(F.col("COMMENTS1")).alias("remarks"),
        F.concat(F.array(shape(name, "Primary", True, F.lit(False))), aliases).alias("names"),
        F.filter(places, lambda p: p["full"] != "").alias("addresses"),
        F.filter(F.concat(*attributes), lambda a: a["value"] != "").alias("attributes"),
        papers.alias("idDocuments"),
        identifiers.alias("identifiers"),
    )
    return conform(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    scan = lambda tag: spark.read.format("xml").option("rowTag", tag).schema(SCHEMA).load(path)
    return from_rows(scan("INDIVIDUAL"), "Individual").unionByName(from_rows(scan("ENTITY"), "Entity"))
