"""The EU consolidated list: one row per <sanctionEntity>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partyloom.schema import COLUMNS, conform, text

FIELDS = {
    "nameAlias": "wholeName firstName middleName lastName function title strong",
    "regulation": "programme numberTitle publicationDate",
    "birthdate": "birthdate year circa city region countryDescription",
    "citizenship": "countryDescription",
    "address": "street poBox city zipCode region place countryDescription",
    "identification": "number latinNumber identificationTypeDescription countryDescription",
    "contactInfo": "value typeDescription",
}
KIND = {k: "struct<" + ",".join(f"_{f}:string" for f in v.split()) + ">" for k, v in FIELDS.items()}
SCHEMA = "_logicalId string, _euReferenceNumber string, _unitedNationId string, _designationDate string, subjectType struct<_code:string>, remark string," + ",".join(f"{k} array<{v}>" for k, v in KIND.items())


def _some(c: Column) -> Column:
    return F.filter(c, lambda x: x != "")


def _known(c: Column) -> Column:
    return F.when(text(c) == "UNKNOWN", "").otherwise(text(c))


def _or(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in cols], F.lit(""))


def _attr(group: str, label, value: Column) -> Column:
    return F.struct(F.lit(group).alias("group"), (F.lit(label) if isinstance(label, str) else label).alias("label"), value.alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return from_rows(spark.read.format("xml").option("rowTag", "sanctionEntity").schema(SCHEMA).load(path))


def from_rows(rows: DataFrame) -> DataFrame:
    many = lambda k: F.coalesce(F.col(k), F.array().cast(f"array<{KIND[k]}>"))
    ident = F.concat(F.lit("EU-"), _or(F.col("_logicalId"), F.col("_euReferenceNumber")))
    told = F.transform(
        many("nameAlias"),
        lambda a: F.struct(
            _or(a["_wholeName"], F.array_join(_some(F.array(text(a["_firstName"]), text(a["_middleName"]), text(a["_lastName"]))), " ")).alias("name"),
            (F.lower(text(a["_strong"])) == "false").alias("low"),
            _or(a["_function"], a["_title"]).alias("title"),
        ),
    )
    named = F.filter(told, lambda a: a["name"] != "")
    keys = F.transform(named, lambda a: F.upper(a["name"]))
    once = F.filter(named, lambda a, i: F.array_position(keys, F.upper(a["name"])) == i + 1)
    names = F.transform(
        once,
        lambda a, i: F.struct(a["name"].alias("name"), F.when(i == 0, "Primary").otherwise("a.k.a.").alias("type"), (i == 0).alias("primary"), a["low"].alias("lowQuality"), F.lit("Latin").alias("script"), F.lit("").alias("native"), F.array().cast("array<string>").alias("parts")),
    )
    bare = F.array(F.struct(F.concat(F.lit("EU listing "), ident).alias("name"), F.lit("Primary").alias("type"), F.lit(True).alias("primary"), F.lit(False).alias("lowQuality"), F.lit("Latin").alias("script"), F.lit("").alias("native"), F.array().cast("array<string>").alias("parts")))
    code = F.lower(text(F.col("subjectType._code")))
    rules = F.array_distinct(_some(F.transform(many("regulation"), lambda r: F.when(text(r["_numberTitle"]) != "", F.concat(F.lit("Council Regulation "), text(r["_numberTitle"]))).otherwise(""))))
    births = F.flatten(
        F.transform(
            many("birthdate"),
            lambda b: F.array(
                _attr("Identity", "Date of Birth", F.when(_or(b["_birthdate"], b["_year"]) == "", "").otherwise(F.concat(F.when(text(b["_circa"]) == "true", "circa ").otherwise(""), _or(b["_birthdate"], b["_year"])))),
                _attr("Identity", "Place of Birth", F.array_join(_some(F.array(_known(b["_city"]), _known(b["_region"]), _known(b["_countryDescription"]))), ", ")),
            ),
        )
    )
    contacts = F.transform(many("contactInfo"), lambda c: _attr("Digital & Contact", _or(c["_typeDescription"], F.lit("Contact")), text(c["_value"])))
    attributes = F.concat(
        F.array(_attr("Program", "EU reference", text(F.col("_euReferenceNumber"))), _attr("Program", "UN reference", text(F.col("_unitedNationId")))),
        births,
        F.transform(many("citizenship"), lambda c: _attr("Identity", "Citizenship", _known(c["_countryDescription"]))),
        contacts,
    )
    lines = ("_street", "_poBox", "_city", "_zipCode", "_region", "_place")
    places = F.transform(many("address"), lambda a: F.struct(F.array_join(_some(F.array(*[text(a[k]) for k in lines], _known(a["_countryDescription"]))), ", ").alias("full"), _known(a["_countryDescription"]).alias("country")))
    papers = F.filter(
        F.transform(many("identification"), lambda d: F.struct(_or(d["_identificationTypeDescription"], F.lit("Document")).alias("type"), _or(d["_number"], d["_latinNumber"]).alias("number"), _known(d["_countryDescription"]).alias("issuingCountry"), F.lit("").alias("issueDate"), F.lit("").alias("expirationDate"))),
        lambda d: d["number"] != "",
    )
    kind = lambda t: F.when(t.rlike("(?i)passport"), "Passport").when(t.rlike("(?i)national"), "National ID").when(t.rlike("(?i)imo"), "IMO").when(t.rlike("(?i)tax"), "Tax ID").when(t.rlike("(?i)registration"), "Registration").otherwise(t)
    mails = F.transform(F.filter(contacts, lambda c: c["label"].rlike("(?i)e-?mail") & (c["value"] != "")), lambda c: F.struct(F.lit("Email").alias("type"), c["value"].alias("value")))
    out = rows.select(
        ident.alias("id"),
        F.lit("EU").alias("authority"),
        F.lit("EU Consolidated List").alias("list"),
        F.array(F.lit("EU Consolidated List")).alias("lists"),
        F.when(code == "person", "Individual").when(code.isin("vessel", "ship"), "Vessel").when(code == "aircraft", "Aircraft").otherwise("Entity").alias("type"),
        F.when(F.size(names) > 0, names).otherwise(bare).alias("names"),
        F.coalesce(F.get(_some(F.transform(told, lambda a: a["title"])), 0), F.lit("")).alias("title"),
        F.array_distinct(_some(F.transform(many("regulation"), lambda r: text(r["_programme"])))).alias("programs"),
        F.array(F.lit("Asset freeze")).alias("sanctionsTypes"),
        F.when(F.size(rules) > 0, rules).otherwise(F.array(F.lit("EU Council Regulation"))).alias("legalAuthorities"),
        _or(F.col("_designationDate"), F.get(many("regulation"), 0)["_publicationDate"]).alias("datePublished"),
        text(F.col("remark")).alias("remarks"),
        F.filter(places, lambda p: p["full"] != "").alias("addresses"),
        papers.alias("idDocuments"),
        F.filter(attributes, lambda a: a["value"] != "").cast(COLUMNS["attributes"]).alias("attributes"),
        F.concat(F.transform(papers, lambda d: F.struct(kind(d["type"]).alias("type"), d["number"].alias("value"))), mails).alias("identifiers"),
    )
    return conform(out.withColumn("name", F.get("names", 0)["name"]))
