"""The advanced XML layout of OFAC lists: one row per <entity> (S4-S6g)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partyloom.functions.vocab import group_for, identifier_type
from partyloom.schema import COLUMNS, conform, text, valued

PART = "struct<type:string,value:string>"
NAME_TEXT = f"struct<isPrimary:string,script:string,formattedFullName:string,formattedFirstName:string,formattedMiddleName:string,formattedLastName:string,nameParts:struct<namePart:array<{PART}>>>"
NAME = f"struct<isPrimary:string,aliasType:string,isLowQuality:string,translations:struct<translation:array<{NAME_TEXT}>>>"
ADDRESS_TEXT = "struct<address1:string,address2:string,address3:string,city:string,stateOrProvince:string,postalCode:string,formattedAddress:string>"
FEATURE = "struct<type:string,value:string,valueDate:struct<isApproximate:string,isDateRange:string,fromDateBegin:string,toDateEnd:string>>"
DOCUMENT = "struct<type:string,documentType:string,documentNumber:string,number:string,idNumber:string,issuingCountry:string,country:string,issueDate:string,issuedDate:string,expirationDate:string,expiryDate:string>"
ITEMS = ("identityDocument", "idDocument", "idRegistrationDocument", "document")
CONTAINERS = ("identityDocuments", "idDocuments", "idRegistrationDocuments", "identificationDocuments")
RELATION = "struct<_relatedId:string,type:string,relationshipType:string,relatedEntity:struct<_entityId:string,_id:string>>"
BOX = "struct<" + ",".join(f"{i}:array<{DOCUMENT}>" for i in ITEMS) + ">"
SCHEMA = (
    "_id string, entityType string, generalInfo struct<entityType:string>,"
    "sanctionsLists struct<sanctionsList:array<struct<_VALUE:string,_datePublished:string>>>,"
    "sanctionsPrograms struct<sanctionsProgram:array<string>>, sanctionsTypes struct<sanctionsType:array<string>>,"
    "legalAuthorities struct<legalAuthority:array<string>>,"
    f"names struct<name:array<{NAME}>>, addresses struct<address:array<struct<country:string,translations:struct<translation:array<{ADDRESS_TEXT}>>>>>,"
    f"features struct<feature:array<{FEATURE}>>,"
    + ",".join(f"{c} {BOX}" for c in CONTAINERS)
    + f", relationships struct<relationship:array<{RELATION}>,profileRelationship:array<{RELATION}>>"
    + f", profileRelationships struct<relationship:array<{RELATION}>,profileRelationship:array<{RELATION}>>"
)
UMBRELLA = "Consolidated List"


def _yes(c: Column) -> Column:
    return F.lower(text(c)) == "true"


def _first(*cols: Column) -> Column:
    """The first that isn't ''."""
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in cols], F.lit(""))


def _list(c: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _texts(c: Column) -> Column:
    return F.filter(F.transform(_list(c), text), lambda x: x != "")


def parse_name(n: Column) -> Column:
    """Primary wording for display, the last other non-Latin one as native form."""
    told = F.transform(
        _list(n["translations"]["translation"], f"array<{NAME_TEXT}>"),
        lambda t: F.struct(
            _first(t["formattedFullName"], F.array_join(F.filter(F.transform(F.array(t["formattedFirstName"], t["formattedMiddleName"], t["formattedLastName"]), text), lambda x: x != ""), " ")).alias("full"),
            text(t["script"]).alias("script"),
            _yes(t["isPrimary"]).alias("main"),
        ),
    )
    start = F.struct(F.lit("").alias("name"), F.lit("").alias("script"), F.lit("").alias("native"))
    seen = F.aggregate(
        told,
        start,
        lambda acc, t: F.struct(
            F.when(t["main"] | (acc["name"] == ""), t["full"]).otherwise(acc["name"]).alias("name"),
            F.when(t["main"] | (acc["name"] == ""), t["script"]).otherwise(acc["script"]).alias("script"),
            F.when(~t["main"] & (acc["name"] != "") & (t["script"] != "") & (F.lower(t["script"]) != "latin"), t["full"]).otherwise(acc["native"]).alias("native"),
        ),
    )
    parts = F.flatten(F.transform(_list(n["translations"]["translation"], f"array<{NAME_TEXT}>"), lambda t: _list(t["nameParts"]["namePart"], f"array<{PART}>")))
    said = F.transform(F.filter(parts, lambda p: (text(p["type"]) != "") & (text(p["value"]) != "")), lambda p: F.concat(text(p["type"]), F.lit(": "), text(p["value"])))
    main = _yes(n["isPrimary"])
    kind = F.when(main, "Primary").otherwise(_first(n["aliasType"], F.lit("A.K.A.")))
    return F.struct(seen["name"].alias("name"), kind.alias("type"), main.alias("primary"), _yes(n["isLowQuality"]).alias("lowQuality"), seen["script"].alias("script"), seen["native"].alias("native"), said.alias("parts"))


def parse_address(a: Column) -> Column:
    told = _list(a["translations"]["translation"], f"array<{ADDRESS_TEXT}>")
    keys = ("address1", "address2", "address3", "city", "stateOrProvince", "postalCode")
    lines = F.filter(F.flatten(F.transform(told, lambda t: F.array(*[text(t[k]) for k in keys]))), lambda x: x != "")
    whole = F.slice(F.filter(F.transform(told, lambda t: text(t["formattedAddress"])), lambda x: x != ""), 1, 1)
    country = text(a["country"])
    every = F.concat(F.when(F.size(lines) > 0, lines).otherwise(whole), F.filter(F.array(country), lambda x: x != ""))
    return F.struct(_first(F.array_join(every, ", "), F.lit("(address on file)")).alias("full"), country.alias("country"))


def format_date_feature(f: Column) -> Column:
    value, d = text(f["value"]), f["valueDate"]
    low, high = text(d["fromDateBegin"]), text(d["toDateEnd"])
    span = F.concat(low, F.lit(" to "), high)
    out = F.when(value != "", value).when(_yes(d["isDateRange"]), span).otherwise(low)
    ranged = _yes(d["isDateRange"]) & (value != "") & (low != "") & (span != value)
    told = F.when(_yes(d["isApproximate"]), F.concat(F.lit("approx. "), out)).when(ranged, F.concat(value, F.lit(" (range "), low, F.lit("–"), high, F.lit(")"))).otherwise(out)
    return F.when(d.isNull(), value).otherwise(told)


def read(spark: SparkSession, path: str, list_fallback: str = "SDN List") -> DataFrame:
    """Party records; the scan splits at <entity>, so memory holds one record at a time."""
    rows = spark.read.format("xml").option("rowTag", "entity").option("mode", "PERMISSIVE").schema(SCHEMA).load(path)
    return from_rows(rows, list_fallback)


def from_rows(rows: DataFrame, list_fallback: str = "SDN List") -> DataFrame:
    c = F.col
    listed = _list(c("sanctionsLists.sanctionsList"), "array<struct<_VALUE:string,_datePublished:string>>")
    named = F.array_distinct(F.filter(F.transform(listed, lambda x: text(x["_VALUE"])), lambda x: x != ""))
    lists = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(list_fallback)))
    label = F.coalesce(F.get(F.filter(lists, lambda x: x != UMBRELLA), 0), F.get(lists, 0))
    names = F.filter(F.transform(_list(c("names.name"), f"array<{NAME}>"), parse_name), lambda n: n["name"] != "")
    documents = F.concat(
        *[
            F.transform(
                _list(c(f"{box}.{item}"), f"array<{DOCUMENT}>"),
                lambda d: F.struct(
                    _first(d["type"], d["documentType"], F.lit("Document")).alias("type"),
                    _first(d["documentNumber"], d["number"], d["idNumber"]).alias("number"),
                    _first(d["issuingCountry"], d["country"]).alias("issuingCountry"),
                    _first(d["issueDate"], d["issuedDate"]).alias("issueDate"),
                    _first(d["expirationDate"], d["expiryDate"]).alias("expirationDate"),
                ),
            )
            for box in CONTAINERS
            for item in ITEMS
        ]
    )
    related = F.concat(*[_list(c(f"{box}.{item}"), f"array<{RELATION}>") for box in ("relationships", "profileRelationships") for item in ("relationship", "profileRelationship")])
    related = F.transform(
        related,
        lambda r: F.struct(
            _first(r["type"], r["relationshipType"], F.lit("Related to")).alias("type"),
            _first(r["relatedEntity"]["_entityId"], r["relatedEntity"]["_id"], r["_relatedId"]).alias("relatedId"),
            F.lit("").alias("relatedName"),
            F.lit(None).cast("boolean").alias("inSnapshot"),
        ),
    )
    features = F.transform(_list(c("features.feature"), f"array<{FEATURE}>"), lambda f: F.struct(_first(f["type"], F.lit("Feature")).alias("label"), format_date_feature(f).alias("value")))
    attributes = F.transform(F.filter(features, lambda f: f["value"] != ""), lambda f: F.struct(group_for(f["label"]).alias("group"), f["label"].alias("label"), f["value"].alias("value")))
    found = F.transform(c("attributes"), lambda a: F.struct(identifier_type(a["label"]).alias("type"), F.regexp_replace(a["value"], r"^approx\.\s*", "").alias("value")))
    carried = F.filter(found, lambda i: i["type"].isNotNull())
    papers = valued(F.transform(c("idDocuments"), lambda d: F.struct(d["type"].alias("type"), d["number"].alias("value"))))
    titled = F.get(F.filter(c("attributes"), lambda a: a["label"].rlike("(?i)title|position")), 0)["value"]
    first = F.coalesce(F.get(F.filter(c("names"), lambda n: n["primary"]), 0)["name"], F.get(c("names"), 0)["name"], F.concat(F.lit("Entity "), c("id")))
    out = rows.select(
        text(c("_id")).alias("id"),
        lists.alias("lists"),
        label.alias("list"),
        _first(c("generalInfo.entityType"), c("entityType"), F.lit("Individual")).alias("type"),
        _texts(c("sanctionsPrograms.sanctionsProgram")).alias("programs"),
        _texts(c("sanctionsTypes.sanctionsType")).alias("sanctionsTypes"),
        _texts(c("legalAuthorities.legalAuthority")).alias("legalAuthorities"),
        listed.alias("__listed"),
        names.alias("names"),
        F.transform(_list(c("addresses.address"), f"array<struct<country:string,translations:struct<translation:array<{ADDRESS_TEXT}>>>>"), parse_address).alias("addresses"),
        documents.alias("idDocuments"),
        F.filter(related, lambda r: r["relatedId"] != "").alias("relationships"),
        attributes.cast(COLUMNS["attributes"]).alias("attributes"),
    )
    listed_at = F.coalesce(F.get(F.filter(c("__listed"), lambda x: text(x["_VALUE"]) == c("list")), 0), F.get(c("__listed"), 0))["_datePublished"]
    out = out.withColumns({"datePublished": text(listed_at), "name": first, "title": F.coalesce(titled, F.lit("")), "identifiers": F.concat(carried, papers), "authority": F.lit("OFAC")})
    return conform(out)
