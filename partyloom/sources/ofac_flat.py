"""OFAC's flat CSV files, stitched by entity number, and the remarks parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partyloom.schema import COLUMNS, conform, valued

PRIM = ("ent_num", "name", "type", "program", "title", "call_sign", "vess_type", "tonnage", "grt", "vess_flag", "vess_owner", "remarks")
ALT = ("ent_num", "alt_num", "alt_type", "alt_name", "alt_remarks")
ADD = ("ent_num", "add_num", "address", "city_state_zip", "country", "add_remarks")
VESSEL = (("Call Sign", "call_sign"), ("Vessel Type", "vess_type"), ("Tonnage", "tonnage"), ("Gross Tonnage (GRT)", "grt"), ("Vessel Flag", "vess_flag"), ("Vessel Owner", "vess_owner"))
# Fixed values: (prefix pattern of a remark, group, label, identifier type, whether the identifier ends at the first blank or parenthesis).
REMARKS = (
    (r"(?:alt\.?\s*)?DOB\s+", "Identity", "Date of Birth", "", False),
    (r"POB\s+", "Identity", "Place of Birth", "", False),
    (r"nationality\s+", "Identity", "Nationality", "", False),
    (r"citizen(?:ship)?\s+", "Identity", "Citizenship", "", False),
    (r"Gender\s+", "Identity", "Gender", "", False),
    (r"Passport\s+", "Documents", "Passport", "Passport", True),
    (r"National\s+ID\s+(?:No\.?\s*)?", "Documents", "National ID", "National ID", True),
    (r"(?:Cedula|C\.?I\.?)\s+(?:No\.?\s*)?", "Documents", "Cedula No.", "Cedula", True),
    (r"Tax\s+ID\s+(?:No\.?\s*)?", "Documents", "Tax ID", "Tax ID", True),
    (r"(?:Business\s+)?Registration\s+Number\s+", "Documents", "Registration No.", "Registration", True),
    (r"IMO\s+", "Vessel / Aircraft", "IMO", "IMO", False),
    (r"MMSI\s+", "Vessel / Aircraft", "MMSI", "MMSI", False),
    (r"(?:Other\s+Vessel\s+)?Call\s+Sign\s+", "Vessel / Aircraft", "Call Sign", "Call Sign", False),
    (r"Aircraft\s+Tail\s+Number\s+", "Vessel / Aircraft", "Aircraft Tail No.", "Aircraft Tail", False),
    (r"Digital\s+Currency\s+Address\s*-\s*\w+\s+", "Digital & Contact", "Digital Currency", "Crypto", False),
    (r"Email\s+Address\s+", "Digital & Contact", "Email", "Email", False),
    (r"Phone\s+Number\s+", "Digital & Contact", "Phone", "Phone", False),
    (r"Website\s+", "Digital & Contact", "Website", "", False),
    (r"Secondary\s+sanctions\s+risk:?\s*", "Program", "Secondary Sanctions Risk", "", False),
    (r"(?:Organization\s+)?Established\s+Date\s+", "Identity", "Established Date", "", False),
    (r"Linked\s+To:?\s*", "Program", "Linked To", "", False),
)


def clean(c: Column) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    return F.when(s == "-0-", "").otherwise(s)


def _segment(seg: Column) -> Column:
    """(group, label, value, id_type, id_value) of one segment of a remark; the first rule that fits."""

    def row(group, label, value, id_type, id_value):
        return F.struct(F.lit(group).alias("group"), label.alias("label"), value.alias("value"), id_type.alias("id_type"), id_value.alias("id_value"))

    out = None
    for prefix, group, label, id_type, cut in REMARKS:
        value = F.regexp_extract(seg, f"(?i)^{prefix}(.+)", 1)
        shown, kind = F.lit(label), F.lit(id_type)
        if label == "Digital Currency":
            coin = F.regexp_extract(seg, r"(?i)^Digital\s+Currency\s+Address\s*-\s*(\w+)\s", 1)
            shown, kind = F.concat(F.lit("Digital Currency ("), coin, F.lit(")")), F.concat(F.lit("Crypto "), coin)
        number = F.when(F.lit(id_type == ""), "").otherwise(F.regexp_extract(value, r"^([^\s(]*)", 1) if cut else value)
        made = row(group, shown, value, kind, number)
        met = seg.rlike(f"(?i)^{prefix}.+")
        out = F.when(met, made) if out is None else out.when(met, made)
    return out.otherwise(row("Other", F.lit("Remark"), seg, F.lit(""), F.lit("")))


def parse_remarks(remarks: Column) -> tuple[Column, Column]:
    """(attributes, identifiers) of a remarks text, in its order."""
    segments = F.filter(F.transform(F.split(F.coalesce(remarks, F.lit("")), ";"), lambda s: F.trim(s)), lambda s: s != "")
    told = F.transform(segments, _segment)
    attributes = F.transform(told, lambda t: F.struct(t["group"].alias("group"), t["label"].alias("label"), t["value"].alias("value")))
    identifiers = F.transform(F.filter(told, lambda t: t["id_value"] != ""), lambda t: F.struct(t["id_type"].alias("type"), t["id_value"].alias("value")))
    return attributes, identifiers


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """RFC 4180: doubled quotes, line breaks inside quotes, ragged rows kept."""
    ddl = ", ".join(f"{c} string" for c in columns)
    return spark.read.schema(ddl).csv(path, header=False, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False)


def stitch(prim: DataFrame, alt: DataFrame, add: DataFrame, list_label: str) -> DataFrame:
    """Main rows with their aliases and addresses collected in file order."""
    keyed = lambda df: df.select(*[clean(F.col(c)).alias(c) for c in df.columns]).where(F.col("ent_num").rlike(r"^\d+$"))
    order = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0))
    alias = F.struct(
        order("alt_num").alias("at"),
        F.struct(
            F.col("alt_name").alias("name"),
            F.when(F.col("alt_type") == "", "A.K.A.").otherwise(F.col("alt_type")).alias("type"),
            F.lit(False).alias("primary"),
            F.col("alt_remarks").rlike("(?i)weak|low").alias("lowQuality"),
            F.lit("Latin").alias("script"),
            F.lit("").alias("native"),
            F.array().cast("array<string>").alias("parts"),
        ).alias("item"),
    )
    aliases = keyed(alt).where("alt_name <> ''").groupBy("ent_num").agg(F.array_sort(F.collect_list(alias)).alias("more_names"))
    line = F.array_join(F.filter(F.array("address", "city_state_zip", "country"), lambda x: x != ""), ", ")
    place = F.struct(order("add_num").alias("at"), F.struct(line.alias("full"), F.col("country").alias("country")).alias("item"))
    places = keyed(add).where(line != "").groupBy("ent_num").agg(F.array_sort(F.collect_list(place)).alias("places"))
    rows = keyed(prim).join(aliases, "ent_num", "left").join(places, "ent_num", "left")
    attributes, identifiers = parse_remarks(F.col("remarks"))
    vessel = valued(F.array(*[F.struct(F.lit("Vessel / Aircraft").alias("group"), F.lit(label).alias("label"), F.col(c).alias("value")) for label, c in VESSEL]))
    sign = valued(F.array(F.struct(F.lit("Call Sign").alias("type"), F.col("call_sign").alias("value"))))
    primary = F.array(F.struct(F.col("name"), F.lit("Primary").alias("type"), F.lit(True).alias("primary"), F.lit(False).alias("lowQuality"), F.lit("Latin").alias("script"), F.lit("").alias("native"), F.array().cast("array<string>").alias("parts")))
    items = lambda c, kind: F.coalesce(F.transform(c, lambda x: x["item"]).cast(kind), F.array().cast(kind))
    out = rows.select(
        F.col("ent_num").alias("id"),
        F.lit("OFAC").alias("authority"),
        F.lit(list_label).alias("list"),
        F.array(F.lit(list_label)).alias("lists"),
        F.when(F.col("type") == "", "Individual").otherwise(F.col("type")).alias("type"),
        "name",
        "title",
        F.filter(F.transform(F.split("program", "[;/]"), lambda s: F.trim(s)), lambda x: x != "").alias("programs"),
        "remarks",
        F.concat(primary.cast(COLUMNS["names"]), items("more_names", COLUMNS["names"])).alias("names"),
        items("places", COLUMNS["addresses"]).alias("addresses"),
        F.concat(attributes.cast(COLUMNS["attributes"]), vessel.cast(COLUMNS["attributes"])).alias("attributes"),
        F.concat(identifiers.cast(COLUMNS["identifiers"]), sign.cast(COLUMNS["identifiers"])).alias("identifiers"),
    )
    return conform(out)


def read(spark: SparkSession, prim: str, alt: str, add: str, list_label: str) -> DataFrame:
    return stitch(read_csv(spark, prim, PRIM), read_csv(spark, alt, ALT), read_csv(spark, add, ADD), list_label)
