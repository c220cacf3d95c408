"""The UK list: a banner line, a header, and one row per name or address of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partyloom.schema import conform, joined, text


def read(spark: SparkSession, path: str) -> DataFrame:
    """The header is on the second line; rows keep their file order, so first rows are well defined."""
    head = spark.read.text(path).limit(2).collect()  # two lines
    if len(head) < 2:
        raise ValueError("the UK file has no header on its second line")
    return from_rows(_parsed(spark, path, [h.strip().strip('"') for h in head[1]["value"].split(",")]))


def _parsed(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    ddl = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.schema(ddl).csv(path, header=False, quote='"', escape='"', multiLine=True, mode="PERMISSIVE")
    first = names[0]
    return rows.withColumn("__at", F.monotonically_increasing_id()).where((F.col("__at") > 0) & ((F.trim(F.col(f"`{first}`")) != first) | (F.col("__at") > 1)))


def from_rows(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    get = lambda name: text(F.col(f"`{name}`")) if name in have else F.lit("")
    if "__at" not in have:
        rows = rows.withColumn("__at", F.monotonically_increasing_id())
    empty = F.lit("")
    full = joined(*[get(f"Name {i}") for i in range(1, 7)], sep=" ")
    place = joined(*[get(f"Address {i}") for i in range(1, 7)], get("Post/Zip Code"), get("Country"))
    attr = lambda group, label, value: F.struct(F.lit(group).alias("group"), F.lit(label).alias("label"), value.alias("value"))
    row = rows.select(
        get("Group ID").alias("g"),
        F.struct(
            (~get("Alias Type").rlike("(?i)^primary name$")).alias("later"),
            F.col("__at").alias("at"),
            full.alias("name"),
            get("Group Type").alias("kind"),
            get("Title").alias("title"),
            F.coalesce(F.nullif(get("Listed On"), empty), get("UK Sanctions List Date Designated")).alias("date"),
            get("Name Non-Latin Script").alias("native"),
            get("Other Information").alias("remarks"),
        ).alias("main"),
        F.struct(
            F.col("__at").alias("at"),
            full.alias("name"),
            F.coalesce(F.nullif(get("Alias Type"), empty), F.lit("a.k.a.")).alias("type"),
            get("Alias Quality").rlike(r"(?i)weak|low|good \(low\)").alias("low"),
            get("Name Non-Latin Script").alias("native"),
            get("Regime").alias("regime"),
            F.struct(place.alias("full"), get("Country").alias("country")).alias("place"),
            F.array(
                attr("Identity", "Date of Birth", get("DOB")),
                attr("Identity", "Place of Birth", joined(get("Town of Birth"), get("Country of Birth"))),
                attr("Identity", "Nationality", get("Nationality")),
                attr("Identity", "Position", get("Position")),
                attr("Documents", "Passport", get("Passport Number")),
                attr("Documents", "National ID", get("National Identification Number")),
            ).alias("attributes"),
        ).alias("line"),
    ).where(F.col("g") != "")
    grouped = row.groupBy("g").agg(F.min("main").alias("main"), F.array_sort(F.collect_list("line")).alias("lines"))
    name = F.when(F.col("main.name") != "", F.col("main.name")).otherwise(F.concat(F.lit("UK group "), F.col("g")))
    kind = F.col("main.kind")
    shape = lambda n, t, main, low, native: F.struct(n.alias("name"), t.alias("type"), F.lit(main).alias("primary"), low.alias("lowQuality"), F.lit("Latin").alias("script"), native.alias("native"), F.array().cast("array<string>").alias("parts"))
    keys = F.transform("lines", lambda x: F.upper(x["name"]))
    more = F.filter("lines", lambda x, i: (x["name"] != "") & (F.upper(x["name"]) != F.upper(F.col("name"))) & (F.array_position(keys, F.upper(x["name"])) == i + 1))
    attributes = F.array_distinct(F.filter(F.flatten(F.transform("lines", lambda x: x["attributes"])), lambda a: a["value"] != ""))
    papers = F.filter("attributes", lambda a: a["group"] == "Documents")
    places = F.filter(F.transform("lines", lambda x: x["place"]), lambda p: p["full"] != "")
    lines_of = F.transform(places, lambda p: p["full"])
    out = grouped.withColumn("name", name).withColumn("attributes", attributes)
    out = out.select(
        F.concat(F.lit("UK-"), F.col("g")).alias("id"),
        F.lit("UK").alias("authority"),
        F.lit("UK Sanctions List").alias("list"),
        F.array(F.lit("UK Sanctions List")).alias("lists"),
        F.when(kind.rlike("(?i)individual"), "Individual").when(kind.rlike("(?i)ship|vessel"), "Vessel").otherwise("Entity").alias("type"),
        "name",
        F.col("main.title").alias("title"),
        F.array_distinct(F.filter(F.transform("lines", lambda x: x["regime"]), lambda x: x != "")).alias("programs"),
        F.array(F.lit("Asset freeze")).alias("sanctionsTypes"),
        F.array(F.lit("UK Sanctions and Anti-Money Laundering Act 2018")).alias("legalAuthorities"),
        F.col("main.date").alias("datePublished"),
        F.col("main.remarks").alias("remarks"),
        F.concat(
            F.array(shape(F.col("name"), F.lit("Primary"), True, F.lit(False), F.col("main.native"))),
            F.transform(more, lambda x: shape(x["name"], x["type"], False, x["low"], x["native"])),
        ).alias("names"),
        F.filter(places, lambda p, i: F.array_position(lines_of, p["full"]) == i + 1).alias("addresses"),
        "attributes",
        F.transform(papers, lambda a: F.struct(a["label"].alias("type"), a["value"].alias("value"))).alias("identifiers"),
    )
    return conform(out)
