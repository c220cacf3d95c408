"""Composition and timeline statistics of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partyloom.functions import countries
from partyloom.functions.dates import normalize_date
from partyloom.functions.text import reading_order
from partyloom.functions.vocab import values_of
from partyloom.operators.graph import OWNERSHIP

# Sizes of the lists and timelines.
RECENT, RECENT_EACH, TOP, YEARS, MONTHS = 150, 40, 15, 16, 24


def top_counts(df: DataFrame, name: Column, most: int | None = TOP) -> DataFrame:
    """(name, count), largest first, then by name in reading order (L2)."""
    out = df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), reading_order("name"), "name")
    return out.limit(most) if most else out


def by_authority(df: DataFrame) -> DataFrame:
    return top_counts(df, F.when(F.col("authority") == "", "OFAC").otherwise(F.col("authority")), None)


def by_type(df: DataFrame) -> DataFrame:
    return top_counts(df, F.when(F.col("type") == "", "Unknown").otherwise(F.col("type")), None)


def by_membership(df: DataFrame, column: str, most: int | None = TOP) -> DataFrame:
    """Per entry of an array column; sums exceed the number of parties (A2, A3)."""
    return top_counts(df.select(F.explode(column).alias("entry")), F.col("entry"), most)


def countries_of(attributes: Column, addresses: Column) -> Column:
    """Nationalities and citizenships, else address countries, each once."""
    stated = countries.labels_of(values_of(attributes, "nationality", "citizenship"))
    placed = countries.labels_of(F.transform(addresses, lambda a: a["country"]))
    return F.when(F.size(stated) > 0, stated).otherwise(placed)


def by_country(df: DataFrame, most: int | None = TOP) -> DataFrame:
    """Parties per country, once each (A4)."""
    return top_counts(df.select(F.explode(countries_of(F.col("attributes"), F.col("addresses"))).alias("c")), F.col("c"), most)


def totals(df: DataFrame, now: Column) -> DataFrame:
    """One row of conditional counts, dates and trailing additions (A5, A6, A8); now: a date."""
    date = normalize_date(F.col("datePublished"))
    age = F.datediff(now, "date")
    return df.withColumn("date", date).agg(
        F.count(F.lit(1)).alias("parties"),
        F.count_if(F.size("names") > 1).alias("with_aliases"),
        F.count_if((F.size("identifiers") > 0) | (F.size("idDocuments") > 0)).alias("with_identifiers"),
        F.count_if(F.size("relationships") > 0).alias("with_relationships"),
        F.coalesce(F.sum(F.size("relationships")), F.lit(0)).alias("edges"),
        F.coalesce(F.sum(F.size(F.filter("relationships", lambda r: r["type"].rlike(OWNERSHIP)))), F.lit(0)).alias("ownership_edges"),
        F.count("date").alias("dated"),
        F.min("date").alias("oldest"),
        F.max("date").alias("newest"),
        *[F.count_if(age.between(0, d)).alias(f"added_{d}") for d in (30, 90, 365)],
    )


def monthly(dated: DataFrame, date: str = "date", months: int = MONTHS, by: str | None = None) -> DataFrame:
    """(month, count): the months up to the newest one, gaps filled with 0."""
    rows = dated.where(F.col(date).isNotNull()).select(F.trunc(date, "month").alias("m"), *([by] if by else []))
    last = rows.agg(F.max("m").alias("last"))
    spine = last.select(F.explode(F.sequence(F.add_months("last", -(months - 1)), "last", F.expr("interval 1 month"))).alias("m"))
    if by:
        spine = spine.join(rows.select(by).distinct(), how="cross")  # months by groups
    counts = rows.groupBy("m", *([by] if by else [])).agg(F.count(F.lit(1)).alias("n"))
    keys = ["m", by] if by else ["m"]
    return spine.join(counts, keys, "left").select(F.date_format("m", "yyyy-MM").alias("month"), *([by] if by else []), F.coalesce("n", F.lit(0)).alias("count"))


def yearly(dated: DataFrame, date: str = "date", years: int = YEARS) -> DataFrame:
    rows = dated.where(F.col(date).isNotNull()).select(F.year(date).alias("y"))
    spine = rows.agg(F.max("y").alias("last")).select(F.explode(F.sequence(F.col("last") - (years - 1), "last")).alias("y"))
    return spine.join(rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")), "y", "left").select(F.col("y").alias("year"), F.coalesce("n", F.lit(0)).alias("count"))


def recents(rows: DataFrame, by: str, order: list[Column], most: int = RECENT, each: int = RECENT_EACH) -> DataFrame:
    """The newest overall and the newest of each group.

    The newest overall are taken by a distributed top-k, so no window holds all rows.
    """
    top = rows.orderBy(*order).limit(most)
    own = rows.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__k") <= each).drop("__k")
    return top.unionByName(own).distinct()
