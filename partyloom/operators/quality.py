"""Quality profiles of snapshots and the gate that compares them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyloom.functions import countries
from partyloom.functions.dates import parse_date_value
from partyloom.functions.vocab import attribute_kind, identifier_kind
from partyloom.operators.shared import dealt

# Floors, which rates are better low, and tolerated drops.
FLOORS = {"dobParseRate": 0.95, "countryResolveRate": 0.95, "attributeUnclassifiedRate": 0.10, "identifierUnclassifiedRate": 0.25}
INVERTED = ("attributeUnclassifiedRate", "identifierUnclassifiedRate")
RATES = ("aliasRate", "addressRate", "identifierRate", "birthDateRate", "nationalityRate")
COUNT_DROP, RATE_DROP, RATE_FLOOR, EDGE_FLOOR = 0.10, 0.25, 0.05, 100
PUBLISHED, REFUSED, PUBLISHED_WITH_ALARM = 0, 1, 3


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _facts(df: DataFrame) -> DataFrame:
    kinds = F.transform("attributes", lambda a: F.struct(attribute_kind(a["label"]).alias("k"), a["value"].alias("v")))
    rows = dealt(df).select("authority", "names", "addresses", "identifiers", "relationships", kinds.alias("kinds"))
    of = lambda *k: F.transform(F.filter("kinds", lambda x: x["k"].isin(*k)), lambda x: x["v"])
    births = F.transform(of("dob"), lambda s: parse_date_value(s).isNotNull())
    stated = countries.known(of("nationality", "citizenship"))
    placed = countries.known(F.transform(F.filter("addresses", lambda a: a["country"] != ""), lambda a: a["country"]))
    ids = F.transform("identifiers", lambda i: identifier_kind(i["type"]) == "other_id")
    return rows.select("*", births.alias("births"), stated.alias("stated"), placed.alias("placed"), ids.alias("odd_ids"))


def profile(df: DataFrame) -> DataFrame:
    """(authority, count, rates, relationshipEdges)."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return _facts(df).groupBy(F.when(F.col("authority") == "", "OFAC").otherwise(F.col("authority")).alias("authority")).agg(
        F.count(F.lit(1)).alias("count"),
        share(F.size("names") > 1).alias("aliasRate"),
        share(F.size("addresses") > 0).alias("addressRate"),
        share(F.size("identifiers") > 0).alias("identifierRate"),
        share(F.exists("births", lambda b: b)).alias("birthDateRate"),
        share(F.size("stated") > 0).alias("nationalityRate"),
        F.sum(F.size("relationships")).alias("relationshipEdges"),
    )


def derived(df: DataFrame) -> DataFrame:
    """One row of parse, resolution and classification rates with their denominators."""
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    hits = lambda c: F.coalesce(F.sum(F.size(F.filter(c, lambda x: x))), F.lit(0))
    other = F.coalesce(F.sum(F.size(F.filter("kinds", lambda x: x["k"] == "other"))), F.lit(0))
    a = _facts(df).agg(
        n("births").alias("dobValues"), hits("births").alias("d1"), (n("stated") + n("placed")).alias("countryValues"), (hits("stated") + hits("placed")).alias("d2"), n("kinds").alias("attributes"), other.alias("d3"), n("odd_ids").alias("identifiers"), hits("odd_ids").alias("d4")
    )
    return a.select(
        rate(F.col("d1"), F.col("dobValues")).alias("dobParseRate"),
        rate(F.col("d2"), F.col("countryValues")).alias("countryResolveRate"),
        rate(F.col("d3"), F.col("attributes")).alias("attributeUnclassifiedRate"),
        rate(F.col("d4"), F.col("identifiers")).alias("identifierUnclassifiedRate"),
        "dobValues", "countryValues", "attributes", "identifiers",
    )


def compare(now: DataFrame, before: DataFrame | None, now_derived: DataFrame, before_derived: DataFrame | None) -> DataFrame:
    """(severity, metric, value, reference): floors that are missed and regressions (Q3)."""
    rows = now_derived.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in FLOORS])).alias("m")).select("m.*")
    floor = F.try_element_at(F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv]), F.col("metric"))
    low = F.col("metric").isin(*INVERTED)
    missed = F.when(low, F.col("value") > floor).otherwise(F.col("value") < floor)
    out = rows.where(missed).select(F.lit("floor").alias("severity"), "metric", "value", floor.alias("reference"))
    if before_derived is not None:
        old = before_derived.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("old")) for k in FLOORS])).alias("m")).select("m.*")
        fell = F.when(low, (F.col("old") >= 0.02) & (F.col("value") > F.col("old") * 2)).otherwise((F.col("old") >= 0.5) & (F.col("value") < F.col("old") * (1 - RATE_DROP)))
        out = out.unionByName(rows.join(old, "metric").where(fell).select(F.lit("regression").alias("severity"), "metric", "value", F.col("old").alias("reference")))
    if before is not None:
        measures = ["count", *RATES, "relationshipEdges"]
        long = lambda df, name: df.select("authority", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias(name)) for k in measures])).alias("m")).select("authority", "m.*")
        met = long(now, "value").join(long(before, "old"), ["authority", "key"])
        fell = (
            F.when(F.col("key") == "count", (F.col("old") > 0) & (F.col("value") < F.col("old") * (1 - COUNT_DROP)))
            .when(F.col("key") == "relationshipEdges", (F.col("old") > EDGE_FLOOR) & (F.col("value") < F.col("old") * (1 - RATE_DROP)))
            .otherwise((F.col("old") >= RATE_FLOOR) & (F.col("value") < F.col("old") * (1 - RATE_DROP)))
        )
        out = out.unionByName(met.where(fell).select(F.lit("regression").alias("severity"), F.concat_ws(".", "authority", "key").alias("metric"), "value", F.col("old").alias("reference")))
    return out


def decision(findings: DataFrame, coverage_ok: bool = True) -> int:
    """Exit status of a publication: published, refused, or published with an alarm (Q4)."""
    found = {r["severity"] for r in findings.select("severity").distinct().collect()}  # two values at most
    if not coverage_ok or "regression" in found:
        return REFUSED
    return PUBLISHED_WITH_ALARM if "floor" in found else PUBLISHED


def should_retry(previous_log: list[dict]) -> bool:
    """A second pass is worth it only if a source failed (Q5)."""
    return any(not s["ok"] for s in previous_log)
