"""Party records as JSON or Parquet: snapshots and the `{entities: [...]}` demo layout."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partyloom.schema import COLUMNS, conform, party_ddl


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A whole JSON document (gzip is fine) with an `entities` array."""
    kind = "array<struct<" + ",".join(f"`{k}`:{v}" for k, v in COLUMNS.items()) + ",aliases:array<string>,sanctionsType:string>>"
    rows = spark.read.schema(f"entities {kind}").option("multiLine", True).json(path).select(F.inline("entities"))
    legacy = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: _plain_name(a))
    own = F.coalesce("names", F.array().cast(COLUMNS["names"]))
    rows = rows.withColumn("names", F.when(F.size(own) == 0, legacy.cast(COLUMNS["names"])).otherwise(own))
    types = F.coalesce("sanctionsTypes", F.array().cast("array<string>"))
    rows = rows.withColumn("sanctionsTypes", F.when((F.size(types) == 0) & (F.coalesce("sanctionsType", F.lit("")) != ""), F.array("sanctionsType")).otherwise(types))
    return conform(rows)


def read_cache(spark: SparkSession, folder: str) -> tuple[DataFrame, float] | None:
    """(parties, age in milliseconds) of snapshot.json, else of snapshot.json.gz, else None.

    Records are finalised anew; a snapshot without records counts as none, one without a
    retrieval time as infinitely old.
    """
    from partyloom.plans.snapshot import finalize

    for name in ("snapshot.json", "snapshot.json.gz"):
        try:
            meta = spark.read.schema("meta struct<retrievedAt:string>").option("multiLine", True).json(f"{folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        parties = read_document(spark, f"{folder}/{name}")
        if parties.isEmpty():
            return None
        age = meta.select((F.unix_millis(F.current_timestamp()) - F.unix_millis(F.try_to_timestamp("meta.retrievedAt"))).alias("age")).first()["age"]
        return finalize(parties), float("inf") if age is None else float(age)
    return None


def _plain_name(a):
    return F.struct(a.alias("name"), F.lit("A.K.A.").alias("type"), F.lit(False).alias("primary"), F.lit(False).alias("lowQuality"), F.lit("Latin").alias("script"), F.lit("").alias("native"), F.array().cast("array<string>").alias("parts"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record a line; splits and scans in parallel."""
    return conform(spark.read.schema(party_ddl()).json(path))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path))
