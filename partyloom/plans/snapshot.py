"""Snapshots: finalising, carry-forward, coverage, freshness, delta and publication."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from partyloom.functions import countries
from partyloom.functions.text import EMPTY, Lexicon, name_tokens, reading_order
from partyloom.functions.vocab import identifier_kind
from partyloom.operators.shared import pinned
from partyloom.schema import COLUMNS, conform

UMBRELLA = "Consolidated List"
# Least rows of a source, and caps.
LEAST_ROWS = {"OFAC": 100, "EU": 1000, "UN": 200, "UK": 200, "CSL": 2000}
MOST_CHANGES = 3000
STALE_HOURS = 24


def merge_by_id(df: DataFrame) -> DataFrame:
    """One row per id (A23, U2): lists united, the copy on the more specific list kept."""
    rows = df.withColumn("authority", F.when(F.col("authority") == "", "OFAC").otherwise(F.col("authority")))
    rows = rows.withColumn("lists", F.when(F.size("lists") > 0, F.col("lists")).otherwise(F.filter(F.array("list"), lambda x: x != "")))
    whole = F.struct(*[F.col(c) for c in COLUMNS])
    order = F.struct((F.col("list") == UMBRELLA).cast("int").alias("umbrella"), F.col("list").alias("list"), F.xxhash64(*COLUMNS).alias("h"))
    merged = rows.groupBy("id").agg(F.min_by(whole, order).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("lists")))).alias("united"))
    kept = merged.select("r.*", "united")
    first = F.array_union(F.filter(F.array("list"), lambda x: x != ""), F.col("united"))
    return kept.withColumn("lists", first).drop("united").select(*COLUMNS)


def drop_misfiled_identifiers(df: DataFrame) -> DataFrame:
    """Without identifiers that are only a country's name filed as a number."""
    kind = lambda i: identifier_kind(i["type"]).isin("national_id", "registration")
    df = df.withColumn("__country", countries.known(F.transform("identifiers", lambda i: i["value"])))
    misfiled = lambda i, k: kind(i) & ~i["value"].rlike(r"\d") & F.get("__country", k)
    return df.withColumn("identifiers", F.filter("identifiers", lambda i, k: ~misfiled(i, k))).drop("__country")


def resolve_relationships(df: DataFrame) -> DataFrame:
    """Names of related parties by id (J2); ids that aren't listed are said to be so."""
    each = df.select("id", F.posexplode("relationships").alias("at", "r"))
    known = df.select(F.col("id").alias("rid"), F.col("name").alias("rname"))
    met = each.join(known, each["r"]["relatedId"] == known["rid"], "left")
    asked = (F.coalesce(F.col("r.relatedName"), F.lit("")) == "") & (F.col("r.relatedId") != "")
    name = F.when(~asked, F.col("r.relatedName")).otherwise(F.coalesce("rname", F.concat(F.lit("Entity "), F.col("r.relatedId"), F.lit(" (unlisted)"))))
    inside = F.when(asked, F.col("rid").isNotNull()).otherwise(F.col("r.inSnapshot"))
    item = F.struct("at", F.struct(F.col("r.type").alias("type"), F.col("r.relatedId").alias("relatedId"), name.alias("relatedName"), inside.alias("inSnapshot")).alias("r"))
    back = met.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("all")).select("id", F.transform("all", lambda x: x["r"]).alias("found"))
    out = df.join(back, "id", "left").withColumn("relationships", F.coalesce("found", "relationships"))
    return out.select(*COLUMNS)


def finalize(df: DataFrame) -> DataFrame:
    return resolve_relationships(drop_misfiled_identifiers(merge_by_id(conform(df))))


def candidate_names(df: DataFrame) -> DataFrame:
    """(party_id, ord, name, is_primary, alias_type, low_quality): every searchable name.

    A native form counts as an alias if its script isn't Latin; a party without names has its
    main one.
    """
    from partyloom.functions.text import other_script

    own = F.transform("names", lambda n: F.struct(n["name"].alias("name"), n["primary"].alias("is_primary"), n["type"].alias("alias_type"), n["lowQuality"].alias("low_quality")))
    native = F.transform(
        F.filter("names", lambda n: (F.coalesce(n["native"], F.lit("")) != "") & other_script(n["native"])),
        lambda n: F.struct(n["native"].alias("name"), F.lit(False).alias("is_primary"), F.concat(n["type"], F.lit(" (native script)")).alias("alias_type"), n["lowQuality"].alias("low_quality")),
    )
    bare = F.array(F.struct(F.col("name").alias("name"), F.lit(True).alias("is_primary"), F.lit("Primary").alias("alias_type"), F.lit(False).alias("low_quality")))
    every = F.when(F.size("names") > 0, F.concat(own, native)).otherwise(bare)
    rows = df.select(F.col("id").alias("party_id"), F.posexplode(every).alias("ord", "n"))
    return rows.select("party_id", "ord", "n.*").where(F.coalesce("name", F.lit("")) != "")


def token_frequencies(df: DataFrame, lexicon: Lexicon = EMPTY) -> DataFrame:
    """(token, df): parties whose names hold the token."""
    names = candidate_names(df).select("party_id", F.explode(name_tokens(F.col("name"), lexicon)).alias("token"))
    return names.distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def facets(df: DataFrame) -> DataFrame:
    """Distinct sorted lists, programs and authorities in one row."""
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return df.agg(sets("lists").alias("lists"), sets("programs").alias("programs"), F.array_sort(F.collect_set("authority")).alias("authorities"))


@dataclass
class Source:
    """A feed: how to read it, what it covers and the fewest rows that are credible."""

    label: str
    authorities: tuple[str, ...]
    read: Callable[[], DataFrame]
    least: int | None = None

    @property
    def floor(self) -> int:
        """The fewest rows; the known minimum of its label or authorities where none is given."""
        if self.least is not None:
            return self.least
        return max([LEAST_ROWS.get(k, 0) for k in (self.label, *self.authorities)])


@dataclass
class Assembly:
    parties: DataFrame
    log: list[dict] = field(default_factory=list)


def taken_in(source: Source) -> tuple[DataFrame, int, int]:
    """(records, rows, distinct ids, about) of a source: read once, written to the shared folder, and counted as it is written."""
    seen = Observation()
    rows = conform(source.read()).observe(seen, F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("id").alias("ids"))
    held = pinned(rows, "source")
    return held, seen.get["rows"], seen.get["ids"]


def assemble(sources: list[Source], previous: DataFrame | None = None) -> Assembly:
    """Union of all sources; one that fails or is too short is replaced by the previous snapshot's rows."""
    parts, log = [], []
    for s in sources:
        try:
            df, count, ids = taken_in(s)
            if count < s.floor:
                raise ValueError(f"{s.label}: {count} rows, at least {s.floor} expected")
            parts.append(df)
            log.append({"label": s.label, "authorities": list(s.authorities), "ok": True, "count": count, "ids": ids, "error": "", "carriedForward": False})
        except Exception as e:  # noqa: BLE001  one source never takes the others down
            old = previous.where(F.col("authority").isin(*s.authorities)) if previous is not None else None
            if old is not None:
                parts.append(conform(old))
            log.append({"label": s.label, "authorities": list(s.authorities), "ok": False, "count": old.count() if old is not None else 0, "ids": 0, "error": str(e)[:300], "carriedForward": old is not None})
    if not parts:
        raise ValueError("no source could be read")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return Assembly(out, log)


def carry_forward(previous: DataFrame, failed: DataFrame) -> DataFrame:
    """Previous rows of the authorities in failed (authority): a semi-join."""
    return previous.join(failed.select("authority").distinct(), "authority", "left_semi")


def coverage(expected: list[str], previous: DataFrame, now: DataFrame) -> DataFrame:
    """One row: missing, regression and publishable."""
    seen = now.agg(F.collect_set("authority").alias("now"))
    before = previous.agg(F.collect_set("authority").alias("before"))
    wanted = F.array(*map(F.lit, expected)).cast("array<string>")
    both = seen.join(before, how="cross")  # one row each
    return both.select(
        F.array_sort(F.array_except(wanted, "now")).alias("missing"), F.array_sort(F.array_except("before", "now")).alias("regression"), (F.size(F.array_except("before", "now")) == 0).alias("publishable")
    )


def freshness(as_of: DataFrame, now: Column, stale_hours: int = STALE_HOURS) -> DataFrame:
    """(authority, as_of) with age_hours and stale (Q2)."""
    hours = F.floor(F.timestamp_diff("MINUTE", F.col("as_of"), now) / 60)
    return as_of.select("authority", "as_of", hours.alias("age_hours"), (hours >= stale_hours).alias("stale"))


def delta(previous: DataFrame, now: DataFrame, most: int = MOST_CHANGES) -> DataFrame:
    """(change, id, name, authority, list, type): added and removed parties, by name, capped per side."""
    columns = ["id", "name", "authority", "list", "type"]
    side = lambda a, b, word: a.join(b.select("id"), "id", "left_anti").select(F.lit(word).alias("change"), *columns).orderBy(reading_order("name"), "id").limit(most)
    return side(now, previous, "added").unionByName(side(previous, now, "removed"))


def publications(history: DataFrame, year: Column, keep: int = 12) -> DataFrame:
    """The newest publications of a year, else of the year before."""
    own = history.where(F.year("published_at") == year)
    last = history.where(F.year("published_at") == year - 1)
    rows = own.unionByName(last.join(own.limit(1).select(F.lit(1).alias("x")), how="left_anti"))
    return rows.orderBy(F.desc("publication_id")).limit(keep)


#: Rows of a snapshot's file.
FILE_ROWS = 1_000_000


def write_snapshot(df: DataFrame, root: str, version: str) -> str:
    """A versioned Parquet folder by authority, so an authority filter prunes files (K1).

    Large authorities are dealt over many tasks.  A version is never overwritten; a pointer row,
    added once all files are there, makes it the current one.
    """
    path = f"{root}/version={version}"
    parts = max(1, -(-df.count() // FILE_ROWS))
    df.repartition("authority", F.pmod(F.xxhash64("id"), F.lit(parts))).write.partitionBy("authority").parquet(path)
    pointer = df.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/_pointer")
    return path


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def current(spark: SparkSession, root: str) -> tuple[str, DataFrame, float] | None:
    """(version, parties, age in milliseconds) of the newest published snapshot, or None."""
    pointer = _read(spark, f"{root}/_pointer")
    row = None if pointer is None else pointer.orderBy(F.desc("published_at"), F.desc("version")).withColumn("age", F.unix_millis(F.current_timestamp()) - F.unix_millis("published_at")).first()
    if row is None:
        return None
    return row["version"], conform(spark.read.parquet(f"{root}/version={row['version']}")), float(row["age"])


def write_aside(df: DataFrame, root: str, kind: str, version: str) -> None:
    """A profile or a delta beside its snapshot, also when it is empty (K2)."""
    df.write.mode("overwrite").parquet(f"{root}/_{kind}/version={version}")


def read_aside(spark: SparkSession, root: str, kind: str, version: str) -> DataFrame | None:
    """None where none was written: an absence, not a quiet day."""
    return _read(spark, f"{root}/_{kind}/version={version}")
