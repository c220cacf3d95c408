"""Views for people: guidance, facts, exports and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partyloom.functions.dates import normalize_date
from partyloom.functions.text import reading_order
from partyloom.functions.vocab import GROUP_ORDER, attribute_kind

LEGAL_PREFIX = r"(?i)^(public |open |closed )?(joint[- ]stock company|limited liability company|jsc|pjsc|ojsc|llc|ooo|oao|pao)\s+"
LEGAL_SUFFIX = r"(?i)[, ]+(jsc|pjsc|ojsc|llc|ltd|limited|inc|corp|corporation|company|co|gmbh|ag|sa|plc|bv)\.?$"
# Guidance by list, tried in order, letters in either case.
GUIDANCE = (
    ("denied persons", "Export privileges denied"),
    ("unverified", "Extra due diligence before export"),
    ("military end-user", "Military end-user licence required"),
    ("itar debarred", "Debarred from defence trade"),
    ("nonproliferation", "Nonproliferation restrictions"),
)
EXPORT = "Export licence required"
NARROW = (
    ("CMIC", "Securities restriction"),
    ("CAPTA", "Correspondent account restriction"),
    ("FSE", "Foreign sanctions evader"),
    ("Sectoral", "Sectoral restriction"),
    ("Palestinian", "Reject, don't block"),
    ("Menu-Based", "Menu-based restrictions"),
)


def determination(authority: Column, lists: Column, blocking: Column) -> Column:
    """What a listing asks of the reader.

    Export-control authorities never lead to blocking, whatever their lists are called; blocking
    dominates narrower lists.
    """
    names = F.lower(F.array_join(lists, "\n"))
    export = F.lit(EXPORT)
    for part, word in reversed(GUIDANCE):
        export = F.when(F.contains(names, F.lit(part)), word).otherwise(export)
    out = F.when(authority.isin("BIS", "State"), export)
    for a in ("EU", "UN", "UK"):
        out = out.when(authority == a, f"{a} asset freeze")
    out = out.when(blocking, "Block")
    for part, word in NARROW:
        out = out.when(F.contains(names, F.lit(part.lower())), word)
    return out.otherwise("Potential block: review")


def identity_facts(df: DataFrame) -> DataFrame:
    """(id, born, birthplace, nationality, gender): first stated values, the address country for want of a nationality."""
    first = lambda *k: F.get(F.transform(F.filter("attributes", lambda a: attribute_kind(a["label"]).isin(*k)), lambda a: a["value"]), 0)
    country = F.get(F.transform("addresses", lambda a: a["country"]), 0)
    return df.select("id", first("dob").alias("born"), first("pob").alias("birthplace"), F.coalesce(first("nationality", "citizenship"), country).alias("nationality"), first("gender").alias("gender"))


def attribute_groups(df: DataFrame) -> DataFrame:
    """(id, group, position, attributes) in the fixed order of groups (P5)."""
    each = df.select("id", F.posexplode("attributes").alias("at", "a"))
    place = F.array_position(F.array(*map(F.lit, GROUP_ORDER)), F.col("group"))
    return each.groupBy("id", F.col("a.group").alias("group")).agg(F.array_sort(F.collect_list(F.struct("at", "a"))).alias("x")).select("id", "group", place.alias("position"), F.transform("x", lambda x: x["a"]).alias("attributes"))


def ordered_lists(lists: Column, umbrella: str = "Consolidated List") -> Column:
    """The umbrella list last."""
    return F.concat(F.filter(lists, lambda x: x != umbrella), F.filter(lists, lambda x: x == umbrella))


def meta(expected: list[str], seen: DataFrame, fresh: DataFrame, failures: int = 0) -> DataFrame:
    """One row: missing and stale authorities and failures."""
    have = seen.agg(F.collect_set("authority").alias("have"))
    old = fresh.agg(F.array_sort(F.collect_set(F.when(F.col("stale"), F.col("authority")))).alias("stale"), F.max("age_hours").alias("oldest_hours"))
    wanted = F.array(*map(F.lit, expected)).cast("array<string>")
    out = have.join(old, how="cross").select(F.array_sort(F.array_except(wanted, "have")).alias("missing"), "stale", "oldest_hours", F.lit(failures).alias("failures"))  # one row each
    said = F.concat_ws("; ", F.when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.array_join("missing", ", "))), F.when(F.size("stale") > 0, F.concat(F.lit("stale: "), F.array_join("stale", ", "))), F.when(F.col("failures") > 0, "not refreshing"))
    return out.withColumn("banner", said)


def short_name(name: Column) -> Column:
    """Without legal wrappers, if three characters are left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, LEGAL_PREFIX, ""), LEGAL_SUFFIX, ""))
    return F.when(F.length(bare) >= 3, bare).otherwise(name)


def tie_note(ranked: DataFrame, members: DataFrame) -> DataFrame:
    """(qid, tied, note): three or more hits tied at the top, and whether they are one party (P10)."""
    top = ranked.withColumn("best", F.max("score").over(Window.partitionBy("qid"))).where("score = best")
    met = top.join(members.select(F.col("id").alias("party_id"), "cluster_id"), "party_id", "left")
    each = met.groupBy("qid").agg(F.count(F.lit(1)).alias("tied"), F.count_distinct("cluster_id").alias("k"), F.count_if(F.col("cluster_id").isNull()).alias("lone"))
    return each.where("tied >= 3").select("qid", "tied", F.when((F.col("k") == 1) & (F.col("lone") == 0), "one party").otherwise("several parties").alias("note"))


def group_sorted(ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """Hits with their ownership group's count in the result, largest groups first."""
    met = ranked.join(groups.select(F.col("id").alias("party_id"), "group_id"), "party_id", "left")
    n = F.when(F.col("group_id").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("qid", "group_id")))
    met = met.withColumn("group_hits", n)
    place = Window.partitionBy("qid").orderBy(F.col("group_id").isNull(), F.desc("group_hits"), "group_id", F.desc("score"), "party_id")
    return met.withColumn("place", F.row_number().over(place))


def client_order(mode: str = "") -> list[Column]:
    """The order of a result list (L7): by name in reading order, by date, the newest first, or as ranked."""
    ranked = [F.desc("score"), F.col("matched_field") != "primary name", F.col("party_id")]
    if mode == "name":
        return [reading_order("name"), *ranked]
    if mode == "date":
        return [F.desc_nulls_last(normalize_date(F.col("datePublished"))), *ranked]
    return ranked


def recent_filter(df: DataFrame, authority: str = "", kind: str = "", words: str = "") -> DataFrame:
    """By authority, type and free text over name, list, countries and programs."""
    if authority:
        df = df.where(F.col("authority") == authority)
    if kind:
        df = df.where(F.col("type") == kind)
    if words.strip():
        parts = [F.col(c) if t == "string" else F.array_join(c, " ") for c, t in df.dtypes if c in ("name", "list", "programs", "countries") and (t == "string" or t == "array<string>")]
        df = df.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(words.strip().lower())))
    return df


def page(df: DataFrame, order: list, offset: int = 0, size: int = 25) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*order).offset(offset).limit(size)


def record_rows(df: DataFrame) -> DataFrame:
    """(id, at, field, value): a record as field/value rows for export (K3)."""
    plain = ("id", "authority", "list", "type", "name", "title", "datePublished", "remarks")
    fixed = [F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in plain]
    many = [F.struct(F.lit(c).alias("field"), F.array_join(c, "; ").alias("value")) for c in ("lists", "programs", "sanctionsTypes", "legalAuthorities")]
    spread = F.transform("attributes", lambda a: F.struct(a["label"].alias("field"), a["value"].alias("value")))
    return df.select("id", F.posexplode(F.concat(F.array(*fixed, *many), spread)).alias("at", "x")).select("id", "at", "x.field", "x.value").where("value <> ''")


def result_rows(hits: DataFrame, parties: DataFrame) -> DataFrame:
    """Fifteen export columns of a result set."""
    p = parties.select(F.col("id").alias("party_id"), "name", "type", "authority", "list", F.array_join("lists", "; ").alias("lists"), F.array_join("programs", "; ").alias("programs"), F.array_join("sanctionsTypes", "; ").alias("measures"), "datePublished", "remarks")
    return hits.join(p, "party_id").select("party_id", "name", "type", "authority", "list", "lists", "programs", "measures", "datePublished", "score", "match_type", "matched_name", "matched_field", "explain", "remarks")


def enriched(hits: DataFrame, parties: DataFrame, profiles: DataFrame, groups: DataFrame, crossed: DataFrame) -> DataFrame:
    """Hits with the party's record, a summary of its ownership, its group and its other listings.

    What has nothing to report is null.  profiles, groups, crossed: as ownership.profile,
    ownership.groups and crosslist.cross_listing make them, keyed by listing.
    """
    record = parties.select(F.col("id").alias("party_id"), *[c for c in parties.columns if c != "id"])
    quiet = (F.size("blocked_owners") == 0) & (F.size("subsidiaries") == 0) & (F.size("controls") == 0)
    lead = F.struct("self_blocked", "blocked_owners", "direct", "indirect", "aggregation_candidate", F.size("subsidiaries").alias("subsidiaries"), F.size("controls").alias("controls"), "note")
    own = profiles.select(F.col("id").alias("party_id"), F.when(~quiet, lead).alias("derivative"))
    group = groups.select(F.col("id").alias("party_id"), F.struct("group_id", "size", "label").alias("cluster"))
    other = crossed.where(F.size("also_listed_by") > 0).select(F.col("id").alias("party_id"), F.struct("also_listed_by", "others", "confidence").alias("cross_listed"))
    out = hits.join(record, "party_id", "left")
    for df in (own, group, other):
        out = out.join(df, "party_id", "left")
    return out


def provenance(retrieved_at: str, publication: str, threshold: float) -> list[tuple[str, str]]:
    """Trailer rows that say what a result was made from."""
    return [("Retrieved", retrieved_at), ("Publication", publication), ("Threshold", f"{threshold:.2f}")]


def csv_lines(df: DataFrame, columns: list[str], order: list, trailer: list[tuple] = ()) -> DataFrame:
    """(line): a header, the rows in a total order and trailer rows, every value quoted (K3-K5).

    For exports of one record or one result set, which are bounded; they come as one file.
    """
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    spark = df.sparkSession
    line = F.concat_ws(",", *[quote(F.col(c)) for c in columns]).alias("line")
    body = df.withColumn("__n", F.row_number().over(Window.orderBy(*order))).select(F.lit(1).alias("part"), "__n", line)
    fixed = [(0, 0, list(columns)), *[(2, i, list(map(str, t))) for i, t in enumerate(trailer)]]
    more = spark.createDataFrame(fixed, "part int, __n int, v array<string>").select("part", "__n", F.concat_ws(",", F.transform("v", quote)).alias("line"))
    mark = F.when(F.col("part") == 0, "\ufeff").otherwise("")  # spreadsheets read the file as UTF-8
    return body.unionByName(more).orderBy("part", "__n").select(F.concat(mark, F.col("line")).alias("line"))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list | None = None, trailer: list[tuple] = ()) -> None:
    """csv_lines as one file with a byte-order mark and CRLF line ends."""
    columns = columns or df.columns
    csv_lines(df, columns, order or columns, trailer).coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON body a row, gzip (K1, K2, K7)."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def memo(record: dict) -> str:
    """A printable memo of one record (K6)."""
    lines = [f"{record.get('name', '')} ({record.get('id', '')})", "=" * 40]
    lines += [f"{k}: {v}" for k, v in record.items() if v and k not in ("name", "id")]
    return "\n".join(lines)
