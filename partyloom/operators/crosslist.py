"""Entity resolution across authorities (J8-J10, R6, G9-G11): links, clusters and views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyloom.functions import countries, dates
from partyloom.functions.text import id_key, norm_name, normalize
from partyloom.functions.vocab import identifier_kind, values_of
from partyloom.operators.components import connected_components
from partyloom.operators.shared import dealt, pinned
from partyloom.plans.snapshot import candidate_names

# Kinds that identify one party, legal forms, and limits.
IDENTIFYING = "passport national_id tax_id registration imo mmsi lei isin duns crypto vessel_registration aircraft_msn".split()
LEGAL_FORMS = (
    "JSC JSCO PJSC OJSC CJSC OAO PAO AO OOO ZAO LLC LLP LP LTD LIMITED PLC INC INCORPORATED CORP CORPORATION CO COMPANY COMPANIES GMBH MBH AG SA SAS SARL SRL SPA"
    " BV NV AB OY OYJ KFT DOO DD EOOD OOD SDN BHD PTE PTY TBK JOINT STOCK PUBLIC OPEN CLOSED PRIVATE THE OF AND"
).split()
MIN_KEY, MOST_PER_KEY, MOST_PER_NAME = 6, 4, 40
DISTINCTIVE_IDF, DISTINCTIVE_LENGTH = 6.5, 4
STRENGTH = {"identifier": 3, "name+dob": 2, "name+country": 1}
CONFIDENCE = {"identifier": "high", "name+dob": "high", "name+country": "medium"}


def identity_of(name: str | None) -> str | None:
    """Sorted words without legal forms; null with fewer than two words."""
    words = sorted(w for w in normalize(name).split() if w not in LEGAL_FORMS)
    return " ".join(words) if len(words) >= 2 else None


def identity_names(names: Column) -> Column:
    """Identity names of an array of names, each once."""
    run = F.udf(lambda many: list(dict.fromkeys(x for n in many if (x := identity_of(n)))), "array<string>", useArrow=True)
    return run(names)


def word_frequencies(parties: DataFrame) -> DataFrame:
    """(word, df) over plain normalised words, so stripped words aren't mistaken for rare ones."""
    words = candidate_names(parties).select("party_id", F.explode(F.split(norm_name(F.col("name")), " ")).alias("word")).where("word <> ''")
    return words.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def distinctive_words(parties: DataFrame, frequencies: DataFrame, total: int) -> DataFrame:
    """(party_id, distinctive): long words that are rare in the corpus."""
    words = candidate_names(parties).select("party_id", F.explode(F.split(norm_name(F.col("name")), " ")).alias("word")).where(F.length("word") >= DISTINCTIVE_LENGTH).distinct()
    rare = frequencies.where(F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1 >= DISTINCTIVE_IDF).select("word")
    return words.join(rare, "word", "left_semi").groupBy("party_id").agg(F.collect_set("word").alias("distinctive"))


def year_ranges(attributes: Column) -> Column:
    """[from, to] years of every stated birth date."""
    found = dates.parse_date_values(values_of(attributes, "dob"))
    return F.transform(found, lambda d: F.struct(F.substring(d["from"], 1, 4).alias("lo"), F.substring(d["to"], 1, 4).alias("hi")))


def country_codes(parties_attributes: Column, addresses: Column) -> Column:
    """Codes stated as such, with sovereigns."""
    stated = values_of(parties_attributes, "nationality", "citizenship")
    return countries.expand_codes(countries.codes_of(F.concat(stated, F.transform(addresses, lambda a: a["country"]))))


def facts(parties: DataFrame) -> DataFrame:
    """What links compare, a row for each party."""
    parties = dealt(parties)
    held = F.transform(F.filter("identifiers", lambda i: identifier_kind(i["type"]).isin(*IDENTIFYING)), lambda i: F.concat(identifier_kind(i["type"]), F.lit(":"), id_key(i["value"])))
    keys = F.array_distinct(F.filter(held, lambda k: F.length(F.substring_index(k, ":", -1)) >= MIN_KEY))
    names = identity_names(F.transform("names", lambda n: n["name"]))
    rows = parties.select("id", F.col("type").alias("kind"), keys.alias("keys"), names.alias("idnames"), year_ranges(F.col("attributes")).alias("years"), country_codes(F.col("attributes"), F.col("addresses")).alias("codes"))
    total = parties.count()
    rare = distinctive_words(parties, word_frequencies(parties), total)
    every = rows.join(rare.withColumnRenamed("party_id", "id"), "id", "left").withColumn("distinctive", F.coalesce("distinctive", F.array().cast("array<string>")))
    return pinned(every, "facts")  # the link rule reads it several times


def _pairs(rows: DataFrame, column: str, most: int) -> DataFrame:
    """(a, b) of different parties that share a value held by 2 to `most` parties; the cap comes before the join."""
    each = rows.select("id", F.explode(column).alias("key"))
    good = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most)).select("key")
    kept = each.join(good, "key", "left_semi")
    return kept.alias("x").join(kept.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def years_overlap(x: Column, y: Column) -> Column:
    """Any interval of x meets any of y."""
    return F.exists(x, lambda i: F.exists(y, lambda j: (i["lo"] <= j["hi"]) & (j["lo"] <= i["hi"])))


def links(rows: DataFrame) -> DataFrame:
    """(a, b, basis): the link rule R6 over pairs that share an identifier or an identity name."""
    pairs = _pairs(rows, "keys", MOST_PER_KEY).withColumn("by_key", F.lit(True)).unionByName(_pairs(rows, "idnames", MOST_PER_NAME).withColumn("by_key", F.lit(False)))
    pairs = pairs.groupBy("a", "b").agg(F.bool_or("by_key").alias("by_key"))
    side = lambda p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns])
    met = pairs.join(side("l"), F.col("a") == F.col("l_id")).join(side("r"), F.col("b") == F.col("r_id"))
    same = F.arrays_overlap("l_idnames", "r_idnames")
    dated = (F.size("l_years") > 0) & (F.size("r_years") > 0)
    person = (F.col("l_kind") == "Individual") | (F.col("r_kind") == "Individual")
    basis = (
        F.when(F.col("by_key") & (same | F.arrays_overlap("l_distinctive", "r_distinctive")), "identifier")
        .when(same & dated, F.when(years_overlap(F.col("l_years"), F.col("r_years")), "name+dob"))
        .when(same & ~person & F.arrays_overlap("l_codes", "r_codes"), "name+country")
    )
    return met.select("a", "b", basis.alias("basis")).where("basis is not null")


def clusters(parties: DataFrame) -> DataFrame:
    """(id, cluster_id, basis): parties with a link, and the weakest basis of their cluster.

    cluster_id is the smallest id.  Records are never merged.
    """
    found = pinned(links(facts(parties)), "links")
    roots = connected_components(found, "a", "b")
    strength = F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv])
    weakest = found.join(roots, found["a"] == roots["node"]).groupBy("root").agg(F.min_by("basis", F.struct(F.try_element_at(strength, F.col("basis")), "basis")).alias("basis"))
    return roots.join(weakest, "root").select(F.col("node").alias("id"), F.col("root").alias("cluster_id"), "basis")


def cross_listing(parties: DataFrame, members: DataFrame) -> DataFrame:
    """(id, also_listed_by, others, confidence): the other listings of each party."""
    own = members.join(parties.select("id", "authority", "name"), "id")
    other = own.select("cluster_id", F.col("id").alias("oid"), F.col("authority").alias("oauth"), F.col("name").alias("oname"))
    met = own.join(other, "cluster_id").where("id <> oid")
    high = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return met.groupBy("id").agg(
        F.array_sort(F.collect_set(F.when(F.col("oauth") != F.col("authority"), F.col("oauth")))).alias("also_listed_by"),
        F.array_sort(F.collect_list(F.struct(F.col("oid").alias("id"), F.col("oauth").alias("authority"), F.col("oname").alias("name")))).alias("others"),
        F.first(F.try_element_at(high, F.col("basis"))).alias("confidence"),
    )


def summary(members: DataFrame, parties: DataFrame) -> DataFrame:
    """One row: clusters, those over several authorities, the largest, and counts by basis."""
    each = members.join(parties.select("id", "authority"), "id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("authority").alias("authorities"), F.first("basis").alias("basis"))
    return each.agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("authorities") > 1).alias("cross_authority"), F.max("n").alias("largest"), *[F.count_if(F.col("basis") == b).alias(b.replace("+", "_")) for b in STRENGTH]
    )
