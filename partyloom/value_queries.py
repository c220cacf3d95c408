"""Registered queries of dates and countries as lists write them, over values made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partyloom.functions import countries, dates
from partyloom.queries import query, table

#: Country names that contain each other, and their codes.
NAMED = {
    "GUINEA BISSAU": "GW", "EQUATORIAL GUINEA": "GQ", "PAPUA NEW GUINEA": "PG", "GUINEA": "GN", "NORTH KOREA": "KP", "SOUTH KOREA": "KR", "KOREA NORTH": "KP", "KOREA SOUTH": "KR",
    "DEMOCRATIC REPUBLIC OF THE CONGO": "CD", "REPUBLIC OF THE CONGO": "CG", "CONGO": "CG", "SOUTH SUDAN": "SS", "SUDAN": "SD", "OMAN": "OM", "ROMANIA": "RO", "LAOS": "LA",
}
#: What stands before and after a document's text.
BEFORE = ("Offices in Oman; ", "Papua New Guinea-Bissau: ", "", "North Korea, South Korea. ", "South-Sudan and Sudan ", "Romania ")
AFTER = (" of the Democratic Republic of the Congo", "", " in Guinea, Bissau", " near the Republic of the Congo!", " Korea, North Korea", " ROMANIAN", " (Equatorial Guinea)")
_SPELLED = "|".join(p.replace(" ", "  ") for p in sorted(NAMED, key=lambda p: -len(p.split())))
_LIST = lambda items: "[" + ", ".join("'" + x + "'" for x in items) + "]"


@query(
    "WITH t AS (SELECT doc_id, ' ' || regexp_replace(upper(" + _LIST(BEFORE) + f"[1 + CAST(doc_id % {len(BEFORE)} AS INT)] || coalesce(text, '') || " + _LIST(AFTER) + f"[1 + CAST(doc_id % {len(AFTER)} AS INT)]), '[^A-Z]+', '  ', 'g') || ' ' AS x FROM documents),"
    f" f AS (SELECT doc_id, list_extract(regexp_extract_all(' ' || trim(x) || ' ', ' ({_SPELLED}) ', 1), -1) AS p FROM t)"
    " SELECT doc_id, coalesce(code, '') AS code FROM f LEFT JOIN (VALUES " + ", ".join(f"('{p.replace(' ', '  ')}', '{c}')" for p, c in NAMED.items()) + ") n(p, code) USING (p)"
)
def c5_country_in_text(spark, sf_dir):
    """Whole documents between names of countries: the rightmost counts, the longest at its place."""
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (F.col("doc_id") % len(items) + 1).cast("int"))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", countries.code_in_text(F.concat(pick(BEFORE), F.coalesce("text", F.lit("")), pick(AFTER))).alias("code"))


def _stated(day: Column, turn: Column) -> Column:
    """A date as lists write it, in ten ways."""
    as_ = lambda f: F.date_format(day, f)
    year = F.year(day)
    ways = [
        as_("d MMMM yyyy"), as_("'00/'MM/yyyy"), as_("'31/02/'yyyy"), as_("'circa' MMM. yyyy"), F.concat(year.cast("string"), F.lit(" to "), (year + 2).cast("string")),
        as_("yyyy-M-d"), as_("'00/00/'yyyy"), F.concat(as_("MMM yyyy"), F.lit(" – "), (year - 1).cast("string")), F.concat(F.lit("approx. "), as_("yyyy"), F.lit(" (Place: Oslo)")),
        F.concat(F.lit("born (range "), as_("yyyy-MM-dd"), F.lit("–"), (year + 1).cast("string"), F.lit("-01-01)")),
    ]
    return F.element_at(F.array(*ways), (turn % 10 + 1).cast("int"))


@query(
    "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 10 AS INT) AS k FROM orders),"
    " s AS (SELECT o_orderkey, k, d, date_trunc('month', d)::DATE AS m, date_trunc('year', d)::DATE AS y, (date_trunc('year', d) + INTERVAL 1 MONTH)::DATE AS feb FROM o),"
    " r AS (SELECT o_orderkey, k,"
    "  CASE k WHEN 0 THEN d WHEN 1 THEN m WHEN 2 THEN feb WHEN 3 THEN m WHEN 4 THEN y WHEN 5 THEN d WHEN 6 THEN y WHEN 7 THEN (y - INTERVAL 1 YEAR)::DATE WHEN 8 THEN y ELSE d END AS f,"
    "  CASE k WHEN 0 THEN d WHEN 1 THEN last_day(m) WHEN 2 THEN last_day(feb) WHEN 3 THEN last_day(m) WHEN 4 THEN (y + INTERVAL 3 YEAR - INTERVAL 1 DAY)::DATE WHEN 5 THEN d"
    "   WHEN 6 THEN (y + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE WHEN 7 THEN last_day(m) WHEN 8 THEN (y + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE ELSE (y + INTERVAL 1 YEAR)::DATE END AS t FROM s)"
    " SELECT o_orderkey, strftime(f, '%Y-%m-%d') AS day_from, strftime(t, '%Y-%m-%d') AS day_to, ['day', 'month', 'month', 'month', 'range', 'day', 'year', 'range', 'year', 'range'][k + 1] AS precision, k IN (3, 8) AS approximate FROM r"
)
def d1_d2_stated_dates(spark, sf_dir):
    """Order dates written in ten ways: unknown parts, impossible days, qualifiers, ranges either way round, explicit bounds."""
    o = table(spark, sf_dir, "orders")
    read = o.select("o_orderkey", dates.parse_date_value(_stated(F.col("o_orderdate").cast("date"), F.col("o_orderkey"))).alias("d"))
    return read.select("o_orderkey", F.col("d.from").alias("day_from"), F.col("d.to").alias("day_to"), F.col("d.precision").alias("precision"), F.col("d.approximate").alias("approximate"))


#: Countries as lists write them, and the label, the code and the codes with sovereigns.
WRITTEN = (
    ("RUSSIAN FEDERATION", "Russia", "RU", "RU"), ("Korea, Democratic People''s Republic of", "North Korea", "KP", "KP"), ("hk", "Hong Kong", "HK", "HK,CN"), ("GREENLAND.", "Greenland", "GL", "GL,DK"),
    ("Ivory Coast (CI)", "Côte d''Ivoire", "CI", "CI"), ("na", "", "", ""), ("NA", "Namibia", "NA", "NA"), ("(1) Ukraine. (2) BURMA", "Ukraine,Myanmar", "UA", "UA,MM"), ("Jersey; Guernsey", "Jersey,Guernsey", "JE", "JE,GB,GG"),
    ("PEOPLE OF NOWHERE-LAND", "People of Nowhere-Land", "", ""), ("12", "", "", ""), ("  Cabo   Verde ", "Cape Verde", "CV", "CV"), ("Unknown", "", "", ""),
)


@query(
    "SELECT c_custkey, labels, code, codes FROM customer JOIN (VALUES " + ", ".join(f"({k}, '{b}', '{c}', '{d}')" for k, (_, b, c, d) in enumerate(WRITTEN)) + f") t(k, labels, code, codes) ON c_custkey % {len(WRITTEN)} = k"
)
def c1_c4_countries(spark, sf_dir):
    """Every customer with a country as some list writes it: labels, first code, codes with sovereigns."""
    written = F.element_at(F.array(*[F.lit(w.replace("''", "'")) for w, *_ in WRITTEN]), (F.col("c_custkey") % len(WRITTEN) + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", written.alias("raw"))
    codes = countries.expand_codes(countries.country_codes(F.col("raw")))
    return c.select("c_custkey", F.array_join(countries.parse_countries(F.col("raw")), ",").alias("labels"), countries.country_code(F.col("raw")).alias("code"), F.array_join(codes, ",").alias("codes"))
