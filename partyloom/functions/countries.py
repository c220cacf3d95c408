"""Countries (C1-C7): one label and ISO code for the many ways lists write them.

The table of codes and names is the JVM's own; only spellings that lists use and the JVM does
not are written out here.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from partyloom.functions.dates import SPACE, let

# Labels that differ from the JVM's English names.
LABELS = {
    "AG": "Antigua and Barbuda", "BA": "Bosnia and Herzegovina", "BL": "Saint Barthélemy", "CC": "Cocos (Keeling) Islands", "CD": "DR Congo", "CG": "Congo",
    "CI": "Côte d'Ivoire", "GS": "South Georgia and South Sandwich Islands", "HK": "Hong Kong", "KN": "Saint Kitts and Nevis", "LC": "Saint Lucia",
    "MF": "Saint Martin", "MM": "Myanmar", "MO": "Macau", "PM": "Saint Pierre and Miquelon", "SH": "Saint Helena", "ST": "São Tomé and Príncipe",
    "TC": "Turks and Caicos Islands", "TT": "Trinidad and Tobago", "TR": "Turkey", "VC": "Saint Vincent and Grenadines", "WF": "Wallis and Futuna", "XK": "Kosovo",
}
# Spellings of each label on the lists, upper case.
SPELLINGS = {
    "Russia": ("RUSSIAN FEDERATION", "RUSSIAN"),
    "Iran": ("IRAN (ISLAMIC REPUBLIC OF)", "ISLAMIC REPUBLIC OF IRAN", "IRANIAN"),
    "Syria": ("SYRIAN ARAB REPUBLIC", "SYRIA, ARAB REPUBLIC OF", "SYRIAN"),
    "North Korea": ("DPRK", "NORTH KOREA", "KOREA, NORTH", "KOREA, DEMOCRATIC PEOPLE'S REPUBLIC OF", "DEMOCRATIC PEOPLE'S REPUBLIC OF KOREA", "NORTH KOREAN"),
    "South Korea": ("KOREA, SOUTH", "KOREA, REPUBLIC OF", "REPUBLIC OF KOREA"),
    "Myanmar": ("BURMA", "MYANMAR", "BURMESE"),
    "Vietnam": ("VIET NAM",),
    "Moldova": ("MOLDOVA, REPUBLIC OF",),
    "Tanzania": ("TANZANIA, UNITED REPUBLIC OF", "UNITED REPUBLIC OF TANZANIA"),
    "Bosnia and Herzegovina": ("BOSNIA AND HERZEGOWINA",),
    "Czechia": ("CZECH REPUBLIC",),
    "British Virgin Islands": ("VIRGIN ISLANDS (BRITISH)", "VIRGIN ISLANDS, BRITISH"),
    "U.S. Virgin Islands": ("VIRGIN ISLANDS, U.S.",),
    "Côte d'Ivoire": ("COTE D'IVOIRE", "COTE D IVOIRE", "IVORY COAST"),
    "United States": ("UNITED STATES OF AMERICA",),
    "DR Congo": ("CONGO, DEMOCRATIC REPUBLIC OF", "CONGO, DEMOCRATIC REPUBLIC OF THE", "CONGO (DEMOCRATIC REPUBLIC)", "DEMOCRATIC REPUBLIC OF THE CONGO"),
    "Congo": ("CONGO, PEOPLE'S REPUBLIC OF", "CONGO, REPUBLIC OF THE", "REPUBLIC OF THE CONGO"),
    "Palestinian Territories": (
        "PALESTINIAN TERRITORY", "PALESTINIAN TERRITORY, OCCUPIED", "PALESTINIAN", "OCCUPIED PALESTINIAN TERRITORIES", "OCCUPIED PALESTINIAN TERRITORY",
        "PALESTINE", "PALESTINE, STATE OF", "STATE OF PALESTINE", "WEST BANK", "GAZA", "GAZA STRIP",
    ),
    "Laos": ("LAO PEOPLE'S DEMOCRATIC REPUBLIC",),
    "Venezuela": ("VENEZUELA, BOLIVARIAN REPUBLIC OF", "VENEZUELAN"),
    "Bolivia": ("BOLIVIA, PLURINATIONAL STATE OF",),
    "Taiwan": ("TAIWAN, PROVINCE OF CHINA",),
    "Turkey": ("TURKIYE", "TÜRKIYE", "TURKISH"),
    "United Arab Emirates": ("UAE",),
    "Macau": ("MACAO", "MACAU SAR", "CHINA, MACAO SPECIAL ADMINISTRATIVE REGION"),
    "Hong Kong": ("HONG KONG SAR", "CHINA, HONG KONG SPECIAL ADMINISTRATIVE REGION", "HONG KONG SPECIAL ADMINISTRATIVE REGION"),
    "Vatican City": ("HOLY SEE (VATICAN CITY STATE)",),
    "United Kingdom": ("UNITED KINGDOM OF GREAT BRITAIN AND NORTHERN IRELAND", "GREAT BRITAIN", "BRITAIN"),
    "Gambia": ("THE GAMBIA", "GAMBIA, THE"),
    "North Macedonia": ("NORTH MACEDONIA, THE REPUBLIC OF", "MACEDONIA, THE FORMER YUGOSLAV REPUBLIC OF"),
    "Kosovo": ("KOSOVO, REPUBLIC OF", "REPUBLIC OF KOSOVO"),
    "Cape Verde": ("CAPE VERDE", "CABO VERDE"),
    "Eswatini": ("SWAZILAND",),
    "Timor-Leste": ("EAST TIMOR",),
    "Brunei": ("BRUNEI DARUSSALAM",),
    "Micronesia": ("MICRONESIA, FEDERATED STATES OF",),
    "Saint Vincent and Grenadines": ("SAINT VINCENT AND THE GRENADINES",),
    "Central African Republic": ("CENTRAL AFRICAN REPUBLIC (THE)",),
    "Netherlands": ("NETHERLANDS, THE",),
    "Philippines": ("PHILIPPINES, THE",),
    "Guinea-Bissau": ("GUINEA BISSAU",),
    "Isle of Man": ("MAN, ISLE OF",),
    "Bahamas": ("BAHAMAS, THE",),
    "Iraq": ("IRAQI",), "Ukraine": ("UKRAINIAN",), "Belarus": ("BELARUSIAN",), "China": ("CHINESE",), "Lebanon": ("LEBANESE",), "Afghanistan": ("AFGHAN",),
    "Pakistan": ("PAKISTANI",), "Cuba": ("CUBAN",), "Libya": ("LIBYAN",), "Yemen": ("YEMENI",), "Sudan": ("SUDANESE",), "Somalia": ("SOMALI",),
}
# Dependencies of each sovereign.
DEPENDENCIES = {
    "CN": "HK MO", "GB": "AI BM FK GG GI IM IO JE KY MS PN SH TC VG GS", "US": "AS GU MP PR VI", "FR": "BL GF GP MF MQ NC PF PM RE TF WF YT",
    "NL": "AW BQ CW SX", "DK": "FO GL", "FI": "AX", "NO": "SJ", "AU": "CC CX NF", "NZ": "CK NU TK",
}
# Words that stay small inside a label.
SMALL_WORDS = ("of", "and", "the", "de", "del", "la", "el", "da", "do")
# Fixed value: the most words of a name that is looked for in free text.
MOST_WORDS = 7


@cache
def _jvm_names() -> dict[str, str]:
    spark = SparkSession.active()
    locale = spark._jvm.java.util.Locale
    english = locale.ENGLISH
    return {c: locale("", c).getDisplayCountry(english) for c in locale.getISOCountries()}


@cache
def tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """(label by code, label by upper-case spelling, code by label)."""
    label = {c: LABELS.get(c, n.replace("’", "'").replace(" & ", " and ").replace("St. ", "Saint ")) for c, n in _jvm_names().items()} | {"XK": LABELS["XK"]}
    code = {}
    for c, n in label.items():
        code.setdefault(n, c)
    label["UK"] = label["GB"]
    spelled = {s: n for n, all_ in SPELLINGS.items() for s in all_}
    return label, spelled, code


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    made = F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*map(F.lit, pairs.values())))
    return F.try_element_at(made, key)


def _titled(s: Column) -> Column:
    """A name in capitals as a label: words and parts of hyphenated ones begin with a capital, but for small words inside."""
    small = F.array(*map(F.lit, SMALL_WORDS))
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))
    part = lambda first: lambda w, k: F.when(F.array_contains(small, w) & ~(first & (k == 0)), w).otherwise(capital(w))
    word = lambda w, i: F.array_join(F.transform(F.split(w, "-"), part(i == 0)), "-")
    return F.array_join(F.transform(F.split(F.lower(s), " "), word), " ")


def canonical_country(raw: Column) -> Column:
    """One value to one label (C1); '' for placeholders.  'na' is a placeholder, 'NA' is Namibia."""
    label, spelled, _ = tables()

    def read(s: Column) -> Column:
        bare = F.trim(F.regexp_replace(s, r"\s*\([^)]*\)\s*$", ""))
        nothing = s.isin("", "na") | s.rlike(r"^\d+$") | s.rlike(r"^(?i)(n/a|unknown|none|-+)$")
        listed = F.coalesce(_lookup(spelled, F.upper(s)), _lookup(spelled, F.upper(bare)))
        rest = lambda x: F.coalesce(
            F.when(x.rlike("^[A-Za-z]{2}$"), _lookup(label, F.upper(x))),
            F.when((F.upper(x) == x) & (F.length(x) > 3), _titled(x)),
            x,
        )
        return F.when(nothing, "").otherwise(F.coalesce(listed, let(F.when(F.length(bare) > 2, bare).otherwise(s), rest)))

    clean = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), SPACE, " "))
    return let(F.trim(F.regexp_replace(clean, r"\.$", "")), read)


def labels_of(raw: Column) -> Column:
    """Labels of all values of an array; a value may name several: '(1) A. (2) B' or 'A; B' (C2)."""
    several = lambda s: F.when(F.trim(s).rlike(r"^\(\d+\)"), F.split(s, r"\(\d+\)")).otherwise(F.split(s, ";"))
    values = F.filter(F.coalesce(raw, F.array().cast("array<string>")), lambda s: s.isNotNull())
    parts = F.flatten(F.transform(values, several))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: canonical_country(x)), lambda x: x != ""))


def parse_countries(raw: Column) -> Column:
    return labels_of(F.array(raw))


def codes_of(raw: Column) -> Column:
    """Codes of all values of an array, each once; names that aren't known give none."""
    code = tables()[2]
    return F.array_distinct(F.filter(F.transform(labels_of(raw), lambda x: _lookup(code, x)), lambda x: x.isNotNull()))


def known(raw: Column) -> Column:
    """For each value of an array whether it names a known country."""
    return F.transform(raw, lambda s: F.size(codes_of(F.array(s))) > 0)


def country_codes(raw: Column) -> Column:
    return codes_of(F.array(raw))


def country_code(raw: Column) -> Column:
    return F.coalesce(F.get(country_codes(raw), 0), F.lit(""))


def expand_codes(codes: Column) -> Column:
    """Each code and its sovereign, never the other way."""
    parent = {d: s for s, all_ in DEPENDENCIES.items() for d in all_.split()}
    return F.array_distinct(F.flatten(F.transform(codes, lambda c: F.filter(F.array(c, _lookup(parent, c)), lambda x: x.isNotNull()))))


@cache
def _phrases() -> dict[str, str]:
    """Code by phrase: every label and spelling in capitals and single spaces."""
    label, spelled, code = tables()
    words = lambda s: " ".join(re.sub("[^A-Z ]+", " ", s.upper()).split())
    out: dict[str, str] = {}
    for c, n in label.items():
        out.setdefault(words(n), "GB" if c == "UK" else c)
    for s, n in spelled.items():
        if n in code:
            out.setdefault(words(s), code[n])
    return {p: c for p, c in out.items() if 1 <= len(p.split()) <= MOST_WORDS}


def phrase_pattern(phrases: list[str]) -> str:
    """Any of the phrases as whole words, the longest first; phrases are grouped by their first words."""
    begins: dict[str, list[str]] = {}
    for p in phrases:
        first, _, rest = p.partition(" ")
        begins.setdefault(first, []).append(rest)
    words = []
    for first, rests in sorted(begins.items()):
        more = [" " + r for r in sorted(rests, key=lambda r: (-len(r.split()), r)) if r]
        tail = "(?:" + "|".join(f"{m}(?= |$)" for m in more) + ("|)" if "" in rests else ")") if more else ""
        words.append((first[:1], f"{first[1:]}{tail}"))
    letters: dict[str, list[str]] = {}
    for letter, rest in words:
        letters.setdefault(letter, []).append(rest)
    return r"(?<![A-Z])(?:" + "|".join(f"{k}(?:{'|'.join(f'{r}(?= |$)' for r in v)})" for k, v in letters.items()) + ")"


def code_in_text(text: Column) -> Column:
    """Code of the rightmost country named in free text, the longest phrase at each place; '' if none.

    One pass of a regular expression over the words: matches don't overlap and come from the left,
    so a phrase inside a longer one that was found isn't looked at.
    """
    known = _phrases()
    words = F.trim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z]+", " "))
    found = F.regexp_extract_all(words, F.lit(phrase_pattern(list(known))), F.lit(0))
    return F.coalesce(_lookup(known, F.try_element_at(found, F.lit(-1))), F.lit(""))
