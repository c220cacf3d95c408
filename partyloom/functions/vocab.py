"""What attribute labels and identifier types mean (V1-V3), as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of attribute labels, then patterns tried in order.
ATTRIBUTE_KINDS = {
    "dob": ("date of birth", "birthdate"),
    "pob": ("place of birth",),
    "nationality": ("nationality", "nationality country", "nationality of registration"),
    "citizenship": ("citizenship", "citizenship country"),
    "gender": ("gender",),
    "position": ("position", "title"),
    "target_type": ("target type",),
    "established": ("organization established date", "established date"),
    "org_type": ("organization type",),
    "secondary_sanctions": ("secondary sanctions risk",),
    "email": ("email address", "email"),
    "phone": ("phone number",),
    "website": ("website",),
    "swift": ("swift/bic",),
    "isin": ("isin",),
    "ticker": ("equity ticker", "micex code"),
    "issuer": ("issuer name",),
    "duns": ("d-u-n-s number",),
    "registration_country": ("registration country",),
    "locode": ("un/locode",),
    "bank_code": ("bik (ru)",),
    "source_reference": ("eu reference", "un reference"),
    "remark": ("remark",),
    "licence": ("licence requirement", "license requirement", "licence policy", "license policy", "standard order"),
    "program_info": ("federal register notice",),
    "program_date": ("end date",),
    "vessel": ("call sign",),
}
ATTRIBUTE_PATTERNS = (
    (r"^digital currency address", "crypto"),
    (r"^(other |former )?vessel", "vessel"),
    (r"^aircraft|^previous aircraft", "aircraft"),
    (r"executive order|caatsa|hkaa|paipa|peesa|ifca|additional sanctions information|transactions prohibited", "program_info"),
    (r"^(effective|listing|purchase/sales for divestment) date", "program_date"),
    (r"passport", "passport"),
    (r"national id", "national_id"),
)
# Patterns of identifier types, tried in order.
IDENTIFIER_PATTERNS = (
    (r"passport", "passport"),
    (r"\bimo\b", "imo"),
    (r"\bmmsi\b", "mmsi"),
    (r"call sign", "call_sign"),
    (r"aircraft tail|tail number", "aircraft_tail"),
    (r"\bmsn\b|manufacturer.s serial|construction number", "aircraft_msn"),
    (r"vessel registration", "vessel_registration"),
    (r"crypto|digital currency", "crypto"),
    (r"e-?mail", "email"),
    (r"phone|telephone|fax", "phone"),
    (r"swift|\bbic\b", "swift"),
    (r"\blei\b|legal entity identifier", "lei"),
    (r"\bisin\b", "isin"),
    (r"d-u-n-s|\bduns\b", "duns"),
    (r"\btax\b|\bvat\b|\bnit\b|\bruc\b|\btin\b|\brif\b|\brfc\b|fiscal code|\bfein\b|global intermediary identification", "tax_id"),
    (
        r"cedula|\bci\b|\bcurp\b|\bcui\b|\bdni\b|\bnie\b|\bife\b|\bssn\b|national id|national identification|national foreign id|identity card|personal id|credencial electoral|voter"
        r"|residency number|birth certificate|citizen|numero de identidad|cartilla|servicio militar|turkish identification",
        "national_id",
    ),
    (
        r"registration|registry|commercial regist|company number|business number|enterprise number|legal entity number|entity code|organization code|branch unit"
        r"|certificate of incorporation|registered charity|folio mercantil|matricula|chamber of comm|social credit|gazette|\bcr no\b|\bcin\b|economic register",
        "registration",
    ),
    (r"licen[cs]e|permit", "license"),
)
# Kinds whose labels never carry an identifier.
NOT_IDENTIFYING = (
    "nationality citizenship pob dob gender position target_type org_type secondary_sanctions program_info program_date established remark"
    " source_reference registration_country issuer"
).split()
# Display groups, tried in order, and types of screenable identifiers.
GROUPS = (
    (r"birth|nationalit|citizen|gender|born|ethnic|title|position|established|dissolved", "Identity"),
    (r"passport|\bid\b|identif|cedula|tax|registration|licen|ssn|d-u-n-s|duns|lei|vat|commercial|folio|rfc|cuit|rut|nie|dni", "Documents"),
    (r"vessel|imo|mmsi|call sign|tonnage|flag|aircraft|tail|msn|manufacture|gross|hull", "Vessel / Aircraft"),
    (r"digital currency|crypto|email|e-mail|phone|fax|website|web site|swift|bic|url", "Digital & Contact"),
)
GROUP_ORDER = ("Identity", "Documents", "Vessel / Aircraft", "Digital & Contact", "Program", "Other")
TYPES = (
    (r"passport", "Passport"),
    (r"tax", "Tax ID"),
    (r"cedula", "Cedula"),
    (r"registration", "Registration"),
    (r"national|\bid\b|identif|dni|nie|rfc|cuit|rut", "National ID"),
    (r"imo", "IMO"),
    (r"mmsi", "MMSI"),
    (r"call sign", "Call Sign"),
    (r"tail", "Aircraft Tail"),
    (r"msn", "Aircraft MSN"),
    (r"digital currency|crypto", "Crypto"),
    (r"email|e-mail", "Email"),
    (r"swift|bic", "SWIFT/BIC"),
    (r"lei", "LEI"),
    (r"vat", "VAT"),
)


def _first(col: Column, rules, otherwise) -> Column:
    out = None
    for pattern, value in rules:
        out = F.when(col.rlike(pattern), value) if out is None else out.when(col.rlike(pattern), value)
    return out.otherwise(otherwise)


def normalize_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[\s:;.,\-–—]+$", ""), r"\s+", " "))


def attribute_kind(label: Column) -> Column:
    bare = normalize_label(label)
    out = F.when(bare == "", "other")
    for kind, labels in ATTRIBUTE_KINDS.items():
        out = out.when(bare.isin(*labels), kind)
    return out.otherwise(_first(bare, ATTRIBUTE_PATTERNS, "other"))


def identifier_kind(kind: Column) -> Column:
    """Dotted abbreviations are also tried without their dots."""
    bare = normalize_label(kind)
    dotless = F.trim(F.regexp_replace(F.replace(bare, F.lit("."), F.lit("")), r"\s+", " "))
    return _first(F.concat(bare, F.lit("\n"), dotless), IDENTIFIER_PATTERNS, "other_id")


def can_be_identifier(label: Column) -> Column:
    return ~attribute_kind(label).isin(*NOT_IDENTIFYING)


def group_for(label: Column) -> Column:
    return _first(F.lower(label), GROUPS, "Other")


def identifier_type(label: Column) -> Column:
    """Type of the identifier that a label carries, null if it carries none."""
    return F.when(can_be_identifier(label), _first(F.lower(label), TYPES, None))


def values_of(attributes: Column, *kinds: str) -> Column:
    """Values of the attributes of these kinds, in order."""
    return F.transform(F.filter(attributes, lambda a: attribute_kind(a["label"]).isin(*kinds)), lambda a: a["value"])
