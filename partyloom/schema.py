"""The canonical party record and helpers for its nested columns.

Missing text is '' in every source, so predicates need no null branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = "struct<name:string,type:string,primary:boolean,lowQuality:boolean,script:string,native:string,parts:array<string>>"
ADDRESS = "struct<full:string,country:string>"
DOCUMENT = "struct<type:string,number:string,issuingCountry:string,issueDate:string,expirationDate:string>"
RELATION = "struct<type:string,relatedId:string,relatedName:string,inSnapshot:boolean>"
ATTRIBUTE = "struct<group:string,label:string,value:string>"
IDENTIFIER = "struct<type:string,value:string>"
COLUMNS = {
    "id": "string",
    "authority": "string",
    "list": "string",
    "lists": "array<string>",
    "type": "string",
    "name": "string",
    "title": "string",
    "programs": "array<string>",
    "sanctionsTypes": "array<string>",
    "legalAuthorities": "array<string>",
    "datePublished": "string",
    "remarks": "string",
    "names": f"array<{NAME}>",
    "addresses": f"array<{ADDRESS}>",
    "idDocuments": f"array<{DOCUMENT}>",
    "relationships": f"array<{RELATION}>",
    "attributes": f"array<{ATTRIBUTE}>",
    "identifiers": f"array<{IDENTIFIER}>",
}


def party_ddl() -> str:
    return ", ".join(f"`{k}` {v}" for k, v in COLUMNS.items())


def conform(df: DataFrame) -> DataFrame:
    """All party columns in order; what a source lacks is '' or an empty array."""
    out = []
    for name, kind in COLUMNS.items():
        empty = F.array().cast(kind) if kind.startswith("array") else F.lit("")
        have = F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out.append(F.coalesce(have, empty).alias(name))
    return df.select(*out)


def text(col: Column) -> Column:
    """Trimmed text, '' for null."""
    return F.trim(F.coalesce(col.cast("string"), F.lit("")))


def full(items: Column) -> Column:
    """Without '' and null entries."""
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def joined(*parts: Column, sep: str = ", ") -> Column:
    """Non-empty parts joined."""
    return F.array_join(full(F.array(*[text(p) for p in parts])), sep)


def attribute(group: str, label: str, value: Column) -> Column:
    return F.struct(F.lit(group).alias("group"), F.lit(label).alias("label"), text(value).alias("value"))


def identifier(kind: str | Column, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), text(value).alias("value"))


def valued(items: Column) -> Column:
    """Structs whose value isn't ''."""
    return F.filter(items, lambda x: x["value"] != "")
