"""Remarks and searchable names as table functions for SQL, to be used with LATERAL.

    SELECT id, r.* FROM parties, LATERAL remark_rows(remarks) r

They give the rows that the column forms give as arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from partyloom.functions.text import has_other_script
from partyloom.sources.ofac_flat import REMARKS

REMARK_ROW = "at int, group string, label string, value string, id_type string, id_value string"
NAME_ROW = "ord int, name string, is_primary boolean, alias_type string, low_quality boolean"


class RemarkRows:
    """remark_rows(remarks): a row for each segment between semicolons."""

    def __init__(self) -> None:
        self.rules = [(re.compile(f"{p}(.+)", re.I | re.A), *rest) for p, *rest in REMARKS]
        self.coin = re.compile(r"Digital\s+Currency\s+Address\s*-\s*(\w+)\s", re.I | re.A)

    def eval(self, remarks: str | None) -> Iterator[tuple]:
        segments = [s for s in (x.strip(" ") for x in (remarks or "").split(";")) if s]
        for at, segment in enumerate(segments):
            for rule, group, label, id_type, cut in self.rules:
                met = rule.match(segment)
                if not met:
                    continue
                value, kind = met[1], id_type
                if label == "Digital Currency":
                    coin = self.coin.match(segment)[1]
                    label, kind = f"Digital Currency ({coin})", f"Crypto {coin}"
                number = "" if not id_type else re.match(r"[^\s(]*", value, re.A)[0] if cut else value
                yield at, group, label, value, kind, number
                break
            else:
                yield at, "Other", "Remark", segment, "", ""


class NameRows:
    """name_rows(name, names): a row for each searchable name; names as in a party record."""

    def eval(self, name: str | None, names: list | None) -> Iterator[tuple]:
        rows = [(n["name"], n["primary"], n["type"], n["lowQuality"]) for n in names or []]
        rows += [(n["native"], False, f"{n['type']} (native script)", n["lowQuality"]) for n in names or [] if has_other_script(n["native"])]
        for at, row in enumerate(rows or [(name, True, "Primary", False)]):
            if row[0]:
                yield at, *row


def register(spark: SparkSession) -> None:
    """remark_rows and name_rows; without Arrow, which would make a data frame of each row's output."""
    for name, cls, kind in (("remark_rows", RemarkRows, REMARK_ROW), ("name_rows", NameRows, NAME_ROW)):
        spark.udtf.register(name, F.udtf(cls, returnType=kind, useArrow=False))
