"""Secret scan with multipart credential linking.

Strong spans (assign, access, hex) are reported wherever they stand.  Weak candidates are parts
that prove nothing alone: an access identifier (`user`: a named account or client id), a secret
(`opaque`: a long token of mixed letters and digits) and an endpoint (`endpoint`: a scheme with a
host).  Within a scope, the text between blank lines, the parts are joined by interval: a weak
candidate is reported only if both complementary kinds stand within LINK_CHARS of it.  Strong
assign and hex spans also serve as secrets, and access spans as identifiers.  Each document is
scanned whole inside its own task; the join works on sorted positions by binary search, so many
parts in one text cost n log n and no pairs are formed.

Null texts count as empty and have no spans.  Rows pass one by one, so repeated rows, null ids
and an empty table need nothing special; extra columns are ignored.  Positions are code points.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from partyloom.llm.common import string_views

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
USER = re.compile(rb"""(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I)
OPAQUE = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(rb"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._:@-]+")
KINDS = ("assign", "access", "hex", "user", "opaque", "endpoint")
LINK_CHARS = 400
BLANK = re.compile(rb"\n[\x20\t\r]*\n")


def code_points(text: bytes) -> np.ndarray:
    """How many code points begin before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of the strong spans."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


def _near(points: np.ndarray, start: np.ndarray, end: np.ndarray, reach: int) -> np.ndarray:
    """Whether some interval [a, b) of points (n, 2), sorted by a, lies within reach of [start, end); intervals may overlap."""
    if not len(points):
        return np.zeros(len(start), bool)
    begun = np.searchsorted(points[:, 0], end + reach, side="right")  # those that do not begin too late
    reached = np.maximum.accumulate(points[:, 1])
    return (begun > 0) & (reached[np.maximum(begun - 1, 0)] >= start - reach)


def linked_spans(text: bytes, base: list[tuple[int, int, int]], reach: int = LINK_CHARS) -> list[tuple[int, int, int]]:
    """Weak candidates with both complementary kinds within reach and scope."""
    ends = [m for m in ENDPOINT.finditer(text)] if b"://" in text else []
    if not ends:
        return []
    opaque = [(m.start(), m.end()) for m in OPAQUE.finditer(text) if re.search(rb"[0-9]", m[0]) and re.search(rb"[A-Za-z]", m[0])]
    if opaque and base:
        strong = np.array(sorted((a, b) for a, b, _ in base), np.int64)
        reached = np.maximum.accumulate(strong[:, 1])  # furthest end among those that start before
        own = np.array(opaque, np.int64)
        before = np.searchsorted(strong[:, 0], own[:, 1], side="left")
        free = (before == 0) | (reached[np.maximum(before - 1, 0)] <= own[:, 0])
        opaque = [x for x, ok in zip(opaque, free.tolist(), strict=True) if ok]
    user = [(m.start(), m.end()) for m in USER.finditer(text)]
    endpoint = [(m.start(), m.end()) for m in ends]
    ids = sorted(user + [(a, b) for a, b, k in base if k == 1])
    secrets = sorted(opaque + [(a, b) for a, b, k in base if k != 1])
    cuts = np.array([0, *[m.end() for m in BLANK.finditer(text)]])
    scope = lambda x: np.searchsorted(cuts, np.array([a for a, _ in x], np.int64), side="right")
    heads = None if text.isascii() else code_points(text)
    # scopes lie further apart than any reach: positions in different scopes never meet
    gap = reach + len(text) + 1
    places = lambda x: np.array(x, np.int64) if heads is None else heads[np.array(x, np.int64)]
    lay = lambda x: (places(x).reshape(-1, 2) + (scope(x) * gap)[:, None]) if x else np.zeros((0, 2), np.int64)
    laid = {"user": lay(ids), "secret": lay(secrets), "endpoint": lay(endpoint)}
    out = []
    for kind, own, needs in ((3, user, ("secret", "endpoint")), (4, opaque, ("user", "endpoint")), (5, endpoint, ("user", "secret"))):
        if own:
            at = lay(own)
            met = np.logical_and(*[_near(laid[k], at[:, 0], at[:, 1], reach) for k in needs])
            out += [(*own[i], kind) for i in np.flatnonzero(met)]
    return out


def scan_text(text: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(strong spans, all spans), each sorted by start, then kind, in code points."""
    base = base_spans(text)
    every = base + linked_spans(text, base)
    if every and not text.isascii():
        heads = code_points(text)
        every = [(int(heads[a]), int(heads[b]), k) for a, b, k in every]
    every.sort(key=lambda x: (x[0], x[2], x[1]))
    return [x for x in every if x[2] < 3], every


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base array<struct>, spans array<struct>): strong spans and all spans of each text."""
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    name = lambda rows: [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in x] for x in rows]

    def run(batches):
        for batch in batches:
            offsets, flat = string_views(batch.column(1))
            view, at = memoryview(flat), offsets.tolist()
            found = [scan_text(bytes(view[a:b])) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(name(x[0] for x in found), span), pa.array(name(x[1] for x in found), span)],
                ["id", "base", "spans"],
            )

    kind = source.schema["id"].dataType.simpleString()
    one = "array<struct<kind:string,start:bigint,end:bigint>>"
    return source.mapInArrow(run, f"id {kind}, base {one}, spans {one}").withColumnRenamed("id", id_col)
