"""Fill-in-middle transformation by a two-pass streaming matcher in constant memory.

A text is cut into units, each a word with the white space before it; white space at the end is a
unit of its own.  The first pass walks a lazy match iterator over the text's bytes and only counts.
Two ranks are then drawn from the document's id, and a second lazy iterator is advanced to the
smaller and on to the larger rank: where it stands are the two cuts.  No array of units, offsets or
matches is ever stored; beside the text and its output a task holds one match at a time.  The
draws are Spark expressions over the hash of seed and id, so reruns agree under any partitioning.

Texts that hold a sentinel stay plain, so an output can always be taken apart: no sentinel can
arise across a seam, as none begins where another ends.  Null texts count as empty and stay
plain; a null id draws like an id without digits; repeated rows repeat in the result; a text of
white space is one unit; an empty table gives an empty result; extra columns are carried along
unless they have the name of a result column, which replaces them.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyloom.llm.common import row_chunks, string_views

#: Words with the white space before them, or the white space that ends a text; ASCII only, so bytes and code points agree.
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
TILE = 1 << 20


def draw(id_col: Column, place: int, seed: int = SEED) -> Column:
    """The place-th (from 0) eight hex digits of the SHA-256 of `seed:id`, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1 + 8 * place, 8), 16, 10).cast("long")


def count_units(data, start: int, end: int) -> int:
    """First pass: how many units data[start:end] has."""
    n = 0
    for _ in UNIT.finditer(data, start, end):
        n += 1
    return n


def cuts(data, start: int, end: int, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the units of rank low and high (low <= high, from 0 to all) end."""
    units, at = UNIT.finditer(data, start, end), start
    if low:
        at = next(islice(units, low - 1, None)).end()
    if high == low:
        return at, at
    return at, next(islice(units, high - low - 1, None)).end()


def code_points(data: np.ndarray) -> int:
    """Code points in UTF-8 bytes, tile by tile."""
    return sum(int(np.count_nonzero((data[a : a + TILE] & 0xC0) != 0x80)) for a in range(0, len(data), TILE))


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """The rows of df without their text, and n, form, prefix_chars, middle_chars and output.

    form: plain, psm or spm; `rate` of 100 texts are cut, `spm_rate` of 100 of those suffix first.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    text = F.coalesce(df[text_col], F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (draw(df[id_col], 2, seed) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(df[id_col], 3, seed) % 100 < spm_rate, "spm").otherwise("psm")
    carried = [c for c in df.columns if c not in (text_col, *made)]
    source = df.select(*[df[c] for c in carried], text.alias("__text"), form.alias("form"), draw(df[id_col], 0, seed).alias("__h1"), draw(df[id_col], 1, seed).alias("__h2"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        for whole in batches:
            sizes, _ = string_views(whole.column("__text"))
            for lo, hi in row_chunks(sizes):
                batch = whole.slice(lo, hi - lo)
                offsets, flat = string_views(batch.column("__text"))
                view, at = memoryview(flat), offsets.tolist()
                forms = batch.column("form").to_pylist()
                h1, h2 = batch.column("__h1").to_pylist(), batch.column("__h2").to_pylist()
                n, before, between, parts, lengths = [], [], [], [], []
                for i, form in enumerate(forms):
                    start, end = at[i], at[i + 1]
                    n.append(count_units(view, start, end))
                    if form == "plain":
                        before.append(None)
                        between.append(None)
                        parts.append(view[start:end])
                        lengths.append(end - start)
                        continue
                    a, b = h1[i] % (n[i] + 1), h2[i] % (n[i] + 1)
                    c1, c2 = cuts(view, start, end, min(a, b), max(a, b))
                    before.append(code_points(flat[start:c1]))
                    between.append(code_points(flat[c1:c2]))
                    prefix, middle, suffix = view[start:c1], view[c1:c2], view[c2:end]
                    parts += [p, prefix, s, suffix, m, middle] if form == "psm" else [s, suffix, p, prefix, m, middle]
                    lengths.append(end - start + len(p) + len(s) + len(m))
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                output = pa.LargeStringArray.from_buffers(len(forms), pa.py_buffer(ends), pa.py_buffer(b"".join(parts))).cast(pa.string())
                columns = [batch.column(c) for c in carried] + [pa.array(n, pa.int64()), batch.column("form"), pa.array(before, pa.int64()), pa.array(between, pa.int64()), output]
                yield pa.RecordBatch.from_arrays(columns, carried + made)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in carried)
    more = "n long, form string, prefix_chars long, middle_chars long, output string"
    return source.mapInArrow(run, f"{kinds}, {more}" if kinds else more)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from, taken apart at its sentinels."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    front = lambda first, second: F.substring_index(F.substring_index(head, second, 1), first, -1)
    psm = F.concat(front(PREFIX, SUFFIX), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, front(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce("text", '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
         regexp_extract_all(coalesce("text", ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), h AS (
  SELECT doc_id, x, u, len(u) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
         CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4
  FROM t
), c AS (
  SELECT doc_id, x, n,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM h
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM c
"""
