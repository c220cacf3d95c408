"""Removal of repeated word windows by level-wise doubling.

A window of LENGTH words is judged from what is known of shorter pieces, level by level:

1. Pieces of half the length.  Each window has one: its piece with the smallest hash, leftmost
   among equals.  Only those pieces, about a quarter of all positions, are counted.  A window can
   only be repeated if its piece is.
2. All windows with the same piece are neighbours; together they are a unit, up to twice as long as
   a piece (less a word).  Units that also start in a smaller document are settled as a whole:
   each of their windows is repeated there.  Where all units around a piece are equal,
   nothing is left to do for it.
3. Candidates that survive, pieces whose surroundings differ from place to place, as at the edges
   of a shared passage, are extended to windows, which are compared by 128-bit digests.

`longest` goes on in the same way: only documents with a window repeated at one length are judged
at twice that length, and so on until no candidate survives.

Before anything is shuffled, a task settles what it can by itself.  Of equal pieces, units or
windows it sends one row, that of its smallest document, and answers for the others at once; so
a passage that a third of all documents share is one row a task and not one a document.  Settled
answers travel by a hash of document and piece, not by the piece.  Answers name contents
(hashes of units and windows), so rows that share an id but not a text can't disturb each other.
Pieces and units go by 64-bit polynomial hashes over words (units within equal pieces).

Documents are ordered by id.  Rows with equal ids are one document for the rule, whatever their
texts: none is smaller than the other.  Null ids come after all others (ids must stay below 2 ** 62)
and among themselves by a hash of their texts.  Null texts have no words; documents of fewer words
than a window lose nothing; repeated rows repeat in the result; an empty table gives an empty
result; extra columns are ignored.  Very long texts are hashed in overlapping pieces in memory,
which changes units and not results.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partyloom.llm.common import WORD_SPACE, materialize, ragged, row_chunks, segment_sum, string_views
from partyloom.llm.substring_dedup import _powers, sliding

LENGTH = 13
#: Words of a document that are hashed at once, and rows that a task settles by itself at once.
PIECE_WORDS, TASK_ROWS = 1 << 18, 1 << 21
#: Bytes whose words are hashed at once, and bytes of a word from which it is hashed by itself.
BLOCK_BYTES, LONG_WORD = 1 << 20, 1 << 12
#: Kinds of rows: a question, a repeat, a piece to extend, the news that a piece is to be extended, and the smallest document of a repeat.
ASK, REPEAT, EXTEND, NEWS, SOURCE = 0, 1, 2, 3, 4
ROW = "g long, v long, uid long, kind byte"
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word in the bytes, and the first word of each text (with one entry more)."""
    inside = np.zeros(len(flat) + 2, bool)
    inside[1:-1] = ~WORD_SPACE[flat]
    before, after = inside[:-2].copy(), inside[2:].copy()
    seams = offsets[(offsets > 0) & (offsets < len(flat))]
    before[seams] = False
    after[seams - 1] = False
    starts, ends = np.flatnonzero(inside[1:-1] & ~before), np.flatnonzero(inside[1:-1] & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial, or XXH64 of words above LONG_WORD bytes."""
    from xxhash import xxh64_intdigest

    out, size = np.zeros(len(starts), np.uint64), ends - starts
    up, down = _powers(BLOCK_BYTES + LONG_WORD)
    lo = 0
    while lo < len(starts):
        low = int(starts[lo])
        hi = int(np.searchsorted(starts, low + BLOCK_BYTES))
        at = lo + np.flatnonzero(size[lo:hi] <= LONG_WORD)
        if len(at):
            part = flat[low : int(ends[at[-1]])]
            run = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=run[1:])
            a, b = starts[at] - low, ends[at] - low
            out[at] = mixed((run[b] - run[a]) * down[a] + size[at].astype(np.uint64))
        for i in (lo + np.flatnonzero(size[lo:hi] > LONG_WORD)).tolist():
            out[i] = xxh64_intdigest(flat[starts[i] : ends[i]].tobytes())
        lo = hi
    return out


def units(h: np.ndarray, firsts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, text, piece hash, unit hash) of the units of hashed words; firsts: first word of each text."""
    k, n = -(-length // 2), len(h)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = _powers(1 << max(16, n.bit_length()))
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=run[1:])
    pieces = mixed((run[k:] - run[:-k]) * down[: n - k + 1])
    span = length - k + 1
    least = sliding(np.minimum, pieces, span)
    at = np.zeros(len(least), np.int64)
    for j in range(span - 1, -1, -1):
        at[pieces[j : j + len(least)] == least] = j
    at += np.arange(len(least))
    text = np.searchsorted(firsts, np.arange(len(least)), side="right") - 1
    ok = np.flatnonzero(np.arange(length, n + 1) <= firsts[text + 1])
    if not len(ok):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.r_[True, (at[ok][1:] != at[ok][:-1]) | (text[ok][1:] != text[ok][:-1])]
    lo, hi = ok[new], ok[np.r_[new[1:], True]]
    whole = mixed((run[hi + length] - run[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    return lo, hi, text[lo], pieces[at[lo]], whole


def cut_texts(batch_offsets: np.ndarray, flat: np.ndarray, length: int):
    """(first text, word starts, word ends, word hashes, first word of each text, word number of the first) for pieces of a batch.

    Short texts come together; a text of more than PIECE_WORDS words comes alone, in pieces that
    overlap by length - 1 words, so each of its windows lies in one of them.
    """
    for lo, hi in row_chunks(batch_offsets):
        base = batch_offsets[lo]
        part = flat[base : batch_offsets[hi]]
        starts, ends, firsts = words(part, batch_offsets[lo : hi + 1] - base)
        if hi - lo > 1 or len(starts) <= PIECE_WORDS:
            yield lo, starts + base, ends + base, word_hashes(part, starts, ends), firsts, 0
            continue
        for a in range(0, len(starts) - length + 1, PIECE_WORDS):
            b = min(len(starts), a + PIECE_WORDS + length - 1)
            yield lo, starts[a:b] + base, ends[a:b] + base, word_hashes(part, starts[a:b], ends[a:b]), np.array([0, b - a]), a


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def settle(g: np.ndarray, v: np.ndarray, uid: np.ndarray, extend: bool, sources: bool = False) -> tuple[np.ndarray, ...]:
    """(g, v, uid, kind): the rows that a task sends for its own (piece, unit, document) rows.

    Of equal (g, v) the smallest document asks and the others are repeats.  With `extend`, a piece
    with different units in different documents is to be extended at each, and one row says so.
    """
    order = np.lexsort((uid, v, g))
    g, v, uid = g[order], v[order], uid[order]
    fresh = _runs(g, v, uid)
    g, v, uid = g[fresh], v[fresh], uid[fresh]
    lead = _runs(g, v)
    out = [(_scatter(v[~lead], uid[~lead]), v[~lead], uid[~lead], np.full(int((~lead).sum()), REPEAT, np.int8))]
    if sources:
        known = lead & np.r_[~lead[1:], False]
        out.append((_scatter(v[known], uid[known]), v[known], uid[known], np.full(int(known.sum()), SOURCE, np.int8)))
    g, v, uid = g[lead], v[lead], uid[lead]
    if extend and len(g):
        differ = _differ(g, uid)
        first = np.flatnonzero(_runs(g))
        out.append((_scatter(g[differ], uid[differ]), g[differ], uid[differ], np.full(int(differ.sum()), EXTEND, np.int8)))
        news = np.zeros(len(g), bool)
        news[first] = True
        news &= differ
        out.append((g[news], v[news], uid[news], np.full(int(news.sum()), NEWS, np.int8)))
        g, v, uid = g[~differ], v[~differ], uid[~differ]
    out.append((g, v, uid, np.full(len(g), ASK, np.int8)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _differ(g: np.ndarray, uid: np.ndarray) -> np.ndarray:
    """Whether the run of equal g that a row lies in has several documents."""
    first = np.flatnonzero(_runs(g))
    return np.repeat(np.minimum.reduceat(uid, first) != np.maximum.reduceat(uid, first), np.diff(np.r_[first, len(g)]))


def _scatter(v: np.ndarray, uid: np.ndarray) -> np.ndarray:
    """Where a settled row travels."""
    return mixed(v.view(np.uint64) + mixed(uid.view(np.uint64))).view(np.int64)


def _rows(parts: list, extend: bool, sources: bool) -> pa.RecordBatch:
    g, v, uid, kind = settle(*(np.concatenate(c) for c in zip(*parts, strict=True)), extend, sources)
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(v), pa.array(uid), pa.array(kind, pa.int8())], ["g", "v", "uid", "kind"])


def _ask_units(length: int, sources: bool):
    """uid, text -> rows about units (piece, unit, document), settled as far as one task can."""

    def run(batches):
        held, count = [], 0
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for first, _, _, h, firsts, _ in cut_texts(*string_views(batch.column(1)), length):
                _, _, text, piece, whole = units(h, firsts, length)
                held.append((piece.view(np.int64), whole.view(np.int64), uid[first + text]))
                count += len(text)
                if count > TASK_ROWS:
                    yield _rows(held, True, sources)
                    held, count = [], 0
        if count:
            yield _rows(held, True, sources)

    return run


def _answer(extend: bool, sources: bool):
    """Rows sorted by (g, settled and news first, v, uid) -> (uid, v, kind).

    One g has few rows a task at most, or those of one document, and is looked at as a whole.
    """

    def judge(g, v, uid, kind):
        settled = (kind != ASK) & (kind != NEWS)
        out = [(uid[settled], v[settled], kind[settled])]
        news = g[kind == NEWS]
        g, v, uid = (c[kind == ASK] for c in (g, v, uid))
        lead = _runs(g, v)
        again = uid != uid[np.maximum.accumulate(np.where(lead, np.arange(len(g)), 0))]
        out.append((uid[again], v[again], np.full(int(again.sum()), REPEAT, np.int8)))
        if sources and len(g):
            first = np.flatnonzero(lead)
            known = first[np.logical_or.reduceat(again, first)]
            out.append((uid[known], v[known], np.full(len(known), SOURCE, np.int8)))
        g, uid = g[lead], uid[lead]
        if extend and len(g):
            differ = _differ(g, uid) | np.isin(g, news)
            out.append((uid[differ], g[differ], np.full(int(differ.sum()), EXTEND, np.int8)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int8())], ["uid", "v", "kind"])

    def run(batches):
        held = None
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last g may go on
            held = [c[cut:] for c in now]
            if cut:
                yield judge(*(c[:cut] for c in now))
        if held is not None and len(held[0]):
            yield judge(*held)

    return run


def _flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all entries of a list column; null lists have none."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _named(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mixed(value.view(np.uint64) + mixed(row.astype(np.uint64) + np.uint64(1)))


def _digests(data: memoryview, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """128-bit digests (n, 2) of the windows that begin at the words `first`, their words joined by a space."""
    from xxhash import xxh3_128_digest

    wide = np.concatenate([[0], np.cumsum(starts[1:] != ends[:-1] + 1)])  # gaps of several bytes
    tight = wide[first + length - 1] == wide[first]
    out = bytearray()
    for i, a, b, plain in zip(first.tolist(), starts[first].tolist(), ends[first + length - 1].tolist(), tight.tolist(), strict=True):
        piece = bytes(data[a:b])
        out += xxh3_128_digest(piece.translate(SPACES) if plain else b" ".join(piece.split()))
    return np.frombuffer(bytes(out), np.int64).reshape(-1, 2)


SPACES = bytes(0x20 if WORD_SPACE[i] else i for i in range(256))


def _each(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) for all values of the ranges lo .. hi."""
    size = hi - lo + 1
    return np.repeat(np.arange(len(lo)), size), ragged(lo, size)


def _ask_windows(length: int, sources: bool):
    """uid, text and answers about units -> rows about the windows of units that are neither repeated nor alone."""

    def run(batches):
        held, count = [], 0
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            extended, repeats = (_named(*_flat_lists(batch.column(c))) for c in ("extended", "repeats"))
            offsets, flat = string_views(batch.column("text"))
            for first, starts, ends, h, firsts, _ in cut_texts(offsets, flat, length):
                lo, hi, text, piece, whole = units(h, firsts, length)
                going = np.isin(_named(first + text, piece), extended) & ~np.isin(_named(first + text, whole), repeats)
                if not going.any():
                    continue
                which, at = _each(lo[going], hi[going])
                d = _digests(memoryview(flat), starts, ends, at, length)
                held.append((d[:, 0], d[:, 1], uid[first + text[going][which]]))
                count += len(at)
                if count > TASK_ROWS:
                    yield _rows(held, False, sources)
                    held, count = [], 0
        if count:
            yield _rows(held, False, sources)

    return run


def _cut(length: int):
    """uid, id, text and answers -> id, n_words, n_removed, kept."""

    def run(batches):
        for batch in batches:
            offsets, flat = string_views(batch.column("text"))
            repeats = _named(*_flat_lists(batch.column("repeats")))
            extended = _named(*_flat_lists(batch.column("extended")))
            windows = _named(*_flat_lists(batch.column("windows")))
            starts, _, firsts = words(flat, offsets)
            step = np.zeros(len(starts) + 1, np.int32)
            for first, a, b, h, own, begin in cut_texts(offsets, flat, length):
                lo, hi, text, piece, whole = units(h, own, length)
                word = firsts[first] + begin
                gone = np.isin(_named(first + text, whole), repeats)
                np.add.at(step, word + lo[gone], 1)
                np.add.at(step, word + hi[gone] + length, -1)
                going = ~gone & np.isin(_named(first + text, piece), extended)
                if len(windows) and going.any():
                    which, at = _each(lo[going], hi[going])
                    d = _digests(memoryview(flat), a, b, at, length)
                    at = word + at[np.isin(_named(first + text[going][which], np.ascontiguousarray(d[:, 1])), windows)]
                    np.add.at(step, at, 1)
                    np.add.at(step, at + length, -1)
            keep = np.cumsum(step[:-1]) == 0
            n = np.diff(firsts)
            removed = n - segment_sum(keep.astype(np.int64), firsts)
            kept, view, at = [], memoryview(flat), offsets.tolist()
            for i in range(len(n)):
                text = bytes(view[at[i] : at[i + 1]]).split()
                kept.append(hashlib.sha256(b" ".join(compress(text, keep[firsts[i] : firsts[i + 1]].tolist()) if removed[i] else text)).digest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    return run


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, uid, text): uid orders documents and is never null."""
    number = df[id_col].cast("long")
    late = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(df[text_col]), 2)
    return df.select(number.alias("id"), F.coalesce(number, late).alias("uid"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def _answers(rows: DataFrame, texts: DataFrame, length: int, sources: bool = False) -> tuple[DataFrame, DataFrame]:
    """(uid, repeats, extended, sources) by units and (uid, windows, window_sources) by windows: one row a document, about its own contents."""
    pick = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("v")))
    answer = "uid long, v long, kind byte"
    asked = rows.select("uid", "text").mapInArrow(_ask_units(length, sources), ROW)
    order = [F.col("g"), F.desc("kind"), F.col("v"), F.col("uid")]
    told = asked.repartition("g").sortWithinPartitions(*order).mapInArrow(_answer(True, sources), answer)
    lists = materialize(told.groupBy("uid").agg(pick(REPEAT).alias("repeats"), pick(EXTEND).alias("extended"), pick(SOURCE).alias("sources")), "units")
    again = texts.join(lists.where(F.size("extended") > 0), "uid").select("uid", "text", "repeats", "extended").mapInArrow(_ask_windows(length, sources), ROW)
    found = again.repartition("g").sortWithinPartitions(*order).mapInArrow(_answer(False, sources), answer)
    return lists, found.groupBy("uid").agg(pick(REPEAT).alias("windows"), pick(SOURCE).alias("window_sources"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_words, n_removed, kept) for each row of df; kept: SHA-256 of the words that stay, joined by a space."""
    rows = _documents(df, id_col, text_col)
    texts = rows.repartition("uid")  # one shuffle of the texts, used twice
    lists, windows = _answers(rows, texts, length)
    met = texts.join(lists, "uid", "left").join(windows, "uid", "left").select("id", "text", "repeats", "extended", "windows")
    return met.mapInArrow(_cut(length), "id long, n_words long, n_removed long, kept binary").withColumnRenamed("id", id_col)


def longest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, longest): the largest of length, 2 length, 4 length ... at which some window of the document is in another one too.

    Documents without such a window give no row.  Each level judges the survivors of the last only.
    """
    rows = _documents(df, id_col, text_col)
    out = None
    while True:
        lists, windows = _answers(rows, rows.repartition("uid"), length, sources=True)
        some = lambda *cs: sum((F.coalesce(F.size(c), F.lit(0)) for c in cs), F.lit(0)) > 0
        live = lists.where(some("repeats", "sources")).select("uid").unionByName(windows.where(some("windows", "window_sources")).select("uid")).distinct()
        live = materialize(live, "live")
        out = live.withColumn("longest", F.lit(length)) if out is None else out.unionByName(live.withColumn("longest", F.lit(length)))
        if live.isEmpty():
            break
        rows, length = materialize(rows.join(live, "uid", "left_semi"), "survivors"), 2 * length
    best = out.groupBy("uid").agg(F.max("longest").alias("longest"))
    return _documents(df, id_col, text_col).select("id", "uid").join(best, "uid").select(F.col("id").alias(id_col), "longest")


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, 9223372036854775807) AS uid, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT k, uid, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT k, uid, w, unnest(range(1, len(w) - 11)) AS i FROM t)
), least AS (
  SELECT h, min(uid) AS uid FROM windows GROUP BY h
), covered AS (
  SELECT DISTINCT k, i + j AS i FROM windows JOIN least USING (h), range(13) r(j) WHERE windows.uid > least.uid
), gone AS (
  SELECT k, count(*) AS n FROM covered GROUP BY k
), split AS (
  SELECT k, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t
), kept AS (
  SELECT k, string_agg(x, ' ' ORDER BY i) AS text FROM split s ANTI JOIN covered USING (k, i) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM t LEFT JOIN gone USING (k) LEFT JOIN kept USING (k)
"""
