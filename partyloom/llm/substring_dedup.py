"""Substring dedup by the common-prefix interval tree of an enhanced, sparse suffix array.

Every string of MATCH bytes has an anchor: its GRAM-byte piece with the smallest hash, leftmost
among equals.  Equal strings have equal anchors at equal offsets, so only suffixes that start at
anchors are sorted.  First, anchors that occur once in the corpus are dropped (a count by hash).
Texts with repeated anchors then send, for each, the bytes around it that its strings span.  Where
equal anchors meet, their right contexts form a suffix array with common-prefix lengths; a stack
scan yields its interval tree, and within every interval the left contexts are compared: members
whose left extensions stay equal long enough form a maximal repeat, diverse extensions end it.
All members of an interval are reported, not neighbours only.  There bytes are compared, never just
hashes.  Anchors with more than HOT occurrences, those of passages that many texts share, would put
one passage into one task and are split: each of their strings goes by its own 128-bit digest,
counted where it is made before anything is shuffled, and is repeated if the count exceeds one.
Before that, the bytes left and right of the anchor are counted in steps of STEP bytes, so that
strings with an end that no other text shares, all at a passage's edges, are not counted at all.

Texts are keyed by two 64-bit hashes, so copies of a text are worked on once: a text that occurs
twice is repeated as a whole if it has MATCH bytes.  Every task passes a text on once at most.

Null texts count as empty.  Texts shorter than MATCH bytes lose nothing.  Repeated rows are
copies of each other; null ids pass through; extra columns are ignored; an empty table gives an
empty result.  Very long texts are cut into overlapping pieces in memory, without changing results.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partyloom.llm.common import materialize, ragged, row_chunks, string_views

MATCH, GRAM = 200, 32
SPAN = MATCH - GRAM + 1
PIECE = 1 << 20
#: Occurrences from which an anchor is split, anchors split at most (more raise HOT), and the step of partial strings.
HOT, MOST_BUSY, STEP = 2_000, 4_000_000, 8
#: Digests that a task may hold (16 bytes each).
MOST_BROADCAST = 1_000_000
HOT_SHARE = 1 / 2000
BASE = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, BASE, np.uint64)
    base[0] = 1
    inverse = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def gram_hashes(flat: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of the GRAM bytes from each position."""
    n = len(flat)
    size = 1 << max(16, (n - 1).bit_length())
    up, down = _powers(size)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(flat * up[:n], out=run[1:])
    h = (run[GRAM:] - run[: n - GRAM + 1]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op over every window of `width` values."""
    done = 1
    while 2 * done <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last, hash): runs of starts of MATCH-byte strings within one text that share an anchor."""
    sizes = np.diff(offsets) - MATCH + 1
    some = sizes > 0
    none = np.zeros(0, np.int64)
    if not some.any():
        return none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(flat)
    least = sliding(np.minimum, h, SPAN)
    edge = np.zeros(SPAN - 1, np.uint64)
    chosen = sliding(np.maximum, np.concatenate([edge, least, edge]), SPAN) == h
    places = np.flatnonzero(chosen)
    starts = ragged(offsets[:-1][some], sizes[some])
    before = np.cumsum(chosen) - chosen
    at = before[starts]
    want = least[starts]
    place = places[at]
    wrong = np.flatnonzero(h[place] != want)
    while len(wrong):
        at[wrong] += 1
        place[wrong] = places[at[wrong]]
        wrong = wrong[h[place[wrong]] != want[wrong]]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(new[1:], len(place)) - 1
    return place[new], starts[new], starts[last], h[place[new]]


def text_anchors(flat: np.ndarray, offsets: np.ndarray):
    """Like anchors, in pieces of bounded size: yields (text, anchor, first, last, hash), places counted from the text's start."""
    for a, b in row_chunks(offsets, PIECE):
        part, cut = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if b - a > 1 or len(part) <= 2 * PIECE:
            place, first, last, h = anchors(part, cut)
            text = np.searchsorted(cut, first, side="right") - 1
            base = cut[text]
            yield a + text, place - base, first - base, last - base, h
            continue
        at = 0
        while True:  # one long text: the last run of a piece begins the next one
            piece = part[at : at + PIECE]
            place, first, last, h = anchors(piece, np.array([0, len(piece)]))
            end = at + len(piece) >= len(part)
            keep = slice(None) if end else slice(0, -1)
            yield np.full(len(first[keep]), a), place[keep] + at, first[keep] + at, last[keep] + at, h[keep]
            if end:
                break
            at += int(first[-1])


def anchor_hashes(flat: np.ndarray, offsets: np.ndarray):
    """(text, hash) of text_anchors, with all pieces of a long text together."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for text, _, _, _, h in text_anchors(flat, offsets):
        if not len(h):
            continue
        if held and held[-1][0][-1] != text[0]:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
        held.append((text, h))
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(df[text_col], F.lit(""))
    return df.select(df[id_col].alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def _once(batches):
    """Each text of the task once."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        fresh = [k not in seen and not seen.add(k) for k in keys]
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _anchor_keys(batches):
    """(h, k1) of each text's anchors; (h, k1 + 1) as well if the text has the anchor twice."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        fresh = np.array([k not in seen and not seen.add(k) for k in zip(k1.tolist(), k2, strict=True)], bool)
        offsets, flat = string_views(batch.column(2))
        for text, h in anchor_hashes(flat, offsets):
            keep = fresh[text]
            text, h = text[keep], h[keep]
            if not len(h):
                continue
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            same = np.concatenate([[False], (h[1:] == h[:-1]) & (text[1:] == text[:-1])])
            again = np.concatenate([[False], same[1:] & ~same[:-1]]) if len(same) > 1 else same
            out_h = np.concatenate([h[~same], h[again]])
            out_k = np.concatenate([k1[text[~same]], k1[text[again]] + 1])
            yield pa.RecordBatch.from_arrays([pa.array(out_h.view(np.int64)), pa.array(out_k)], ["h", "k1"])


CONTEXT = "h long, before int, bytes binary, k1 long, k2 long, places array<bigint>"


def _contexts(batches):
    """For each repeated anchor of a text the bytes that its strings span; equal ones of a text in one row."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
        offsets, flat = string_views(batch.column("text"))
        data = flat.tobytes()
        wanted = [frozenset() if k in seen else frozenset(x) for k, x in zip(zip(k1, k2, strict=True), batch.column("hashes").to_pylist(), strict=True)]
        seen.update(zip(k1, k2, strict=True))
        found: dict[tuple[int, int, int, bytes], list[int]] = {}
        starts = offsets.tolist()
        for text, place, first, last, h in text_anchors(flat, offsets):
            for i, p, f, e, v in zip(text.tolist(), place.tolist(), first.tolist(), last.tolist(), h.view(np.int64).tolist(), strict=True):
                if v in wanted[i]:
                    lo = starts[i]
                    found.setdefault((i, v, p - f, data[lo + f : lo + e + MATCH]), []).append(p)
            if len(found) > 20_000:
                yield _context_rows(found, k1, k2)
                found = {}
        if found:
            yield _context_rows(found, k1, k2)


def _context_rows(found: dict, k1: list[int], k2: list[int]) -> pa.RecordBatch:
    text, h, before, data = zip(*found, strict=True)
    cols = [pa.array(h, pa.int64()), pa.array(before, pa.int32()), pa.array(data, pa.binary()), pa.array([k1[i] for i in text], pa.int64()), pa.array([k2[i] for i in text], pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, ["h", "before", "bytes", "k1", "k2", "places"])


def _common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of x and y, at most `most`."""
    if not len(x):
        return np.zeros(0, np.int64)
    differ = np.concatenate([x != y, np.ones((len(x), 1), bool)], axis=1)
    return np.minimum(differ.argmax(axis=1), most)


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """(first, end, depth) of the intervals of the common-prefix tree; lcp[i] is of suffixes i and i + 1.

    A stack scan: an interval closes when a shorter common prefix follows.
    """
    out, stack = [], []
    for i, d in enumerate([*lcp, -1]):
        start = i
        while stack and stack[-1][1] > d:
            start, depth = stack.pop()
            out.append((start, i + 1, depth))
        if d >= 0 and (not stack or stack[-1][1] < d):
            stack.append((start, d))
    return out


def maximal(groups: np.ndarray, before: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For distinct contexts around equal anchors: how far the repeats of each reach left and right (0, 0: none).

    groups: the anchor of each context, ascending.  All reported repeats hold the anchor, so their
    union is one stretch.
    """
    n = len(contexts)
    reach_l, reach_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return reach_l, reach_r
    rights = np.frombuffer(b"".join([c[b:].ljust(MATCH, b"\0") for c, b in zip(contexts, before.tolist(), strict=True)]), np.uint8).reshape(n, MATCH)
    lefts = np.frombuffer(b"".join([c[b - 1 :: -1].ljust(SPAN, b"\0") if b else b"\0" * SPAN for c, b in zip(contexts, before.tolist(), strict=True)]), np.uint8).reshape(n, SPAN)
    size_r = np.fromiter(map(len, contexts), np.int64, n) - before
    order = np.lexsort((size_r, rights.view(f"S{MATCH}").ravel(), groups))
    x, y = order[:-1], order[1:]
    lcp = _common(rights[x], rights[y], np.minimum(size_r[x], size_r[y]))
    g = groups[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    count = np.diff(np.append(first, n))
    pairs = first[count == 2]
    if len(pairs):
        a, b, r = order[pairs], order[pairs + 1], lcp[pairs]
        left = _common(lefts[a], lefts[b], np.minimum(before[a], before[b]))
        good = left + r >= MATCH
        for k in (a[good], b[good]):
            reach_l[k], reach_r[k] = left[good], r[good]
    for at, m in zip(first[count > 2].tolist(), count[count > 2].tolist(), strict=True):
        for s, e, depth in intervals(lcp[at : at + m - 1].tolist()):
            if depth + SPAN - 1 < MATCH:
                continue
            own = order[at + s : at + e]
            own = own[np.lexsort((before[own], lefts[own].view(f"S{SPAN}").ravel()))] if len(own) > 2 else own
            left = _common(lefts[own[:-1]], lefts[own[1:]], np.minimum(before[own[:-1]], before[own[1:]]))
            best = np.maximum(np.append(left, 0), np.append(0, left))
            good = best + depth >= MATCH
            k = own[good]
            reach_l[k] = np.maximum(reach_l[k], best[good])
            reach_r[k] = np.maximum(reach_r[k], depth)
    return reach_l, reach_r


def _resolve(rows: list[tuple]) -> pa.RecordBatch:
    """Repeated stretches of the occurrences of whole anchor groups.  rows: (h, before, bytes, k1, k2, places), by h."""
    at: dict[tuple[int, int, bytes], set] = {}
    for h, before, data, k1, k2, places in rows:
        at.setdefault((h, before, data), set()).update((k1, k2, p) for p in places)
    keys = sorted(at, key=lambda x: x[0])
    groups = np.array([k[0] for k in keys], np.int64)
    alone = np.ones(len(keys), bool)
    if len(keys) > 1:
        same = groups[1:] == groups[:-1]
        alone = ~(np.append(same, False) | np.append(False, same))
    before = np.array([k[1] for k in keys], np.int64)
    left, right = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    met = np.flatnonzero(~alone)
    left[met], right[met] = maximal(groups[met], before[met], [keys[i][2] for i in met.tolist()])
    out = []
    for i, key in enumerate(keys):
        own = at[key]
        a, b = (int(left[i]), int(right[i])) if len(own) < 2 else (key[1], len(key[2]) - key[1])
        if a or b:
            out += [(key[0], k1, k2, p - a, p + b) for k1, k2, p in own]
    cols = list(zip(*out, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor", "k1", "k2", "first", "end"])


def _repeats(batches):
    """Streams rows sorted by h and resolves whole groups together."""
    held: list[tuple] = []
    for batch in batches:
        new = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if not new:
            continue
        if held and held[-1][0] == new[-1][0]:
            held += new
            continue
        cut = len(new)
        while cut and new[cut - 1][0] == new[-1][0]:
            cut -= 1
        yield _resolve(held + new[:cut])
        held = new[cut:]
    if held:
        yield _resolve(held)


def span_digests(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the bytes [start, end) and of the salt."""
    out = []
    up, down = _powers(1 << max(16, (len(flat) - 1).bit_length()))
    for seed in (1, 3):
        x = (flat.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
        x ^= x >> np.uint64(29)  # bytes as mixed words, so that the two sums differ in more than a factor
        run = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(x * up[: len(flat)], out=run[1:])
        h = (run[ends] - run[starts]) * down[starts] + (ends - starts + (salt << 20)).astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((h ^ (h >> np.uint64(29))).view(np.int64))
    return out[0], out[1]


BUSY = "before int, bytes binary, k1 long, k2 long, place long"


def _busy_contexts(batches, busy: np.ndarray):
    """The bytes that strings of the anchors in busy (sorted) span, a row for each place."""
    for batch in batches:
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        offsets, flat = string_views(batch.column(2))
        for text, place, first, last, h in text_anchors(flat, offsets):
            h = h.view(np.int64)
            at = np.minimum(np.searchsorted(busy, h), len(busy) - 1)
            keep = np.flatnonzero(busy[at] == h)
            if not len(keep):
                continue
            text, place, first, last = text[keep], place[keep], first[keep], last[keep]
            base, size = offsets[text], last - first + MATCH
            data = flat[ragged(base + first, size)].tobytes()
            cut = np.concatenate([[0], np.cumsum(size)]).tolist()
            parts = pa.array([data[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((place - first).astype(np.int32)), parts, pa.array(k1[text]), pa.array(k2[text]), pa.array(place.astype(np.int64))], ["before", "bytes", "k1", "k2", "place"])


def _context_parts(batch):
    """(rows, bytes, begin, before, size) of a batch of contexts, in steps of bounded size."""
    offsets, flat = string_views(batch.column("bytes"))
    before = batch.column("before").to_numpy().astype(np.int64)
    for lo, hi in row_chunks(offsets, PIECE):
        yield np.arange(lo, hi), flat[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo], before[lo:hi], np.diff(offsets[lo : hi + 1])


def _sides(flat, begin, before, size):
    """Digests of the anchor with the bytes before it, and after it, in steps: (d1, d2) of either side and how many each context has."""
    out = []
    for salt, steps in ((1, before // STEP + 1), (2, (size - before - GRAM) // STEP + 1)):
        own = np.repeat(np.arange(len(begin)), steps)
        reach = STEP * ragged(np.zeros(len(steps), np.int64), steps)
        at = (begin + before)[own]
        ends = (at - reach, at + GRAM) if salt == 1 else (at, at + GRAM + reach)
        out.append((*span_digests(flat, *ends, salt), steps))
    return out


def _side_digests(batches):
    for batch in batches:
        for _, *part in _context_parts(batch):
            for d1, d2, _ in _sides(*part):
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2)], ["d1", "d2"])


def _strings(batches, shared: np.ndarray | None):
    """MATCH-byte strings of contexts by digest: the way of hot anchors.  shared: sorted d1 of sides that occur twice; other strings are left out."""
    for batch in batches:
        k1, k2, place = (batch.column(k).to_numpy() for k in ("k1", "k2", "place"))
        for rows, flat, begin, before, size in _context_parts(batch):
            count = size - MATCH + 1
            own = np.repeat(np.arange(len(begin)), count)
            inside = ragged(np.zeros(len(count), np.int64), count)
            if shared is not None:
                left, right = before[own] - inside, inside + MATCH - before[own] - GRAM
                good = np.ones(len(own), bool)
                for (d1, _, steps), reach in zip(_sides(flat, begin, before, size), (left, right), strict=True):
                    known = np.isin(d1, shared)
                    good &= known[(np.cumsum(steps) - steps)[own] + reach // STEP]
                own, inside = own[good], inside[good]
            d1, d2 = span_digests(flat, begin[own] + inside, begin[own] + inside + MATCH)
            first = place[rows[own]] - before[own] + inside
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(k1[rows[own]]), pa.array(k2[rows[own]]), pa.array(first)], ["d1", "d2", "k1", "k2", "first"])


def hot_repeats(df: DataFrame, busy: DataFrame) -> DataFrame:
    """(k1, k2, first, end): repeated strings around the anchors busy (h), MOST_BUSY at most.

    Copies of a text count as what they are: strings that start elsewhere.
    """
    context = df.sparkSession.sparkContext
    known = context.broadcast(np.sort(np.array([r["h"] for r in busy.collect()], np.int64)))
    found = materialize(df.where(F.octet_length("text") >= MATCH).select("k1", "k2", "text").mapInArrow(lambda x: _busy_contexts(x, known.value), BUSY), "contexts")
    twice = lambda rows: materialize(rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2"), "twice")
    sides = twice(found.mapInArrow(_side_digests, "d1 long, d2 long"))
    few = sides.count() <= MOST_BROADCAST
    shared = context.broadcast(np.sort(np.array([r["d1"] for r in sides.select("d1").collect()], np.int64)) if few else None)
    strings = found.mapInArrow(lambda x: _strings(x, shared.value), "d1 long, d2 long, k1 long, k2 long, first long")
    again = twice(strings)
    met = strings.join(F.broadcast(again) if again.count() <= MOST_BROADCAST else again, ["d1", "d2"], "left_semi")
    return met.select("k1", "k2", "first", (F.col("first") + MATCH).alias("end"))


def _cut(batches):
    """What is left of each text without its repeated stretches."""
    for batch in batches:
        offsets, flat = string_views(batch.column("text"))
        spans, k2 = batch.column("spans"), batch.column("k2").to_numpy()
        told, removed, runs, digests = [], [], [], []
        for i in range(batch.num_rows):
            found = spans[i].values
            other, first, end = (np.asarray(found.field(k), np.int64) for k in range(3))
            own = other == k2[i]  # texts may share k1
            if not own.any():
                continue
            told.append(i)
            first, end = first[own], end[own]
            order = np.argsort(first, kind="stable")
            first, end = first[order], np.maximum.accumulate(end[order])
            new = np.concatenate([[True], first[1:] > end[:-1]])
            starts, stops = first[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
            data, at, kept = flat[offsets[i] : offsets[i + 1]].tobytes(), 0, hashlib.sha256()
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            removed.append(int((stops - starts).sum()))
            runs.append(len(starts))
            digests.append(kept.digest())
        yield pa.RecordBatch.from_arrays([batch.column("k1").take(pa.array(told, pa.int64())), batch.column("k2").take(pa.array(told, pa.int64())), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.binary())], ["k1", "k2", "n_removed", "n_spans", "kept"])


def spans(texts: DataFrame, df: DataFrame, hot: int = HOT) -> DataFrame:
    """(k1, k2, first, end): repeated stretches of distinct texts.  texts: (k1, k2, text) partitioned by k1."""
    marks = materialize(df.select("k1", "k2", "text").where(F.octet_length("text") >= MATCH).mapInArrow(_anchor_keys, "h long, k1 long"), "marks")
    hot = max(hot, marks.count() // MOST_BUSY)
    counts = marks.groupBy("h").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(counts.where(F.col("lo") != F.col("hi")).select("h", (F.col("n") > hot).alias("hot")), "repeated")
    lists = materialize(marks.join(repeated.where("not hot").select("h"), "h", "left_semi").groupBy("k1").agg(F.collect_set("h").alias("hashes")), "lists")
    # the build side holds one row a text: the hashes of its own anchors
    found = texts.join(lists.hint("shuffle_hash"), "k1").select("k1", "k2", "text", "hashes").mapInArrow(_contexts, CONTEXT)
    busy, parts = repeated.where("hot").select("h"), []
    if not busy.isEmpty():
        parts.append(hot_repeats(df, busy))
    told = found.repartition("h").sortWithinPartitions("h").mapInArrow(_repeats, "anchor long, k1 long, k2 long, first long, end long")
    out = told.select("k1", "k2", "first", "end")
    for p in parts:
        out = out.unionByName(p)
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each row of df; kept: SHA-256 of the remaining bytes."""
    rows = keyed(df, id_col, text_col)
    known = materialize(rows.select("id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("whole")), "texts")
    texts = rows.select("k1", "k2", "text").where(F.octet_length("text") >= MATCH).mapInArrow(_once, "k1 long, k2 long, text string").repartition("k1")
    stretches = spans(texts, rows, hot).groupBy("k1").agg(F.collect_set(F.struct("k2", "first", "end")).alias("spans"))
    cut = texts.join(stretches.hint("shuffle_hash"), "k1").select("k1", "k2", "text", "spans").mapInArrow(_cut, "k1 long, k2 long, n_removed long, n_spans long, kept binary")
    cut = cut.dropDuplicates(["k1", "k2"])
    sizes = known.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    told = materialize(sizes.join(cut, ["k1", "k2"], "left"), "told")
    floor = F.lit(max(2, int(known.count() * HOT_SHARE)))
    first = known.join(F.broadcast(told.where(F.col("n") >= floor)), ["k1", "k2"], "left")
    columns = ["id", "n_bytes", "whole", "n", "n_removed", "n_spans", "kept"]
    done = first.where(F.col("n").isNotNull()).select(columns)
    rest = first.where(F.col("n").isNull()).select("id", "k1", "k2", "n_bytes", "whole").join(told.where(F.col("n") < floor), ["k1", "k2"]).select(columns)
    copied = (F.col("n") > 1) & (F.col("n_bytes") >= MATCH)
    empty = F.lit(hashlib.sha256().digest())
    return done.unionByName(rest).select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, empty).otherwise(F.coalesce("kept", "whole")).alias("kept"),
    )
