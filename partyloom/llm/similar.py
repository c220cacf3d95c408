"""Near-dedup at a stated similarity of word-shingle sets, by ball hashing of wide SimHash fingerprints.

A text's fingerprint has PIECES times 32 bits over its distinct shingles of five words.  Two texts
of Jaccard similarity 0.8 differ in 15 of 100 bits, too many for one ball around a word; but a bit
flips where its count was nearly even, and both texts know which bits those are.  So each piece
emits the variants in which at most FLIPS of its LEAST least certain bits are flipped: a part of
the ball of half the radius that holds nearly all of its probability.  Two texts meet if some piece
of theirs differs in bits that one or the other may flip.  One shuffle brings equal variants
together, and of what meets there is linked what has near CHECK words and the similarity by its sets of
shingles (as 32-bit hashes): nothing is linked by fingerprints alone.  Measured on random texts of 400
words, 9 of 10 pairs at 0.8 to 0.85 are found, and 99 of 100 above.

All pairs of a collision set count, whatever its size, but those within a component needn't be looked
at.  So first each set's members meet its lead, the text nearest to the majority of their check bits (in
sets of up to SMALL all meet all); this connects nearly all of a family of near copies, in no more pairs
than members.  Then every pair of a set that isn't connected is a candidate, unless its parity sketches
show that it lacks the similarity.  That is a join, spread over the cluster; no set is held whole, as
those above MOST_HELD go on in parts.  Pairs left then grow with the square only of texts that share
pieces, lie just below the similarity and can't be told by the sketches (long ones).  Links that a task has
verified go on as a spanning forest.

Texts without words, null ones too, are linked to nothing but equal texts.  Equal texts are one
node.  Null ids take part; a component with null ids only has a null id.  Repeated rows
repeat in the result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partyloom.llm.common import keep_rows, materialize, row_chunks, string_views, winners
from partyloom.llm.components import components
from partyloom.llm.simhash import _forest, grouped
from partyloom.llm.substring_dedup import _powers
from partyloom.llm.window_dedup import mixed, word_hashes, words

SHINGLE, SIMILARITY = 5, 0.8
#: Pieces of 32 bits, least certain bits that may flip, flips at most, and the most differing bits of check words (999 of 1000 pairs at 0.8 have no more).
PIECES, LEAST, FLIPS, CHECK = 8, 6, 2, 19
#: Collision sets of which all pairs are candidates at once, and of which more rows go on in parts.
SMALL, MOST_HELD = 4, 4096
MET_DDL = "key long, lead long, lead_check long, fps array<bigint>, checks array<bigint>"
#: Bits of a text's parity sketch.
PARITY = 512
#: Texts, and their bytes, that a task takes in at once.
MOST_TEXTS, MOST_BYTES = 512, 1 << 19
#: Verified links that a task turns into a forest at once.
FOREST_ROWS = 1 << 20
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingles(flat: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct shingles of each text, sorted; a text of fewer words has one, the whole of it."""
    low = flat + (((flat >= 0x41) & (flat <= 0x5A)).astype(np.uint8) << 5)
    starts, ends, firsts = words(low, offsets)
    h = word_hashes(low, starts, ends)
    up, down = _powers(1 << max(16, len(h).bit_length()))
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=run[1:])
    count = np.diff(firsts)
    take = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), take)
    first = np.repeat(firsts[:-1], take) + np.arange(len(text)) - np.repeat(np.cumsum(take) - take, take)
    length = np.minimum(count, size)[text]
    s = mixed((run[first + length] - run[first]) * down[first] + length.astype(np.uint64))
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
    return s[fresh], np.searchsorted(text[fresh], np.arange(len(count)), side="right")


def bit_counts(s: np.ndarray) -> np.ndarray:
    """How often each of the PIECES * 32 bits is set."""
    out = np.zeros(PIECES * 32, np.int64)
    for lo in range(0, len(s), 1 << 14):
        wide = mixed(s[lo : lo + (1 << 14), None] ^ SEEDS[None, : PIECES // 2])
        out += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def flips(least: int = LEAST, most: int = FLIPS) -> np.ndarray:
    """Which of the least certain bits each variant flips."""
    sets = [c for k in range(most + 1) for c in combinations(range(least), k)]
    out = np.zeros((len(sets), least), bool)
    for i, c in enumerate(sets):
        out[i, list(c)] = True
    return out


def variants(counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((texts, pieces, variants) keys, check words) of bit counts (texts, bits) over n shingles."""
    margin = 2 * counts - n[:, None]
    bits = (margin > 0).reshape(len(n), PIECES, 32)
    place = np.uint64(1) << np.arange(32, dtype=np.uint64)
    base = (bits * place).sum(axis=2, dtype=np.uint64)
    least = np.argsort(np.abs(margin).reshape(len(n), PIECES, 32), axis=2, kind="stable")[:, :, :LEAST]
    change = (flips()[None, None] * place[least][:, :, None, :]).sum(axis=3, dtype=np.uint64)
    keys = (base[:, :, None] ^ change) | (np.arange(PIECES, dtype=np.uint64) << np.uint64(32))[None, :, None]
    return keys, base[:, 0] | (base[:, 1] << np.uint64(32))


def parities(packed: np.ndarray) -> np.ndarray:
    """Of each of PARITY classes of distinct 32-bit hashes, whether it holds an odd number, as words of 64 bits."""
    return np.packbits(np.bincount(packed % PARITY, minlength=PARITY) & 1 == 1, bitorder="little").view(np.uint64)


def _sets(batches):
    """key, text -> key and the text's distinct shingles as packed sorted 32-bit hashes, with its check word, variants and parities."""
    for whole in batches:
        sizes, _ = string_views(whole.column(1))
        for lo, hi in ((a, min(a + MOST_TEXTS, hi)) for lo, hi in row_chunks(sizes, MOST_BYTES) for a in range(lo, hi, MOST_TEXTS)):
            batch = whole.slice(lo, hi - lo)
            offsets, flat = string_views(batch.column(1))
            s, ends = shingles(flat, offsets)
            starts = np.concatenate([[0], ends[:-1]])
            n = ends - starts
            some = np.flatnonzero(n)
            if not len(some):
                continue
            counts = np.stack([bit_counts(s[starts[i] : ends[i]]) for i in some.tolist()])
            keys, check = variants(counts, n[some])
            packed = [np.unique((s[starts[i] : ends[i]] >> np.uint64(32)).astype(np.uint32)) for i in some.tolist()]
            parity = np.stack([parities(p) for p in packed])
            packed = [p.tobytes() for p in packed]
            flat = keys.reshape(len(some), -1)
            many = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(packed, pa.binary()), pa.array(check.view(np.int64)), many(flat), many(np.ascontiguousarray(keys[:, :, 0])), many(parity)], ["fp", "shingles", "check", "keys", "bases", "parity"])


def _met(most_held: int):
    """(key, fp, check, flipped) sorted by key and fp -> collision sets of two texts or more, each with its lead, the text nearest to the majority of check bits.

    A set of more than most_held rows goes on in parts, which have its key and one lead.  Sets whose members have all
    flipped one bit are part of the set without it, and left out.
    """

    def run(batches):
        held, went_on = [np.zeros(0, np.int64)] * 4, None  # key, lead and its check of a set that goes on

        def found(keys, refs, check, flipped, more):
            """Sets of whole rows; more: the last one goes on."""
            nonlocal went_on
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[first, len(keys)])
            part = np.zeros(len(first), bool)
            part[0] = went_on is not None and keys[0] == went_on[0]
            known, part[-1] = part[0], part[-1] or more
            take = part | (size > 1) & (np.bitwise_and.reduceat(flipped, first) == 0)
            rows = np.repeat(take, size)
            keys, refs, check, size, part = keys[rows], refs[rows], check[rows], size[take], part[take]
            if not len(keys):
                return
            first = np.cumsum(size) - size
            bits = np.unpackbits(check.view(np.uint8).reshape(-1, 8), axis=1)
            most = np.packbits(2 * np.add.reduceat(bits, first, axis=0, dtype=np.int64) > size[:, None], axis=1).view(np.int64)[:, 0]
            away = np.bitwise_count((check ^ np.repeat(most, size)).view(np.uint64))
            lead = np.lexsort((refs, away, np.repeat(np.arange(len(size)), size)))[first]
            leads, lead_check = refs[lead], check[lead]
            if known:
                leads[0], lead_check[0] = went_on[1:]
            if more:
                went_on = keys[-1], leads[-1], lead_check[-1]
            many = lambda x: pa.ListArray.from_arrays(pa.array(np.r_[first, len(x)].astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([pa.array(keys[first], mask=~part), pa.array(leads), pa.array(lead_check), many(refs), many(check)], ["key", "lead", "lead_check", "fps", "checks"])

        for batch in batches:
            now = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            more = len(now[0]) - cut > most_held
            cut = len(now[0]) if more else cut
            held = [c[cut:] for c in now]
            if cut:
                yield from found(*(c[:cut] for c in now), more)
        if len(held[0]):
            yield from found(*held, False)

    return run


def _first_pairs(small: int):
    """Collision sets -> candidate pairs: the lead with each other member, and in sets of up to `small` members all."""

    def run(batches):
        for batch in batches:
            part, lead, lead_check = batch.column(0).is_valid().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            first = np.r_[0, np.cumsum(batch.column(3).value_lengths().to_numpy())].astype(np.int64)
            refs, check = batch.column(3).flatten().to_numpy(), batch.column(4).flatten().to_numpy()
            size = np.diff(first)
            a, b = [np.repeat(lead, size)], [refs]
            ca, cb = [np.repeat(lead_check, size)], [check]
            for n in range(3, small + 1):
                own = first[:-1][(size == n) & ~part]
                for i, j in combinations(range(n), 2):
                    for out, of, k in ((a, refs, i), (b, refs, j), (ca, check, i), (cb, check, j)):
                        out.append(of[own + k])
            a, b, ca, cb = (np.concatenate(x) for x in (a, b, ca, cb))
            good = (a != b) & (np.bitwise_count((ca ^ cb).view(np.uint64)) <= CHECK)
            pairs = np.unique(np.stack([np.minimum(a, b)[good], np.maximum(a, b)[good]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["a", "b"])

    return run


def large_sets(met: DataFrame, small: int) -> DataFrame:
    """(key, fp, check): members of the sets of which not all pairs were candidates; sets whose keys clash are looked at together."""
    large = met.where((F.size("fps") > small) | F.col("key").isNotNull()).withColumn("key", F.coalesce("key", F.xxhash64("fps")))
    return large.select("key", F.explode(F.arrays_zip("fps", "checks")).alias("m")).select("key", F.col("m.fps").alias("fp"), F.col("m.checks").alias("check"))


def unsettled(each: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, fp, check, root, main): members of the sets with texts that aren't connected; main is the commonest root there.  roots: (node, root)."""
    rooted = materialize(each.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    counted = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    parted = counted.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    return rooted.join(parted.select("key", "main"), "key")


def other_pairs(members: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all candidate pairs of a set that aren't connected.  sketches: (fp, parity, n)

    Each shingle in which two texts differ flips one bit of their parities, so these differ in no more bits than there
    are such shingles: pairs with more than the similarity allows are left out, and none that has it.
    """
    members = materialize(members.join(sketches, "fp"), "members")
    x, y = members.where("root <> main").alias("x"), members.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.fp") < F.col("y.fp")))
    near = F.bit_count(F.col("x.check").bitwiseXOR(F.col("y.check"))) <= CHECK
    differ = sum((F.bit_count(F.get("x.parity", F.lit(k)).bitwiseXOR(F.get("y.parity", F.lit(k)))) for k in range(PARITY // 64)), F.lit(0))
    able = differ * (1 + similarity) <= (F.col("x.n") + F.col("y.n")) * (1 - similarity) + 1e-3  # both sides are whole but for rounding
    return x.join(y, apart & near & able).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def _verified(similarity: float):
    """a, b and their shingles -> a forest that connects what the pairs whose sets have the similarity connect."""

    def forest(parts):
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        x, y = _forest(nodes, at[: len(a)], at[len(a) :])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = np.zeros(len(x), bool)
            for i, (p, q) in enumerate(zip(x, y, strict=True)):
                if min(len(p), len(q)) < similarity * max(len(p), len(q)):
                    continue
                p, q = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good[i] = both >= similarity * (len(p) + len(q) - both)
            held.append((batch.column(0).to_numpy()[good], batch.column(1).to_numpy()[good]))
            count += int(good.sum())
            if count > FOREST_ROWS:
                yield forest(held)
                held, count = [], 0
        if count:
            yield forest(held)

    return run


def links(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): similar pairs of texts.  texts: (key, text), key a text's hash."""
    sets = materialize(texts.mapInArrow(_sets, "fp long, shingles binary, check long, keys array<bigint>, bases array<bigint>, parity array<bigint>"), "shingles")
    again = materialize(sets.groupBy("fp").count().where("count > 1").select("fp"), "again")
    if not again.isEmpty():  # only repeated texts are shuffled to become one
        sets = materialize(sets.join(again, "fp", "left_anti").unionByName(sets.join(again, "fp", "left_semi").dropDuplicates(["fp"])), "shingles")
    rows = sets.select(F.explode("keys").alias("key"), "fp", "check", "bases")
    flipped = F.col("key").bitwiseXOR(F.get("bases", F.shiftright("key", 32).cast("int")))  # each key and its piece's base share the upper bits
    rows = rows.select("key", "fp", "check", flipped.alias("flipped"))
    met = materialize(rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_met(MOST_HELD), MET_DDL).distinct(), "met")
    x, y = (sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    verified = lambda pairs: pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(_verified(similarity), "a long, b long")
    tried = materialize(met.mapInArrow(_first_pairs(SMALL), "a long, b long").distinct(), "candidates")
    roots = components(verified(tried))
    members = unsettled(large_sets(met, SMALL), roots)
    more = other_pairs(members, sets.select("fp", "parity", (F.length("shingles") / 4).cast("int").alias("n")), similarity)
    more = materialize(more.join(tried, ["a", "b"], "left_anti"), "candidates")
    return roots.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a <> b").unionByName(verified(more))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, fp, key, root, component_id) for every row of df; fp and key are the text's hash."""
    h = F.xxhash64(df[text_col])
    rows = materialize(df.select(df[id_col].cast("long").alias("id"), h.alias("fp"), h.alias("key")), "hashes")
    texts = df.select(h.alias("key"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    return grouped(rows, lambda _: links(texts, similarity))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component, the one with the smallest id, with all columns."""
    return keep_rows(df, winners(similar_groups(df, id_col, text_col, **how), "root", "component_id"), id_col, text_col)
