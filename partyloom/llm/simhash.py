"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints have 64 bits over word shingles.  If two differ in at most r bits, one of their two
32-bit halves differs in at most r // 2: every distinct fingerprint therefore emits, for either
half, all variants within half the radius.  One shuffle brings equal variants together, colliding
fingerprints are verified over all 64 bits, and the links found make the components.  Within a
collision set links are kept as a spanning forest, never as all pairs.  Sets above MOST_HELD are
not held by one task: their members emit the variants of their other half in turn, a second
shuffle deals those over the cluster, and no variant of both halves can have more than some 17,000
fingerprints.  Copies with one fingerprint are one node.

Full-width variants within r // 2 = 1 bit would only find pairs up to 2 bits apart, and within 2
bits would cost 2,081 rows a fingerprint; splitting the word costs 66 and loses nothing.

Null and empty texts and texts without words have fingerprint zero and are linked like any other.
Null ids take part; a component with null ids only has a null id.  Repeated rows repeat in the
result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partyloom.llm.common import keep_rows, materialize, string_views, winners
from partyloom.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Collision sets up to this size are compared directly, and up to that size held by one task.
DIRECT, MOST_HELD = 256, 4096
HOT_SHARE = 1 / 2000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in pairs), np.uint64, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        part = h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > len(h)).tolist()))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp, key): fp as a signed 64-bit number; key hashes the text."""
    source = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"), F.xxhash64(df[text_col]).alias("key"))

    def run(batches):
        for batch in batches:
            offsets, flat = string_views(batch.column(1))
            view, at = memoryview(flat), offsets.tolist()
            fps = np.array([fingerprint(bytes(view[a:b]), shingle, seed) for a, b in zip(at, at[1:], strict=False)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["id", "fp", "key"])

    return source.mapInArrow(run, "id long, fp long, key long")


def _forest(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a[i] - b[i] between positions in fps."""
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return fps[a[keep]], fps[b[keep]]


def link_set(fps: np.ndarray, key: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is within the radius in one collision set of distinct uint64 fingerprints.

    key: half << 32 | variant.  Pairs of which neither has the variant as its half may be left
    out: they meet on the half of one of them as well.
    """
    n = len(fps)
    if n <= DIRECT:
        close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        a, b = np.nonzero(np.triu(close, 1))
        return _forest(fps, a, b)
    # Many fingerprints that share this half but for a bit: ball hashing of their other half.  A variant
    # within t1 bits of one and t2 bits of another, t1 + t2 <= what the shared half leaves, links them.
    v, who, cost = other_variants(fps, np.full(n, key), radius)
    a, b = cheapest_links(np.zeros(len(v), np.int64), v, cost, who)
    good = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    return _forest(fps, a[good], b[good])


def other_variants(fps: np.ndarray, keys: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(variant, position, bits used) of the other half of each fingerprint, as far as what its own half differs from its key leaves."""
    half = keys >> 32
    own = np.where(half == 1, fps >> np.uint64(32), fps & np.uint64(0xFFFFFFFF))
    other = np.where(half == 1, fps & np.uint64(0xFFFFFFFF), fps >> np.uint64(32))
    used = np.bitwise_count(own ^ (keys & 0xFFFFFFFF).astype(np.uint64)).astype(np.int64)  # 0 or more bits
    bits = np.uint64(1) << np.arange(32, dtype=np.uint64)
    variants, who, cost = [other], [np.arange(len(fps))], [used]
    inner = np.zeros(1, np.uint64)
    for t in range(1, (radius + 1) // 2 + 1):
        grown = (inner[:, None] | bits[None, :]).ravel()
        inner = np.unique(grown[np.bitwise_count(grown) == t])
        some = np.flatnonzero(radius - used >= t)
        variants.append((other[some][:, None] ^ inner[None, :]).ravel())
        who.append(np.repeat(some, len(inner)))
        cost.append(np.repeat(used[some] + t, len(inner)))
    return np.concatenate(variants), np.concatenate(who), np.concatenate(cost)


def cheapest_links(key: np.ndarray, variant: np.ndarray, cost: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of `who`: the one of each (key, variant) that used the fewest bits with all others there."""
    order = np.lexsort((who, cost, variant, key))
    key, variant, who = key[order], variant[order], who[order]
    first = np.concatenate([[True], (variant[1:] != variant[:-1]) | (key[1:] != key[:-1])])[: len(who)]
    head = np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
    a, b = who[head[~first]], who[~first]
    return a[a != b], b[a != b]


#: a, b: a link.  key, variant, cost, fp: a member of a set too large for one task, to be dealt again.
FOUND = "a long, b long, key long, variant long, cost int, fp long"


def _found(a=(), b=(), key=(), variant=(), cost=(), fp=()) -> pa.RecordBatch:
    n, m = len(a), len(key)
    long = lambda x, fill, front: pa.array(np.asarray(x).astype(np.int64), pa.int64()) if not fill else pa.concat_arrays([pa.nulls(fill, pa.int64()), pa.array(np.asarray(x, np.int64))] if front else [pa.array(np.asarray(x, np.int64)), pa.nulls(fill, pa.int64())])
    cols = [long(a, m, False), long(b, m, False), long(key, n, True), long(variant, n, True), long(cost, n, True).cast(pa.int32()), long(fp, n, True)]
    return pa.RecordBatch.from_arrays(cols, ["a", "b", "key", "variant", "cost", "fp"])


def _links(batches, radius: int):
    """Edges of each collision set in a stream sorted by key; what belongs to a set above MOST_HELD goes on as variants."""
    held_key, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    large: int | None = None  # the key whose members go on

    def resolve(keys, fps):
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(first, len(keys)))
        pairs = first[size == 2]
        good = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= radius
        a, b = [fps[pairs[good]]], [fps[pairs[good] + 1]]
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if n > MOST_HELD:
                yield from deal(keys[at : at + n], fps[at : at + n])
                continue
            x, y = link_set(fps[at : at + n], int(keys[at]), radius)
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        yield _found(a=np.minimum(a, b), b=np.maximum(a, b))

    def deal(keys, fps):
        for lo in range(0, len(keys), 1024):
            k, f = keys[lo : lo + 1024], fps[lo : lo + 1024]
            v, who, cost = other_variants(f, k, radius)
            yield _found(key=k[who], variant=v, cost=cost, fp=f.view(np.int64)[who])

    for batch in batches:
        keys = np.concatenate([held_key, batch.column(0).to_numpy()])
        fps = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
        if not len(keys):
            continue
        if large is not None:
            stop = int(np.searchsorted(keys, large, side="right"))
            yield from deal(keys[:stop], fps[:stop])
            keys, fps = keys[stop:], fps[stop:]
            large = None if len(keys) else large
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        held_key, held = keys[cut:], fps[cut:]
        if cut:
            yield from resolve(keys[:cut], fps[:cut])
        if len(held_key) > MOST_HELD:
            large = int(held_key[0])
            yield from deal(held_key, held)
            held_key, held = keys[:0], fps[:0]
    if len(held_key):
        yield from resolve(held_key, held)


def _dealt_links(batches, radius: int):
    """Edges among rows sorted by (key, variant)."""
    held = np.zeros((0, 4), np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)])
        same = (rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == rows[-1, 1]) if len(rows) else np.zeros(0, bool)
        held, done = rows[same], rows[~same]
        yield _linked(done, radius)
    yield _linked(held, radius)


def _linked(rows: np.ndarray, radius: int) -> pa.RecordBatch:
    a, b = cheapest_links(*rows.T)
    good = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= radius
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[good]), pa.array(np.maximum(a, b)[good])], ["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all pairs within the radius."""
    if not 0 < radius // 2 <= 1:
        raise ValueError("radius must be 2 or 3")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    flips = F.sequence(F.lit(0), F.lit(31))

    def ball(half, tag):
        one = F.transform(flips, lambda i: half.bitwiseXOR(F.pow(F.lit(2), i).cast("long")).bitwiseOR(F.lit(tag << 32)))
        return F.concat(F.array(half.bitwiseOR(F.lit(tag << 32))), one)

    variants = distinct.select(F.explode(F.concat(ball(low, 0), ball(high, 1))).alias("key"), "fp")
    found = materialize(variants.repartition("key").sortWithinPartitions("key").mapInArrow(lambda x: _links(x, radius), FOUND), "links")
    dealt = found.where("key is not null").select("key", "variant", "cost", "fp")
    more = dealt.repartition("key", "variant").sortWithinPartitions("key", "variant").mapInArrow(lambda x: _dealt_links(x, radius), "a long, b long")
    return found.where("key is null").select("a", "b").unionByName(more).distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """(id, fp, key, root, component_id) for every row of df; root is the component's least fingerprint."""
    rows = materialize(fingerprints(df, id_col, text_col, shingle, seed), "fps")
    return grouped(rows, lambda distinct: links(distinct, radius))


def grouped(rows: DataFrame, linked) -> DataFrame:
    """(id, fp, key, root, component_id) of rows (id, fp, key); linked: a function from (fp), once each, to links (a, b)."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(linked(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    owner = materialize(rooted.join(lows, "root").select("fp", "n", "root", "component_id"), "owner")
    # fingerprints of at least HOT_SHARE of the rows, 1 / HOT_SHARE at most, are broadcast; no other is hot
    floor = F.lit(max(2, int(rows.count() * HOT_SHARE)))
    hot = F.broadcast(owner.where(F.col("n") >= floor))
    first = rows.join(hot, "fp", "left")
    done = first.where(F.col("n").isNotNull())
    rest = first.where(F.col("n").isNull()).select("fp", "id", "key").join(owner.where(F.col("n") < floor), "fp")
    return done.select("id", "fp", "key", "root", "component_id").unionByName(rest.select("id", "fp", "key", "root", "component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component, the one with the smallest id, with all columns."""
    return keep_rows(df, winners(near_groups(df, id_col, text_col, **how), "root", "component_id"), id_col, text_col)
