"""Near-dedup at a similarity of 0.8 over five-word shingles, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from partyloom.llm import similar

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp int, key int, root int, a int"


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x or y else 0.0


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, 3, 4) for i, t in rows], DOCS).repartition(5)


def changed(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = str(rng.randrange(10**6))
    return out


def test_pairs_at_every_similarity(spark):
    rng = random.Random(3)
    texts = []
    for i in range(500):
        w = [str(rng.randrange(10**6)) for _ in range(rng.choice([120, 400, 900]))]
        texts += [" ".join(w), "  ".join(changed(rng, w, len(w) * (i % 8) // 200 + 1)).upper()]
    got = {r["id"]: r["component_id"] for r in similar.similar_groups(frame(spark, enumerate(texts))).collect()}
    told = [(jaccard(shingles(texts[2 * i]), shingles(texts[2 * i + 1])), got[2 * i] == got[2 * i + 1]) for i in range(500)]
    assert not [j for j, met in told if met and j < 0.79]
    for low, high, least in ((0.8, 0.85, 0.85), (0.85, 0.9, 0.93), (0.9, 1.1, 0.99)):
        met = [m for j, m in told if low <= j < high]
        assert len(met) > 30 and np.mean(met) >= least
    assert all(got[i] in (i, i - i % 2) for i in got)


def test_family_of_near_copies_stays_connected(spark, monkeypatch):
    """More copies than are paired directly, and than are looked at at once."""
    monkeypatch.setattr(similar, "SMALL", 8)
    monkeypatch.setattr(similar, "MOST_HELD", 100)
    rng = random.Random(4)
    first = [str(rng.randrange(10**6)) for _ in range(300)]
    rows = [(i, " ".join(changed(rng, first, 3))) for i in range(400)] + [(1000 + i, " ".join(str(rng.randrange(10**6)) for _ in range(50))) for i in range(50)]
    got = {r["id"]: r["component_id"] for r in similar.similar_groups(frame(spark, rows)).collect()}
    assert sum(got[i] == 0 for i in range(400)) >= 396 and all(got[i] == i for i in range(1000, 1050))
    kept = similar.keep_one(frame(spark, rows)).collect()
    assert len(kept) == len(set(got.values()))


def small_batches(spark, request, rows):
    """Sets are only held in parts where they span batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"))


@pytest.mark.parametrize(("small", "most_held"), [(4, 4096), (2, 10)])
def test_no_pair_of_a_set_is_left_out(spark, monkeypatch, request, small, most_held):
    """Families with many pairs near the similarity: components of all pairs that share a key, in sets of any size."""
    monkeypatch.setattr(similar, "SMALL", small)
    monkeypatch.setattr(similar, "MOST_HELD", most_held)
    small_batches(spark, request, 64)
    rng = random.Random(11)
    texts = []
    for _ in range(4):
        first = [str(rng.randrange(10**6)) for _ in range(300)]
        texts += [" ".join(changed(rng, first, rng.randrange(2, 11))) for _ in range(100)]
    data = [t.encode() for t in texts]
    s, ends = similar.shingles(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    sets = np.split(s, ends[:-1])
    keys, check = similar.variants(np.stack([similar.bit_counts(x) for x in sets]), np.array([len(x) for x in sets]))
    meet = {}
    for i, own in enumerate(keys.reshape(len(texts), -1).tolist()):
        for k in own:
            meet.setdefault(k, []).append(i)
    assert max(map(len, meet.values())) > 3 * most_held or most_held > len(texts)
    hashed = [set((x >> np.uint64(32)).tolist()) for x in sets]
    root = list(range(len(texts)))
    for a, b in sorted({(a, b) for m in meet.values() for a, b in combinations(m, 2)}):
        if int(check[a] ^ check[b]).bit_count() <= similar.CHECK and jaccard(hashed[a], hashed[b]) >= 0.8 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    got = {r["id"]: r["component_id"] for r in similar.similar_groups(frame(spark, enumerate(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_few_rows_are_made_of_a_family(spark, request):
    """Members meet their set's lead, not each other, in all of its parts."""
    small_batches(spark, request, 400)
    rng = random.Random(12)
    fps, check = np.arange(3000), rng.randrange(1 << 62)
    rows = [(7, int(i), check ^ (1 << rng.randrange(60)), 0) for i in fps]
    met = spark.createDataFrame(rows, "key long, fp long, check long, flipped long").coalesce(1).sortWithinPartitions("key", "fp").mapInArrow(similar._met(500), similar.MET_DDL)
    assert sum(len(r["fps"]) for r in met.collect()) == 3000 and met.select("key", "lead").distinct().count() == 1 and met.count() > 3
    assert met.mapInArrow(similar._first_pairs(4), "a long, b long").distinct().count() == 2999


def test_hostile_rows(spark):
    long = " ".join(str(i % 9973) for i in range(120_000))
    rows = [(1, None), (2, ""), (3, "  "), (4, "one two"), (5, "ONE  two"), (6, long), (7, long + " end"), (None, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (10, "A B C D E F")]
    got = [(r["id"], r["component_id"]) for r in similar.similar_groups(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (None, 9), (None, 9), (9, 9), (9, 9), (10, 9)], key=repr)
    kept = similar.keep_one(frame(spark, rows))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 9]
    assert similar.similar_groups(frame(spark, [])).count() == 0 and similar.keep_one(frame(spark, [])).count() == 0


def test_shingles_and_counts_like_plain():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("aAbBcC") for _ in range(rng.randrange(30))) for _ in range(60)]
    data = [t.encode() for t in texts]
    s, ends = similar.shingles(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert np.diff(np.r_[0, ends]).tolist() == [len(shingles(t)) for t in texts]
    seen = {}
    for i, t in enumerate(texts):
        own = s[(ends[i - 1] if i else 0) : ends[i]].tolist()
        for j, u in enumerate(texts[:i]):
            other = seen[j]
            assert len(set(own) & other) == len(shingles(t) & shingles(u))
        seen[i] = set(own)
    keys, check = similar.variants(np.stack([similar.bit_counts(s[:50])]), np.array([50]))
    assert keys.shape == (1, similar.PIECES, 22) and len(np.unique(keys)) == keys.size
    base = keys[0, :, 0] & np.uint64(0xFFFFFFFF)
    assert (np.bitwise_count((keys[0] & np.uint64(0xFFFFFFFF)) ^ base[:, None]) <= similar.FLIPS).all()
    assert int(check[0]) == int(base[0]) | int(base[1]) << 32
