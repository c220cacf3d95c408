"""Texts of many tiles, and rows that are equal in everything."""

import random

import numpy as np

from partyloom.llm import langid, mixing


def test_language_of_a_long_text_is_summed_in_tiles(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(w) for _ in range(80)).encode() for w in (["the", "and", "with"], ["der", "und", "mit"]) for _ in range(15)]
    whole = langid.train(texts, ["en"] * 15 + ["de"] * 15)
    long = np.frombuffer(b" und ".join(texts), np.uint8)
    at = np.array([0, len(long)])
    best, p = whole.predict(long, at)
    for tile in (1, 5, 64, 1000):
        monkeypatch.setattr(langid, "TILE", tile)
        again, q = whole.predict(long, at)
        assert again.tolist() == best.tolist() and abs(p[0] - q[0]) < 1e-9
        assert sorted(np.concatenate(list(langid.tiled(long))).tolist()) == sorted(np.concatenate(langid.grams(long)).tolist())
        assert langid.has_letter(long, at).all() and not langid.has_letter(np.frombuffer(b"1 2 " * 50, np.uint8), np.array([0, 200])).any()
    part = langid.train(texts, ["en"] * 15 + ["de"] * 15)
    assert np.allclose(part.table, whole.table)


def test_mixing_deals_equal_rows_over_the_leaves(spark, monkeypatch):
    """Half of all rows are one row, null id and all: they go to many leaves, and words come near the target."""
    monkeypatch.setattr(mixing, "LEAF_ROWS", 50)
    held = []
    dealer = mixing._dealer

    def spy(order, seed, level, last):
        deal = dealer(order, seed, level, last)

        def run(rows):
            assert len(rows) <= 400
            return deal(rows)

        held.append(level)
        return run

    monkeypatch.setattr(mixing, "_dealer", spy)
    rows = [(None, "same words here", "a")] * 1000 + [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix(df).collect()
    assert len(out) == 2000 and held
    for size, target in {(r["source_size"], r["target"]) for r in out}:
        assert abs(sum(r["taken"] for r in out if (r["source_size"], r["target"]) == (size, target)) - target) <= 7
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
