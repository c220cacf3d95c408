"""Substring dedup against brute force, on its main way and on that of hot anchors."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle as pickle

from partyloom.llm import substring_dedup as sub


def corpus():
    rng = random.Random(1)
    noise = lambda n, letters="abcdefgh é\0": "".join(rng.choice(letters) for _ in range(n))
    shared = [noise(n) for n in (150, 185, 199, 200, 201, 260, 500)]
    texts = [None, "", "x" * 199, "x" * 200, "x" * 201, "y" * 1000, "word " * 200, "ab" * 150, "\0" * 300]
    for _ in range(40):
        texts.append("".join(rng.choice([noise(rng.randrange(120)), rng.choice(shared), rng.choice(shared)[rng.randrange(50) :]]) for _ in range(rng.randrange(1, 7))))
    core = noise(190)  # one passage in many surroundings
    texts += [noise(rng.choice([3, 40]), "ab") + core + noise(rng.choice([3, 40]), "ab") for _ in range(50)]
    return [*texts, texts[9], texts[10], texts[10] + "z", noise(20000) + shared[5]]


def brute(texts):
    data = [(t or "").encode() for t in texts]
    starts = collections.Counter(b[p : p + sub.MATCH] for b in data for p in range(len(b) - sub.MATCH + 1))
    for i, b in enumerate(data):
        hit = bytearray(len(b))
        for p in range(len(b) - sub.MATCH + 1):
            if starts[b[p : p + sub.MATCH]] > 1:
                hit[p : p + sub.MATCH] = b"\1" * sub.MATCH
        runs = sum(1 for j in range(len(b)) if hit[j] and (j == 0 or not hit[j - 1]))
        yield i, len(b), sum(hit), runs, hashlib.sha256(bytes(x for x, h in zip(b, hit, strict=True) if not h)).hexdigest()


@pytest.mark.parametrize("hot", [20_000, 3])
def test_removes_what_brute_force_removes(spark, hot):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n string, k1 int, first int").repartition(5)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).hex()) for r in sub.remove_repeats(df, hot=hot).collect())
    assert got == list(brute(texts))
    assert sub.remove_repeats(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = "".join(random.Random(2).choice("abcd ") for _ in range(300))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (8, "short"), (8, "short")], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_removed"], r["n_spans"]) for r in sub.remove_repeats(df).collect())
    assert got == {(None, 300, 1): 1, (7, 300, 1): 2, (8, 0, 0): 2}


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    flat = np.concatenate([rng.integers(97, 101, 6000), np.tile([97, 98, 99], 900), rng.integers(97, 101, 2000)]).astype(np.uint8)
    at = np.array([0, len(flat)])
    whole = sub.anchors(flat, at)
    monkeypatch.setattr(sub, "PIECE", 900)
    parts = list(sub.text_anchors(flat, at))
    assert len(parts) > 5
    for k in range(4):
        assert np.array_equal(np.concatenate([p[k + 1] for p in parts]), whole[k])


def test_interval_tree():
    assert sorted(sub.intervals([3, 3, 1, 5])) == [(0, 3, 3), (0, 5, 1), (3, 5, 5)]
    assert sub.intervals([]) == [] and sub.intervals([0]) == [(0, 2, 0)]


def test_repeats_across_pieces_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(sub, "PIECE", 900)
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    one, two, three = noise(260), noise(230), noise(200)
    texts = [noise(3000) + one + noise(3000) + one + noise(2500) + one + noise(100), noise(40) + two + noise(5000) + two, three + noise(2700) + three, noise(7000), two[:199] + noise(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    pickle.register_pickle_by_value(sub)  # workers take PIECE along
    try:
        got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).hex()) for r in sub.remove_repeats(df).collect())
    finally:
        pickle.unregister_pickle_by_value(sub)
    assert got == list(brute(texts))
    assert [r[3] for r in got[:4]] == [3, 2, 2, 0]


def test_marks_of_anchors_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    one = noise(300)
    texts = ["short", noise(3000) + one + noise(3000) + one, noise(500), "ab" * 2500, noise(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array([10, 20, 30, 40, 50]), pa.array([1, 2, 3, 4, 5]), pa.array(texts)], ["k1", "k2", "text"])
    marks = lambda: sorted(r for b in sub._anchor_keys(iter([batch, batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    whole = marks()
    assert any(k == 21 for _, k in whole)
    monkeypatch.setattr(sub, "PIECE", 900)
    assert marks() == whole
