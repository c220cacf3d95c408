"""Removal of repeated word windows against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from partyloom.llm import queries, window_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, uid int, g int, v int, kind int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def save(spark, path, rows, parts=6):
    spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1, 2, 3, 4) for i, t in rows], DOCS).repartition(parts).write.parquet(f"{path}/documents.parquet")
    return str(path)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(rows, length):
    """With non-null ids, or at most one null id."""
    order = lambda i: (i is None, i or 0)
    least = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            least[key] = min(least.get(key, order(i)), order(i))
    for i, t in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - length + 1):
            if least[tuple(w[k : k + length])] < order(i):
                gone |= set(range(k, k + length))
        yield (i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def corpus(seed=1, n=80):
    """Texts over few words (many chance repeats), shared passages in different surroundings, gaps of several bytes."""
    rng = random.Random(seed)
    words = ["a", "b", "Dé", "漢字", "x\x1c", "\x00", "\x00\x00"]
    passages = [[rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(5, 60))] for _ in range(8)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(30))]
        texts.append("".join(x + rng.choice([" ", " ", " ", "\n", " \t", "\r\n"]) for x in w))
    texts += [None, "", "   ", "one", "la " * 5000, texts[4], texts[4], "Z" + (texts[4] or "z")]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, texts[2]), (rows[9][0], texts[10]), (rows[9][0], "la " * 40)]


@pytest.mark.parametrize("length", [2, 5, 13, 14])
def test_like_brute_force(spark, tmp_path, length):
    docs = spark.read.parquet(save(spark, tmp_path, corpus()) + "/documents.parquet")
    got = window_dedup.remove_repeats(docs, length=length).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).hex()) for r in got) == Counter(plain(corpus(), length))


def test_small_tasks_pieces_and_words_hashed_alone(spark, tmp_path, monkeypatch):
    for name, value in (("TASK_ROWS", 20), ("PIECE_WORDS", 50), ("BLOCK_BYTES", 64), ("LONG_WORD", 3)):
        monkeypatch.setattr(window_dedup, name, value)
    monkeypatch.setattr(window_dedup, "row_chunks", lambda o: [(i, i + 1) for i in range(len(o) - 1)])
    got = queries.op13_window_dedup(spark, save(spark, tmp_path, corpus(2))).collect()
    assert Counter(map(tuple, got)) == Counter(plain(corpus(2), 13))


def test_hot_passage_and_hot_line(spark, tmp_path):
    """A third of all documents share a passage, another third a short line in different surroundings."""
    rng = random.Random(3)
    some = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    passage, line = some(40), some(9)
    rows = [(i, f"{some(20)} {passage if i % 3 == 0 else line if i % 3 == 1 else ''} {some(20)}") for i in range(1500)]
    got = queries.op13_window_dedup(spark, save(spark, tmp_path, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(plain(rows, 13))
    assert 499 * 40 <= sum(r["n_removed"] for r in got) < 500 * 41


def test_null_ids_are_ordered_by_text(spark, tmp_path):
    text = " ".join(map(str, range(30)))
    got = queries.op13_window_dedup(spark, save(spark, tmp_path, [(None, text), (None, text + " end"), (None, text), (None, None)])).collect()
    assert sorted(r["n_removed"] for r in got) in ([0, 0, 0, 30], [0, 0, 30, 30])
    assert queries.op13_window_dedup(spark, save(spark, tmp_path / "none", [])).count() == 0


def test_a_task_sends_one_row_of_equal_ones():
    g, v, uid = np.repeat([7, 8], [1000, 3]), np.repeat([1, 2], [1000, 3]), np.r_[np.arange(1000), [5, 5, 5]]
    out = window_dedup.settle(g, v, uid, True)
    asked = out[3] == window_dedup.ASK
    assert sorted(zip(out[0][asked].tolist(), out[2][asked].tolist(), strict=True)) == [(7, 0), (8, 5)]
    assert int((out[3] == window_dedup.REPEAT).sum()) == 999 and len(set(out[0][~asked].tolist())) == 999


def test_longest_doubles_until_nothing_survives(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: str(rng.randrange(10**9))
    pieces = {n: [word() for _ in range(n)] for n in (12, 13, 25, 26, 60, 104, 500)}
    texts = []
    for i, (n, p) in enumerate(pieces.items()):
        texts += [(2 * i, " ".join([word(), *p, word()])), (2 * i + 1, " ".join([word(), word(), *p]))]
    docs = spark.read.parquet(save(spark, tmp_path, texts) + "/documents.parquet")
    got = {r["doc_id"]: r["longest"] for r in window_dedup.longest(docs).collect()}
    seen = defaultdict(set)
    for i, t in texts:
        w = t.split()
        for k in range(7):
            for a in range(len(w) - 13 * 2**k + 1):
                seen[13 * 2**k, " ".join(w[a : a + 13 * 2**k])].add(i)
    want = {}
    for (n, _), who in seen.items():
        for i in who if len(who) > 1 else ():
            want[i] = max(n, want.get(i, 0))
    assert got == want and set(got.values()) == {13, 26, 52, 104, 416}
