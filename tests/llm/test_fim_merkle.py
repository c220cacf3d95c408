"""Fill-in-middle and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from partyloom.llm import fim, merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, form int, leaf int, tree int, pos int"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(n=300):
    rng = random.Random(5)
    words = ["alpha", "Beta", "dé", "漢字", "<", "P>", "<M", "x\x1c", " ", "𝒳"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t\r", ""]) for _ in range(rng.randrange(40))) for _ in range(n)]
    texts += [None, "", " \n ", "A", "has <P> inside", "<S>", "word " * 50000, texts[3], texts[3]]
    rows = [(None if i == 7 else i, t, rng.choice(["en", "fr", None, "é"]), rng.choice(["s1", None]), i if i % 5 else None) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], rows[7], (None, texts[9], None, "s1", 1)]


def save(spark, path, rows):
    spark.createDataFrame([(*r, "clash", 1, 2, 3, 4, 5) for r in rows], DOCS).repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path)


def plain_fim(doc_id, text):
    x = text or ""
    units = [m.group() for m in UNIT.finditer(x)]
    d = sha("42:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not x or any(s in x for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(x), sha(x))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return (doc_id, n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(x))


def test_fim_like_plain(spark, tmp_path):
    got = queries.op11_fim(spark, save(spark, tmp_path / "some", corpus())).collect()
    assert Counter(map(tuple, got)) == Counter(plain_fim(i, t) for i, t, *_ in corpus())
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert queries.op11_fim(spark, save(spark, tmp_path / "none", [])).count() == 0


def test_fim_outputs_and_restored_texts(spark, tmp_path):
    docs = spark.read.parquet(save(spark, tmp_path, corpus()) + "/documents.parquet")
    made = fim.transform(docs, rate=100, spm_rate=50)
    assert {"source", "lang", "leaf"} <= set(made.columns) and "text" not in made.columns
    back = made.withColumn("text", fim.restore(F.col("output"), F.col("form"))).select("doc_id", "text")
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t, *_ in corpus())


def test_fim_matcher_keeps_no_units():
    data = b"ab " * 400_000
    tracemalloc.start()
    assert fim.count_units(data, 0, len(data)) == 400_001
    assert fim.cuts(data, 0, len(data), 100_000, 400_001) == (299_999, len(data))
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


def plain_tree(leaves):
    """(root, [proof of each leaf as [(place, run)]])."""
    level, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for i, p in enumerate(proofs):
            p.append((at[i] % 8, runs[at[i] // 8]))
            at[i] //= 8
        level = [sha("".join(r)) for r in runs]
    return level[0], proofs


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513, 577, 1025, 4095, 4096])
@pytest.mark.parametrize("step", [1, 2, 3])
def test_traversal_like_plain_tree(n, step):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    root, proofs = plain_tree([d.hex() for d in leaves])
    height = merkle.depth(n)
    assert merkle.block_root(leaves, height).hex() == root
    paths = list(merkle.traverse(leaves, height, step))
    assert len(paths) == n
    for d, (siblings, shape), want in zip(leaves, paths, proofs, strict=True):
        assert siblings.hex() == "".join("".join(r[:k] + r[k + 1 :]) for k, r in want)
        assert list(shape) == [x for k, r in want for x in (k, len(r))]
        assert merkle.fold(d, siblings, shape).hex() == root
    assert n == 1 or merkle.fold(b"x" * 32, *paths[0]).hex() != root


def plain_manifest(rows):
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    trees = defaultdict(list)
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, lower(r[1]) if changed else r[1]), r[0]))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    subs = {t: plain_tree([x[2] for x in sorted(trees[t])]) for t in order}
    root, tops = plain_tree([subs[t][0] for t in order])
    for k, t in enumerate(order):
        for x, low in zip(sorted(trees[t]), subs[t][1], strict=True):
            path, now = [*low, *tops[k]], x[3]
            for place, run in path:
                now = sha("".join([*run[:place], now, *run[place + 1 :]]))
            yield (x[4], x[2], subs[t][0], root, sha("".join("".join(r[:p] + r[p + 1 :]) for p, r in path)), now, now == root)


def test_manifest_like_plain(spark, tmp_path):
    got = queries.op12_merkle(spark, save(spark, tmp_path / "some", corpus())).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(corpus()))
    assert {r["verified"] for r in got} == {True, False}
    one = [(5, "Abc", None, None, 3)]
    assert [tuple(r) for r in queries.op12_merkle(spark, save(spark, tmp_path / "one", one)).collect()] == list(plain_manifest(one))
    assert queries.op12_merkle(spark, save(spark, tmp_path / "none", [])).count() == 0


def test_manifest_of_several_blocks(spark, tmp_path, monkeypatch):
    """Blocks of 64 leaves: one tree of four storeys of blocks, one of a single leaf, many repeated ids."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    rows = [(i // 2 * 3, f"Text {i}", "en", None, i) for i in range(4500)] + [(1, "one", "de", "s", 0)] + [(i, "t", f"x{i:02}", "s", 0) for i in range(9)]
    got = queries.op12_merkle(spark, save(spark, tmp_path, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))


def test_manifest_of_more_offsets_than_are_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_STARTS", 0)
    got = queries.op12_merkle(spark, save(spark, tmp_path, corpus())).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(corpus()))
