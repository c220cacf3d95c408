"""The batch kernels against the scalar ones: equal, not just close."""

import random

import numpy as np
import pyarrow as pa
import pytest

from partyloom.functions import batch_similarity as batch
from partyloom.functions import similarity as sim
from partyloom.functions.text import WEAK_NAMES

CONFUSABLE = frozenset({"0O", "O0", "1I", "I1", "VW", "WV"})
STEMS = "MOHAMMED MUHAMMAD KHALED SCHMIDT SHMIT PHILIP FILIP WRIGHT KNIGHT GAZPROM GASPROM 000000123 000000132 O0O0 1I1I PLATE PLAET X Q AL ALI ÅNGSTRÖM ПУТИН ПУТЫН 東京 HHHH WWW".split()


def words(rng, n):
    out = []
    for _ in range(n):
        w = list(rng.choice(STEMS))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "A", "E", "H", "0", "O", "W", "É"])
        out.append("".join(w) or "Z")
    return out + ["A" * 40, "AB" * 40, "LONGERWORD" * 9]


@pytest.mark.parametrize("confusable", [frozenset(), CONFUSABLE])
def test_token_sims(confusable):
    rng = random.Random(4)
    a, b = sorted(set(words(rng, 150))), sorted(set(words(rng, 150)))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
    got = batch.token_sims(batch.Words(a), batch.Words(b), i, j, confusable)
    assert got.tolist() == [sim.token_sim(a[x], b[y], confusable) for x, y in zip(i.tolist(), j.tolist(), strict=True)]


@pytest.mark.parametrize("kernel, scalar", [(batch._jaro_winkler, sim.jaro_winkler), (batch._dice, sim.dice), (batch._jaccard3, sim.jaccard3), (batch._edit_sim(CONFUSABLE), lambda a, b: sim.edit_sim(a, b, CONFUSABLE))])
def test_kernels_of_unequal_strings(kernel, scalar):
    rng = random.Random(9)
    a, b = words(rng, 400), words(rng, 400)
    pairs = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    x, y = batch.Words([p[0] for p in pairs]), batch.Words([p[1] for p in pairs])
    at = np.arange(len(pairs))
    assert batch.over(kernel, x, y, at, at).tolist() == [scalar(*p) for p in pairs]


@pytest.mark.parametrize("least", [0.0, 0.86, 0.95])
@pytest.mark.parametrize("confusable", [frozenset(), CONFUSABLE])
def test_name_scores(least, confusable):
    rng = random.Random(int(least * 100))
    vocabulary = words(rng, 60) + list(WEAK_NAMES)[:5]
    some = lambda most: [rng.choice(vocabulary) for _ in range(rng.randrange(most))]
    rows = []
    for _ in range(1500):
        q = some(5)
        c = rng.choice([some(6), list(q), q[::-1], [*q, "CO"], [w + "A" for w in q]])
        rows.append((q, c, [1 + rng.random() * 5 for _ in q], rng.random() < 0.2))
    rows += [(["CML"], ["CASPIAN", "MARITIME", "LOGISTICS"], [1.0], False), (["CM"], ["CASPIAN", "MARITIME", "LOGISTICS"], [1.0], False), (["A"] * 70, ["A"] * 69, [1.0] * 70, False)]
    q, c, w, low = (pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.bool_()), strict=True))
    got = batch.name_scores(q, c, w, low, confusable, least)
    want = [sim.name_score(*r, confusable, least) for r in rows]
    hit = np.array(want) >= least
    assert got[hit].tolist() == np.array(want)[hit].tolist()
    assert (got[~hit] < least).all()
    assert batch.name_scores(q.slice(7, 40), c.slice(7, 40), w.slice(7, 40), low.slice(7, 40), confusable, least).tolist() == got[7:47].tolist()
    assert len(batch.name_scores(q.slice(0, 0), c.slice(0, 0), w.slice(0, 0), low.slice(0, 0))) == 0


@pytest.mark.parametrize("least", [0.64, 0.72, 0.9, 0.93])
@pytest.mark.parametrize("confusable", [frozenset(), CONFUSABLE])
def test_word_table_leaves_no_pair_out(least, confusable):
    rng = random.Random(11)
    letters = "ABEHINOSTW01É"
    asked = sorted({*words(rng, 120), *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(150)), "AAAA", "AAAAAAA"})
    other = sorted({*words(rng, 120), *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(150)), "AAAAA"})
    i, j, score = batch.WordTable(asked, confusable).alike(other, least)
    got = {(asked[a], other[b]): s for a, b, s in zip(i.tolist(), j.tolist(), score.tolist(), strict=True)}
    want = {(a, b): s for a in asked for b in other if (s := sim.token_sim(a, b, confusable)) >= least - 1e-9}
    assert got == want and len(got) < len(asked) * len(other) / 4


@pytest.mark.parametrize("confusable", [frozenset(), CONFUSABLE])
def test_explanations(confusable):
    rng = random.Random(21)
    vocabulary = words(rng, 60)
    some = lambda most: [rng.choice(vocabulary) for _ in range(rng.randrange(most))]
    rows = [(q, rng.choice([some(6), list(q), [w + "A" for w in q], [q[0] + "H", *some(2)] if q else []])) for q in (some(5) for _ in range(600))] + [(None, None), ([], ["X"]), (["X"], [])]
    q, c = (pa.array(x, pa.list_(pa.string())) for x in zip(*rows, strict=True))
    want = [None if a is None else sim.explain(a, b, confusable) for a, b in rows]
    assert batch.explanations(q, c, confusable) == want and batch.explanations(q.slice(5, 30), c.slice(5, 30), confusable) == want[5:35]
    assert batch.explanations(q.slice(0, 0), c.slice(0, 0)) == []


@pytest.mark.parametrize("least", [0.0, 0.7, 0.86, 0.95])
@pytest.mark.parametrize("confusable", [frozenset(), CONFUSABLE])
def test_scan_leaves_no_pair_out(least, confusable, monkeypatch):
    rng = random.Random(17)
    monkeypatch.setattr(batch, "SCAN_CELLS", 3000)
    monkeypatch.setattr(batch, "SCAN_ROWS", 500)
    vocabulary = words(rng, 40) + list(WEAK_NAMES)[:5]
    some = lambda most: [rng.choice(vocabulary) for _ in range(rng.randrange(most))]
    names = [some(5) for _ in range(90)] + [["CASPIAN", "MARITIME", "LOGISTICS"], [], ["A"] * 69, ["ÉÉ", "中国"]]
    asked = [some(4) for _ in range(50)] + [rng.choice(names)[::-1] for _ in range(20)] + [["CML"], ["CM"], ["A"] * 70, ["ÉÉ", "中"], ["CASPIAN", "MARITIMES"], []]
    weights, low = [[1 + rng.random() * 5 for _ in q] for q in asked], [rng.random() < 0.2 for _ in names]
    kinds = (pa.list_(pa.string()), pa.list_(pa.float64()))
    table = batch.Asked(pa.table({"qid": pa.array(range(len(asked))), "q_tokens": pa.array(asked, kinds[0]), "weights": pa.array(weights, kinds[1])}), least, confusable)
    want = {(i, j): s for i, q in enumerate(asked) for j, c in enumerate(names) if c and (s := sim.name_score(q, c, weights[i], low[j], confusable, least)) >= least - 1e-9}
    for by_word in (False, True) if least >= 0.82 else (False,):
        found = list(table.scored(pa.array(names, kinds[0]), pa.array(low), by_word))
        got = {(i, j): s for part in found for i, j, s in zip(*(x.tolist() for x in part), strict=True)}
        assert got == want and len(want) > 10 and sum(len(i) for i, _, _ in found) == len(got)


def test_few_pairs_are_scored(monkeypatch):
    """Customers and suppliers are told apart, and all words of queries looked at, before any pair is scored."""
    asked = [["SUPPLIEER", f"{k:09}"] for k in range(60)] + [["RED", "PLATEE"]]
    names = [["CUSTOMER", f"{k:09}"] for k in range(300)] + [["SUPPLIER", f"{k:09}"] for k in range(20)] + [["RED", "PLATE"]]
    rows = []
    monkeypatch.setattr(batch, "_scores", lambda q, *rest, whole=batch._scores: rows.append(len(q[0])) or whole(q, *rest))
    table = batch.Asked(pa.table({"qid": range(61), "q_tokens": asked, "weights": [[1.0, 1.0]] * 61}), 0.95)
    hits = [p for i, j, _ in table.scored(pa.array(names), pa.array([False] * 321), False) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert sum(rows) <= 60 * 20 + 1 and (60, 320) in hits and all((k, 300 + k) in hits for k in range(20))
