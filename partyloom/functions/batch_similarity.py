"""The similarity kernels over whole Arrow batches, in numpy.

A batch of name pairs is turned into a table of its distinct (query word, name word) pairs; each
kernel runs once over that table, whatever the number of rows, and the greedy assignment of words
reads from it.  Strings are matrices of code points, padded; pairs go by length class, so padding at
most doubles the work.  Results equal those of the scalar functions bit by bit: the same
operations in the same order.  Words hold no NUL, which stands for the end of a string here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from partyloom.functions import similarity as sim
from partyloom.functions import text as names

#: Cells of a comparison of all characters (or grams) of two strings that are held at once.
CELLS = 1 << 22


class Words:
    """Strings as rows of code points (0 where a string has ended)."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.start = np.cumsum(self.size) - self.size

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        where = self.start[at][:, None] + np.arange(width)
        inside = np.arange(width) < self.size[at][:, None]
        flat = self.flat if len(self.flat) else np.zeros(1, np.uint32)
        return np.where(inside, flat[np.minimum(where, len(flat) - 1)], 0).astype(np.int64)


def _classes(la: np.ndarray, lb: np.ndarray):
    """(indices, greatest length in a, in b) of pairs whose lengths round up to the same powers of two, in slices of bounded work."""
    up = lambda n: 1 << np.maximum(2, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    wa, wb = up(la), up(lb)
    order = np.lexsort((wb, wa))
    edges = np.flatnonzero(np.r_[True, (wa[order][1:] != wa[order][:-1]) | (wb[order][1:] != wb[order][:-1]), True]) if len(order) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        group = order[a:b]
        x, y = int(wa[group[0]]), int(wb[group[0]])
        step = max(64, CELLS // (x * y))
        for lo in range(0, len(group), step):
            some = group[lo : lo + step]
            yield some, max(4, int(la[some].max())), max(4, int(lb[some].max()))


def _paired(a: np.ndarray, b: np.ndarray, lb: np.ndarray, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each character of a takes the first free equal one of b, at most `reach` places away: (taken in a, taken in b).

    Here strings are columns, so a step works on one place of all of them.
    """
    places = np.arange(len(b))
    free = places[:, None] < lb
    met = np.zeros(a.shape, bool)
    far = len(a) + len(b) if reach is None else int(reach.max(initial=0))
    near = far if reach is None else int(reach.min(initial=far))
    for i in range(len(a)):
        left = np.ones(a.shape[1], bool)
        for j in range(max(0, i - far), min(len(b), i + far + 1)):
            fits = b[j] == a[i]
            fits &= free[j]
            fits &= left
            if abs(i - j) > near:
                fits &= reach >= abs(i - j)
            free[j] ^= fits
            left ^= fits
        met[i] = ~left
    return met, ~free & (places[:, None] < lb)


def _taken(x: np.ndarray, met: np.ndarray) -> np.ndarray:
    """The taken characters of each column moved to its beginning, 0 after them."""
    width, n = x.shape
    out = np.zeros((width + 1) * n, x.dtype)
    to = np.where(met, np.cumsum(met, axis=0) - 1, width)
    np.put(out, to * n + np.arange(n), x)
    return out.reshape(width + 1, n)[:width]


def _columns(x: np.ndarray) -> np.ndarray:
    """The rows as columns, in the smallest type."""
    return np.ascontiguousarray(x.astype(np.uint8 if x.max(initial=0) < 256 else np.uint32).T)


def _jaro_winkler(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    x, y = _columns(a), _columns(b)
    in_a, in_b = _paired(x, y, lb, reach)
    m = in_a.sum(axis=0)
    left, right = _taken(x, in_a), _taken(y, in_b)
    w = min(len(left), len(right))
    half = (left[:w] != right[:w]).sum(axis=0) / 2
    some = np.maximum(m, 1)
    j = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - half) / some) / 3, 0.0)
    same = (x[:4] == y[:4]) & (x[:4] != 0)
    prefix = np.cumprod(same, axis=0).sum(axis=0)
    out = j + prefix * 0.1 * (1 - j)
    w = min(len(x), len(y))
    equal = (la == lb) & (x[:w] == y[:w]).all(axis=0)
    return np.where(equal, 1.0, out)


def _dice(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    two = lambda x: np.where(x[:, 1:] != 0, (x[:, :-1] << 21) | x[:, 1:], 0)
    x, y = (np.ascontiguousarray(two(w).T) for w in (a, b))
    met, _ = _paired(x, y, np.maximum(lb - 1, 0), None)
    return np.where((la < 2) | (lb < 2), 0.0, 2 * (met & (x != 0)).sum(axis=0) / np.maximum(la + lb - 2, 1))


def _trigrams(x: np.ndarray, size: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams, which of them are the first of their kind) with `pad` spaces on either side; strings are columns of them."""
    n, width = x.shape
    full = np.zeros((n, width + 2 * pad), np.int64)
    full[:, :pad] = 0x20
    full[:, pad : pad + width] = x
    if pad:
        np.put_along_axis(full, size[:, None] + pad + np.arange(pad), 0x20, axis=1)
    g = np.ascontiguousarray(((full[:, :-2] << 42) | (full[:, 1:-1] << 21) | full[:, 2:]).T)
    live = np.arange(len(g))[:, None] < size + 2 * pad - 2
    g[~live] = -1
    fresh = live.copy()
    for k in range(1, len(g)):
        for m in range(k):
            fresh[k] &= g[m] != g[k]
    return g, fresh


def _found(x: np.ndarray, new: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the new trigrams x are in y; strings are columns."""
    out = np.zeros(x.shape, bool)
    for k in range(len(x)):
        for m in range(len(y)):
            out[k] |= x[k] == y[m]
    return out & new


def _jaccard3(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    x, new_x = _trigrams(a, la, 2)
    y, new_y = _trigrams(b, lb, 2)
    both = _found(x, new_x, y).sum(axis=0)
    return np.where((la < 2) | (lb < 2), 0.0, both / (new_x.sum(axis=0) + new_y.sum(axis=0) - both))


def _shares_gram(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    if a.shape[1] < 3 or b.shape[1] < 3:
        return np.zeros(len(a), bool)
    x, new_x = _trigrams(a, la, 0)
    y, _ = _trigrams(b, lb, 0)
    return _found(x, new_x, y).any(axis=0)


def _edit_sim(confusable: frozenset) -> Callable:
    """1 - OSA distance / longer length; all pairs of a class move through the table of distances together."""
    alike = np.array(sorted((ord(p[0]) << 21) | ord(p[1]) for p in confusable if len(p) == 2), np.int64)

    def run(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
        n, wa, wb = len(a), a.shape[1], b.shape[1]
        older, old = None, np.repeat(np.arange(wb + 1, dtype=float)[:, None], n, axis=1)
        out = old[lb, np.arange(n)].copy()  # where a is empty
        for i in range(1, wa + 1):
            if not (la >= i).any():
                break
            row = np.empty((wb + 1, n))
            row[0] = i
            x = a[:, i - 1]
            for j in range(1, wb + 1):
                y = b[:, j - 1]
                swap = (x != y).astype(float)
                if len(alike):
                    swap[(x != y) & np.isin((x << 21) | y, alike)] = sim.CONFUSABLE_COST
                best = np.minimum(np.minimum(old[j] + 1, row[j - 1] + 1), old[j - 1] + swap)
                if i > 1 and j > 1:
                    crossed = (x == b[:, j - 2]) & (a[:, i - 2] == y)
                    best = np.where(crossed, np.minimum(best, older[j - 2] + 1), best)
                row[j] = best
            done = la == i
            out[done] = row[lb[done], np.flatnonzero(done)]
            older, old = old, row
        most = np.maximum(la, lb)
        return np.where(most > 0, 1 - out / np.maximum(most, 1), 1.0)

    return run


def over(kernel: Callable, x: Words, y: Words, at_x: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """A kernel over the pairs (x[at_x[k]], y[at_y[k]])."""
    out = None
    for some, wa, wb in _classes(x.size[at_x], y.size[at_y]):
        i, j = at_x[some], at_y[some]
        found = kernel(x.rows(i, wa), y.rows(j, wb), x.size[i], y.size[j])
        if out is None:
            out = np.zeros(len(at_x), found.dtype)
        out[some] = found
    return np.zeros(len(at_x)) if out is None else out


def raised(top: np.ndarray, kernel: Callable, x: Words, y: Words, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The greater one of `top` and the kernel over the pairs, which is `most` at most: it runs only where that is more."""
    able = np.flatnonzero(most > top - 1e-9)
    out = top.copy()
    out[able] = np.maximum(top[able], over(kernel, x, y, i[able], j[able]))
    return out


def token_sims(x: Words, y: Words, i: np.ndarray, j: np.ndarray, confusable: frozenset = frozenset()) -> np.ndarray:
    """sim.token_sim of the pairs (x[i[k]], y[j[k]])."""
    same_as = {s: k for k, s in enumerate(x.strings)}
    twin = np.array([same_as.get(s, -1) for s in y.strings], np.int64)
    first = lambda w: w.rows(np.arange(len(w.strings)), 1)[:, 0]
    la, lb = x.size[i], y.size[j]
    out = np.full(len(i), -1.0)
    out[((la == 1) | (lb == 1)) & (first(x)[i] == first(y)[j])] = sim.INITIAL
    out[(la == 0) & (lb == 1) | (la == 1) & (lb == 0)] = -1.0
    out[twin[j] == i] = 1.0
    left = np.flatnonzero(out < 0)
    if not len(left):
        return out
    i, j = i[left], j[left]
    jw = over(_jaro_winkler, x, y, i, j)
    la, lb = x.size[i], y.size[j]
    sx, sy = Signatures(x), Signatures(y)
    common = _common(sx, sy, i, j)
    best = raised(jw, _dice, x, y, i, j, 2 * common / np.maximum(la + lb - 2, 1))
    deep = np.flatnonzero(jw >= sim.CHEAP_BELOW)
    if len(deep):
        a, b, j_w, common = i[deep], j[deep], jw[deep], common[deep]
        la, lb = x.size[a], y.size[b]
        top = raised(best[deep], _jaccard3, x, y, a, b, (common + 2) / np.maximum(np.maximum(sx.trigrams[a], sy.trigrams[b]), 1))
        longer = np.maximum(la, lb)
        # each edit, or half edit between look-alikes, costs the longer word one common character at most
        top = raised(top, _edit_sim(confusable), x, y, a, b, 1 - np.maximum(np.abs(la - lb), (longer - common) * (sim.CONFUSABLE_COST if confusable else 1)) / longer)
        keys = {}
        number = lambda w: np.array([keys.setdefault(sim._key(s), len(keys) + 1) if sim._key(s) else 0 for s in w.strings], np.int64)
        kx, ky = number(x), number(y)
        sounds = (j_w >= sim.PHONETIC_FROM) & (la >= 4) & (lb >= 4) & (kx[a] > 0) & (kx[a] == ky[b])
        top[sounds] = np.maximum(top[sounds], sim.PHONETIC)
        near = np.flatnonzero(j_w >= sim.TRANSLIT_FROM)
        if len(near):
            fx, fy = Words([sim._fold(s) for s in x.strings]), Words([sim._fold(s) for s in y.strings])
            near = near[(fx.size[a[near]] >= 3) & (fy.size[b[near]] >= 3)]
            near = near[over(_shares_gram, fx, fy, a[near], b[near]).astype(bool)]
            folded = over(_jaro_winkler, fx, fy, a[near], b[near])
            top[near] = np.maximum(top[near], np.minimum(sim.TRANSLIT, folded))
        best[deep] = top
    out[left] = best
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(start, length, word number of each entry, distinct words) of a list<string> column; null lists are empty."""
    size = np.asarray(pc.fill_null(column.value_lengths(), 0), np.int64)
    coded = column.flatten().dictionary_encode()
    return np.cumsum(size) - size, size, np.asarray(coded.indices, np.int64), coded.dictionary.to_pylist()


def name_scores(q: pa.Array, c: pa.Array, weights: pa.Array, low_quality: pa.Array, confusable: frozenset = frozenset(), least: float = 0.0) -> np.ndarray:
    """sim.name_score of each row; where that is below `least`, that or some lower score."""
    return _scores(_lists(q), _lists(c), _lists_of_numbers(weights)[::2], _flags(low_quality), confusable, least)


def _flags(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column, False)).astype(bool)


def _scores(query: tuple, name: tuple, weight: tuple, low: np.ndarray, confusable: frozenset, least: float, bounded: bool = False) -> np.ndarray:
    """name_scores of rows given by where their lists start; bounded: rows that can't reach `least` by their words are left out already."""
    (q_at, q_n, q_word, q_words), (c_at, c_n, c_word, c_words), (w_at, w) = query, name, weight
    n = len(q_n)
    score = np.zeros(n)
    if not n:
        return score
    x, y = Words(q_words), Words(c_words)
    # whole lists as numbers, to find rows of equal words
    number = {s: k for k, s in enumerate(q_words)}
    for s in c_words:
        number.setdefault(s, len(number))
    to = np.array([number[s] for s in c_words], np.int64)
    size_q, size_c = np.minimum(q_n, sim.MOST_TOKENS), np.minimum(c_n, sim.MOST_TOKENS)
    exact = np.zeros(n, bool)
    for m in np.unique(q_n[(q_n == c_n) & (q_n > 0)]).tolist():
        rows = np.flatnonzero((q_n == m) & (c_n == m))
        exact[rows] = (q_word[q_at[rows][:, None] + np.arange(m)] == to[c_word[c_at[rows][:, None] + np.arange(m)]]).all(axis=1)
    live = (q_n > 0) & (c_n > 0)
    score[live & exact] = 1.0
    open_ = np.flatnonzero(live & ~exact)
    if len(open_):
        score[open_] = _assigned(open_, (q_at, size_q, q_word, x), (c_at, size_c, c_word, y), (w_at, w, q_n), confusable, least, bounded)
    able = np.array([2 <= len(s) <= 6 for s in q_words], bool)
    rows = open_[(q_n[open_] == 1) & (c_n[open_] > 1)]
    for r in rows[able[q_word[q_at[rows]]]].tolist():
        score[r] = max(score[r], sim.acronym_score([q_words[q_word[q_at[r]]]], [c_words[k] for k in c_word[c_at[r] : c_at[r] + c_n[r]].tolist()]))
    single = np.zeros(n, bool)
    single[open_] = q_n[open_] == 1
    weak = np.array([s in names.WEAK_NAMES for s in q_words], bool)
    rows = np.flatnonzero(single)
    capped = rows[weak[q_word[q_at[rows]]]]
    score[capped] = np.minimum(score[capped], sim.WEAK_CAP)
    rows = rows[c_n[rows] > 1]
    score[rows] = np.where(score[rows] >= 0.999, sim.SINGLE_EXACT, score[rows] * sim.SINGLE_DAMP)
    return np.where(low, score * sim.LOW_QUALITY, score)


def _lists_of_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.asarray(pc.fill_null(column.value_lengths(), 0), np.int64)
    return np.cumsum(size) - size, size, np.asarray(column.flatten(), float)


def _assigned(rows: np.ndarray, query: tuple, name: tuple, weight: tuple, confusable: frozenset, least: float, bounded: bool) -> np.ndarray:
    """sim.token_set_score of the rows: the distinct word pairs of the batch are scored once, then assigned greedily row by row."""
    (q_at, q_n, q_word, x), (c_at, c_n, c_word, y), (w_at, w, w_n) = query, name, weight
    out = np.zeros(len(rows))
    shape = q_n[rows] * (sim.MOST_TOKENS + 1) + c_n[rows]
    groups, every = [], []
    for s in np.unique(shape).tolist():
        at = np.flatnonzero(shape == s)
        nq, nc = divmod(s, sim.MOST_TOKENS + 1)
        a = q_word[q_at[rows[at]][:, None] + np.arange(nq)]
        b = c_word[c_at[rows[at]][:, None] + np.arange(nc)]
        pairs = a[:, :, None] * len(y.strings) + b[:, None, :]
        groups.append((at, nq, nc))
        every.append(pairs.ravel())
    if 2 * least - 1 > 0.5 and not bounded:
        groups, every = _within_reach(rows, groups, every, weight, (x, y), confusable, least)
        if not groups:
            return out
    table, where = np.unique(np.concatenate(every), return_inverse=True)
    sims = token_sims(x, y, table // len(y.strings), table % len(y.strings), confusable)[where]
    lo, going, averages = 0, [], []
    for at, nq, nc in groups:
        s = sims[lo : lo + len(at) * nq * nc].reshape(len(at), nq * nc).copy()
        lo += len(at) * nq * nc
        k = rows[at]
        whole = _sums(w, w_at[k], w_n[k])
        total, each = np.zeros(len(at)), np.arange(len(at))
        for _ in range(min(nq, nc)):
            best = s.argmax(axis=1)
            i, j = best // nc, best % nc
            total += w[w_at[k] + i] * s[each, best]
            s3 = s.reshape(len(at), nq, nc)
            s3[each, i, :] = -1.0
            s3[each, :, j] = -1.0
        able = total >= (2 * least - 1 - 1e-9) * whole
        average = np.divide(total, whole, out=np.zeros(len(at)), where=whole != 0)
        going.append(at[able])
        averages.append(average[able])
    at, average = np.concatenate(going), np.concatenate(averages)
    if len(at):
        texts_x, i = _joined(rows[at], q_at, q_n, q_word, x.strings)
        texts_y, j = _joined(rows[at], c_at, c_n, c_word, y.strings)
        out[at] = average
        sx, sy = Signatures(texts_x), Signatures(texts_y)
        most_jw, common = _jaro_winkler_at_most(sx, sy, i, j)
        most_dice = 2 * common / np.maximum(sx.size[i] + sy.size[j] - 2, 1)
        most_jaccard = (common + 2) / np.maximum(np.maximum(sx.trigrams[i], sy.trigrams[j]), 1)
        most = np.maximum(np.maximum(most_jw, most_dice), most_jaccard)
        k = np.flatnonzero((most > average - 1e-9) & (average + most >= 2 * least - 1e-9))  # others stay as they are, or too low
        if len(k):
            at, average, i, j = at[k], average[k], i[k], j[k]
            whole = over(_jaro_winkler, texts_x, texts_y, i, j)
            whole = raised(whole, _dice, texts_x, texts_y, i, j, most_dice[k])
            whole = raised(whole, _jaccard3, texts_x, texts_y, i, j, most_jaccard[k])
            same_as = {s: n for n, s in enumerate(texts_x.strings)}
            whole[np.array([same_as.get(s, -1) for s in texts_y.strings], np.int64)[j] == i] = 1.0
            out[at] = np.maximum(average, 0.5 * average + 0.5 * whole)
    return out


def _joined(rows: np.ndarray, start: np.ndarray, size: np.ndarray, word: np.ndarray, strings: list[str]) -> tuple[Words, np.ndarray]:
    """(distinct joined lists, which of them each row has)."""
    _, first, of = np.unique(start[rows], return_index=True, return_inverse=True)
    number, lists = {}, []
    for r in rows[first].tolist():
        lists.append(number.setdefault("".join([strings[k] for k in word[start[r] : start[r] + size[r]].tolist()]), len(number)))
    return Words(list(number)), np.array(lists, np.int64)[of]


def _sums(w: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of slices, from the left."""
    out = np.zeros(len(start))
    for m in range(int(size.max(initial=0))):
        inside = m < size
        out[inside] += w[start[inside] + m]
    return out


def _within_reach(rows: np.ndarray, groups: list, every: list, weight: tuple, words: tuple, confusable: frozenset, least: float) -> tuple[list, list]:
    """The groups without rows whose average stays too low even if each query word had the name word that can be nearest to it."""
    (w_at, w, w_n), (x, y) = weight, words
    table, where = np.unique(np.concatenate(every), return_inverse=True)
    most = sims_at_most(x.strings, y.strings, table // len(y.strings), table % len(y.strings), bool(confusable))[where]
    lo, kept, pairs = 0, [], []
    for (at, nq, nc), own in zip(groups, every, strict=True):
        best = most[lo : lo + len(own)].reshape(len(at), nq, nc).max(axis=2)
        lo += len(own)
        k = rows[at]
        bound = (w[w_at[k][:, None] + np.arange(nq)] * best).sum(axis=1)
        able = bound >= (2 * least - 1 - 1e-9) * _sums(w, w_at[k], w_n[k]) - 1e-9
        if able.any():
            kept.append((at[able], nq, nc))
            pairs.append(own.reshape(len(at), -1)[able].ravel())
    return kept, pairs


def name_score_column(q, c, weights, low_quality, confusable: frozenset = frozenset(), least: float = 0.0):
    """name_scores as a column."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array, w: pa.Array, low: pa.Array) -> pa.Array:
        return pa.array(name_scores(a, b, w, low, confusable, least))

    return run(q, c, weights, low_quality)


def explanations(q: pa.Array, c: pa.Array, confusable: frozenset = frozenset()) -> list:
    """sim.explain of each row, null where q is; similarities of the batch's distinct word pairs are worked out together."""
    (q_at, q_n, q_word, q_words), (c_at, c_n, c_word, c_words) = _lists(q), _lists(c)
    x, y = Words(q_words), Words(c_words)
    size = q_n * c_n
    row = np.repeat(np.arange(len(q_n)), size)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    i, j = q_word[q_at[row] + inner // np.maximum(c_n[row], 1)], c_word[c_at[row] + inner % np.maximum(c_n[row], 1)]
    table, where = np.unique(i * max(1, len(c_words)) + j, return_inverse=True)
    i, j = table // max(1, len(c_words)), table % max(1, len(c_words))
    sims = token_sims(x, y, i, j, confusable)
    edits = np.zeros(len(table))
    able = np.flatnonzero((sims >= 0.5) & (sims < 1))
    edits[able] = over(_edit_sim(confusable), x, y, i[able], j[able])
    met = dict(zip(zip(i.tolist(), j.tolist(), strict=True), zip(sims.tolist(), edits.tolist(), strict=True), strict=True))
    out = []
    for known, a, m, b, n in zip(q.is_valid().to_pylist(), q_at.tolist(), q_n.tolist(), c_at.tolist(), c_n.tolist(), strict=True):
        mine, left = q_word[a : a + m].tolist(), c_word[b : b + n].tolist()
        out.append(sim.explain([q_words[k] for k in mine], [c_words[k] for k in left], confusable, lambda s, t, mine=mine, left=left: met[mine[s], left[t]]) if known else None)
    return out


# Characters that a mask can hold: each of A-Z three times, each digit three times.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_TIMES = 3
_CODE = np.array([_ALPHABET.find(chr(c)) if chr(c) in _ALPHABET else len(_ALPHABET) for c in range(128)], np.int64)


class Signatures:
    """What bounds the similarity of words from above without comparing them: character masks, lengths, beginnings.

    A character's first three occurrences are bits of a mask; further ones and other characters
    are counted.  So two words have at most popcount(mask & mask) + least(count, count) characters
    in common.
    """

    def __init__(self, words: Words):
        n = len(words.strings)
        row = np.repeat(np.arange(n), words.size)
        kind = np.where(words.flat < 128, _CODE[np.minimum(words.flat, 127)], len(_ALPHABET))
        key = row * (len(_ALPHABET) + 1) + kind
        order = np.argsort(key, kind="stable")
        first = np.r_[True, key[order][1:] != key[order][:-1]] if len(key) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        turn = np.empty(len(key), np.int64)
        turn[order] = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        held = (kind < len(_ALPHABET)) & (turn < _TIMES)
        bit = kind * _TIMES + turn
        self.masks = np.zeros((2, n), np.uint64)
        for half in (0, 1):
            mine = held & (bit // 64 == half)
            np.bitwise_or.at(self.masks[half], row[mine], np.uint64(1) << (bit[mine] % 64).astype(np.uint64))
        self.more = np.bincount(row[~held], minlength=n).astype(np.int64)
        self.size, self.head = words.size, words.rows(np.arange(n), 4)
        at = np.arange(n)
        #: distinct padded trigrams of each word
        self.trigrams = over(lambda a, b, la, lb: _trigrams(a, la, 2)[1].sum(axis=0), words, words, at, at).astype(np.int64)

    def common(self, i: np.ndarray, other: Signatures) -> np.ndarray:
        """(words i, all of other): at least the number of characters in common."""
        out = np.minimum(self.more[i][:, None], other.more[None, :])
        for half in (0, 1):
            out = out + np.bitwise_count(self.masks[half][i][:, None] & other.masks[half][None, :])
        return np.minimum(out, np.minimum(self.size[i][:, None], other.size[None, :]))

    def jaro_winkler(self, i: np.ndarray, other: Signatures, common: np.ndarray) -> np.ndarray:
        """At least the Jaro-Winkler similarity: all common characters meet, in order."""
        la, lb = np.maximum(self.size[i], 1)[:, None], np.maximum(other.size, 1)[None, :]
        j = np.where(common > 0, (common / la + common / lb + 1) / 3, 0.0)
        prefix, going = np.zeros(j.shape), np.ones(j.shape, bool)
        for k in range(4):
            going &= (self.head[i, k][:, None] == other.head[None, :, k]) & (self.head[i, k][:, None] != 0)
            prefix += going
        return j + prefix * 0.1 * (1 - j)


def _common(x: Signatures, y: Signatures, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """At least the number of characters that the words x[i[k]] and y[j[k]] have in common."""
    out = np.minimum(x.more[i], y.more[j])
    for half in (0, 1):
        out = out + np.bitwise_count(x.masks[half][i] & y.masks[half][j])
    return np.minimum(out, np.minimum(x.size[i], y.size[j]))


def _jaro_winkler_at_most(x: Signatures, y: Signatures, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at least the Jaro-Winkler similarity, at least the number of common characters) of the words x[i[k]] and y[j[k]]."""
    la, lb, common = x.size[i], y.size[j], _common(x, y, i, j)
    jw = np.where(common > 0, (common / np.maximum(la, 1) + common / np.maximum(lb, 1) + 1) / 3, 0.0)
    same = (x.head[i] == y.head[j]) & (x.head[i] != 0)
    return jw + np.cumprod(same, axis=1).sum(axis=1) * 0.1 * (1 - jw), common


def sims_at_most(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray, confusable: bool) -> np.ndarray:
    """At least the similarity of the words a[i[k]] and b[j[k]]: the bounds of WordTable.alike as numbers."""
    x, y = Signatures(Words(a)), Signatures(Words(b))
    la, lb = x.size[i], y.size[j]
    jw, common = _jaro_winkler_at_most(x, y, i, j)
    longer = np.maximum(np.maximum(la, lb), 1)
    most = np.maximum(jw, 1 - (longer - common) * (sim.CONFUSABLE_COST if confusable else 1) / longer)
    most = np.maximum(most, 2 * common / np.maximum(la + lb - 2, 1))
    most = np.maximum(most, (common + 2) / np.maximum(np.maximum(x.trigrams[i], y.trigrams[j]), 1))
    most = np.where((la <= 1) | (lb <= 1), 1.0, np.minimum(most, 1.0))
    near = np.flatnonzero((jw >= min(sim.PHONETIC_FROM, sim.TRANSLIT_FROM)) & (most < max(sim.PHONETIC, sim.TRANSLIT)))
    if len(near):
        p, q, some = i[near], j[near], most[near]
        number = {k: n for n, k in enumerate({sim._key(s) for s in (*a, *b)})}
        keys = [np.array([number[sim._key(s)] for s in w], np.int64) for w in (a, b)]
        sounds = (jw[near] >= sim.PHONETIC_FROM) & (keys[0][p] == keys[1][q])
        some[sounds] = np.maximum(some[sounds], sim.PHONETIC)
        folded, _ = _jaro_winkler_at_most(*(Signatures(Words([sim._fold(s) for s in w])) for w in (a, b)), p, q)
        most[near] = np.maximum(some, np.minimum(sim.TRANSLIT, folded))
    return most + 1e-9


class WordTable:
    """Finds the words of a vocabulary that are alike some asked words: a bounded table."""

    def __init__(self, asked: list[str], confusable: frozenset = frozenset()):
        self.asked, self.confusable = asked, confusable
        self.words = Words(asked)
        self.plain = Signatures(self.words)
        self.folds = Signatures(Words([sim._fold(w) for w in asked]))
        self.keys = [sim._key(w) for w in asked]

    def alike(self, other: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asked word, other word, similarity) of all pairs with a similarity of `least` or more, which is over 0.5."""
        words, folds = Words(other), Signatures(Words([sim._fold(w) for w in other]))
        plain = Signatures(words)
        number = {k: n for n, k in enumerate(filter(None, {*self.keys}))}
        mine = np.array([number.get(k, -1) for k in self.keys], np.int64)
        theirs = np.array([number.get(sim._key(w), -2) for w in other], np.int64)
        found = []
        step = max(1, CELLS // max(1, len(other)))
        for lo in range(0, len(self.asked), step):
            i = np.arange(lo, min(len(self.asked), lo + step))
            la, lb = self.plain.size[i][:, None], plain.size[None, :]
            common, most = self.plain.common(i, plain), np.maximum(la, lb)
            jw = self.plain.jaro_winkler(i, plain, common)
            able = jw >= least - 1e-9
            # each edit, or half edit between look-alikes, costs the longer word one common character at most
            able |= most - common <= (1 - least) * most * (1 / sim.CONFUSABLE_COST if self.confusable else 1) + 1e-9
            # k shared bigrams, or k + 2 of the padded trigrams, need k common characters
            able |= common >= least * (la + lb - 2) / 2 - 1e-9
            able |= common + 2 >= least * np.maximum(self.plain.trigrams[i][:, None], plain.trigrams[None, :]) - 1e-9
            able |= (la == 1) | (lb == 1)
            able |= (mine[i][:, None] == theirs[None, :]) & (jw >= sim.PHONETIC_FROM)
            folded = self.folds.jaro_winkler(i, folds, self.folds.common(i, folds))
            able |= (jw >= sim.TRANSLIT_FROM) & (folded >= least - 1e-9) & (self.folds.size[i][:, None] >= 3) & (folds.size[None, :] >= 3)
            a, b = np.nonzero(able)
            score = token_sims(self.words, words, a + lo, b, self.confusable)
            good = score >= least - 1e-9
            found.append((a[good] + lo, b[good], score[good]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Bounds:
    """Words with what bounds the similarity of any two, as matrices in single precision."""

    def __init__(self, strings: list[str]):
        self.strings, self.words = strings, Words(strings)
        self.plain, self.folds = Signatures(self.words), Signatures(Words([sim._fold(w) for w in strings]))
        self.keys = [sim._key(w) for w in strings]

    def most(self, i: np.ndarray, other: Bounds, j: np.ndarray, confusable: bool) -> np.ndarray:
        """At least the similarities of the words i and the words j of other: what sims_at_most gives, or more."""
        x, y = self.plain, other.plain
        common = _common_characters(x, y, i, j)
        jw = _jaro_winkler_matrix(x, y, i, j, common)
        la, lb = (np.maximum(s, 1).astype(np.float32) for s in (x.size[i], y.size[j]))
        cost = np.float32(sim.CONFUSABLE_COST if confusable else 1)
        out = 1 - cost + cost * common / np.maximum(la[:, None], lb)
        np.maximum(out, 2 * common / np.maximum(la[:, None] + lb - 2, 1), out=out)
        np.maximum(out, (common + 2) / np.maximum(x.trigrams[i][:, None], y.trigrams[j]).astype(np.float32), out=out)
        np.maximum(out, jw, out=out)
        near = jw >= min(sim.PHONETIC_FROM, sim.TRANSLIT_FROM) - 1e-5
        if near.any():
            folded = _jaro_winkler_matrix(self.folds, other.folds, i, j, _common_characters(self.folds, other.folds, i, j))
            np.maximum(out, np.where(near, np.minimum(folded, np.float32(sim.TRANSLIT)), 0), out=out)
            number = {k: n for n, k in enumerate(filter(None, {self.keys[k] for k in i.tolist()}))}
            mine = np.array([number.get(self.keys[k], -1) for k in i.tolist()], np.int32)
            sounds = mine[:, None] == np.array([number.get(other.keys[k], -2) for k in j.tolist()], np.int32)
            if sounds.any():
                np.maximum(out, np.where(sounds & near, np.float32(sim.PHONETIC), 0), out=out)
        np.minimum(out, 1, out=out)
        out[x.size[i] <= 1] = 1
        out[:, y.size[j] <= 1] = 1
        return out


def _common_characters(x: Signatures, y: Signatures, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """At least the numbers of characters that the words i of x and j of y have in common."""
    out = np.bitwise_count(x.masks[0][i][:, None] & y.masks[0][j])
    out += np.bitwise_count(x.masks[1][i][:, None] & y.masks[1][j])
    if x.more[i].any() and y.more[j].any():
        out = out + np.minimum(x.more[i][:, None], y.more[j])
    return np.minimum(out.astype(np.float32), np.minimum(x.size[i][:, None], y.size[j]).astype(np.float32))


def _jaro_winkler_matrix(x: Signatures, y: Signatures, i: np.ndarray, j: np.ndarray, common: np.ndarray) -> np.ndarray:
    """At least the Jaro-Winkler similarities of the words i of x and j of y."""
    inverse = lambda size: (1 / (3 * np.maximum(size, 1))).astype(np.float32)
    jaro = common * (inverse(x.size[i])[:, None] + inverse(y.size[j])) + np.float32(1 / 3)
    prefix, going = np.zeros(jaro.shape, np.uint8), np.ones(jaro.shape, bool)
    for k in range(4):
        going &= x.head[i, k].astype(np.uint32)[:, None] == y.head[j, k].astype(np.uint32)
        prefix += going
    return jaro + prefix * (np.float32(0.1) * (1 - jaro))


#: Cells of the matrices of (words of the queries, names) and rows of pairs that are scored at once.
SCAN_CELLS, SCAN_ROWS = 1 << 19, 1 << 15
#: Pairs of words, frequent on both sides, whose similarities a batch of names is told apart by.
FREQUENT_PAIRS = 1 << 14


class Asked:
    """A block of queries (qid, q_tokens, weights), to be compared with batches of names."""

    def __init__(self, table: pa.Table, least: float, confusable: frozenset = frozenset()):
        self.table, self.least, self.confusable = table, least, confusable
        self.at, self.size, self.word, strings = _lists(table.column("q_tokens").combine_chunks())
        self.w_at, _, self.w = _lists_of_numbers(table.column("weights").combine_chunks())
        self.bounds, self.vocabulary = Bounds(strings), WordTable(strings, confusable)
        counted = np.minimum(self.size, sim.MOST_TOKENS)
        whole = _sums(self.w, self.w_at, counted)
        self.need = ((2 * least - 1) * whole - 1e-5 * (1 + whole)).astype(np.float32)
        #: (queries with a k-th word, that word, its weight)
        self.turns = []
        for k in range(int(counted.max(initial=0))):
            rows = np.flatnonzero(counted > k)
            self.turns.append((rows, self.word[self.at[rows] + k], self.w[self.w_at[rows] + k].astype(np.float32)))
        uses = np.zeros(len(strings), np.int64)
        for _, word, _ in self.turns:
            np.add.at(uses, word, 1)
        self.shared = uses > 1
        able = (self.size == 1) & (sim.ACRONYM * sim.SINGLE_DAMP >= least - 1e-9)
        self.initials = [(k, strings[self.word[self.at[k]]]) for k in np.flatnonzero(able).tolist() if 2 <= len(strings[self.word[self.at[k]]]) <= 6]

    def frequent(self, names: Bounds, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words that several names have, similarities of those that several queries have with them): few pairs that tell many apart."""
        i = np.flatnonzero(self.shared)
        often = np.flatnonzero(uses > 1)
        often = np.sort(often[np.argsort(-uses[often], kind="stable")][: FREQUENT_PAIRS // max(1, len(i))])
        sims = token_sims(self.bounds.words, names.words, np.repeat(i, len(often)), np.tile(often, len(i)), self.confusable)
        return often, sims.reshape(len(i), len(often)).astype(np.float32)

    def _partners(self, i: np.ndarray, names: Bounds, j: np.ndarray, words: np.ndarray, known: tuple | None) -> np.ndarray:
        """(words i, names): the bound of each word's best partner.  words: (names, places), numbers of a name's words among j."""
        most = self.bounds.most(i, names, j, bool(self.confusable))
        if known is not None:
            _, at, place = np.intersect1d(known[0], j, assume_unique=True, return_indices=True)
            most[:, place] = known[1][:, at]
        out = most[:, words[:, 0]]
        for k in range(1, words.shape[1]):
            np.maximum(out, most[:, words[:, k]], out=out)
        return out

    def within_reach(self, names: Bounds, words: np.ndarray, known: tuple) -> np.ndarray:
        """(queries, names): whether the average over the query's words can suffice.  words: (names, places), with repeats.  known: of frequent().

        Words that several queries have come first; what they leave is looked at by all words.
        """
        where = np.full(len(self.shared), -1)

        def lowered(sums: np.ndarray, i: np.ndarray, queries: np.ndarray, chosen: np.ndarray, known: tuple | None = None) -> None:
            """Sums in which the words i no longer count as equal to some word of the name."""
            if not len(i):
                return
            j, own = np.unique(chosen, return_inverse=True)
            partners = 1 - self._partners(i, names, j, own.reshape(chosen.shape), known)
            where[:] = -1
            where[i] = np.arange(len(i))
            place = np.full(len(self.at), -1)
            place[queries] = np.arange(len(queries))
            for rows, word, weight in self.turns:
                mine = (place[rows] >= 0) & (where[word] >= 0)
                sums[place[rows[mine]]] -= weight[mine][:, None] * partners[where[word[mine]]]

        out = np.zeros((len(self.at), len(words)), bool)
        every = np.arange(len(self.at))
        whole = np.zeros(len(self.at), np.float32)
        for rows, _, weight in self.turns:
            whole[rows] += weight
        sums = np.repeat(whole[:, None], len(words), axis=1)
        lowered(sums, np.flatnonzero(self.shared), every, words, known)
        able = sums >= self.need[:, None]
        rows, columns = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
        if len(rows):
            alone = np.zeros(len(self.shared), bool)
            for some, word, _ in self.turns:
                alone[word[np.isin(some, rows)]] = True
            sums = sums[np.ix_(rows, columns)]
            lowered(sums, np.flatnonzero(alone & ~self.shared), rows, words[columns])
            out[np.ix_(rows, columns)] = sums >= self.need[rows][:, None]
        return out

    def alike(self, names: Bounds, words: np.ndarray) -> np.ndarray:
        """(queries, names): whether some word of either are as similar as the best pair of words has to be."""
        j, own = np.unique(words, return_inverse=True)
        own = own.reshape(words.shape)
        met = np.zeros((len(self.shared), len(j)), bool)
        a, b, _ = self.vocabulary.alike([names.strings[k] for k in j.tolist()], 2 * self.least - 1 - 1e-9)
        met[a, b] = True
        partner = met[:, own[:, 0]]
        for k in range(1, words.shape[1]):
            partner |= met[:, own[:, k]]
        out = np.zeros((len(self.at), len(words)), bool)
        for rows, word, _ in self.turns:
            out[rows] |= partner[word]
        return out

    def scored(self, tokens: pa.Array, low_quality: pa.Array, by_word: bool):
        """(queries, names, scores) of pairs of a query and a name (non-null tokens) with a score of `least` or more, part by part."""
        at, size, word, strings = _lists(tokens)
        low, some = _flags(low_quality), np.flatnonzero(size > 0)
        if not len(some) or not len(self.at):
            return
        bounds, waiting, held = Bounds(strings), [], 0
        known = self.frequent(bounds, np.bincount(word, minlength=len(strings)))
        if self.initials:
            number, firsts = {}, [w[0] for w in strings]
            head = np.array([number.setdefault("".join([firsts[k] for k in word[at[r] : at[r] + size[r]].tolist()]) if size[r] > 1 else "", len(number)) for r in some.tolist()], np.int64)
            fits = [np.array([bool(h) and (h.startswith(one) or one.startswith(h)) for h in number], bool) for _, one in self.initials]
        step = max(1, SCAN_CELLS // (len(self.at) + len(self.shared)))
        for lo in range(0, len(some), step):
            rows = some[lo : lo + step]
            counted = np.minimum(size[rows], sim.MOST_TOKENS)
            words = word[at[rows][:, None] + np.minimum(np.arange(counted.max()), counted[:, None] - 1)]
            able = self.within_reach(bounds, words, known)
            if by_word:
                able &= self.alike(bounds, words)
            for n, (k, _) in enumerate(self.initials):
                able[k] |= fits[n][head[lo : lo + step]]
            i, j = np.nonzero(able)
            waiting.append((i, rows[j]))
            held += len(i)
            if held >= SCAN_ROWS or lo + step >= len(some):
                i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
                waiting, held = [], 0
                for k in range(0, len(i), SCAN_ROWS):
                    a, b = i[k : k + SCAN_ROWS], j[k : k + SCAN_ROWS]
                    raw = _scores((self.at[a], self.size[a], self.word, self.bounds.strings), (at[b], size[b], word, strings), (self.w_at[a], self.w), low[b], self.confusable, self.least, True)
                    good = raw >= self.least - 1e-9
                    yield a[good], b[good], raw[good]


#: Pairs of a query and a name that one task compares, about; queries that are compared at once, names of a task at most.
SCAN_PAIRS, SCAN_QUERIES, SCAN_NAMES = 1 << 22, 4096, 20_000


def scan(asked: DataFrame, names: DataFrame, size: int, least: float, confusable: frozenset = frozenset(), by_word: bool = False) -> DataFrame:
    """(qid, q_tokens, columns of names, raw) of pairs with a score of `least` or more.

    asked: (qid, q_tokens, weights), a bounded block, broadcast; each part of it meets each of the `size` names,
    by bounds on their words first.  by_word: only pairs with a pair of words as similar as such a score needs.
    """
    spark = names.sparkSession
    block = asked.select("qid", "q_tokens", "weights").toArrow()
    parts = max(1, -(-len(block) // SCAN_QUERIES))
    held = spark.sparkContext.broadcast((block, confusable))
    tasks = max(1, min(size, max(-(-size * len(block) // SCAN_PAIRS), -(-size // SCAN_NAMES))))
    kept = StructType([asked.schema["qid"], asked.schema["q_tokens"], *names.schema.fields, StructField("raw", DoubleType())])

    def run(batches):
        tables = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for part in pc.unique(batch.column("part")).to_pylist():
                if part not in tables:
                    tables[part] = Asked(held.value[0].slice(part * SCAN_QUERIES, SCAN_QUERIES).combine_chunks(), least, held.value[1])
                mine = table.filter(pc.equal(table.column("part"), part)).drop_columns("part").combine_chunks()
                tokens, low = (mine.column(c).combine_chunks() for c in ("tokens", "low_quality"))
                for i, j, raw in tables[part].scored(tokens, low, by_word):
                    if not len(i):
                        continue
                    q, n = tables[part].table.take(pa.array(i)), mine.take(pa.array(j))
                    columns = [q.column("qid"), q.column("q_tokens"), *n.columns, pa.chunked_array([raw])]
                    yield from pa.table(columns, names=kept.names).to_batches()

    dealt = names.repartition(tasks)
    numbers = spark.range(parts).select(F.col("id").cast("int").alias("part"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")) if by_word else dealt.join(F.broadcast(numbers), how="cross")
    return met.mapInArrow(run, kept)
