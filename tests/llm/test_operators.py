"""The operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from partyloom.llm import ann, bpe, exact_dedup, langid, mixing, quality, queries, secrets, simhash, url_filter
from partyloom.llm.common import hash_sample
from partyloom.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, fp int, digest int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "dé", "漢字", "of", "the", "x", "don't", "42"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    texts += [None, "", "", "   ", "A", "a", "word " * 9000, texts[3], texts[3].upper(), texts[5] + " end"]
    rows = [(None if i == 7 else i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None, "s10"]), 0) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], rows[7], (None, texts[9], "en", "s1", 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def test_bpe_like_tiktoken(docs, nothing):
    path = public_tokenizers.path(queries.VOCAB)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for doc_id, text, *_ in corpus():
        ids = own.encode_ordinary(text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[(doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(own.decode_bytes(ids)))] += 1
    assert Counter(map(tuple, bpe.digests(docs, queries.VOCAB).collect())) == want
    assert bpe.digests(nothing, queries.VOCAB).count() == 0
    coded = bpe.encode(docs, queries.VOCAB)
    back = {(r["doc_id"], bytes(r["bytes"])) for r in bpe.decode(coded, queries.VOCAB).collect()}
    assert back == {(i, (t or "").encode()) for i, t, *_ in corpus()}


def test_bpe_boundaries_like_tiktoken():
    path = public_tokenizers.path(queries.VOCAB)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    held, rng = bpe.Vocabulary(path, cache_pieces=500), random.Random(3)
    texts = ["".join(rng.choice("ab s'tmdrevl  \n\t é1٣.,!\"漢𝒳\U0001f600\x1c\u2003") for _ in range(rng.randrange(50))) for _ in range(3000)] + ["a" * 3000, "'" * 99]
    data = [t.encode() for t in texts]
    ids, at, starts = held.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([*map(len, data)])]))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == own.encode_ordinary(t)
    assert held.decode(ids).tobytes() == b"".join(data)
    assert starts.tolist() == (np.cumsum(held.lengths[ids]) - held.lengths[ids]).tolist()


def test_bpe_classes_like_tiktoken():
    """Every code point's class is the one of the library; new and sampled ones also give its ids in several contexts."""
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    table = bpe.class_table()
    for pattern, kind in ((r"\p{L}", bpe.LETTER), (r"\p{N}", bpe.NUMBER), (r"\s", bpe.SPACE)):
        of = tiktoken.Encoding("of", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(of.encode_ordinary("".join(map(chr, every)))).decode()  # only what the pattern matches
        assert [ord(c) for c in found] == [c for c in every if table[c] == kind]
    path = public_tokenizers.path(queries.VOCAB)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    held = bpe.Vocabulary(path)
    new = {c for a, b in (*bpe.NEW_LETTERS, *bpe.NEW_NUMBERS) for c in (a, b)}
    part = [chr(c) for c in every if c in new or c % 311 == 0]
    for before, after in (("", ""), ("a", "b"), ("1", "2"), (" ", " x"), ("!", "?"), ("\n", "\n")):
        data = [(before + c + after).encode() for c in part]
        ids, at, _ = held.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([*map(len, data)])]))
        want = [own.encode_ordinary(before + c + after) for c in part]
        assert ids.tolist() == [i for x in want for i in x] and np.diff(at).tolist() == [*map(len, want)], (before, after)


@pytest.mark.parametrize("keep", ["low", "high"])
def test_exact_dedup(spark, docs, nothing, keep):
    groups = defaultdict(list)
    for r in corpus():
        groups[lower(r[1])].append(r[0])
    pick = max if keep == "high" else min
    want = Counter((i, pick([x for x in g if x is not None], default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    got = exact_dedup.groups(docs, keep=keep).collect()
    assert Counter((r["id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in got) == want
    assert Counter(bytes(r["digest"]) for r in got if r["kept"]) == Counter(hashlib.sha256(t.encode()).digest() for t in groups)
    stay = exact_dedup.keep_one(docs, keep=keep)
    assert stay.columns == docs.columns
    assert Counter(lower(r["text"]) for r in stay.collect()) == Counter(list(groups))
    assert exact_dedup.groups(nothing).count() == 0 and exact_dedup.keep_one(nothing).count() == 0


def brute_simhash(rows):
    def fp(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        if not words:
            return 0
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[root[i]].append(r[0])
    least = lambda g: min([x for x in g if x is not None], default=None)
    return [(r[0], fps[i], least(low[root[i]])) for i, r in enumerate(rows)], len(low)


def test_simhash(docs, nothing):
    want, n = brute_simhash(corpus())
    got = simhash.near_groups(docs).collect()
    assert Counter((r["id"], r["fp"] % 2**64, r["component_id"]) for r in got) == Counter(want)
    stay = simhash.keep_one(docs)
    assert stay.columns == docs.columns and stay.count() == n
    assert simhash.near_groups(nothing).count() == 0


@pytest.mark.parametrize("n", [40, 700])
def test_simhash_links_keep_every_component(spark, n, monkeypatch):
    rng = random.Random(n)
    base = [rng.getrandbits(64) for _ in range(max(1, n // 200))]
    fps = list({b ^ sum(1 << i for i in rng.sample(range(64) if k % 3 else range(28, 40), rng.randrange(0, 6))) for k in range(n) for b in [rng.choice(base)]})
    monkeypatch.setattr(simhash, "DIRECT", 8)
    signed = [(x - (x >> 63 << 64),) for x in fps]
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)

    def parts(edges):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        out = defaultdict(set)
        for x in fps:
            out[find(x)].add(x)
        return {frozenset(s) for s in out.values()}

    assert parts(found) == parts((a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3)


def test_simhash_large_sets_are_dealt_again(monkeypatch):
    """Sets above MOST_HELD go on as variants and lose no component, however the stream is cut into batches."""
    rng = np.random.default_rng(4)
    base = int(rng.integers(1 << 63))
    fps = np.unique([base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(220)]).astype(np.uint64)
    monkeypatch.setattr(simhash, "MOST_HELD", 20)
    monkeypatch.setattr(simhash, "DIRECT", 8)
    rows = []
    for f in fps.tolist():
        for tag, half in ((0, f & 0xFFFFFFFF), (1, f >> 32)):
            rows += [(tag << 32 | (half ^ v), f - (f >> 63 << 64)) for v in [0, *(1 << i for i in range(32))]]
    rows.sort(key=lambda r: r[0])
    batch = lambda part, names: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names)
    found = [r for b in simhash._links((batch(rows[i : i + 97], ["key", "fp"]) for i in range(0, len(rows), 97)), 3) for r in b.to_pylist()]
    dealt = sorted((r["key"], r["variant"], r["cost"], r["fp"]) for r in found if r["key"] is not None)
    assert dealt
    more = [r for b in simhash._dealt_links((batch(dealt[i : i + 1000], ["key", "variant", "cost", "fp"]) for i in range(0, len(dealt), 1000)), 3) for r in b.to_pylist()]
    edges = {(r["a"] % 2**64, r["b"] % 2**64) for r in found if r["key"] is None} | {(r["a"] % 2**64, r["b"] % 2**64) for r in more}
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)

    def parts(links):
        root = {x: x for x in fps.tolist()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        return Counter(find(x) for x in root).values()

    want = [(a, b) for a in fps.tolist() for b in fps.tolist() if a < b and (a ^ b).bit_count() <= 3]
    assert sorted(parts(edges)) == sorted(parts(want))


def test_components_with_hubs(spark):
    edges = [(0, i) for i in range(1, 3001)] + [(i, i + 1) for i in range(5000, 5040)] + [(9000, 9000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(3001)} | {i: 5000 for i in range(5000, 5041)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_samples_hold_at_any_count(spark):
    ids = spark.range(200_000)
    for want, count in ((3000, 200_000), (500, 2_000_000), (10, 5)):
        n = ids.where(hash_sample(["id"], 1, want, count)).count()
        assert abs(n - min(200_000, 200_000 * want / count)) <= 5 * (200_000 * want / count) ** 0.5 + 1
    share = ((3000 << 64) // 10**10) / 2**64
    assert abs(share * 10**10 - 3000) < 1e-3


def test_samples_are_bounded_in_rows(spark):
    rows = [(7, f"text {i}", "en") for i in range(500)] + [(i, "some words here", "fr") for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = df.select("doc_id", F.lit(1).alias("quality"))
    assert langid.sample(df, 40).count() <= 40 and quality.sample(df, labels, 40).count() <= 40
    assert langid.sample(df).groupBy("doc_id").count().where("count > 1").isEmpty()


RULES = [("net", "/es/"), ("net", "/fr/"), ("com", "/"), ("example.com", "/en/"), ("www.example.com", "/en/")]
URLS = [None, "", "nothing", "http://", "http://COM/", "http://com", "https://WWW.Example.com/en/x?y#z", "ftp://example.com/en/", "http://example.com/EN/",
        "http://notexample.com/en/", "http://a.net/es/1", "http://net/fr/", "http://a.net/es", "x://y.com?q=/en/", "http://u:p@example.com:80/en/", "://example.com/en/\n",
        "http://e.com/" + "a." * 30000, "http://" + "a." * 20000 + "example.com/en/"]


def test_url_filter(spark):
    def brute(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
        fit = [(len(h + p), len(h), h + p) for h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit)[2] if fit else None
        return host, path, rule, {None: "allow", "com/": "allow", "www.example.com/en/": "allow"}.get(rule, "block")

    rows = [(None if i == 2 else i, u, "c", "c", "c", "c") for i, u in enumerate(URLS)] + [(4, URLS[4], "c", "c", "c", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, e string")
    got = Counter(map(tuple, url_filter.judge(df, url_filter.rule_table(spark)).collect()))
    assert got == Counter((r[0], *brute(r[1])) for r in rows)
    assert got == Counter(map(tuple, url_filter.judge(df, url_filter.rule_table(spark), most_broadcast=0, salts=3).collect()))
    assert url_filter.judge(df.limit(0), url_filter.rule_table(spark)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, url_filter.rule_table(spark, [("block", "a", "/")]).limit(0)).collect()} == {"allow"}


def brute_base(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(out)]


LEAKS = [None, "", "é password = 'abcdef' token: secret: abcdefgh", "Api_Key=" + "a1" * 20, "AKIA" + "Z9" * 9 + " é AKIA123", "token=\ntoken=abc", "paſſword=abcdefgh",
         "user: jane\nhttps://db.example.com/x\nkey Zk81jQx9LmPq02RtYw77 é", "key Zk81jQx9LmPq02RtYw77 alone", "user: jane\n\nhttps://db.example.com Zk81jQx9LmPq02RtYw77",
         "user: jane " + "y " * 400 + " https://h.example Zk81jQx9LmPq02RtYw77", "password=secret=tokentoken" * 50, "0123456789abcdef" * 5000]


def test_secrets(spark):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(LEAKS)] + [(2, LEAKS[2], "c", 1), (None, LEAKS[3], "c", 1)], "doc_id long, text string, spans string, base int")
    spans = lambda x: [(s["kind"], s["start"], s["end"]) for s in x]
    got = secrets.scan(df).collect()
    assert Counter((r["doc_id"], *spans(r["base"])) for r in got) == Counter((r[0], *brute_base(r[1])) for r in df.collect())
    weak = {r["doc_id"]: [s for s in spans(r["spans"]) if s[0] in secrets.KINDS[3:]] for r in got}
    assert [k for k, _, _ in weak[7]] == ["user", "endpoint", "opaque"]
    assert LEAKS[7][slice(*weak[7][2][1:])] == "Zk81jQx9LmPq02RtYw77"
    assert not any(weak[i] for i in weak if i != 7)
    assert secrets.scan(df.limit(0)).count() == 0


def test_links_reach_in_code_points():
    parts = lambda gap: f"user: jane {gap} https://h.example Zk81jQx9LmPq02RtYw77"
    kinds = lambda text: [secrets.KINDS[k] for _, _, k in secrets.scan_text(text.encode())[1]]
    for letter in "yé漢😀":
        assert kinds(parts(letter * 350)) == ["user", "endpoint", "opaque"], letter
        assert kinds(parts(letter * 401)) == [], letter


def test_links_with_nested_parts():
    rng = random.Random(6)
    for _ in range(300):
        points = sorted((a, a + rng.choice([1, 5, 60])) for a in rng.choices(range(300), k=rng.randrange(6)))
        own = [(a, a + rng.randrange(1, 9)) for a in rng.choices(range(300), k=8)]
        at = np.array(own)
        got = secrets._near(np.array(points, np.int64).reshape(-1, 2), at[:, 0], at[:, 1], 20)
        assert got.tolist() == [any(b >= s - 20 and a <= e + 20 for a, b in points) for s, e in own]
    text = "token=abc." + "0a" * 12 + "." + "x" * 400 + " " + "z " * 150 + "user: jane https://h.example"
    assert [secrets.KINDS[k] for _, _, k in secrets.scan_text(text.encode())[1]] == ["assign", "hex", "user", "endpoint"]


def brute_links(text, reach=secrets.LINK_CHARS):
    """Weak parts by comparing all parts of a text with all others, in code points."""
    strong = [(a, b, k) for k, a, b in brute_base(text)]
    find = lambda pattern: [(m.start(), m.end()) for m in re.finditer(pattern.pattern.decode(), text, pattern.flags & re.I | re.A)]
    user, endpoint = find(secrets.USER), find(secrets.ENDPOINT)
    opaque = [(a, b) for a, b in find(secrets.OPAQUE) if re.search("[0-9]", text[a:b]) and re.search("[A-Za-z]", text[a:b]) and not any(x < b and y > a for x, y, _ in strong)]
    ends = [m.end() for m in re.finditer(secrets.BLANK.pattern.decode(), text)]
    scope = lambda a: sum(e <= a for e in ends)
    parts = {"user": user + [(a, b) for a, b, k in strong if k == "access"], "secret": opaque + [(a, b) for a, b, k in strong if k != "access"], "endpoint": endpoint}
    near = lambda own, kind: any(scope(own[0]) == scope(x[0]) and x[0] <= own[1] + reach and x[1] >= own[0] - reach for x in parts[kind])
    out = [("user", *x) for x in user if near(x, "secret") and near(x, "endpoint")]
    out += [("opaque", *x) for x in opaque if near(x, "user") and near(x, "endpoint")]
    return sorted(out + [("endpoint", *x) for x in endpoint if near(x, "user") and near(x, "secret")])


def test_links_like_all_pairs():
    rng = random.Random(9)
    pieces = ["user: jane", "client_id=ab-12", "https://h.example", "ftp://x.y", "Zk81jQx9LmPq02RtYw77", "password=zz." + "0a" * 16 + ".zz", "AKIA" + "Z9" * 9, "0a" * 14, "login=AKIA" + "Z9" * 9, "\n\n", "\n \t\n", "é漢 ", "token: abc"]
    for _ in range(600):
        text = "".join(rng.choice(pieces) + " " * rng.choice([1, 1, 30]) + rng.choice(["", "x " * rng.randrange(250), "é " * rng.randrange(250)]) for _ in range(rng.randrange(1, 9)))
        got = [(secrets.KINDS[k], a, b) for a, b, k in secrets.scan_text(text.encode())[1] if k > 2]
        assert sorted(got) == brute_links(text), text


def test_mixing(spark, docs, nothing):
    out = mixing.mix(docs).collect()
    sizes = Counter()
    for r in corpus():
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = ["s1", "s10", "s2", None]
    goal, full, total = {}, {}, 1.5 * sum(sizes.values())
    weight = dict(zip(order, (5, 2, 1, 5), strict=True))
    while True:
        free = [s for s in order if s not in full]
        goal = {s: (total - sum(full.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > 2 * sizes[s]]
        if not over:
            break
        full |= {s: 2 * sizes[s] for s in over}
    goal |= full
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in corpus())
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in out)
    taken = Counter()
    for r in out:
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert set(taken) == {(sizes[s], round(goal[s], 6)) for s in order}
    assert all(abs(t - k[1]) <= 9000 for k, t in taken.items())
    again = mixing.mix(docs.repartition(11)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.mix(nothing).count() == 0 and mixing.apply(nothing).count() == 0
    assert mixing.targets([("a", 0), (None, 0)]) == {"a": 0, None: 0}
    rows = mixing.apply(docs)
    assert rows.columns == docs.columns
    assert rows.count() == sum(r["copies"] for r in out)


def test_mixing_tree_is_close_and_fair(spark):
    df = spark.range(9000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "if(id % 3 = 0, 'a', concat('b', id % 7)) as source")
    out = mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 50 for r in out)
    means = np.mean([mixing.round_pairs(np.array([1.0, 2, 3, 9]), np.array([0.5, 0.25, 0.75, 0.4]), np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.allclose(means, [0.5, 0.25, 0.75, 0.4], atol=0.03)


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 17)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(None, x[1].tolist()), (901, None), (902, []), (903, [0.0] * 17), (904, [1.0] * 3), (905, [None] + [1.0] * 16), (906, [float("nan")] + [1.0] * 16), (907, [float("inf")] * 17), rows[20], rows[20]]
    df = spark.createDataFrame([(*r, "c", b"c") for r in rows], "vec_id long, embedding array<float>, id string, vec binary").repartition(3)
    got = defaultdict(list)
    for r in ann.search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    hits = 0
    for q in range(0, 900, 20):
        score = (x.astype(float) * x[q].astype(float)).sum(1)
        best = sorted((-s, i) for i, s in enumerate(score.tolist()) if i != q)[:20]
        hits += len({i for _, i in best} & {i for i, _ in got[q]})
        assert len(got[q]) == 20 and sorted(got[q], key=lambda r: (-r[1], r[0])) == got[q]
        assert all(s == score[i] for i, s in got[q])
    assert sorted(got) == list(range(0, 900, 20)) and hits >= 0.9 * 45 * 20
    few = ann.search(df.where("vec_id < 5"), F.col("id") % 2 == 0).collect()
    assert len(few) == 12
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_ann_over_lists_and_blocks(spark, monkeypatch):
    for name, value in (("LIST_ROWS", 300), ("CANDIDATE_BLOCK", 90), ("QUERY_BLOCK", 7), ("FIT_ROWS", 500)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(12, 16))[rng.integers(0, 12, 2400)] * 2 + rng.normal(size=(2400, 16))).astype(np.float64)
    x[::60] = x[0]  # a hot vector, asked for as well
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in ann.search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    hits = 0
    for q in range(0, 2400, 20):
        score = (x * x[q]).sum(1).tolist()
        best = sorted((-s, i) for i, s in enumerate(score) if i != q)[:20]
        assert len(got[q]) == 20 and all(s == score[i] and i != q for i, s in got[q])
        assert sorted(got[q], key=lambda r: (-r[1], r[0])) == got[q]
        hits += sum(s >= -best[-1][0] for _, s in got[q])
    assert len(got) == 120 and hits >= 0.9 * 120 * 20
    same = ann.search(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0)
    assert {(r["query_id"], r["rank"], r["id"], r["score"]) for r in same.collect()} == {(q, k + 1, i, 5.0) for q in (0, 20, 40) for k, i in enumerate([j for j in range(50) if j != q][:20])}


def read(spark, name):
    return spark.read.parquet(f"{SF}/../sf0.01/{name}.parquet")


def test_quality_held_out(spark, nothing):
    documents, labels = read(spark, "documents"), read(spark, "labels")
    model = quality.fit(documents, labels)
    rows = quality.score(documents, model).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.9
    every = quality.score(documents, model)
    assert every.count() == documents.count() and every.where("not score between 0 and 1").isEmpty()
    odd = quality.score(frame(spark, corpus()), model)
    assert odd.count() == len(corpus()) and odd.where("score is null").isEmpty()
    assert quality.score(nothing, quality.fit(nothing, labels.limit(0))).count() == 0
    kept = quality.keep_good(documents, model)
    assert kept.columns == documents.columns and kept.count() == every.where("predicted = 1").count()


def test_quality_pools_over_any_batch():
    rng = np.random.default_rng(1)
    model = quality.Model(3)
    texts = [rng.integers(32, 120, n).astype(np.uint8).tobytes() for n in (0, 1, 127, 128, 129, 256, 5000)]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([*map(len, texts)])])
    alone = [model.probability(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(model.probability(flat, at), alone, atol=1e-6)


def test_quality_like_plain_convolution():
    rng = np.random.default_rng(5)
    model = quality.Model(7)
    model.bias[0] = 0.3
    for n in (0, 3, 130, 700):
        text = rng.integers(32, 122, n).astype(np.uint8)
        halves = max(2, -(-(n + quality.WIDTH) // quality.HALF))
        padded = np.full(halves * quality.HALF, quality.PAD)
        padded[:n] = text
        logits = []
        for c in range(halves - 1):  # chunks of whole start positions, each half a chunk after the one before
            top = np.full(quality.FILTERS, -np.inf)
            for at in range(c * quality.HALF, (c + 2) * quality.HALF):
                if at + quality.WIDTH <= len(padded):
                    top = np.maximum(top, sum(model.filters[j][padded[at + j]] for j in range(quality.WIDTH)))
            logits.append(np.tanh(top @ model.hidden + model.hidden_bias) @ model.out)
        want = 1 / (1 + np.exp(-(np.mean(logits) + 0.3)))
        assert abs(model.probability(text, np.array([0, n]))[0] - want) < 1e-5


def test_langid_like_plain_average():
    texts = [b"the cat and the dog", "der Hund und die Katze \u00fc".encode(), b"le chien et le chat"] * 12
    model = langid.train(texts, ["en", "de", "fr"] * 12)
    for text in (*texts[:3], b"", b"a", "12 \u6f22".encode(), b"the Der LE " * 400):
        folded = bytes(langid.FOLD[b] for b in text)
        buckets = []
        for n in langid.ORDERS:
            for i in range(len(folded) - n + 1):
                h = 2166136261 ^ n
                for b in folded[i : i + n]:
                    h = (h ^ b) * 16777619 % 2**32
                buckets.append((h ^ (h >> 15)) & (langid.BUCKETS - 1))
        z = (np.mean([model.table[k].astype(float) for k in buckets], axis=0) if buckets else 0) + model.bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best, score = model.predict(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert best[0] == p.argmax() and abs(score[0] - p.max()) < 1e-6


def test_langid_hostile_rows(spark):
    model = langid.fit(read(spark, "documents"))
    rows = [(1, None), (2, "le chien " * 200_000), (2, "le chien " * 200_000), (3, "the dog and the cat")] * 2
    df = spark.createDataFrame([(*r, "x", "y", True) for r in rows], "doc_id long, text string, lang_pred string, score string, rejected boolean")
    got = langid.predict(df, model)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    assert Counter((r["doc_id"], r["lang_pred"]) for r in got.collect()) == Counter({(1, "und"): 2, (2, "fr"): 4, (3, "en"): 2})


def test_langid_held_out(spark, nothing):
    documents = read(spark, "documents")
    model = langid.fit(documents)
    rows = langid.predict(documents, model).join(documents.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.97
    odd = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "漢"), (5, "é"), (None, "the")], "doc_id long, text string"), model).collect()}
    assert [odd[i]["lang_pred"] == "und" for i in (1, 2, 3, 4, 5, None)] == [True, True, True, False, False, False]
    assert langid.fit(nothing) is None and langid.predict(nothing, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(documents, None).collect()} == {"und"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(want)
