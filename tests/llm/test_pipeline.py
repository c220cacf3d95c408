"""The pipeline, stage by stage, against plain versions of its decisions."""

import base64
import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
from test_operators import lower

import corpus_pipeline
from partyloom.llm import mixing, quality, queries
from partyloom.llm.common import materialize

SF = "/root/testdata/sf0.001"


def similar_components(rows):
    """Groups of documents linked by a Jaccard similarity of 0.8 over five-word shingles, by comparing all that share one."""
    sets, holders, root = {}, defaultdict(list), {}
    for doc_id, text, *_ in rows:
        w = lower(text).split()
        k = min(5, len(w))
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        root[doc_id] = doc_id
        for x in sets[doc_id]:
            holders[x].append(doc_id)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in {j for x in sets[a] for j in holders[x] if j > a}:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in sets:
        groups[find(i)].append(i)
    return list(groups.values())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing to target weights", "byte-level BPE"]
    plain = lambda df: Counter(map(tuple, df.collect()))
    good = materialize(steps["quality classifier"](spark, docs, SF), "t1")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.score(docs, model).collect() if r["predicted"] == 1}
    assert plain(good) == Counter(t for t in map(tuple, docs.collect()) if t[0] in kept) and good.count() > 100
    once = materialize(steps["exact dedup"](spark, good, SF), "t2")
    last = {}
    for r in good.collect():
        last[lower(r["text"])] = max(last.get(lower(r["text"]), -1), r["doc_id"])
    assert Counter(r["doc_id"] for r in once.collect()) == Counter(last.values())
    near = materialize(steps["SimHash near-dedup"](spark, once, SF), "t3")
    stay, groups = {r["doc_id"] for r in near.collect()}, similar_components([tuple(r) for r in once.collect()])
    assert near.count() == len(stay) and stay <= {i for g in groups for i in g}
    # nothing but members of brute force's groups goes, each keeps its smallest member, and nine of ten others go
    assert {min(g) for g in groups} <= stay
    others = {i for g in groups for i in g} - {min(g) for g in groups}
    assert others and len(others - stay) >= 0.9 * len(others)
    mixed = materialize(steps["mixing to target weights"](spark, near, SF), "t4")
    times = {r["doc_id"]: r["copies"] for r in mixing.mix(near).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in times.items() if v})
    assert mixed.columns == near.columns == once.columns == docs.columns
    path = public_tokenizers.path(queries.VOCAB)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = defaultdict(int)
    for r in mixed.collect():
        ids = own.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))] += 1
    end = steps["byte-level BPE"](spark, mixed, SF)
    assert plain(end) == want
    assert plain(corpus_pipeline.run(spark, SF)) == want


def test_hostile_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns, an empty table."""
    good = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    rows = good + [good[0], good[1], (None, good[2][1], None, None, None), (900, None, "en", "src0", 0), (901, "", None, None, None), (902, good[3][1] * 300, "en", "src1", 1)]
    docs = spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, key int, fp binary")
    steps = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r["doc_id"], r["text"]) for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), "hostile")
        assert docs.columns[-3:] == ["id", "key", "fp"], name
        assert {(r["doc_id"], r["text"]) for r in docs.collect()} <= before, name
    assert steps["byte-level BPE"](spark, docs, SF).count() == docs.count() > 0
    none = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
