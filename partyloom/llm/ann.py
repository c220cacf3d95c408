"""Nearest neighbours by largest inner product, with anisotropic four-bit product quantisation.

A coarse codebook deals the vectors into lists, about LIST_ROWS each.  What is left of a vector
beside its list's centre is coded: codebooks of 16 centres for pairs of dimensions, fitted on a
bounded sample.  Both losses weigh the part of the residual parallel to the vector ETA times, as
errors there change large inner products most; codes are chosen by coordinate descent over the
subspaces, centres by weighted least squares.  As only residuals are coded, members of a tight
cluster still differ in their codes.

How many lists a query visits and what share of a block is scored exactly are measured together,
on the sample's own true neighbours and with the very scan that the search makes: the codes must
rank RANKED of them within the share, and share and visits together must reach PROBED.  Where
codes can't tell candidates apart, the share grows up to the whole block, which is an exact scan;
where vectors have no structure, nearly all lists are visited.

Equal vectors are indexed once, with their smallest ids (as many as any answer can show), so a
hot vector is one row.  A list of any size is cut into blocks of candidates and of queries.  In
each meeting the four-bit tables, joined in pairs, score every candidate, the best are scored
exactly in double precision, and the best of those go on; a window keeps each query's best in
every task before they are shuffled.  Asked ids that share a vector are split by a broadcast.

Rows with a null id or a vector that is null, empty, zero, of another dimension than the table's
most common one, or with null or non-finite components take no part.  Repeated rows (same id,
same vector) count once, and all rows with the query's id are its own, also those with other
vectors: no more than k of one id are kept, and 2k in all, so k others remain.  A query visits as
many lists more as it takes to find k rows of others.  Ties go to smaller ids.  An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partyloom.llm.common import hash_sample, materialize

K = 20
SUB, CENTRES = 2, 16
#: Vectors the quantiser is fitted on, the coarse codebook at most, and exact scores in a meeting at least.
FIT_ROWS, MOST_FIT_ROWS, RERANK = 8192, 1 << 16, 128
#: Vectors in a list, lists at most, and fitted vectors for each list at least.
LIST_ROWS, MOST_LISTS, ROWS_A_LIST = 4096, 4096, 16
#: Sample's true neighbours that exact scoring must reach, and that search as a whole must; sample's queries.
RANKED, PROBED, ASKED = 0.995, 0.98, 256
#: The least weight of parallel errors, and the part of a vector's length from which inner products matter.
LEAST_ETA, THRESHOLD = 1.5, 0.2
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 4096
#: Vectors asked by at least this share of the queries are joined by a broadcast: 1/share at most.
HOT_SHARE = 1 / 2000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


@dataclass
class Quantiser:
    """centres: (subspaces, CENTRES, SUB)."""

    centres: np.ndarray
    eta: float

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.centres.shape[0] * SUB - x.shape[1])))

    def encode(self, x: np.ndarray, toward: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (n, subspaces) of x, minimising |r|^2 + (eta - 1) (r . toward)^2; toward: unit vectors."""
        x = self.pad(x)
        parts, unit = x.reshape(len(x), -1, SUB), self.pad(toward).reshape(len(x), -1, SUB)
        m = parts.shape[1]
        codes = np.stack([((parts[:, s, None] - self.centres[s]) ** 2).sum(2).argmin(1) for s in range(m)], 1) if len(x) else np.zeros((0, m), int)
        along = np.stack([((parts[:, s] - self.centres[s][codes[:, s]]) * unit[:, s]).sum(1) for s in range(m)], 1) if len(x) else np.zeros((0, m))
        total = along.sum(1)
        for _ in range(sweeps):
            for s in range(m):
                r = parts[:, s, None] - self.centres[s]
                par = (r * unit[:, s, None]).sum(2)
                rest = total - along[:, s]
                best = ((r**2).sum(2) + (self.eta - 1) * (rest[:, None] + par) ** 2).argmin(1)
                codes[:, s] = best
                along[:, s] = par[np.arange(len(x)), best]
                total = rest + along[:, s]
        return codes.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query, inner products of its pairs of subspaces with all pairs of centres: (n, pairs * 256)."""
        one = np.einsum("nsd,scd->nsc", self.pad(q).reshape(len(q), -1, SUB), self.centres)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros((len(q), 1, CENTRES))], 1)
        both = one[:, 0::2, :, None] + one[:, 1::2, None, :]
        return both.reshape(len(q), -1).astype(np.float32)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return (codes[:, 0::2] << 4) | codes[:, 1::2]


def weight_of_parallel(d: int, threshold: float = THRESHOLD) -> float:
    """Eta, for vectors of d dimensions."""
    return max(LEAST_ETA, (d - 1) * threshold**2 / (1 - threshold**2))


def fit(x: np.ndarray, toward: np.ndarray, eta: float, rounds: int = 5, seed: int = 0) -> Quantiser:
    """From a bounded sample of residuals and the unit vectors of what they are residuals of."""
    m = -(-x.shape[1] // SUB)
    rng = np.random.default_rng(seed)
    q = Quantiser(np.zeros((m, CENTRES, SUB)), eta)
    x = q.pad(x)
    parts, unit = x.reshape(len(x), m, SUB), q.pad(toward).reshape(len(x), m, SUB)
    q.centres = np.stack([parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), s] for s in range(m)])
    for _ in range(8):  # plain k-means first
        for s in range(m):
            at = ((parts[:, s, None] - q.centres[s]) ** 2).sum(2).argmin(1)
            for c in np.unique(at):
                q.centres[s, c] = parts[at == c, s].mean(0)
    for _ in range(rounds):
        codes = q.encode(x, toward, 1)
        r = parts - np.stack([q.centres[s][codes[:, s]] for s in range(m)], 1)
        along = (r * unit).sum(2)
        total = along.sum(1)
        for s in range(m):
            u = unit[:, s]
            rest = total - along[:, s]
            lhs = np.eye(SUB) + (eta - 1) * u[:, :, None] * u[:, None, :]
            rhs = parts[:, s] + (eta - 1) * (rest + (parts[:, s] * u).sum(1))[:, None] * u
            for c in np.unique(codes[:, s]):
                mine = codes[:, s] == c
                q.centres[s, c] = np.linalg.solve(lhs[mine].sum(0), rhs[mine].sum(0))
            now = ((parts[:, s] - q.centres[s][codes[:, s]]) * u).sum(1)
            total = rest + now
            along[:, s] = now
    return q


@dataclass
class Index:
    """Coarse centres (lists, d) with the quantiser of residuals; how many lists a query visits, and the share of a block scored exactly."""

    centres: np.ndarray
    eta: float
    quantiser: Quantiser | None = None
    probes: int = 1
    share: float = 1.0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector, minimising |r|^2 + (eta - 1) (r . x / |x|)^2."""
        out = np.empty(len(x), np.int32)
        norm = (self.centres**2).sum(1)
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024]
            size = np.linalg.norm(part, axis=1, keepdims=True)
            dot = part @ self.centres.T
            out[lo : lo + 1024] = (norm - 2 * dot + (self.eta - 1) * (size - dot / size) ** 2).argmin(1)
        return out

    def encode(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Packed codes of vectors in the lists `at`."""
        return pack(self.quantiser.encode(x - self.centres[at], _unit(x)))

    def order(self, q: np.ndarray) -> np.ndarray:
        """All lists for each query, those whose centres have the largest inner products first."""
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")

    def visits(self, q: np.ndarray, sizes: np.ndarray, need: int) -> list[np.ndarray]:
        """The lists that each query visits: `probes`, and more until they hold `need` vectors."""
        order = self.order(q)
        enough = (np.cumsum(sizes[order], axis=1) < need).sum(axis=1) + 1
        return [o[:n] for o, n in zip(order, np.maximum(enough, self.probes).tolist(), strict=True)]

    def keep(self, block: int) -> int:
        """Candidates of a block that are scored exactly."""
        return min(block, max(RERANK, math.ceil(self.share * block)))


def fit_index(x: np.ndarray, lists: int, k: int = K, rounds: int = 6, seed: int = 0) -> Index:
    """From a bounded sample."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    out = Index(x[rng.choice(len(x), lists, replace=False)].copy(), weight_of_parallel(x.shape[1]))
    for _ in range(rounds if lists > 1 else 1):
        at = out.assign(x)
        for c in np.unique(at):
            mine = x[at == c]
            u = _unit(mine)
            out.centres[c] = np.linalg.solve(len(mine) * np.eye(x.shape[1]) + (out.eta - 1) * u.T @ u, out.eta * mine.sum(0))
    some = x[rng.permutation(len(x))[:FIT_ROWS]]
    out.quantiser = fit(some - out.centres[out.assign(some)], _unit(some), out.eta, seed=seed)
    measure(out, x, some[:ASKED], k)
    return out


def measure(index: Index, x: np.ndarray, asked: np.ndarray, k: int) -> None:
    """Sets share and probes by where the scan of the sample x ranks the true neighbours of its members `asked`."""
    at = index.assign(x)
    codes = index.encode(x, at)
    members = [np.flatnonzero(at == c) for c in range(len(index.centres))]
    order, tables = index.order(asked), index.quantiser.tables(asked)
    turns, shares = [], []
    for q, o, t in zip(asked, order, tables, strict=True):
        score = x @ q
        score[(x == q).all(axis=1)] = -np.inf
        best = np.argpartition(-score, min(k, len(x) - 1))[: min(k, len(x) - 1)]
        turn = np.argsort(o)
        for c in np.unique(at[best]).tolist():
            mine = members[c]
            rough = scan(t[None], codes[mine])[0]
            for b in best[at[best] == c].tolist():
                worse = (rough > rough[np.searchsorted(mine, b)]).sum()
                shares.append((worse + 1) / len(mine))
                turns.append(turn[c])
    index.probes, index.share = len(index.centres), 1.0
    if shares:
        shares, turns = np.array(shares), np.array(turns)
        index.share = float(np.quantile(shares, RANKED, method="higher"))
        reached = np.sort(turns[shares <= index.share])
        wanted = math.ceil(PROBED * len(shares))
        if len(reached) >= wanted:
            index.probes = int(reached[wanted - 1]) + 1


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate scores (queries, candidates) from the joined tables."""
    at = (packed.T.astype(np.int32) + 256 * np.arange(packed.shape[1], dtype=np.int32)[:, None])
    out = np.empty((len(tables), packed.shape[0]), np.float32)
    for i, t in enumerate(tables):
        out[i] = t[at].sum(axis=0)
    return out


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): usable rows, the vector packed in its own width (float or double); -0.0 counts as 0.0."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(df[id_col].cast("long").alias("id"), df[vec_col].cast(f"array<{_width(df, vec_col)}>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    kind = np.dtype(KINDS[_width(df, vec_col)])

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = np.asarray(lists.flatten(), kind) + kind.type(0)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64) * kind.itemsize
            data = flat.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["id", "vec"])

    return rows.mapInArrow(run, "id long, vec binary")


KINDS = {"float": "f4", "double": "f8"}


def _width(df: DataFrame, vec_col: str) -> str:
    return "float" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "double"


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vec, ids): each vector once with its `keep` smallest ids; every task collapses its own rows first."""

    def run(batches):
        for batch in batches:
            found: dict[bytes, set] = {}
            for vec, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(vec, set()).update(ids)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([sorted(x)[:keep] for x in found.values()], pa.list_(pa.int64()))], ["vec", "ids"])

    part = rows.select("vec", F.array("id").alias("ids")).mapInArrow(run, "vec binary, ids array<bigint>")
    return part.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def _capped(best: list, k: int, own: int | None) -> list:
    """Sorted (-score, id) with k entries of an id at most, and none of `own`."""
    seen: dict[int, int] = {}
    out = []
    for s, d in best:
        seen[d] = seen.get(d, 0) + 1
        if seen[d] <= k and d != own:
            out.append((s, d))
    return out


def search(df: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0) -> DataFrame:
    """(query_id, rank, id, score): each query row's k best other rows.  is_query: a condition on column `id`."""
    spark, kind = df.sparkSession, KINDS[_width(df, vec_col)]
    rows = materialize(valid(df, id_col, vec_col), "vectors")
    common = rows.groupBy(F.length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = "query_id long, rank int, id long, score double"
    if common is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.length("vec") == common["n"])
    asked = materialize(rows.where(is_query).select("id", "vec").distinct(), "asked")
    m = asked.count()
    # vectors of one query id: more than one fill places of its own in answers
    most_own = asked.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    several = most_own > 1
    places = 2 * k if several else k + 1
    each = materialize(distinct_vectors(rows, places), "each")
    n = each.count()
    queries = materialize(asked.groupBy("vec").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("own")).withColumn("qn", F.monotonically_increasing_id()), "queries")

    doubles = lambda many: np.stack([np.frombuffer(v, kind) for v in many]).astype(np.float64)
    lists = max(1, min(MOST_LISTS, math.ceil(n / LIST_ROWS)))
    want = max(FIT_ROWS, min(MOST_FIT_ROWS, ROWS_A_LIST * lists))
    got = sorted(bytes(r["vec"]) for r in each.select("vec").where(hash_sample(["vec"], 5, want, n)).orderBy(F.xxhash64("vec", F.lit(5)), "vec").limit(want).collect())
    if not got:  # a sample of few rows can be empty
        got = [bytes(r["vec"]) for r in each.select("vec").limit(1).collect()]
    x = doubles(got)[np.random.default_rng(seed).permutation(len(got))]
    held = spark.sparkContext.broadcast(fit_index(x, lists, k, seed=seed))  # bounded codebooks

    def code(batches):
        for batch in batches:
            vecs = batch.column(0).to_pylist()
            if vecs:
                x = doubles(vecs)
                at = held.value.assign(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in held.value.encode(x, at)], pa.binary()), pa.array(at)], ["vec", "ids", "code", "list"])

    index = materialize(each.mapInArrow(code, "vec binary, ids array<bigint>, code binary, list int"), "index")
    sizes = np.zeros(lists, np.int64)
    for r in index.groupBy("list").count().collect():  # MOST_LISTS rows at most
        sizes[r["list"]] = r["count"]
    sizes = sizes[: len(held.value.centres)]
    need = k + 1 + most_own

    def visit(batches):
        for batch in batches:
            vecs = batch.column(0).to_pylist()
            if vecs:
                near = held.value.visits(doubles(vecs), sizes, need)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v.tolist() for v in near], pa.list_(pa.int32()))], ["vec", "qn", "own", "lists"])

    single = F.when(F.col("times") == 1, F.col("own")).alias("own")  # an id that alone asks a vector
    visits = materialize(queries.select("vec", "qn", single).mapInArrow(visit, "vec binary, qn long, own long, lists array<int>"), "visits")
    visits = visits.select("vec", "qn", "own", F.explode("lists").alias("list"))
    # blocks of each list; one row a list, MOST_LISTS at most
    parts = lambda of, size, name: of.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    blocks = F.broadcast(parts(index, CANDIDATE_BLOCK, "cbs").join(parts(visits, QUERY_BLOCK, "qbs"), "list"))
    block = lambda count, salt: F.pmod(F.xxhash64("vec", F.lit(salt)), count.cast("long")).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    cands = index.join(blocks, "list").withColumn("cb", block(F.col("cbs"), 3)).withColumn("qb", every(F.col("qbs"))).select("list", "cb", "qb", "vec", "ids", "code")
    posed = visits.join(blocks, "list").withColumn("qb", block(F.col("qbs"), 2)).withColumn("cb", every(F.col("cbs"))).select("list", "cb", "qb", "vec", "qn", "own")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [], [], []
        if len(left) and len(right):
            q, x, qn = doubles(left.column("vec").to_pylist()), doubles(right.column("vec").to_pylist()), left.column("qn").to_pylist()
            ids, own = right.column("ids").to_pylist(), left.column("own").to_pylist()
            alone = np.array([i[0] if len(i) == 1 else -1 for i in ids], np.int64)  # candidates of one id only
            packed = np.stack([np.frombuffer(v, np.uint8) for v in right.column("code").to_pylist()])
            keep = held.value.keep(len(x))
            for lo in range(0, len(q), 64):
                rough = scan(held.value.quantiser.tables(q[lo : lo + 64]), packed)
                for i in range(len(rough)):
                    if several and own[lo + i] is not None:
                        rough[i, (alone == own[lo + i]) & (alone != -1)] = -np.inf
                    near = np.argpartition(-rough[i], keep - 1)[:keep]
                    score = (x[near] * q[lo + i]).sum(axis=1)
                    if len(near) > 4 * places:  # the rest can't be among the best; ties stay
                        least = np.partition(score, len(score) - places)[len(score) - places]
                        near, score = (near[score >= least], score[score >= least]) if not several else (near, score)
                    best = sorted((-s, d) for s, j in zip(score.tolist(), near.tolist(), strict=True) for d in ids[j])
                    best = _capped(best, k, own[lo + i])[:places] if several else best[:places]
                    out_q += [qn[lo + i]] * len(best)
                    out_i += [d for _, d in best]
                    out_s += [-s for s, _ in best]
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_i, pa.int64()), pa.array(out_s, pa.float64())], ["qn", "id", "score"])

    met = posed.groupBy("list", "cb", "qb").cogroup(cands.groupBy("list", "cb", "qb")).applyInArrow(meet, "qn long, id long, score double")
    if several:
        met = met.withColumn("turn", F.row_number().over(Window.partitionBy("qn", "id").orderBy(F.desc("score")))).where(F.col("turn") <= k).drop("turn")
    place = F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("score"), "id"))
    top = met.withColumn("at", place).where(F.col("at") <= places)
    best = materialize(top.groupBy("qn").agg(F.array_sort(F.collect_list(F.struct("at", "id", "score"))).alias("best")), "best")  # k + 1 entries a query
    floor = max(2, int(m * HOT_SHARE))
    answers = queries.join(best, "qn").select("vec", "times", "best")
    first = asked.join(F.broadcast(answers.where(F.col("times") >= floor)), "vec", "left")
    rest = first.where("best is null").select("id", "vec").join(answers.where(F.col("times") < floor).select("vec", "best"), "vec")
    own = first.where("best is not null").select(F.col("id").alias("query_id"), "best").unionByName(rest.select(F.col("id").alias("query_id"), "best"))
    listed = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(listed).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
