"""Whole results where a group is larger than any in the test tables."""

import numpy as np
from pyspark.sql import functions as F

from partyloom.functions import batch_similarity, gram_sets
from partyloom.operators import graph
from partyloom.operators.shared import dealt
from partyloom.plans import recall, screening
from partyloom.queries import QUERIES
from tests.parties import frame, party


def test_ego_network_is_not_cut(spark, tmp_path):
    n = 10_500
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(3, 1)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    got = QUERIES["g2_ego_network"](spark, str(tmp_path)).groupBy("hop").count().collect()
    assert {r["hop"]: r["count"] for r in got} == {0: 1, 1: n + 1}


def test_screening_of_stated_pairs_is_the_same(spark):
    parties = frame(spark)
    asked = spark.createDataFrame([("1", "Viktor Petrov Sokolin", "1968", "Russia"), ("2", "Sokolin Shiping", "", ""), ("UK-1", "Viktor Sokolin", "1990", ""), ("3", "9345678", "", ""), ("4", "Redstone Holdings", "", "")], "qid string, q string, yob string, country string")
    among = asked.select("qid", F.col("qid").alias("party_id"))
    want = sorted(map(tuple, screening.screen(asked, parties, 0.91).where("qid = party_id").collect()))
    got = screening.screen(asked, parties, 0.91, among=among)
    assert want and sorted(map(tuple, got.collect())) == want


def test_parties_of_equal_names_are_scored_once_and_all_given_back(spark):
    rows = [party(f"{k}-{n}", n, aliases=a) for k in range(4) for n, a in (("Redstone Holdings", ()), ("Caspian Marine Lines", ("CML JSC",)))] + [party("x", "Redstone Holdings", aliases=("Redstone",))]
    parties = frame(spark, rows)
    same = screening.same_names(screening.names_table(parties))
    assert {r["party_id"]: r["lead"] for r in same.collect()} == {r["id"]: r["id"] if r["id"] == "x" else "0-" + r["name"] for r in rows}
    asked = spark.createDataFrame([("a", "Redstone Holding"), ("b", "Caspian Marine Line")], "qid string, q string")
    for exhaustive in (False, True):
        got = {(r["qid"], r["party_id"]) for r in screening.screen(asked, parties, 0.95, exhaustive=exhaustive).collect()}
        assert got == {("b" if "Caspian" in r["name"] else "a", r["id"]) for r in rows}


def test_bounds_of_word_similarity_hold():
    words = ["SUPPLIER", "SUPPLIEER", "CUSTOMER", "PHILIP", "FILIP", "YUSUF", "JOUSEF", "X", "AL", "000000123", "000000132", "ÉÉ", "中国", "AAAAAAA", "SCHMIDT", "SHMIT"]
    at = np.arange(len(words))
    i, j = np.repeat(at, len(at)), np.tile(at, len(at))
    for confusable in (frozenset(), frozenset({"OU", "EA"})):
        w = batch_similarity.Words(words)
        most = batch_similarity.sims_at_most(words, words, i, j, bool(confusable))
        assert (batch_similarity.token_sims(w, w, i, j, confusable) <= most).all()
        assert most[words.index("CUSTOMER")] < 0.8  # against SUPPLIER: no kernel has to run


def test_parallel_edges_collapse_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINK_ROWS", 10)
    rows = [(a, b, k == 0, f"t{k}") for k in range(2) for a, b in [("a", "b"), ("b", "a"), ("c", "c"), ("d", "c")]] + [(f"n{k}", "hub", False, "x") for k in range(40)]
    out = graph.collapse_parallel(spark.createDataFrame(rows, "src string, dst string, ownership boolean, type string"))
    assert out.rdd.getNumPartitions() == 5
    got = {(r["a"], r["b"]): (r["ownership"], r["types"], r["mutual"]) for r in out.collect()}
    assert got == {("a", "b"): (True, ["t0", "t1"], True), ("c", "c"): (True, ["t0", "t1"], False), ("c", "d"): (True, ["t0", "t1"], False)} | {("hub", f"n{k}"): (False, ["x"], False) for k in range(40)}


def test_rows_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    out = dealt(spark.read.parquet(f"{tmp_path}/one"), 100)
    sizes = out.rdd.glom().map(len).collect()
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) <= 200


def test_table_functions_are_dealt_and_make_no_frame_a_row(spark):
    for name in ("n10_name_rows", "s8_remark_rows"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan and "REPARTITION_BY_NUM" in plan


def test_gram_lane_joins_no_postings_and_goes_in_blocks(spark, monkeypatch):
    words = ["SUPPLIER", "CUSTOMER", "SCHMIDT", "ÉÉPHKH", "ABAB", "X"]
    asked = [(i, [words[i % 6], f"{i * 7:05}"]) for i in range(40)] + [(3, ["OTHER", "NAME"]), (None, ["SUPPLIER"]), (90, ["AB"])]
    held = [(f"p{i}", [words[i * 5 % 6], f"{i * 3 % 60:05}"]) for i in range(90)] + [("p1", ["OTHER", "NAMES"])]
    q, names = spark.createDataFrame(asked, "qid long, q_tokens array<string>"), spark.createDataFrame(held, "party_id string, tokens array<string>")
    of = {}
    for party, tokens in held:
        of.setdefault(party, []).append(tokens)
    wanted = set()
    for qid, tokens in asked:
        mine = gram_sets.gram_set_of([tokens])
        wanted |= {(qid, p) for p, lists in of.items() if qid is not None and len(mine & gram_sets.gram_set_of(lists)) >= max(1, len(mine) // 4)}
    whole = screening.gram_lane(q, names)
    assert sorted(map(tuple, whole.collect())) == sorted(wanted) and (3, "p1") in wanted
    assert not any(w in whole._jdf.queryExecution().executedPlan().toString() for w in ("Join", "Window"))
    for module, name, value in ((screening, "MOST_SETS", 8), (gram_sets, "CELLS", 64), (gram_sets, "ROWS_OUT", 5), (gram_sets, "RARE", 2)):
        monkeypatch.setattr(module, name, value)
    assert sorted(map(tuple, screening.gram_lane(q, names).collect())) == sorted(wanted)


def test_gram_sets_equal_the_columns(spark):
    lists = [["SCHMIDT", "PHILLIP"], ["X"], ["ÉÉ", "中国中国"], ["KHXQUWRIGHT", "00123"], ["HHHH"], []]
    got = spark.createDataFrame([(t,) for t in lists], "t array<string>").select(screening.gram_set(F.col("t")).alias("g")).collect()
    assert [set(r["g"]) for r in got] == [gram_sets.gram_set_of([t]) for t in lists]


def test_scan_compares_parts_of_queries_and_makes_no_rows_of_pairs(spark, monkeypatch):
    parties = frame(spark)
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(("Sokolin Shiping", "Delta Frieght", "Redstone Holdings", "MV Northern Gull", "Orion Gulf Metal"))], "qid int, q string")
    whole = sorted(map(tuple, screening.screen(asked, parties, exhaustive=False).collect()))
    monkeypatch.setattr(batch_similarity, "SCAN_QUERIES", 2)
    got = screening.screen(asked, parties)
    assert whole and sorted(map(tuple, got.collect())) == whole
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_recall_reads_names_once(spark, monkeypatch):
    read, names_table = [], screening.names_table
    monkeypatch.setattr(screening, "names_table", lambda *of: read.append(1) or names_table(*of))
    parties = frame(spark)
    told = recall.differential(recall.perturbed(parties, 6), parties, 0.9).collect()
    assert len(read) == 1 and sum(r["compared"] for r in told) > 0 and not any(r["lost"] or r["gained"] for r in told)
