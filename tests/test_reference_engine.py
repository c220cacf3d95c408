"""Plans and operators on fictional parties, with answers worked out by hand."""

import datetime
import io
import random
import urllib.error

import pytest
from parties import ROWS, frame, party
from pyspark.sql import functions as F

from partyloom.engine import Engine
from partyloom.operators import crosslist, graph, ownership, present, quality, stats
from partyloom.operators.components import connected_components
from partyloom.plans import below_the_line, screening
from partyloom.plans import snapshot as snap
from partyloom.sources.fetch import fetch


@pytest.fixture(scope="module")
def parties(spark):
    return snap.finalize(frame(spark)).persist()


@pytest.fixture(scope="module")
def engine(parties):
    return Engine(parties, expected=("OFAC", "EU", "UN", "UK", "BIS"))


def hits(engine, *rows, **kw):
    """{q: {party: hit}} of a batch of (q,) or (q, yob, country)."""
    full = [(i, r[0], *(r[1:] if len(r) > 1 else ())) for i, r in enumerate(rows)]
    ddl = "qid int, q string" + (", yob string, country string" if len(rows[0]) > 1 else "")
    found = [{} for _ in rows]
    for r in engine.screen(engine.spark.createDataFrame(full, ddl), **kw).collect():
        found[r["qid"]][r["party_id"]] = r
    return found


def test_batch_of_names_and_identifiers(engine):
    surname, own, order, weak, none, imo, cml = hits(engine, ("Sokolin",), ("ВИКТОР СОКОЛИН",), ("muhammad khan ali",), ("Khan",), ("",), ("9345678",), ("CML",))
    assert surname["1"]["score"] == 0.96 and surname["1"]["match_type"] == "strong" and surname["1"]["matched_field"] == "primary name"
    assert "1" in own and order["4"]["score"] == 1.0 and "4" not in weak and none == {}
    assert (imo["3"]["score"], imo["3"]["match_type"], imo["3"]["matched_field"]) == (1.0, "identifier", "IMO")
    assert cml["5"]["score"] == 0.96 and cml["5"]["matched_field"] == "alias (A.K.A.)"


def test_modifiers(engine):
    rows = [("Sokolin", "1968", ""), ("Sokolin", "1975", ""), ("Sokolin", "", "Russia"), ("Sokolin Shipping LLC", "", "Moscow Oblast"), ("Harbor Trade Company", "", "Syria")]
    year, other, country, odd, text = hits(engine, *rows)
    assert year["1"]["score"] == 1.0 and "1" not in other
    assert country["1"]["corroborated"] and country["1"]["score"] == 1.0
    assert odd["2"]["conflict"] and text["7"]["corroborated"]


def test_search_filters_and_parameters(engine):
    assert {r["party_id"] for r in engine.search("Sokolin", authority="EU").collect()} == {"EU-1", "EU-2"}
    assert set(hits(engine, ("Caspian Marine Lines",), list_name="Consolidated List")[0]) == {"5"}
    assert engine.search("").isEmpty()
    assert screening.threshold_of("0") == 0.95 and screening.threshold_of("") == 0.95 and screening.threshold_of("0.99") == 0.99
    assert screening.threshold_of("x", least=0.8) == 0.95 and screening.threshold_of("0.1", least=0.8) == 0.8


def test_blocking_loses_nothing(spark, parties):
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(["Sokolin Shiping", "Viktor Sokolin Petrov", "Northern Gull", "Muhamad Ali Khan", "CML", "Redstone Holding", "ab", "Orion Golf Metals", "Petrov"])], "qid int, q string")
    fast, full = (screening.screen(queries, parties, 0.95, exhaustive=e).select("qid", "party_id", "score") for e in (False, True))
    assert fast.exceptAll(full).isEmpty() and full.exceptAll(fast).isEmpty() and not full.isEmpty()


def test_below_the_line(engine):
    out = engine.below_the_line("Sokolin Shipping LLC")
    curve = {r["step"]: r["hits"] for r in out["curve"].collect()}
    assert len(curve) == 21 and curve[0.8] >= curve[0.9] >= curve[1.0] >= 1
    assert all(r["score"] < 0.95 for r in out["marginal"].collect())
    assert {r["id"] for r in below_the_line.prefix_hits(engine.parties, "gul").collect()} == {"3", "UN-1"}
    kinds = engine.spark.createDataFrame([("9345678",), ("273000111",), ("0x" + "a" * 40,), ("hello",)], "q string").select(below_the_line.query_shape(F.col("q"))).collect()
    assert [r[0] for r in kinds] == ["imo", "mmsi", "crypto", ""]


def test_snapshot_finalize(spark):
    rows = [party("9", "X", lists=("Consolidated List",)), party("9", "X", lists=("Non-SDN CMIC List",)), party("8", "Y", relations=[("Linked to", "9", ""), ("Linked to", "77", "")], identifiers=[("National ID", "Russia"), ("National ID", "R1")])]
    out = {r["id"]: r for r in snap.finalize(frame(spark, rows)).collect()}
    assert out["9"]["list"] == "Non-SDN CMIC List" and sorted(out["9"]["lists"]) == ["Consolidated List", "Non-SDN CMIC List"]
    assert [(r["relatedName"], r["inSnapshot"]) for r in out["8"]["relationships"]] == [("X", True), ("Entity 77 (unlisted)", False)]
    assert [i["value"] for i in out["8"]["identifiers"]] == ["R1"]


def test_assembly_carries_failed_sources_forward(spark, parties):
    def broken():
        raise OSError("gone")

    done = snap.assemble([snap.Source("a", ("OFAC",), lambda: parties.where("authority = 'OFAC'"), 1), snap.Source("b", ("EU",), broken), snap.Source("c", ("UN",), lambda: parties.limit(0), 5)], parties)
    assert [x["ok"] for x in done.log] == [True, False, False] and done.parties.count() == 8 + 2 + 1
    assert snap.carry_forward(parties, spark.createDataFrame([("EU",)], "authority string")).count() == 2
    row = snap.coverage(["OFAC", "EU", "BIS"], parties, parties.where("authority <> 'EU'")).first()
    assert (row["missing"], row["regression"], row["publishable"]) == (["BIS", "EU"], ["EU"], False)


def test_delta_and_pages(spark, parties):
    now = parties.where("id <> '8'").unionByName(frame(spark, [party("99", "New One")]))
    out = snap.delta(parties, now).collect()
    assert [(r["change"], r["id"]) for r in out] == [("added", "99"), ("removed", "8")]
    assert [r["id"] for r in present.page(parties, ["id"], 2, 3).collect()] == ["3", "4", "5"]


def test_stats(engine):
    s = engine.stats(F.lit(datetime.date(2023, 6, 10)))
    t = s["totals"].first()
    assert (t["parties"], t["dated"], str(t["oldest"]), str(t["newest"]), t["added_30"], t["added_90"]) == (12, 11, "2023-05-01", "2023-06-01", 1, 11)
    assert (t["with_aliases"], t["with_relationships"], t["edges"], t["ownership_edges"]) == (2, 6, 7, 4)
    assert {r["name"]: r["count"] for r in s["authorities"].collect()} == {"OFAC": 8, "EU": 2, "UK": 1, "UN": 1}
    assert {r["name"]: r["count"] for r in s["countries"].collect()}["Russia"] == 3
    months = {r["month"]: r["count"] for r in s["months"].collect()}
    assert len(months) == 24 and months["2023-06"] == 1 and months["2023-05"] == 10 and months["2021-07"] == 0
    assert len(s["years"].collect()) == 16 and s["recents"].count() == 11


def test_quality_gate(spark, parties):
    p, d = quality.profile(parties), quality.derived(parties)
    ofac = {r["authority"]: r for r in p.collect()}["OFAC"]
    assert (ofac["count"], ofac["aliasRate"], ofac["relationshipEdges"]) == (8, 2 / 8, 7)
    assert d.first()["dobParseRate"] == 1.0
    assert quality.compare(p, p, d, d).isEmpty()
    worse = parties.withColumn("addresses", F.array().cast("array<struct<full:string,country:string>>"))
    bad = quality.compare(quality.profile(worse), p, quality.derived(worse), d)
    assert "OFAC.addressRate" in {r["metric"] for r in bad.collect()} and quality.decision(bad) == quality.REFUSED
    renamed = parties.withColumn("attributes", F.transform("attributes", lambda a: F.struct(a["group"].alias("group"), F.lit("Odd").alias("label"), a["value"].alias("value"))))
    assert quality.decision(quality.compare(quality.profile(renamed), None, quality.derived(renamed), None)) == quality.PUBLISHED_WITH_ALARM
    assert quality.should_retry([{"ok": True}, {"ok": False}]) and not quality.should_retry([{"ok": True}])


def test_entity_resolution(engine):
    links = {(r["a"], r["b"]): r["basis"] for r in crosslist.links(crosslist.facts(engine.parties)).collect()}
    assert links[("1", "EU-1")] == "name+dob"
    assert links[("2", "EU-2")] == "identifier"
    assert ("1", "UK-1") not in links and ("EU-1", "UK-1") not in links
    rows = {r["id"]: r for r in engine.clusters.collect()}
    assert rows["EU-1"]["cluster_id"] == "1" and rows["EU-2"]["cluster_id"] == "2"
    seen = engine.cross_listing("1").first()
    assert seen["also_listed_by"] == ["EU"] and seen["confidence"] == "high"
    assert crosslist.summary(engine.clusters, engine.parties).first()["cross_authority"] == 2


def test_identifier_shared_by_many_is_ignored(spark):
    rows = [party(str(i), "Same Name Bank", identifiers=[("Registration", "770401001")]) for i in range(5)]
    facts = crosslist.facts(frame(spark, rows))
    assert crosslist._pairs(facts, "keys", crosslist.MOST_PER_KEY).isEmpty()


def test_ownership(engine):
    rows = {r["id"]: r for r in ownership.profile(engine.parties, engine.clusters).collect()}
    assert [(x["owner"], x["hops"]) for x in rows["2"]["blocked_owners"]] == [("1", 1)]
    assert [(x["owner"], x["hops"], x["path"]) for x in rows["7"]["blocked_owners"]] == [("2", 1, ["7", "2"]), ("1", 2, ["7", "2", "1"])]
    assert rows["7"]["aggregation_candidate"] and [x["id"] for x in rows["1"]["subsidiaries"]] == ["2"] and [tuple(x) for x in rows["8"]["controls"]] == [("1", "Viktor Petrov Sokolin", True)]
    assert rows["6"]["blocked_owners"] == [] and rows["6"]["note"] == ownership.NO_CHAIN and not rows["6"]["self_blocked"]
    assert all((r["note"] == ownership.REACHES) == bool(r["blocked_owners"]) for r in rows.values()) and set(rows) == {r["id"] for r in engine.parties.select("id").collect()}
    for listing, twin in (("EU-2", "2"),):  # a listing is answered for its party
        one = engine.ownership(listing).first()
        assert rows["EU-1"]["subsidiaries"] == rows["1"]["subsidiaries"]
        assert (one["id"], one["blocked_owners"], one["subsidiaries"], one["self_blocked"]) == (listing, rows[twin]["blocked_owners"], rows[twin]["subsidiaries"], True)
    with pytest.raises(ValueError):
        engine.ownership("1; drop")
    groups = {r["id"]: (r["group_id"], r["size"], r["label"]) for r in ownership.groups(engine.parties, engine.clusters).collect()}
    assert groups["1"] == groups["EU-1"] == groups["7"] and groups["1"][1] == 3
    over = ownership.overview(engine.parties, engine.clusters).first()
    assert (over["with_blocked_owner"], over["several_owners"]) == (2, 1)


def test_graph(engine):
    net = engine.ego_network("1", 2)
    assert {r["id"] for r in net["nodes"].collect()} == {"1", "2", "3", "7", "8"}
    m = net["metrics"].first()
    assert (m["nodes"], m["edges"]) == (5, 6) and m["top"][0] == "2"
    levels = {r["id"]: r["level"] for r in net["levels"].collect()}
    assert levels["1"] == 0 and levels["2"] > 0
    assert graph.layout(net["levels"]).count() == len(levels)
    ego = {r["id"] for r in engine.ego_network("6", 1)["nodes"].collect()}
    assert ego == {"6", "name:redwall_group_co_ltd"}
    assert graph.nodes(engine.parties, engine.edges).where("external").count() == 1
    pair = graph.collapse_parallel(engine.edges).where("a = '1' and b = '2'").first()
    assert pair["ownership"] and pair["mutual"]


def test_components_on_chain_and_cycle(spark):
    e = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z2"), ("z2", "z1"), ("q", "q")], "src string, dst string")
    roots = {r["node"]: r["root"] for r in connected_components(e).collect()}
    assert {roots[f"n{i:03}"] for i in range(61)} == {"n000"} and roots["z2"] == "z1" and roots["q"] == "q"


def test_views(spark, engine):
    ranked = engine.search("Sokolin")
    note = present.tie_note(ranked, engine.clusters).first()
    assert note is None or note["tied"] >= 3
    assert present.group_sorted(ranked, ownership.groups(engine.parties, engine.clusters)).orderBy("place").first()["group_id"] is not None
    rows = present.result_rows(ranked, engine.parties)
    assert len(rows.columns) == 15 and rows.count() == ranked.count()
    assert {r["field"] for r in present.record_rows(engine.entity("1")).collect()} >= {"id", "name", "Date of Birth"}
    facts = {r["id"]: r for r in present.identity_facts(engine.parties).collect()}
    assert facts["1"]["born"] == "12 Mar 1968" and facts["2"]["nationality"] == "Russia"
    word = lambda i: engine.entity(i).select(present.determination(F.col("authority"), F.col("lists"), ownership.is_blocking(F.col("lists"), F.col("list"), F.col("sanctionsTypes")))).first()[0]
    assert [word(i) for i in ("1", "5", "6", "8", "EU-1")] == ["Block", "Block", "Securities restriction", "Sectoral restriction", "EU asset freeze"]
    assert spark.range(1).select(present.short_name(F.lit("Sokolin Shipping LLC"))).first()[0] == "Sokolin Shipping"
    assert present.recent_filter(engine.parties, words="shipping").count() == 2
    fresh = spark.createDataFrame([("OFAC", datetime.datetime(2024, 1, 1)), ("EU", datetime.datetime(2024, 1, 2))], "authority string, as_of timestamp")
    meta = engine.meta(fresh, F.lit(datetime.datetime(2024, 1, 2, 12)), 1).first()
    assert meta["missing"] == ["BIS"] and meta["stale"] == ["OFAC"] and "not refreshing" in meta["banner"]
    assert present.memo({"id": "1", "name": "X", "type": "Entity"}).startswith("X (1)")
    assert present.attribute_groups(engine.entity("1")).first()["position"] == 1


def test_publish(engine, tmp_path):
    assert engine.publish(str(tmp_path), "1") in (quality.PUBLISHED, quality.PUBLISHED_WITH_ALARM)
    back = engine.spark.read.parquet(f"{tmp_path}/version=1")
    assert engine.published_changes(str(tmp_path), "1") is None and snap.current(engine.spark, f"{tmp_path}/none") is None
    before = engine.parties.where("id <> '3'")
    assert engine.publish(str(tmp_path), "2", before) != quality.REFUSED
    assert [(r["change"], r["id"]) for r in engine.published_changes(str(tmp_path), "2").collect()] == [("added", "3")]
    version, found, age = snap.current(engine.spark, str(tmp_path))
    assert version == "2" and found.count() == len(ROWS) and age >= 0
    assert snap.read_aside(engine.spark, str(tmp_path), "quality", "2").count() == engine.parties.select("authority").distinct().count()
    assert back.count() == len(ROWS) and engine.health()["parties"] == len(ROWS)
    present.write_csv(present.record_rows(engine.parties), f"{tmp_path}/csv")
    text = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("part-*"))
    assert text.startswith("\ufeff\"id\",\"at\"".encode()) and text.count(b"\r\n") == present.record_rows(engine.parties).count() + 1
    present.write_csv(present.record_rows(engine.entity("1")), f"{tmp_path}/trailer", trailer=present.provenance("now", "7", 0.95))
    assert b'"Threshold","0.95"\r\n' in b"".join(p.read_bytes() for p in (tmp_path / "trailer").glob("part-*"))
    present.write_json(engine.parties, f"{tmp_path}/json")
    assert engine.spark.read.json(f"{tmp_path}/json").count() == len(ROWS)


def test_results_are_enriched(engine):
    rows = {r["party_id"]: r for r in engine.results("Sokolin Shipping").collect()}
    assert rows["2"]["cross_listed"]["also_listed_by"] == ["EU"] and rows["2"]["cluster"]["size"] == 3
    assert rows["2"]["derivative"]["direct"] == 1 and rows["EU-2"]["derivative"] == rows["2"]["derivative"] and rows["2"]["lists"] == ["SDN List"]
    assert {r["party_id"] for r in engine.kept_results("Sokolin Shipping")} == set(rows)
    assert engine.kept_results("Sokolin Shipping") is engine.kept_results(" Sokolin Shipping")


def test_export_control_never_blocks(spark):
    word = lambda a, *lists: spark.range(1).select(present.determination(F.lit(a), F.array(*map(F.lit, lists)), F.lit(True))).first()[0]
    assert word("BIS", "Entity List (EL) - Bureau of Industry and Security") == "Export licence required"
    assert word("BIS", "Denied Persons List (DPL)") == "Export privileges denied" and word("State", "ITAR Debarred (DTC)") == "Debarred from defence trade"
    assert word("BIS", "MILITARY END-USER (MEU) List") == "Military end-user licence required" and word("OFAC", "SDN List", "CMIC") == "Block"


def test_known_minimum_of_a_source(parties):
    done = snap.assemble([snap.Source("EU", ("EU",), lambda: parties.where("authority = 'EU'")), snap.Source("x", ("ZZ",), lambda: parties.limit(1))], parties)
    assert [(r["ok"], r["carriedForward"]) for r in done.log] == [(False, True), (True, False)] and "at least 1000" in done.log[0]["error"]


def test_scan_in_blocks_of_queries(spark, parties, monkeypatch):
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(("Sokolin Shiping", "Delta Frieght", "Redstone Holdings", "MV Northern Gull", "Orion Metals"))], "qid int, q string")
    rows = lambda: sorted(map(tuple, screening.screen(asked, parties, 0.8, exhaustive=True).collect()))
    whole = rows()
    monkeypatch.setattr(screening, "MOST_BROADCAST", 2)
    assert rows() == whole and whole


def test_fetch_retries():
    calls, waits = [], []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {"Retry-After": "2"}, None)
        return io.BytesIO(b"ok")

    assert fetch("http://x", opener=opener, sleep=waits.append) == b"ok" and len(calls) == 3 and len(waits) == 2
    with pytest.raises(urllib.error.HTTPError):
        fetch("http://x", opener=lambda u, timeout: (_ for _ in ()).throw(urllib.error.HTTPError(u, 404, "no", {}, None)), sleep=waits.append)


def test_gram_lane_counts_whole_sets(spark):
    """The rarest grams alone find every party that shares a quarter of a query's grams."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("ABCD") for _ in range(r.randint(1, 7)))
    asked = [(i, [word() for _ in range(r.randint(1, 3))]) for i in range(60)] + [(60, []), (61, ["AB"])]
    held = [(f"p{i % 90}", [word() for _ in range(r.randint(1, 3))]) for i in range(120)] + [("common", ["ABCDABCD"])] * 3
    q = spark.createDataFrame(asked, "qid long, q_tokens array<string>")
    names = spark.createDataFrame(held, "party_id string, tokens array<string>")
    sets = lambda df, key, col: df.select(key, screening.gram_set(F.col(col)).alias("g")).collect()
    of = {}
    for party, g in sets(names, "party_id", "tokens"):
        of.setdefault(party, set()).update(g)
    wanted = sorted((i, p) for i, g in sets(q, "qid", "q_tokens") for p, h in of.items() if len(h & set(g)) >= max(1, len(g) // 4))
    assert wanted and sorted(map(tuple, screening.gram_lane(q, names).collect())) == wanted
    assert sorted(map(tuple, screening.gram_lane(q.union(q), names).collect())) == wanted
    assert screening.gram_lane(q, names.limit(0)).isEmpty() and screening.gram_lane(q.limit(0), names).isEmpty()


def test_hashes_of_grams_differ(spark):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    df = spark.range(2 * 36**3).select(F.concat(F.when(F.col("id") % 2 == 0, "~").otherwise(""), *[F.substring(F.lit(letters), (F.floor(F.col("id") / (2 * 36**k)) % 36 + 1).cast("int"), F.lit(1)) for k in range(3)]).alias("g"))
    assert df.distinct().count() == df.select(F.xxhash64("g")).distinct().count() == 2 * 36**3
