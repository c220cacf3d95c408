"""Dates, countries, names in reading order, sources and table functions as Spark plans."""

import random

import pytest
from pyspark.sql import functions as F

from partyloom import engine as facade
from partyloom.functions import countries, dates
from partyloom.functions.text import reading_order
from partyloom.operators import present, stats
from partyloom.plans import recall, screening
from partyloom.plans import snapshot as snap
from partyloom.sources import ofac_flat, table_functions
from tests.parties import ROWS, frame, name, party


def plan(df):
    return df._jdf.queryExecution().toString()


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, v string").repartition(3)


def test_no_python_worker_reads_dates_or_countries(spark):
    df = texts(spark, ["x"])
    v = F.col("v")
    told = df.select(dates.parse_date_value(v).alias("a"), dates.parse_date_values(F.array(v)).alias("b"), countries.parse_countries(v).alias("c"), countries.codes_of(F.array(v)).alias("d"), countries.code_in_text(v).alias("e"), countries.known(F.array(v)).alias("f"))
    assert not any(w in plan(told) for w in ("Python", "ArrowEval"))


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("1979–1975", ("1975-01-01", "1979-12-31", "range", False)),
        ("1990 to Jan 1990", ("1990-01-01", "1990-01-31", "range", False)),
        ("x to 1960", ("1960-01-01", "1960-12-31", "year", False)),
        ("1960 to 1961 to 1962", None),
        ("ca. Sept. 1971 (POB: x)", ("1971-09-01", "1971-09-30", "month", True)),
        ("29/02/1900", ("1900-02-01", "1900-02-28", "month", False)),
        ("1990-13-01", ("1990-01-01", "1990-12-31", "year", False)),
        ("00/13/1990", ("1990-01-01", "1990-12-31", "year", False)),
        ("1 Foo 1990", None),
        ("0999", None),
        (None, None),
    ],
)
def test_dates_of_every_kind(spark, raw, want):
    got = texts(spark, [raw]).select(dates.parse_date_value(F.col("v")).alias("d")).first()["d"]
    assert (got and tuple(got)) == want


def plain_code(words, known):
    found, i = "", 0
    while i < len(words):
        n = next((n for n in range(min(7, len(words) - i), 0, -1) if " ".join(words[i : i + n]) in known), 0)
        if n:
            found = known[" ".join(words[i : i + n])]
        i += n or 1
    return found


def test_countries_in_text_like_a_scan_of_words(spark):
    spark.range(1).count()
    known, rng = countries._phrases(), random.Random(5)
    some = [*known, "KOREA", "GUINEA", "UNITED", "STATES OF", "NORTH", "X", "OMANI", "IRELAND", "GREAT BRITAIN AND"]
    values = [rng.choice(["", "- ", "a, "]).join(f"{w} " for w in rng.choices(some, k=rng.randrange(1, 7))) for _ in range(800)]
    got = {r["i"]: r["code"] for r in texts(spark, values).select("i", countries.code_in_text(F.col("v")).alias("code")).collect()}
    import re

    assert got == {i: plain_code(re.sub("[^A-Z]+", " ", v.upper()).split(), known) for i, v in enumerate(values)}


def test_names_sort_as_they_are_read(spark):
    names = ["Zebra", "émile", "Emil", "emile", "Öst", "Olaf", "apple", "Banana", "Émile"]
    df = texts(spark, names)
    want = ["apple", "Banana", "Emil", "emile", "émile", "Émile", "Olaf", "Öst", "Zebra"]
    assert [r["v"] for r in df.orderBy(reading_order("v")).collect()] == want
    assert [r["name"] for r in stats.top_counts(df, F.col("v"), 4).collect()] == want[:4]
    parties = frame(spark, [party(str(i), n) for i, n in enumerate(names)])
    assert [r["name"] for r in snap.delta(parties.limit(0), parties, most=5).collect()] == want[:5]
    hits = parties.select(F.col("id").alias("party_id"), "name", "datePublished", F.lit(1.0).alias("score"), F.lit("primary name").alias("matched_field"))
    assert [r["name"] for r in present.page(hits, present.client_order("name"), 0, 3).collect()] == want[:3]
    assert [r["party_id"] for r in present.page(hits, present.client_order(), 0, 2).collect()] == ["0", "1"]


def test_a_source_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)
    rows = frame(spark, [party(str(i), f"P {i}") for i in range(40)])

    def counted(least):
        def batches(it):
            for b in it:
                read.add(b.num_rows)
                yield b

        return snap.Source("a", ("OFAC",), lambda: rows.mapInArrow(batches, rows.schema), least)

    done = snap.assemble([counted(40)])
    assert done.parties.count() == 40 and done.parties.where("id = '3'").count() == 1 and done.log[0]["count"] == 40 and abs(done.log[0]["ids"] - 40) <= 4
    assert read.value == 40
    cut = snap.assemble([counted(41), snap.Source("b", ("EU",), lambda: rows.limit(1), 1)], rows.withColumn("authority", F.lit("OFAC")).limit(5))
    assert [x["ok"] for x in cut.log] == [False, True] and cut.log[0]["carriedForward"] and "at least 41" in cut.log[0]["error"] and cut.parties.count() == 6


def test_table_functions_equal_columns(spark):
    remarks = ["DOB 12 Mar 1968; alt. DOB 1970; POB X; Passport AB12 (Russia); odd; Tax ID No. 7; ;IMO 1; Digital Currency Address - XBT 1a b", None, "", "C.I. 5 (x); Website y.z; Secondary sanctions risk: q"]
    df = texts(spark, remarks)
    table_functions.register(spark)
    got = spark.sql("SELECT i, r.* FROM {df}, LATERAL remark_rows(v) r", df=df).collect()
    attributes, identifiers = ofac_flat.parse_remarks(F.col("v"))
    want = {r["i"]: (r["a"], r["d"]) for r in df.select("i", attributes.alias("a"), identifiers.alias("d")).collect()}
    for i in want:
        mine = sorted((r for r in got if r["i"] == i), key=lambda r: r["at"])
        assert [(r["group"], r["label"], r["value"]) for r in mine] == [tuple(a) for a in want[i][0]]
        assert [(r["id_type"], r["id_value"]) for r in mine if r["id_value"]] == [tuple(d) for d in want[i][1]]
    parties = frame(spark, [*ROWS, party("n", "No Names"), party("w", "Wéak", aliases=[name("W", low=True, native="ВЭ")])]).withColumn("names", F.when(F.col("id") == "n", F.slice("names", 1, 0)).otherwise(F.col("names")))
    got = spark.sql("SELECT id, n.* FROM {p}, LATERAL name_rows(name, names) n", p=parties).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, snap.candidate_names(parties).collect()))


def test_word_lane_needs_no_nested_loop(spark):
    parties = frame(spark)
    asked = spark.createDataFrame([(i, q, y, c) for i, (q, y, c) in enumerate([("Sokolin", "1968", ""), ("Sokolin Shiping", "", "Russia"), ("CML", "1970", "Syria"), ("Muhamad Khan Ali", "1985", "Pakistan"), ("ab", "", ""), ("Orion Golf", "", "UAE")])], "qid int, q string, yob string, country string")
    fast, full = (screening.screen(asked, parties, 0.95, exhaustive=e) for e in (False, True))
    assert not any(w in plan(fast) for w in ("NestedLoop", "Cartesian")) and "NestedLoop" in plan(full)
    assert fast.exceptAll(full).isEmpty() and full.exceptAll(fast).isEmpty() and full.count() >= 3
    told = recall.differential(recall.perturbed(parties, 30), parties).collect()
    assert {r["family"] for r in told} == {"typo", "acronym", "verbatim", "native"} and sum(r["compared"] for r in told) > 20
    assert sum(r["lost"] + r["gained"] for r in told) == 0


def test_typos_change_one_place(spark):
    names = ["abcdefgh", "Sokolin Shipping", "xyzxyz"] * 30
    df = texts(spark, [f"{n}{i}" for i, n in enumerate(names)])
    kinds = set()
    for r in df.select("v", recall.typo(F.col("v")).alias("t")).collect():
        v, t = r["v"], r["t"]
        assert t[0] == v[0] and abs(len(v) - len(t)) <= 1
        kinds.add("dropped" if len(t) < len(v) else "swapped" if sorted(t) == sorted(v) and t != v else "vowel")
    assert kinds == {"dropped", "swapped", "vowel"}


def test_kept_results_go_by_age_and_number(spark, monkeypatch):
    e = facade.Engine(frame(spark, ROWS[:3]))
    calls = []
    monkeypatch.setattr(e, "search", lambda q, **how: calls.append(q) or spark.createDataFrame([(1,)], "rank int"))
    now = [0.0]
    monkeypatch.setattr(facade.time, "monotonic", lambda: now[0])
    monkeypatch.setattr(facade, "MOST_KEPT", 2)
    for q in ("a", "a", "b", "c", "c", "a"):
        e.kept_results(q)
    assert calls == ["a", "b", "c", "a"]
    now[0] = facade.KEPT_FOR
    e.kept_results("a")
    assert calls == ["a", "b", "c", "a", "a"]
