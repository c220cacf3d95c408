"""What lies below the threshold: the curve, marginal names, literal prefixes and the query's shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partyloom.functions.text import reading_order
from partyloom.functions.vocab import identifier_kind

# The curve's floor, step and list caps.
FLOOR, STEP, STEPS, MOST_MARGINAL, MOST_PREFIX = 0.80, 0.01, 21, 50, 25


def threshold_curve(scores: DataFrame, by: list[str] | None = None, score: str = "score") -> DataFrame:
    """(step, hits): how many scores reach each step from 0.80 to 1.00.

    Scores fall into their highest step first, so the running sum is over 21 rows a group.
    """
    by = by or []
    cell = F.least(F.lit(STEPS - 1), F.floor((F.round(score, 4) - FLOOR) / STEP + 1e-9)).cast("int")
    counts = scores.where(F.round(score, 4) >= FLOOR).groupBy(*by, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    spine = counts.sparkSession.range(STEPS).select(F.col("id").cast("int").alias("cell"))
    keys = scores.select(*by).distinct() if by else None
    grid = F.broadcast(spine) if keys is None else keys.join(F.broadcast(spine), how="cross")
    met = (grid if keys is not None else spine).join(counts, [*by, "cell"], "left")
    run = Window.partitionBy(*by).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return met.select(*by, F.round(FLOOR + STEP * F.col("cell"), 2).alias("step"), F.sum(F.coalesce("n", F.lit(0))).over(run).alias("hits"))


def marginal(hits: DataFrame, threshold: float, most: int = MOST_MARGINAL) -> DataFrame:
    """The best-ranked hits below the threshold: truly the best, in total order (L3)."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), (F.col("matched_field") != "primary name"), "party_id")
    return hits.where((F.col("score") < threshold) & (F.col("score") >= FLOOR)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def starts_word(name: Column, q: Column) -> Column:
    """Whether q starts the name, or the first place that holds it starts a word."""
    up, word = F.upper(name), F.upper(q)
    at = F.position(word, up)
    before = F.substring(up, at - 1, F.lit(1))
    return up.startswith(word) | ((at > 1) & before.rlike("[^A-Z0-9]"))


def prefix_hits(parties: DataFrame, q: str, most: int = MOST_PREFIX) -> DataFrame:
    """Parties with a romanised name in which the word q starts (L4); words only, three characters at least."""
    q = q.strip()
    if len(q) < 3 or " " in q:
        return parties.select("id", "name").limit(0)
    word = F.lit(q)
    return parties.where(F.exists("names", lambda n: F.coalesce(starts_word(n["name"], word), F.lit(False)))).select("id", "name").orderBy(reading_order("name"), "id").limit(most)


def query_shape(q: Column) -> Column:
    """What kind of identifier the query looks like (F8)."""
    s = F.trim(q)
    return (
        F.when(s.rlike(r"^(IMO\s*)?\d{7}$"), "imo")
        .when(s.rlike(r"^\d{9}$"), "mmsi")
        .when(s.rlike(r"^0x[0-9a-fA-F]{40}$"), "crypto")
        .when(s.rlike(r"^[13bc][1-9A-HJ-NP-Za-km-z]{24,60}$"), "crypto")
        .otherwise("")
    )


def identifier_coverage(parties: DataFrame, most: int = 12) -> DataFrame:
    """(type, kind, carriers): parties per identifier type, once each (A10)."""
    each = parties.select("id", F.explode("identifiers.type").alias("type")).distinct()
    return each.groupBy("type").agg(F.count(F.lit(1)).alias("carriers")).withColumn("kind", identifier_kind(F.col("type"))).orderBy(F.desc("carriers"), "type").limit(most)
