"""Whether blocking loses hits (Q6): perturbed names screened by the lanes and by a full scan.

Four families of queries are drawn from the snapshot's own names: typos (a character dropped, two
swapped, or one turned into a vowel), initials, names copied as they are, and names in another
script.  The draw is a hash of the name and a seed, so it is the same under any partitioning; how
many names are drawn is what the check takes as its parameter, the parties are always all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyloom.functions.text import EMPTY, Lexicon, name_tokens, other_script
from partyloom.operators.shared import pinned
from partyloom.plans import screening
from partyloom.plans.snapshot import candidate_names

SAMPLE = 120
SEED = 20260726
#: Names drawn of each family, as a part of the sample, and the shortest cleaned names.
TYPO_FROM, VERBATIM_FROM = 6, 4


def draw(col: Column, place: int, below: Column | int, seed: int = SEED) -> Column:
    """A number from 0 to below - 1, fixed by the value, the place and the seed."""
    return F.pmod(F.xxhash64(col, F.lit(place), F.lit(seed)), F.lit(below) if isinstance(below, int) else below).cast("int")


def clean(col: Column) -> Column:
    """Letters and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, "[^A-Za-z ]", " "), r"\s+", " "))


def typo(name: Column, seed: int = SEED) -> Column:
    """name with one character, never the first, dropped, swapped with the next or turned into a vowel."""
    size = F.length(name)
    i = draw(name, 1, F.greatest(F.lit(1), size - 2), seed) + 2  # from 1
    at = lambda a, n: F.substring(name, a, n)
    rest = lambda a: F.substring(name, a, size)
    dropped = F.concat(at(F.lit(1), i - 1), rest(i + 1))
    swapped = F.concat(at(F.lit(1), i - 1), at(i + 1, F.lit(1)), at(i, F.lit(1)), rest(i + 2))
    vowel = F.concat(at(F.lit(1), i - 1), F.substring(F.lit("AEIOU"), draw(name, 3, 5, seed) + 1, F.lit(1)), rest(i + 1))
    how = draw(name, 2, 3, seed)
    return F.when(how == 0, dropped).when((how == 1) & (i < size), swapped).otherwise(vowel)


def perturbed(parties: DataFrame, sample: int = SAMPLE, lexicon: Lexicon = EMPTY, seed: int = SEED) -> DataFrame:
    """(qid, family, q): about `sample` typos and a third as many of each other family."""
    names = pinned(candidate_names(parties).select("name").distinct(), "drawn-from")  # read by each family
    plain = names.withColumns({"q": clean(F.col("name")), "tokens": name_tokens(F.col("name"), lexicon)})
    initials = F.array_join(F.transform("tokens", lambda t: F.substring(t, 1, 1)), "")
    families = (
        ("typo", sample, plain.where(F.length("q") >= TYPO_FROM).select(typo(F.col("q"), seed).alias("q"))),
        ("acronym", -(-sample // 3), plain.where(F.size("tokens").between(2, 6)).select(initials.alias("q"))),
        ("verbatim", -(-sample // 3), plain.where(F.length("q") >= VERBATIM_FROM).select("q")),
        ("native", -(-sample // 3), names.where(other_script(F.col("name"))).select(F.col("name").alias("q"))),
    )
    out = None
    for family, most, rows in families:
        some = rows.distinct().orderBy(F.xxhash64("q", F.lit(seed)), "q").limit(most)
        some = some.select(F.concat_ws(":", F.lit(family), "q").alias("qid"), F.lit(family).alias("family"), "q")
        out = some if out is None else out.unionByName(some)
    return out


def differential(queries: DataFrame, parties: DataFrame, threshold: float = screening.DEFAULT_THRESHOLD, **how) -> DataFrame:
    """(family, queries, compared, lost, gained): hits of the lanes against those of a full scan, scores included.

    queries: (qid, family, q) and, for modifiers, yob and country.  compared: hits of the full scan.
    """
    queries = pinned(queries, "perturbed")
    asked, known = queries.drop("family"), screening.distinct_names(parties, how.get("lexicon", EMPTY))
    fast, full = (screening.screen(asked, parties, threshold, exhaustive=e, known=known, **how).select("qid", "party_id", "score", "matched_name") for e in (False, True))
    both = full.withColumn("in_full", F.lit(1)).unionByName(fast.withColumn("in_full", F.lit(-1)))
    # a hit that both give sums to 0, one of the full scan only to 1
    sums = both.groupBy("qid", "party_id", "score", "matched_name").agg(F.sum("in_full").alias("side"), F.max("in_full").alias("known"))
    told = sums.groupBy("qid").agg(F.count_if(F.col("known") == 1).alias("compared"), F.count_if(F.col("side") > 0).alias("lost"), F.count_if(F.col("side") < 0).alias("gained"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return queries.select("qid", "family").join(told, "qid", "left").groupBy("family").agg(F.count(F.lit(1)).alias("queries"), zero("compared"), zero("lost"), zero("gained"))
