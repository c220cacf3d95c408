"""The query facade: one method for each request the engine answers."""

from __future__ import annotations

import re
import time
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partyloom.functions.text import EMPTY, Lexicon, reading_order
from partyloom.operators import crosslist, graph, ownership, present, quality, stats
from partyloom.plans import below_the_line, screening
from partyloom.plans import snapshot as snap

#: Ids that may be asked for.
ID = re.compile(r"[A-Za-z0-9_:.-]+")
# Results of single queries that are kept, the oldest out first, and for how many seconds.
MOST_KEPT, KEPT_FOR = 500, 600.0


class Engine:
    """Answers over one immutable snapshot; derived tables are built once, on first use."""

    def __init__(self, parties: DataFrame, lexicon: Lexicon = EMPTY, expected: tuple[str, ...] = ()):
        self.parties, self.lexicon, self.expected = parties, lexicon, expected
        self.spark = parties.sparkSession
        self._kept: dict[tuple, tuple[float, list]] = {}

    @cached_property
    def total(self) -> int:
        return self.parties.count()

    @cached_property
    def frequencies(self) -> DataFrame:
        return snap.token_frequencies(self.parties, self.lexicon).persist()

    @cached_property
    def clusters(self) -> DataFrame:
        return crosslist.clusters(self.parties).persist()

    @cached_property
    def edges(self) -> DataFrame:
        return graph.edges(self.parties).persist()

    def health(self) -> dict:
        return {"ok": True, "parties": self.total}

    def meta(self, as_of: DataFrame, now, failures: int = 0) -> DataFrame:
        return present.meta(list(self.expected), self.parties, snap.freshness(as_of, now), failures)

    def stats(self, now) -> dict[str, DataFrame]:
        p = self.parties
        dated = p.withColumn("date", stats.normalize_date(F.col("datePublished")))
        return {
            "totals": stats.totals(p, now),
            "authorities": stats.by_authority(p),
            "types": stats.by_type(p),
            "lists": stats.by_membership(p, "lists", None),
            "programs": stats.by_membership(p, "programs"),
            "measures": stats.by_membership(p, "sanctionsTypes"),
            "countries": stats.by_country(p),
            "months": stats.monthly(dated),
            "months_by_authority": stats.monthly(dated, by="authority"),
            "years": stats.yearly(dated),
            "recents": stats.recents(dated.where("date is not null").select("id", "name", "authority", "list", "type", "date"), "authority", [F.desc("date"), reading_order("name"), F.col("id")]),
        }

    def screen(self, queries: DataFrame, threshold: float = screening.DEFAULT_THRESHOLD, authority: str = "", list_name: str = "", program: str = "", exhaustive: bool = False) -> DataFrame:
        """Many queries at once, at any threshold."""
        some = screening.filter_parties(self.parties, authority, list_name, program)
        return screening.screen(queries, some, threshold, self.frequencies, self.total, self.lexicon, exhaustive)

    def search(self, q: str, authority: str = "", list_name: str = "", program: str = "", threshold=None, yob: str = "", country: str = "") -> DataFrame:
        """One query, ranked and cut; an empty one has no hits."""
        level = screening.threshold_of(threshold)
        yob = yob if len(str(yob)) == 4 and str(yob).isdigit() else ""
        clean = [screening.clean_param(x) for x in (authority, list_name, program)]
        row = (0, screening.clean_param(q, screening.MOST_QUERY))
        if yob or country:
            asked = self.spark.createDataFrame([(*row, str(yob), screening.clean_param(country))], "qid int, q string, yob string, country string")
        else:
            asked = self.spark.createDataFrame([row], "qid int, q string")
        return screening.rank(self.screen(asked, level, *clean))

    def results(self, q: str, **how) -> DataFrame:
        """search() with each hit's record, ownership lead, group and other listings."""
        hits = self.search(q, **how)
        return present.enriched(hits, self.parties, self.profiles, self.groups, self.crossed)

    def kept_results(self, q: str, **how) -> list:
        """Rows of search(), 200 at most, kept for a while for equal questions to this snapshot (Q8)."""
        key, now = (screening.clean_param(q, screening.MOST_QUERY), *sorted(how.items())), time.monotonic()
        held = self._kept.get(key)
        if held is None or now - held[0] >= KEPT_FOR:
            self._kept.pop(key, None)
            while len(self._kept) >= MOST_KEPT:
                self._kept.pop(next(iter(self._kept)))
            held = self._kept[key] = (now, self.search(q, **how).orderBy("rank").collect())
        return held[1]

    @cached_property
    def profiles(self) -> DataFrame:
        return ownership.profile(self.parties, self.clusters).persist()

    @cached_property
    def groups(self) -> DataFrame:
        return ownership.groups(self.parties, self.clusters).persist()

    @cached_property
    def crossed(self) -> DataFrame:
        return crosslist.cross_listing(self.parties, self.clusters).persist()

    def entity(self, party_id: str) -> DataFrame:
        return self.parties.where(F.col("id") == checked_id(party_id))

    def ownership(self, party_id: str) -> DataFrame:
        return ownership.profile(self.parties, self.clusters, only=checked_id(party_id))

    def cross_listing(self, party_id: str) -> DataFrame:
        return self.crossed.where(F.col("id") == checked_id(party_id))

    def changes(self, previous: DataFrame) -> DataFrame:
        return snap.delta(previous, self.parties)

    def below_the_line(self, q: str, threshold=None, **filters) -> dict[str, DataFrame]:
        """Curve, marginal hits and prefix hits; a missing threshold is the default one."""
        level = screening.threshold_of(threshold, least=below_the_line.FLOOR)
        asked = self.spark.createDataFrame([(0, screening.clean_param(q, screening.MOST_QUERY))], "qid int, q string")
        hits = self.screen(asked, below_the_line.FLOOR, **filters).persist()
        return {
            "curve": below_the_line.threshold_curve(hits),
            "marginal": below_the_line.marginal(hits, level),
            "prefix": below_the_line.prefix_hits(self.parties, q),
            "identifiers": below_the_line.identifier_coverage(self.parties),
        }

    def ego_network(self, party_id: str, depth: int = 2) -> dict[str, DataFrame]:
        near = graph.ego_nodes(self.edges, checked_id(party_id), max(1, min(3, int(depth))))
        links = graph.induced_edges(self.edges, near)
        return {"nodes": near, "edges": links, "metrics": graph.ego_metrics(near, links), "levels": graph.assign_levels(links, party_id)}

    def publish(self, root: str, version: str, previous: DataFrame | None = None) -> int:
        """Writes the snapshot, its profile and what changed, unless its quality regressed; returns the status of the decision.

        The pointer to the version is written with the snapshot, after profile and delta.
        """
        own = quality.profile(self.parties)
        before = quality.profile(previous) if previous is not None else None
        before_derived = quality.derived(previous) if previous is not None else None
        found = quality.compare(own, before, quality.derived(self.parties), before_derived)
        covered = True if previous is None else snap.coverage(list(self.expected), previous, self.parties).first()["publishable"]
        status = quality.decision(found, covered)
        if status != quality.REFUSED:
            snap.write_aside(own, root, "quality", version)
            if previous is not None:
                snap.write_aside(snap.delta(previous, self.parties), root, "changes", version)
            snap.write_snapshot(self.parties, root, version)
        return status

    def published_changes(self, root: str, version: str) -> DataFrame | None:
        """The delta published with a version; None if none was."""
        return snap.read_aside(self.spark, root, "changes", version)


def checked_id(party_id: str) -> str:
    if not ID.fullmatch(str(party_id)):
        raise ValueError("invalid id")
    return str(party_id)
