"""Choosing road layouts: constraint problems, rules and their scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..materialise import cut
from .graph import pair_key


@dataclass
class Problem:
    """Variables with their domains and rules.

    A rule is ``(variables, test)``: the names that ``test`` reads and a function
    from a dict of columns to a boolean column. A rule is applied as soon as all
    of its variables have values, so wrong partial layouts go no further."""

    domains: dict[str, Sequence[str]]
    rules: list[tuple[tuple[str, ...], Callable[[dict[str, Column]], Column]]] = field(default_factory=list)

    def levels(self, spark: SparkSession) -> Iterator[tuple[str, DataFrame, DataFrame]]:
        """Per variable: partial layouts with a value for it, and those of them
        that no rule whose variables all have values forbids."""
        kept = spark.range(1).select()
        given: set[str] = set()
        for name, values in self.domains.items():
            given.add(name)
            tried = kept.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
            kept = tried
            for names, test in self.rules:
                if name in names and given.issuperset(names):
                    kept = kept.where(test({n: F.col(n) for n in names}))
            yield name, tried, kept

    def solve(self, spark: SparkSession) -> DataFrame:
        """All layouts that satisfy the rules: one column per variable."""
        *_, (_, _, kept) = self.levels(spark)
        return kept

    def search_counts(self, spark: SparkSession) -> DataFrame:
        """What the search did, by variable: ``(position, variable, tried,
        crossed_out, dead_ends)``. A dead end is a partial layout that no value of
        the next variable continues."""
        counts = []
        before = spark.range(1).select()
        for k, (name, tried, kept) in enumerate(self.levels(spark)):
            went_on = kept.select(*before.columns).distinct() if before.columns else kept.limit(1)
            sizes = [df.agg(F.count("*").alias(c)) for df, c in ((before, "given"), (tried, "tried"), (kept, "kept"), (went_on, "went_on"))]
            row = sizes[0].crossJoin(sizes[1]).crossJoin(sizes[2]).crossJoin(sizes[3])  # of one row each
            counts.append(row.select(
                F.lit(k).alias("position"), F.lit(name).alias("variable"), "tried", (F.col("tried") - F.col("kept")).alias("crossed_out"), (F.col("given") - F.col("went_on")).alias("dead_ends")
            ))
            before = kept
        return reduce(DataFrame.union, counts)

    def counted(self) -> dict[str, int]:
        """Sizes of the search: layouts in all and values."""
        size = 1
        for v in self.domains.values():
            size *= len(v)
        return {"layouts": size, "variables": len(self.domains)}


def at_most_changed(today: dict[str, str], most: int) -> tuple[tuple[str, ...], Callable[[dict[str, Column]], Column]]:
    """Budget: no more than ``most`` variables differ from today. Being a sum of
    non-negative terms, it may also be tested on the first few variables."""
    return tuple(today), lambda c: sum((F.when(c[n] != v, 1).otherwise(0) for n, v in today.items()), F.lit(0)) <= most


def budget_prefixes(today: dict[str, str], most: int) -> list:
    """The budget as a rule on every prefix of the variables (forward checking)."""
    names = list(today)
    return [at_most_changed({n: today[n] for n in names[: i + 1]}, most) for i in range(len(names))]


def layout_edges(edges: DataFrame, options: DataFrame, layout: DataFrame) -> DataFrame:
    """The edges under a layout.

    ``options(key, edge_id, role)`` names the roads of each option: role
    ``forward`` or ``backward`` of a two-way street, or ``gap``. ``layout(key,
    value)``: ``twoway`` and ``open`` leave things be, ``forward`` and ``backward``
    drop the other direction and double the kept one, ``closed`` drops a gap."""
    touched = options.join(layout, "key").select("edge_id", "role", "value")
    dropped = touched.where(((F.col("role") == "gap") & (F.col("value") == "closed")) | (F.col("value").isin("forward", "backward") & (F.col("role") != F.col("value"))))
    doubled = touched.where(F.col("role") == F.col("value")).select("edge_id", F.lit(2).alias("times"))
    return edges.join(dropped.select("edge_id"), "edge_id", "left_anti").join(doubled, "edge_id", "left").withColumn(
        "capacity_vph", F.col("capacity_vph") * F.coalesce("times", F.lit(1))
    ).drop("times")


def nobody_trapped(core: DataFrame, reach: DataFrame) -> DataFrame:
    """Nodes of the core that are no longer reached; empty if the rule holds."""
    return core.join(reach.select("node").hint("merge"), "node", "left_anti")


def gaps_too_close(gaps: DataFrame, least_m: float = 400.0, cell_deg: float = 0.005, digits: int | None = None) -> DataFrame:
    """Pairs of closed gaps ``(key, lon, lat)`` nearer than ``least_m``: places are
    joined by grid cell with its neighbours, so far ones never meet. Distances (to
    ``digits`` if given) are those of places, however many gaps lie at one."""
    places = cut(gaps.select("lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL").distinct())
    cell = {"cx": F.floor(F.col("lon") / cell_deg), "cy": F.floor(F.col("lat") / cell_deg)}
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = places.select(F.col("lon").alias("lon2"), F.col("lat").alias("lat2")).withColumn("o", F.explode(around))
    b = b.withColumns({"cx": F.floor(F.col("lon2") / cell_deg) + F.col("o.i"), "cy": F.floor(F.col("lat2") / cell_deg) + F.col("o.j")}).drop("o")
    d = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    near = places.withColumns(cell).join(b, ["cx", "cy"]).withColumn("metres", d).where(F.col("metres") < least_m)
    near = near.select("lon", "lat", "lon2", "lat2", (F.col("metres") if digits is None else F.round("metres", digits)).alias("metres"))
    other = gaps.select(F.col("key").alias("other"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    half = near.join(gaps.select("key", "lon", "lat"), ["lon", "lat"]).select("key", "lon2", "lat2", "metres")
    # a hash of a place's few gaps; the pairs are many and not sorted
    met = half.join(other.hint("shuffle_hash"), (half["lon2"] == other["lon2"]) & (half["lat2"] == other["lat2"]) & (half["key"] < other["other"]))
    return met.select("key", "other", "metres")


def u_turns(edges: DataFrame, nodes: DataFrame, longest_m: float = 60.0, least_turn: float = 150.0) -> DataFrame:
    """Short links between one-way main roads that turn traffic back.

    ``edges`` carry ``oneway``, ``highway`` and ends; a link qualifies if some
    arriving and some leaving main road turn by more than ``least_turn`` degrees."""
    at = lambda side: nodes.select(F.col("node_id").alias(side), F.struct("lon", "lat").alias(f"p{side}"))
    e = edges.join(at("u"), "u").join(at("v"), "v").withColumn("heading", geo.bearing(F.col("pu.lon"), F.col("pu.lat"), F.col("pv.lon"), F.col("pv.lat")))
    main = e.where(F.col("oneway") & F.col("highway").isin("trunk", "primary", "secondary", "tertiary"))
    links = e.where(F.col("length_m") <= longest_m)
    into = main.select(F.col("v").alias("u"), F.col("heading").alias("h1"), F.col("edge_id").alias("e1"))
    out = main.select(F.col("u").alias("v"), F.col("heading").alias("h2"), F.col("edge_id").alias("e2"))
    turn = F.abs(F.pmod(F.col("h2") - F.col("h1") + 180.0, F.lit(360.0)) - 180.0)
    back = links.join(into, "u").join(out, "v").where((F.col("edge_id") != F.col("e1")) & (F.col("edge_id") != F.col("e2")) & (turn > least_turn))
    return back.groupBy(*pair_key()).agg(F.min("edge_id").alias("edge_id"), F.count_distinct("edge_id").alias("links"))


def describe(kind: Column, value: Column, heading: Column) -> Column:
    """One sentence about an option's value."""
    return (
        F.when(value == "twoway", "two-way, as today").when(value == "open", "gap open, as today").when(value == "closed", "gap closed")
        .when(value == "forward", F.concat(F.lit("one-way "), heading)).otherwise(F.concat(F.lit("one-way against "), heading))
    )


def journeys_lost(exits: DataFrame, reach: DataFrame) -> DataFrame:
    """``exits(enter, leave)`` that ``reach(enter, leave)`` no longer holds."""
    return exits.join(reach, ["enter", "leave"], "left_anti")


def ranked(scores: DataFrame, baseline: float, top: int = 10) -> DataFrame:
    """Layouts without lost trips, the lowest vehicle-hours first, with the change."""
    return scores.where("unreachable = 0").withColumn("change_pct", F.round((F.col("vehicle_hours") / baseline - 1) * 100, 2)).orderBy("vehicle_hours", "layout").limit(top)
