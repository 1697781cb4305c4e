"""Rules on road layouts, tested for all layouts in one search.

A layout changes a few streets; all else is as it is today. The whole graph is searched
without layouts, for the ends of these streets alone, and layouts are told apart on the
graph of these ends. A search there keeps, for each junction, the set of layouts under
which it is reached as a bitmap of 62 layouts to a word. A round ands the bitmaps with what each edge allows, puts those that meet at a
junction together with ``bit_or`` and goes on with the bits that are new: one search
whatever the number of layouts, and rounds no more than hops.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..materialise import Rounds, cut
from .aggregates import numbered

#: Layouts to a word of a bitmap; all bits of a word are below the sign.
WORD = 62
#: Fronts that are kept apart before they are put together.
LOG = 6


def layouts_within_budget(values: DataFrame, most: int) -> DataFrame:
    """All layouts that change at most ``most`` options: ``(layout, changes)``.

    ``values(key, value)`` are the values other than today's; ``changes`` is an array
    of them by key. Layouts are numbered from 0 by number of changes, then by name;
    there are so many as options allow, and none of this grows with the graph."""
    one = values.select(F.struct("key", "value").alias("c")).distinct()
    grown = one.select(F.array("c").alias("changes"))
    every = grown.limit(0).unionByName(one.sparkSession.range(1).select(F.array().cast("array<struct<key:string,value:string>>").alias("changes")))
    for n in range(most):
        every = every.unionByName(grown)
        if n + 1 < most:
            grown = grown.join(one, F.element_at("changes", -1)["key"] < F.col("c")["key"]).select(F.concat("changes", F.array("c")).alias("changes"))
    name = F.array_join(F.transform("changes", lambda c: F.concat(c["key"], F.lit("="), c["value"])), " ")
    number = F.row_number().over(Window.orderBy(F.size("changes"), "name")) - 1
    return cut(every.withColumn("name", name).withColumn("layout", number.cast("bigint")).select("layout", "name", "changes"))


def in_words(layout: str = "layout") -> list:
    """Columns ``word`` and ``bit`` of a layout's number."""
    return [F.floor(F.col(layout) / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, CAST({layout} % {WORD} AS INT))").alias("bit")]


def closed_edges(options: DataFrame, layouts: DataFrame) -> DataFrame:
    """``(edge_id, word, shut)``: the layouts that close an edge.

    ``options(key, edge_id, role)`` has roles ``forward``, ``backward`` and ``gap``; a
    street's value closes its roads of another role, ``closed`` all of them."""
    change = layouts.select("layout", F.explode("changes").alias("c")).select("layout", "c.key", "c.value")
    met = options.join(F.broadcast(change), "key").where(F.col("role") != F.col("value"))
    return met.select("edge_id", *in_words()).groupBy("edge_id", "word").agg(F.bit_or("bit").alias("shut"))


def _grown(tables: Rounds, front: DataFrame, plain: DataFrame, some: DataFrame | None) -> DataFrame:
    """All that ``front(origin, node, word, bits)`` comes to over ``plain(node, to)``,
    which any bit may take, and ``some(node, to, word, open)``."""
    front = tables.keep(front)
    log = [front]
    together = lambda dfs: reduce(DataFrame.unionByName, dfs).groupBy("origin", "node", "word").agg(F.bit_or("bits").alias("bits"))
    while True:
        offers = [front.join(plain, "node").select("origin", F.col("to").alias("node"), "word", "bits")]
        if some is not None:
            under = front.join(some, ["node", "word"]).select("origin", F.col("to").alias("node"), "word", F.col("bits").bitwiseAND(F.col("open")).alias("bits"))
            offers.append(under.where("bits <> 0"))
        known = together(log).withColumnRenamed("bits", "old")
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("bigint"))))
        front = tables.keep(together(offers).join(known, ["origin", "node", "word"], "left").select("origin", "node", "word", new.alias("bits")).where("bits <> 0"))
        if front.isEmpty():
            return tables.close(together(log))
        log = [tables.keep(together(log)), front] if len(log) >= LOG else [*log, front]


def reach_bitmaps(edges: DataFrame, shut: DataFrame, starts: DataFrame, layouts: int, backward: bool = False) -> DataFrame:
    """``(origin, node, word, bits)``: the layouts under which each ``starts(origin,
    node)`` reaches a node, or is reached from it if ``backward``. A junction that no
    layout reaches has no row; words without a bit there are left out, too."""
    a, b = ("v", "u") if backward else ("u", "v")
    roads = edges.select("edge_id", F.col(a).alias("node"), F.col(b).alias("to"))
    touched = shut.select("edge_id").distinct()
    plain = cut(roads.join(touched, "edge_id", "left_anti").select("node", "to").distinct())
    words = starts.sparkSession.range(max(1, -(-layouts // WORD))).select(F.col("id").cast("int").alias("word"))
    full = F.when(F.col("word") < layouts // WORD, F.lit((1 << WORD) - 1)).otherwise(F.lit((1 << layouts % WORD) - 1))
    some = roads.join(touched, "edge_id", "left_semi").crossJoin(F.broadcast(words)).join(shut, ["edge_id", "word"], "left")
    some = cut(some.select("node", "to", "word", F.bitwise_not(F.coalesce("shut", F.lit(0).cast("bigint"))).alias("open")))
    first = starts.select("origin", "node").distinct().crossJoin(F.broadcast(words)).select("origin", "node", "word", full.cast("bigint").alias("bits"))
    return _grown(Rounds(edges.sparkSession), first.where("bits <> 0"), plain, some)


def plain_reach(edges: DataFrame, shut: DataFrame, marked: DataFrame, backward: bool = False) -> DataFrame:
    """``(node, marks)``: which of ``marked(mark, node)``, numbered from 0, reach a
    junction over roads that no layout closes, or are reached from it if ``backward``:
    an array of words. A junction has one row of it, whatever the number of layouts."""
    a, b = ("v", "u") if backward else ("u", "v")
    roads = edges.select("edge_id", F.col(a).alias("node"), F.col(b).alias("to"))
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # closed roads are those of options: few
    plain = roads.join(F.broadcast(shut.select("edge_id").distinct()), "edge_id", "left_anti").where("node <> to").select("node", "to")
    plain = cut(plain.repartition(n, "node").distinct())
    first = marked.select(F.lit(0).alias("origin"), "node", *in_words("mark")).groupBy("origin", "node", "word").agg(F.bit_or("bit").alias("bits"))
    found = _grown(Rounds(edges.sparkSession), first, plain, None)
    words = (marked.agg(F.max("mark")).first()[0] or 0) // WORD + 1
    each = [F.coalesce(F.max(F.when(F.col("word") == i, F.col("bits"))), F.lit(0).cast("bigint")) for i in range(words)]
    return found.groupBy("node").agg(F.array(*each).alias("marks"))


def _marks(column: str):
    """A column of the numbers that an array of words holds."""
    word = lambda x, i: F.transform(
        F.filter(F.array(*map(F.lit, range(WORD))), lambda k: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), k)) != 0), lambda k: (i * WORD + k).cast("bigint")
    )
    return F.flatten(F.transform(column, word))


@dataclass
class Judged:
    """What layouts leave of the reach of a hub and of journeys.

    ``groups(origin, node, k)`` are ``k`` junctions of today's core that the same marked
    junctions reach and are reached from: for layouts they are one. ``ahead`` and
    ``behind(origin, node, word, bits)`` are the layouts under which the hub reaches a
    group and under which the group reaches it; ``ends(origin, node, word, bits)`` has
    those under which an origin reaches a marked junction."""

    groups: DataFrame
    ahead: DataFrame
    behind: DataFrame
    ends: DataFrame


def reach_of_layouts(edges: DataFrame, options_shut: DataFrame, layouts: int, hub: DataFrame, journeys: DataFrame) -> Judged:
    """The search of all layouts: junctions differ only by which ends of changed streets,
    of journeys and which hub lie before and behind them, so the graph is searched
    once each way with a bit for each of these, without layouts. Layouts are then told
    apart on a graph of the marked junctions alone."""
    spark, shut = edges.sparkSession, options_shut
    # one row: origins are junctions, and -1 is the hub
    first = spark.createDataFrame([(-1, r["node"]) for r in hub.select("node").limit(1).collect()], "origin bigint, node bigint")
    enters = journeys.select(F.col("enter").alias("origin"), F.col("enter").alias("node")).distinct()
    changed = cut(edges.select("edge_id", "u", "v").join(F.broadcast(shut.select("edge_id").distinct()), "edge_id", "left_semi"))
    ends = [first.select("node"), enters.select("node"), journeys.select(F.col("leave").alias("node")), changed.select(F.col("u").alias("node")), changed.select(F.col("v").alias("node"))]
    marked = cut(numbered(reduce(DataFrame.unionByName, ends).where("node IS NOT NULL").distinct(), "node", "mark"))
    before, after = (plain_reach(edges, shut, marked, backward) for backward in (False, True))
    at = before.join(F.broadcast(marked.select(F.col("node"), F.lit(True).alias("is"))), "node").select(F.col("node").alias("v"), F.explode(_marks("marks")).alias("mark"))
    links = at.join(F.broadcast(marked.withColumnRenamed("node", "u")), "mark").select(F.lit(None).cast("bigint").alias("edge_id"), "u", "v")
    small = cut(links.unionByName(changed))
    ahead = reach_bitmaps(small, shut, first.unionByName(enters), layouts)
    behind = reach_bitmaps(small, shut, first, layouts, backward=True)
    same = before.withColumnRenamed("marks", "before").join(after.withColumnRenamed("marks", "after"), "node").groupBy("before", "after").agg(F.count("*").alias("k"))
    same = cut(cut(same).select(F.monotonically_increasing_id().alias("node"), "before", "after", "k"))

    def of_groups(column: str, reach: DataFrame) -> DataFrame:
        named = F.broadcast(reach.where("origin = -1").join(marked, "node").select("mark", "word", "bits"))
        met = same.select("node", F.explode(_marks(column)).alias("mark")).join(named, "mark")
        return cut(met.groupBy(F.lit(-1).cast("bigint").alias("origin"), "node", "word").agg(F.bit_or("bits").alias("bits")))

    forth, back = of_groups("before", ahead), of_groups("after", behind)
    groups = cut(today(forth).join(today(back), ["origin", "node"]).join(same.select("node", "k"), "node").select("origin", "node", "k"))
    return Judged(groups, forth, back, ahead)


def today(reach: DataFrame) -> DataFrame:
    """``(origin, node)`` that are reached under layout 0."""
    return reach.where((F.col("word") == 0) & (F.col("bits").bitwiseAND(F.lit(1)) == 1)).select("origin", "node")


def missing_layouts(wanted: DataFrame, reach: DataFrame, layouts: int) -> DataFrame:
    """Layouts under which some ``wanted(origin, node)`` isn't reached: ``(layout,
    missed)``, how many of them, or the sum of their ``k`` if they have one. Bits are
    unpacked only where one is missing."""
    words = wanted.sparkSession.range(max(1, -(-layouts // WORD))).select(F.col("id").cast("int").alias("word"))
    full = F.when(F.col("word") < layouts // WORD, F.lit((1 << WORD) - 1)).otherwise(F.lit((1 << layouts % WORD) - 1))
    asked = wanted if "k" in wanted.columns else wanted.select("origin", "node", F.lit(1).alias("k")).distinct()
    asked = asked.crossJoin(F.broadcast(words))
    gone = asked.join(reach, ["origin", "node", "word"], "left").select("word", "k", full.cast("bigint").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("bigint")))).alias("gone"))
    # equal gaps are counted before they are unpacked
    gone = gone.where("gone <> 0").groupBy("word", "gone").agg(F.sum("k").alias("k"))
    place = F.explode(F.filter(F.array(*map(F.lit, range(WORD))), lambda i: F.expr("gone").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0))
    return gone.select("word", place.alias("i"), "k").groupBy((F.col("word") * WORD + F.col("i")).cast("bigint").alias("layout")).agg(F.sum("k").alias("missed"))


def judge_layouts(edges: DataFrame, options: DataFrame, layouts: DataFrame, hub: DataFrame, journeys: DataFrame) -> DataFrame:
    """The rule that nobody is trapped and all journeys stay possible, for each of
    ``layouts``: ``(layout, name, trapped_out, trapped_in, journeys_lost, allowed)``.

    The core, the junctions that ``hub(node)`` reaches and that reach it today, must
    stay so: ``trapped_out`` counts those no longer reached, ``trapped_in`` those that
    no longer reach the hub. ``journeys(enter, leave)`` that are possible today must
    stay possible. Today's layout is number 0."""
    n = layouts.count()
    shut = cut(closed_edges(options, layouts))
    found = reach_of_layouts(edges, shut, n, hub, journeys)
    asked = journeys.select(F.col("enter").alias("origin"), F.col("leave").alias("node")).distinct().join(today(found.ends), ["origin", "node"], "left_semi")
    out = layouts.select("layout", "name")
    for name, wanted, reach in (("trapped_out", found.groups, found.ahead), ("trapped_in", found.groups, found.behind), ("journeys_lost", asked, found.ends)):
        missed = missing_layouts(wanted, reach, n).withColumnRenamed("missed", name)
        out = out.join(missed, "layout", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out.withColumn("allowed", (F.col("trapped_out") == 0) & (F.col("trapped_in") == 0) & (F.col("journeys_lost") == 0))
