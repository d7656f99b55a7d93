"""Aisle graph: arcs by mode, shortest paths with a deterministic tie-break, components, reachability.

A layout is the size of a building. As long as its nodes and edges are few (`MOST_ARCS`, counted first) they are read
once, broadcast, and every task solves its own sources; a larger graph is solved by relaxation joins, with the state
written to the shared folder each round.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from dataclasses import dataclass
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import checkpoint
from ..schema import MODES, Bundle

MOST_ARCS = 200_000
#: Rows of the table of distances between all stops that goes out by broadcast (about 30 MB); beyond it only used pairs are solved.
MOST_PAIRS = 250_000
#: Arcs walked by all searches together up to which the driver solves them itself: less than a job costs.
DRIVER_STEPS = 300_000
#: Lengths this close are equal.
TIE = 1e-12


def arcs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, u, v, w, mode): one row per direction and mode; edges with unknown ends or no positive length have none."""
    ids = nodes.select("node_id").distinct()
    good = edges.where("distance_m > 0")
    for end in ("from_node", "to_node"):
        good = good.join(ids, good[end] == ids.node_id, "left_semi")
    ends = F.when(F.col("bidirectional"), F.array(F.struct(F.col("from_node").alias("u"), F.col("to_node").alias("v")), F.struct(F.col("to_node").alias("u"), F.col("from_node").alias("v"))))
    ends = ends.otherwise(F.array(F.struct(F.col("from_node").alias("u"), F.col("to_node").alias("v"))))
    wide = good.select("edge_id", F.explode(ends).alias("e"), F.col("distance_m").alias("w"), "allowed_modes")
    return wide.select("edge_id", "e.u", "e.v", "w", F.explode(F.array_distinct("allowed_modes")).alias("mode"))


def modes_present(arc_table: DataFrame) -> DataFrame:
    return arc_table.select("mode").distinct()


@dataclass(frozen=True)
class Layout:
    """A small graph in memory: arcs by mode, out of and into each node."""

    ids: frozenset
    out: dict
    into: dict
    n_arcs: int


_layouts: WeakKeyDictionary = WeakKeyDictionary()


def layout(nodes: DataFrame, edges: DataFrame) -> Layout | None:
    """The graph of two tables, read once; None if either holds more than MOST_ARCS rows."""
    known = _layouts.get(nodes)
    if known and known[0] is edges and known[1] == MOST_ARCS:
        return known[2]
    ids = [r.node_id for r in nodes.select("node_id").limit(MOST_ARCS + 1).collect()]
    rows = edges.where("distance_m > 0").select("edge_id", "from_node", "to_node", "distance_m", "bidirectional", "allowed_modes").limit(MOST_ARCS + 1).collect()
    found = None
    if max(len(ids), len(rows)) <= MOST_ARCS:
        out, into, n = defaultdict(lambda: defaultdict(list)), defaultdict(lambda: defaultdict(list)), 0
        there = frozenset(ids)
        for r in rows:
            if r.from_node in there and r.to_node in there:
                for mode in set(r.allowed_modes or ()):
                    for u, v in ((r.from_node, r.to_node), (r.to_node, r.from_node))[: 2 if r.bidirectional else 1]:
                        out[mode][u].append((v, r.distance_m))
                        into[mode][v].append((r.edge_id, u, r.distance_m))
                        n += 1
        found = Layout(there, {m: dict(x) for m, x in out.items()}, {m: dict(x) for m, x in into.items()}, n)
    _layouts[nodes] = (edges, MOST_ARCS, found)
    return found


def _distances(out: dict, source: str) -> dict[str, float]:
    dist, heap = {source: 0.0}, [(0.0, source)]
    done = set()
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        for v, w in out.get(u, ()):
            if d + w < dist.get(v, math.inf):
                dist[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return dist


def _tight(into: dict, dist: dict[str, float], node: str) -> tuple[str, str]:
    """(edge, previous node): of the arcs on shortest paths to node the one with the smallest edge id."""
    return min((e, u) for e, u, w in into[node] if u in dist and abs(dist[u] + w - dist[node]) <= TIE)


def _solve(g: Layout, source: str, mode: str, targets, with_edges: bool) -> list[tuple]:
    """(source, mode, target, distance, path) of the reachable targets; a known node reaches itself at 0 in any mode."""
    if source not in g.ids:
        return []
    dist, into = _distances(g.out.get(mode, {}), source), g.into.get(mode, {})
    back: dict[str, tuple[str, str]] = {}
    got = []
    for t in targets:
        if t not in dist:
            continue
        path, at = [], t
        while with_edges and at != source:
            if at not in back:
                back[at] = _tight(into, dist, at)
            path.append(back[at][0])
            at = back[at][1]
        got.append((source, mode, t, dist[t], path[::-1]))
    return got


_SOLVED = "src string, mode string, dst string, dist double, path array<string>"


def _solved_by_tasks(g: Layout, todo: DataFrame, with_edges: bool) -> DataFrame:
    """todo: (src, mode, targets)."""
    shared = todo.sparkSession.sparkContext.broadcast(g)

    def run(frames):
        import pandas as pd

        for frame in frames:
            got = []
            for source, mode, targets in zip(frame["src"], frame["mode"], frame["targets"], strict=True):
                got += _solve(shared.value, source, mode, targets, with_edges)
            if got:
                yield pd.DataFrame(got, columns=["src", "mode", "dst", "dist", "path"])

    return todo.mapInPandas(run, _SOLVED)


def shortest_paths(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, *, with_edges: bool = True) -> DataFrame:
    """wanted: distinct (src, mode, dst). Returns (src, mode, dst, dist, path) for the reachable ones.

    A node reaches itself at 0 with an empty path, in any mode; unknown nodes reach nothing. path lists edge ids in order.
    """
    g = layout(nodes, edges)
    if g is None:
        return _by_relaxation(nodes, arcs(nodes, edges), wanted)
    return _solved_by_tasks(g, wanted.groupBy("src", "mode").agg(F.collect_set("dst").alias("targets")), with_edges)  # a layout's nodes at most


def between_stops(bundle: Bundle) -> DataFrame | None:
    """(src, mode, dst, dist, path) between all access nodes, start and end, solved once; None above MOST_PAIRS."""
    if "_between" not in bundle.__dict__:
        bundle.__dict__["_between"] = _between_stops(bundle)
    return bundle.__dict__["_between"]


def _between_stops(bundle: Bundle) -> DataFrame | None:
    g = layout(bundle.nodes, bundle.edges)
    if g is None:
        return None
    modes = sorted(set(g.out) | set(MODES) | {bundle.get("default_mode")})
    most = math.isqrt(MOST_PAIRS // len(modes))
    ends = {r.n for r in bundle.locations.select(F.col("access_node_id").alias("n")).distinct().limit(most + 1).collect()}
    ends = sorted((ends | {bundle.get("route_start_node"), bundle.get("route_end_node")}) & g.ids)
    if len(ends) > most:
        return None
    todo = [(s, m) for s in ends for m in modes]
    if len(todo) * (g.n_arcs + len(ends)) <= DRIVER_STEPS:
        return bundle.spark.createDataFrame([r for s, m in todo for r in _solve(g, s, m, ends, True)], _SOLVED).coalesce(1)
    work = bundle.spark.createDataFrame(todo, "src string, mode string").repartition(min(len(todo), 4 * bundle.spark.sparkContext.defaultParallelism))
    return checkpoint(_solved_by_tasks(g, work.withColumn("targets", F.array(*map(F.lit, ends))), True))


def away_from(bundle: Bundle, source: str | None, mode: str) -> DataFrame:
    """(access_node_id, away): distance of the locations' access nodes from one node."""
    known = between_stops(bundle)
    if known is None:
        wanted = bundle.locations.select(F.lit(source).cast("string").alias("src"), F.lit(mode).alias("mode"), F.col("access_node_id").alias("dst")).distinct()
        known = shortest_paths(bundle.nodes, bundle.edges, wanted, with_edges=False)
    here = (F.col("src") == F.lit(source).cast("string")) & (F.col("mode") == F.lit(mode))
    return known.where(here).select(F.col("dst").alias("access_node_id"), F.col("dist").alias("away"))


def relax(nodes: DataFrame, table: DataFrame, sources: DataFrame) -> DataFrame:
    """sources: (src, mode). Min-plus relaxation to the fixed point: (src, mode, node, dist)."""
    start = sources.join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi").distinct()
    dist = checkpoint(start.select("src", "mode", F.col("src").alias("node"), F.lit(0.0).alias("dist")))
    fresh = dist
    while not fresh.isEmpty():
        step = fresh.join(table, (fresh.node == table.u) & (fresh["mode"] == table["mode"])).select("src", fresh["mode"], F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("new"))
        best = step.groupBy("src", "mode", "node").agg(F.min("new").alias("new"))
        joined = checkpoint(best.join(dist, ["src", "mode", "node"], "full"))
        fresh = joined.where("new is not null and (dist is null or new < dist)").select("src", "mode", "node", F.col("new").alias("dist"))
        dist = joined.select("src", "mode", "node", F.least("new", "dist").alias("dist"))
    return dist


def predecessors(table: DataFrame, dist: DataFrame) -> DataFrame:
    """(src, mode, node, edge_id, prev): the last edge of the path to each node but the source; the smallest id of equals."""
    far = dist.select("src", "mode", F.col("node").alias("v"), F.col("dist").alias("dv"))
    near = dist.select("src", "mode", F.col("node").alias("u"), F.col("dist").alias("du"))
    tight = table.join(far, ["mode", "v"]).join(near, ["src", "mode", "u"]).where((F.abs(F.col("du") + F.col("w") - F.col("dv")) <= TIE) & (F.col("v") != F.col("src")))
    best = tight.groupBy("src", "mode", "v").agg(F.min(F.struct("edge_id", "u")).alias("x"))
    return best.select("src", "mode", F.col("v").alias("node"), "x.edge_id", F.col("x.u").alias("prev"))


def _by_relaxation(nodes: DataFrame, table: DataFrame, wanted: DataFrame) -> DataFrame:
    dist = relax(nodes, table, wanted.select("src", "mode").distinct())
    back = checkpoint(predecessors(table, dist))
    reached = wanted.join(dist.withColumnRenamed("node", "dst"), ["src", "mode", "dst"])
    walk = checkpoint(reached.select("src", "mode", "dst", "dist", F.col("dst").alias("at"), F.expr("cast(array() as array<string>)").alias("path")))
    done = walk.where("at = src")
    walk = walk.where("at <> src")
    while not walk.isEmpty():
        step = walk.join(back.withColumnRenamed("node", "at"), ["src", "mode", "at"])
        walk = checkpoint(step.select("src", "mode", "dst", "dist", F.col("prev").alias("at"), F.concat(F.array("edge_id"), "path").alias("path")))
        done = done.unionByName(walk.where("at = src"))
        walk = walk.where("at <> src")
    return done.select("src", "mode", "dst", "dist", "path")


def all_pairs(nodes: DataFrame, edges: DataFrame, modes: list[str], *, with_edges: bool = False) -> DataFrame:
    """Distances between all nodes: a layout's own square table, for reports on small layouts."""
    ids = nodes.select(F.col("node_id").alias("src")).distinct()
    others = nodes.select(F.col("node_id").alias("dst")).distinct()
    wanted = ids.crossJoin(others).withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    return shortest_paths(nodes, edges, wanted.select("src", "mode", "dst"), with_edges=with_edges)


def _united(g: Layout) -> dict[str, str]:
    root = {n: n for n in g.ids}

    def find(n: str) -> str:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for by_node in g.out.values():
        for u, outs in by_node.items():
            for v, _ in outs:
                a, b = sorted((find(u), find(v)))
                root[b] = a
    return {n: find(n) for n in g.ids}


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): weak components over all edges that count, named by their smallest node."""
    g = layout(nodes, edges)
    if g is not None:
        return nodes.sparkSession.createDataFrame(sorted(_united(g).items()), "node_id string, component string").coalesce(1)
    pairs = arcs(nodes, edges).select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
    pairs = checkpoint(pairs.union(pairs.select("b", "a")).distinct())
    label = checkpoint(nodes.select("node_id", F.col("node_id").alias("component")).distinct())
    while True:
        near = pairs.join(label, pairs.b == label.node_id).groupBy("a").agg(F.min("component").alias("least"))
        new = checkpoint(label.join(near, label.node_id == near.a, "left").select("node_id", F.least("component", "least").alias("component"), (F.col("least") < F.col("component")).alias("moved")))
        if new.where("moved").isEmpty():
            return label
        # follow the label's own label too, so that long corridors take few rounds
        own = new.select(F.col("node_id").alias("component"), F.col("component").alias("next"))
        label = checkpoint(new.join(own, "component", "left").select("node_id", F.coalesce("next", "component").alias("component")))


def unreachable(nodes: DataFrame, edges: DataFrame, source: str, mode: str) -> DataFrame:
    """Nodes that the mode cannot reach from the source."""
    wanted = nodes.select(F.lit(source).alias("src"), F.lit(mode).alias("mode"), F.col("node_id").alias("dst")).distinct()
    got = shortest_paths(nodes, edges, wanted, with_edges=False)
    return nodes.select("node_id").distinct().join(got, F.col("node_id") == F.col("dst"), "left_anti")
