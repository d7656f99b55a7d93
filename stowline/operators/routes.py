"""Route reconstruction: stops in sequence, legs between them, and a route per order.

One shuffle of picks by order gives a row per stop with its place in the sequence, the leg that leads to it and, at an
order's last stop, the leg back. Orders, legs and what hangs on a whole order are read off these rows without a further
shuffle as long as the distances between all stops fit a broadcast (`network.between_stops`).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.shared import checkpoint
from ..schema import Bundle
from . import network


@dataclass(frozen=True)
class Routing:
    """stops: a row per pick; paths: (from_node, mode, to_node, path) of the legs; end: where routes end."""

    stops: DataFrame
    paths: DataFrame
    end: str | None

    @cached_property
    def orders(self) -> DataFrame:
        """One row per order: mode, lines, units, reason (null: complete), total_distance_m, zone_transitions, and what failed."""
        crossed = lambda m, a, b: (F.col(m).isNotNull() & ~F.col(a).eqNullSafe(F.col(b))).cast("long")
        routed = F.col("excluded").isNull()
        turns = F.sum(F.when(routed, crossed("in_m", "from_zone", "zone") + F.when(F.col("is_last"), crossed("back_m", "zone", "end_zone")).otherwise(0)).otherwise(0))
        out = self.stops.groupBy("order_id").agg(
            F.first("mode").alias("mode"), F.count("*").alias("lines"), F.sum("quantity").alias("units"), F.first("excluded").alias("excluded"),
            F.first("lost_legs").alias("lost"), F.first("order_m").alias("order_m"), turns.alias("zone_transitions"),
            F.min_by("pick_id", F.when(~F.col("known"), F.col("leg_no"))).alias("lost_pick"), F.collect_set("sku").alias("skus"), F.collect_set("location_id").alias("location_ids"),
        )
        reason = F.coalesce("excluded", F.when(F.col("lost") > 0, "UNREACHABLE_SEGMENT"))
        out = out.withColumn("reason", reason).withColumn("complete", F.col("reason").isNull())
        fails = F.when(F.col("excluded").isNull(), F.col("lost"))
        return out.select(
            "order_id", "mode", "lines", "units", "reason", "complete", F.when(F.col("complete"), F.col("order_m")).alias("total_distance_m"), "zone_transitions",
            fails.alias("unreachable_legs"), F.when(F.col("excluded") == "UNKNOWN_LOCATION", F.col("lost_pick")).alias("unknown_at_pick"), "skus", "location_ids",
        )

    @cached_property
    def legs(self) -> DataFrame:
        """One row per leg of a routable order (the last of an order leads to the end node); complete: of the whole order."""
        leg = lambda no, a, b, back, m, za, zb: F.struct(no.alias("leg_no"), a.alias("from_node"), b.alias("to_node"), F.lit(back).alias("is_return"), F.col(m).alias("distance_m"), F.col(za).alias("from_zone"), F.col(zb).alias("to_zone"))
        there = leg(F.col("leg_no"), F.col("before"), F.col("access"), False, "in_m", "from_zone", "zone")
        back = leg(F.col("leg_no") + 1, F.col("access"), F.lit(self.end), True, "back_m", "zone", "end_zone")
        each = self.stops.where("excluded is null").select("order_id", "mode", "pick_id", "sku", "location_id", (F.col("lost_legs") == 0).alias("complete"), F.explode(F.when(F.col("is_last"), F.array(there, back)).otherwise(F.array(there))).alias("leg"))
        return each.select("order_id", "mode", "pick_id", "sku", "location_id", "leg.*", "complete")

    def cached(self) -> Routing:
        """The same routes, kept for several readers."""
        return replace(self, stops=self.stops.cache())


def places(bundle: Bundle) -> DataFrame:
    """(location_id, access, access_known, zone) of each location; zone is that of its access node."""
    nodes = bundle.nodes.groupBy("node_id").agg(F.first("zone_id").alias("zone"), F.lit(True).alias("access_known"))
    own = bundle.locations.groupBy("location_id").agg(F.first("access_node_id").alias("access"))
    return own.join(nodes, own.access == nodes.node_id, "left").select("location_id", "access", F.coalesce("access_known", F.lit(False)).alias("access_known"), "zone")


def excluded(bundle: Bundle) -> Column:
    """Why an order has no route whatever its locations, from columns unsequenced, least_mode and most_mode."""
    reason = F.when(F.col("unsequenced"), "MISSING_PICK_SEQUENCE").when(F.col("least_mode") != F.col("most_mode"), "MIXED_ORDER_MODES")
    if not bundle.get("route_start_node") or not bundle.get("route_end_node"):
        reason = reason.otherwise("MISSING_ROUTE_ENDPOINTS")
    return reason


def in_order():
    return W.partitionBy("order_id").orderBy("pick_sequence", "pick_id", "ordinal")


def whole_order():
    return W.partitionBy("order_id")


def with_order_facts(p: DataFrame, bundle: Bundle, **more: Column) -> DataFrame:
    """p (sorted by in_order()) with the order's travel mode and excluded, and more of the whole order from one pass."""
    p = p.withColumns({k: c.over(whole_order()) for k, c in more.items()} | {"unsequenced": F.max(F.col("pick_sequence").isNull()).over(whole_order()), "least_mode": F.min("mode").over(whole_order()), "most_mode": F.max("mode").over(whole_order())})
    mode = F.when(F.col("least_mode") == F.col("most_mode"), F.col("least_mode")).otherwise(bundle.get("default_mode"))
    return p.withColumn("excluded", excluded(bundle)).withColumn("mode", mode).drop("unsequenced", "least_mode", "most_mode")


class Distances:
    """Looks up distances of (from, mode, to) columns; a known node is at 0 from itself in any mode."""

    def __init__(self, bundle: Bundle):
        self.bundle, known = bundle, network.between_stops(bundle)
        self.small = known is not None
        self.table = known

    def solve(self, pairs: DataFrame) -> None:
        """For layouts without a small table: the distances of distinct (src, mode, dst)."""
        if not self.small:
            self.table = checkpoint(network.shortest_paths(self.bundle.nodes, self.bundle.edges, pairs))

    def add(self, df: DataFrame, name: str, a: Column, b: Column, known: Column, mode: str = "mode") -> DataFrame:
        """df with the distance from a to b as `name`, null where there is none."""
        t = self.table.select(F.col("src").alias("__a"), F.col("mode").alias("__m"), F.col("dst").alias("__b"), F.col("dist").alias(f"__{name}"))
        t = F.broadcast(t) if self.small else t  # MOST_PAIRS rows at most
        out = df.join(t, (a == F.col("__a")) & (F.col(mode) == F.col("__m")) & (b == F.col("__b")), "left")
        return out.withColumn(name, F.when((a == b) & known, F.lit(0.0)).otherwise(F.col(f"__{name}"))).drop("__a", "__m", "__b", f"__{name}")


def build(bundle: Bundle, override: DataFrame | None = None) -> Routing:
    """Routes of all orders; override: (sku, to_location) replaces the recorded location of those SKUs."""
    start, end = bundle.get("route_start_node"), bundle.get("route_end_node")
    p = bundle.picks.select("order_id", "pick_id", "pick_sequence", "ordinal", "sku", "location_id", "quantity", "mode")
    if override is not None:
        p = p.join(override.select("sku", "to_location"), "sku", "left").withColumn("location_id", F.coalesce("to_location", "location_id")).drop("to_location")
    p = p.join(places(bundle).withColumn("known", F.lit(True)), "location_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    here = lambda node: F.col("node_id") == F.lit(node).cast("string")
    ends = bundle.nodes.agg(
        F.first(F.when(here(start), F.col("zone_id")), ignorenulls=True).alias("start_zone"), F.first(F.when(here(end), F.col("zone_id")), ignorenulls=True).alias("end_zone"),
    )
    p = p.crossJoin(F.broadcast(ends))  # one row
    p = p.withColumns({
        "leg_no": F.row_number().over(in_order()), "before": F.lag("access", 1, start).over(in_order()), "is_last": F.lead(F.lit(1), 1).over(in_order()).isNull(),
        "from_zone": F.when(F.row_number().over(in_order()) == 1, F.col("start_zone")).otherwise(F.lag("zone", 1).over(in_order())),
    })
    p = with_order_facts(p, bundle, lost=F.max(~F.col("known")))
    p = p.withColumn("excluded", F.coalesce("excluded", F.when(F.col("lost"), "UNKNOWN_LOCATION"))).drop("lost", "start_zone", "ordinal", "pick_sequence")
    at_end = F.when(F.col("is_last"), F.lit(end).cast("string"))
    d = Distances(bundle)
    if not d.small:
        p = checkpoint(p)
        routable = p.where("excluded is null")
        pairs = routable.select(F.col("before").alias("src"), "mode", F.col("access").alias("dst")).union(routable.select("access", "mode", at_end).where(at_end.isNotNull()))
        d.solve(pairs.distinct())
    p = d.add(p, "in_m", F.col("before"), F.col("access"), F.col("access_known"))
    p = d.add(p, "back_m", F.col("access"), at_end, F.col("access_known"))
    missing = F.col("in_m").isNull().cast("long") + (F.col("is_last") & F.col("back_m").isNull()).cast("long")
    walked = F.coalesce("in_m", F.lit(0.0)) + F.coalesce("back_m", F.lit(0.0))
    p = p.withColumns({"lost_legs": F.sum(missing).over(whole_order()), "order_m": F.sum(walked).over(whole_order())})
    paths = d.table.select(F.col("src").alias("from_node"), "mode", F.col("dst").alias("to_node"), "path")
    return Routing(p, paths, end)


def order_edges(routing: Routing) -> DataFrame:
    """(order_id, edge_id, traversals): how often each order's legs lead over each aisle segment, unfinished routes included."""
    used = routing.legs.where("distance_m is not null").groupBy("order_id", "from_node", "mode", "to_node").agg(F.count("*").alias("times"))
    each = used.join(routing.paths, ["from_node", "mode", "to_node"]).select("order_id", "times", F.explode("path").alias("edge_id"))
    return each.groupBy("order_id", "edge_id").agg(F.sum("times").alias("traversals"))


def unreachable_segments(routing: Routing) -> DataFrame:
    """(order_id, pick_id, from_node, to_node, mode): the legs without a permitted path; pick_id is null for the way to the end."""
    return routing.legs.where("distance_m is null").select("order_id", F.when(~F.col("is_return"), F.col("pick_id")).alias("pick_id"), "from_node", "to_node", "mode")


def touching(routing: Routing, *, skus: list[str] | None = None, locations: list[str] | None = None) -> DataFrame:
    """Orders that touch any of the SKUs or locations."""
    column, values = ("skus", skus) if skus is not None else ("location_ids", locations or [])
    return routing.orders.where(F.arrays_overlap(column, F.array(*map(F.lit, values)).cast("array<string>")))
