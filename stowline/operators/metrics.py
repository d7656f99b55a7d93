"""Flow metrics of routes by order, location, item, aisle segment and zone.

Values carry full precision; rounding is left to the reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..schema import Bundle
from .network import away_from
from .routes import Routing


def percentile(column: str, p: float) -> Column:
    """Exact percentile with linear interpolation; null over no values."""
    if not 0 <= p <= 100:
        raise ValueError("p lies between 0 and 100")
    return F.percentile(column, p / 100)


def _zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0))


def flow_metrics(bundle: Bundle, routing: Routing) -> DataFrame:
    """One row of totals."""
    done = F.col("complete")
    o = routing.orders.agg(
        F.count("*").alias("total_orders"), F.count_if(done).alias("total_valid_orders"),
        F.coalesce(F.sum(F.when(done, F.col("lines"))), F.lit(0)).alias("pick_lines_in_valid_orders"),
        F.coalesce(F.sum("total_distance_m"), F.lit(0.0)).alias("total_distance_m"), F.avg("total_distance_m").alias("average_distance_per_order_m"),
        percentile("total_distance_m", 50).alias("median_distance_per_order_m"), percentile("total_distance_m", 90).alias("p90_distance_per_order_m"),
        F.coalesce(F.sum(F.when(done, F.col("zone_transitions"))), F.lit(0)).alias("zone_transitions"),
        F.count_if(F.col("reason") == "UNREACHABLE_SEGMENT").alias("unreachable_orders"), F.count_if(F.col("reason") == "MISSING_PICK_SEQUENCE").alias("unsequenced_orders"),
        F.count_if(~done).alias("excluded_orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_pick_lines"), F.coalesce(F.sum("units"), F.lit(0.0)).alias("total_units"),
    )
    return o.withColumn("average_distance_per_pick_m", F.try_divide("total_distance_m", "pick_lines_in_valid_orders"))


def _complete_legs(routing: Routing) -> DataFrame:
    return routing.legs.where("complete")


def _share(name: str) -> Column:
    total = F.sum(name).over(W.partitionBy())
    return 100.0 * F.col(name) / F.when(total == 0, 1).otherwise(total)


def location_metrics(bundle: Bundle, routing: Routing) -> DataFrame:
    """Every location: visits and distance of complete routes (a return leg counts for the last location), units of all picks."""
    legs = _complete_legs(routing)
    walked = legs.groupBy("location_id").agg(
        F.count_if(~F.col("is_return")).alias("visits"), F.countDistinct("order_id").alias("orders"), F.sum("distance_m").alias("attributable_distance_m")
    )
    units = bundle.picks.groupBy("location_id").agg(F.sum("quantity").alias("units"))
    away = away_from(bundle, bundle.get("route_start_node"), bundle.get("default_mode")).withColumnRenamed("away", "distance_from_start_m")
    out = bundle.locations.select("location_id", "access_node_id", "zone_id").join(walked, "location_id", "left").join(units, "location_id", "left").join(away, "access_node_id", "left")
    out = out.select("location_id", "zone_id", _zero("visits").alias("visits"), _zero("orders").alias("orders"), F.coalesce("units", F.lit(0.0)).alias("units"), F.coalesce("attributable_distance_m", F.lit(0.0)).alias("attributable_distance_m"), "distance_from_start_m")
    # a layout's locations: one partition for the shares is of the building's size
    return out.withColumn("pick_share_percent", _share("visits")).withColumn("distance_share_percent", _share("attributable_distance_m"))


def sku_metrics(bundle: Bundle, routing: Routing) -> DataFrame:
    """Every item: lines, units and orders of all picks, distance of the legs that lead to it (no return legs)."""
    p = bundle.picks.groupBy("sku").agg(F.count("*").alias("pick_lines"), F.sum("quantity").alias("units"), F.countDistinct("order_id").alias("orders"))
    walked = _complete_legs(routing).where(~F.col("is_return")).groupBy("sku").agg(F.sum("distance_m").alias("attributable_distance_m"))
    out = bundle.items.select("sku").distinct().join(p, "sku", "left").join(walked, "sku", "left").join(pick_assignments(bundle).select("sku", "location_id"), "sku", "left")
    out = out.select("sku", "location_id", _zero("pick_lines").alias("pick_lines"), F.coalesce("units", F.lit(0.0)).alias("units"), _zero("orders").alias("orders"), F.coalesce("attributable_distance_m", F.lit(0.0)).alias("attributable_distance_m"))
    total = F.broadcast(out.agg(F.sum("pick_lines").alias("all_lines"), F.sum("attributable_distance_m").alias("all_m")))  # one row
    guard = lambda c: F.when(F.col(c) == 0, 1).otherwise(F.col(c))
    shares = {"pick_share_percent": 100.0 * F.col("pick_lines") / guard("all_lines"), "distance_share_percent": 100.0 * F.col("attributable_distance_m") / guard("all_m")}
    return out.crossJoin(total).withColumns(shares).drop("all_lines", "all_m")


def pick_assignments(bundle: Bundle) -> DataFrame:
    """The first assignment with role 'pick' of each SKU, in input order."""
    rows = bundle.assignments.where("role = 'pick'")
    first = rows.groupBy("sku").agg(F.min_by(F.struct("location_id", "current_units", "max_units"), "ordinal").alias("x"))
    return first.select("sku", "x.*")


def edge_flows(bundle: Bundle, routing: Routing) -> DataFrame:
    """Every edge: traversals in both directions over complete routes, share, and length walked."""
    # paths are counted by leg kind first, so that only distinct (from, to, mode) paths are expanded
    used = _complete_legs(routing).groupBy("from_node", "to_node", "mode").agg(F.count("*").alias("times"))
    each = used.join(routing.paths, ["from_node", "to_node", "mode"]).select("times", F.explode("path").alias("edge_id"))
    counts = each.groupBy("edge_id").agg(F.sum("times").alias("traversals"))
    out = bundle.edges.select("edge_id", "distance_m").join(counts, "edge_id", "left").select("edge_id", _zero("traversals").alias("traversals"), "distance_m")
    return out.select("edge_id", "traversals", _share("traversals").alias("share_percent"), (F.col("traversals") * F.col("distance_m")).alias("walked_m"))


def zone_flows(bundle: Bundle, routing: Routing) -> DataFrame:
    """Visits of complete routes by the location's zone; 'UNZONED' without one."""
    visits = _complete_legs(routing).where(~F.col("is_return")).groupBy("location_id").agg(F.count("*").alias("visits"))
    zone = bundle.locations.select("location_id", F.coalesce("zone_id", F.lit("UNZONED")).alias("zone_id"))
    return visits.join(zone, "location_id").groupBy("zone_id").agg(F.sum("visits").alias("visits")).withColumn("share_percent", _share("visits"))


def top_orders(routing: Routing, n: int) -> DataFrame:
    return routing.orders.where("complete").orderBy(F.desc("total_distance_m"), "order_id").limit(n)


def top_locations(locations: DataFrame, n: int) -> DataFrame:
    return locations.orderBy(F.desc("attributable_distance_m"), "location_id").limit(n).where("attributable_distance_m > 0")


def data_quality(bundle: Bundle, routing: Routing) -> DataFrame:
    """Counts of the blocks and the share of orders that could be routed, one row."""
    one = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    counts = one("nodes", bundle.nodes)
    for b in ("edges", "locations", "items", "assignments"):
        counts = counts.union(one(b, getattr(bundle, b)))
    p = bundle.picks.agg(F.count("*").alias("picks"), F.count("timestamp").alias("picks_with_timestamp"), F.count("pick_sequence").alias("picks_with_sequence"))
    o = routing.orders.agg(F.count("*").alias("orders"), F.count_if("complete").alias("routed_orders"), F.count_if(~F.col("complete")).alias("excluded_orders"))
    for facts in (p, o):
        counts = counts.union(facts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in facts.columns])).alias("x")).select("x.*"))
    names = ("orders", "routed_orders", "excluded_orders", "nodes", "edges", "locations", "items", "assignments", "picks", "picks_with_timestamp", "picks_with_sequence")
    out = counts.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names])  # a row per count
    return out.withColumn("route_coverage_percent", F.when(F.col("orders") == 0, 0.0).otherwise(100.0 * F.col("routed_orders") / F.col("orders")))
