"""Validation: one DataFrame of issues per rule under ISSUES' schema, their union in rule order, and a status."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ABC_BASES, DISTANCE_BASES, IDS, LOCATION_TYPES, MODES, SEQUENCE_BASES, Bundle
from . import network
from .routes import Routing, build

ISSUES = "rule int, code string, severity string, field string, message string, affected array<string>"
#: Issues that leave data usable for the other orders; any other error is structural.
ORDER_LEVEL = ("MIXED_ORDER_MODES", "DISCONNECTED_ROUTE", "MISSING_PICK_SEQUENCE", "UNKNOWN_LOCATION_IN_ROUTE", "UNREACHABLE_SEGMENT", "MISSING_ROUTE_ENDPOINTS")


@dataclass(frozen=True)
class Report:
    issues: DataFrame
    status: str
    routing: Routing | None

    @property
    def exit_code(self) -> int:
        return {"ok": 0, "data_error": 1}.get(self.status, 2)


class _Rules:
    """Collects rules in order. Rules about the rows of one table are judged in one pass over it."""

    def __init__(self, bundle: Bundle):
        self.b, self.spark, self.made, self.facts, self.n = bundle, bundle.spark, [], [], 0

    def fact(self, bad: bool, code: str, severity: str, field: str, message: str) -> None:
        """A rule about meta or config, known on the driver."""
        self.n += 1
        if bad:
            self.facts.append((self.n, code, severity, field, message, []))

    def _issue(self, code: str, severity: str, field: str, message: str, affected: Column) -> Column:
        self.n += 1
        return F.struct(F.lit(self.n).alias("rule"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field"), F.lit(message).alias("message"), affected.alias("affected"))

    def none(self, df: DataFrame, code: str, field: str, message: str) -> None:
        """A rule that a table has a row."""
        one = df.limit(1).agg(F.count("*").alias("n")).where("n = 0")
        self.made.append(one.select(self._issue(code, "error", field, message, F.expr("cast(array() as array<string>)")).alias("x")).select("x.*"))

    def each(self, df: DataFrame, *rules: tuple) -> None:
        """rules: (condition, code, severity, field, message, affected columns); one issue per row and rule that applies."""
        found = []
        for bad, code, severity, field, message, *affected in rules:
            ids = F.array(*[F.col(c).cast("string") for c in affected])
            found.append(F.when(bad, self._issue(code, severity, field, message, ids)))
        some = F.array_compact(F.array(*found))
        applies = functools.reduce(operator.or_, [F.coalesce(rule[0], F.lit(False)) for rule in rules])
        self.made.append(df.where(applies).select(F.explode(some).alias("x")).select("x.*"))

    def once(self, df: DataFrame, column: str, code: str, severity: str, field: str, message: str) -> None:
        """A rule with one issue for all rows of df, if there are any; for ids of a layout or a master table."""
        found = df.select(F.col(column).cast("string").alias("x")).distinct().agg(F.array_sort(F.collect_list("x")).alias("ids")).where(F.size("ids") > 0)
        self.made.append(found.select(self._issue(code, severity, field, message, F.col("ids")).alias("x")).select("x.*"))

    def table(self) -> DataFrame:
        out = self.spark.createDataFrame(self.facts, ISSUES).coalesce(1)
        for more in self.made:
            out = out.unionByName(more)
        return out


def _marked(df: DataFrame, column: str, known: DataFrame, key: str, flag: str) -> DataFrame:
    """df with `flag`: whether the column names nothing known (null names nothing)."""
    ids = known.select(F.col(key).alias(f"__{flag}")).where(F.col(key).isNotNull()).distinct()
    return df.join(ids, F.col(column) == F.col(f"__{flag}"), "left").withColumn(flag, F.col(column).isNotNull() & F.col(f"__{flag}").isNull()).drop(f"__{flag}")


def _stamp(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(text) if text else None
    except ValueError:
        return None


def issues(bundle: Bundle) -> DataFrame:
    """All issues that need no routes."""
    b, r = bundle, _Rules(bundle)
    m = b.meta
    r.fact(m.sequence_basis not in SEQUENCE_BASES, "UNKNOWN_SEQUENCE_BASIS", "error", "meta.sequence_basis", "not a known basis")
    r.fact(m.sequence_basis == "unknown", "SEQUENCE_BASIS_UNKNOWN", "info", "meta.sequence_basis", "the source of the sequence is not declared")
    r.fact(m.distance_basis not in DISTANCE_BASES, "UNKNOWN_DISTANCE_BASIS", "error", "meta.distance_basis", "not a known basis")
    r.fact(m.distance_unit != "m", "UNKNOWN_DISTANCE_UNIT", "error", "meta.distance_unit", "distances are in metres")
    for name in ("period_start", "period_end"):
        value = getattr(m, name)
        r.fact(bool(value) and _stamp(value) is None, "INVALID_TIMESTAMP", "error", f"meta.{name}", "not an ISO 8601 time")
    r.fact(not m.fictional, "NON_FICTIONAL_DATASET", "info", "meta.fictional", "real data: check what may be shared")
    for block, key in IDS.items():
        twice = getattr(b, block).groupBy(key).count().where("count > 1")
        code = "DUPLICATE_" + {"items": "SKU"}.get(block, key.upper())
        if block == "picks":  # of any number: an issue per id
            r.each(twice, (F.lit(True), code, "error", f"{block}.{key}", "the id occurs more than once", key))
        else:
            r.once(twice, key, code, "error", f"{block}.{key}", "the id occurs more than once")
    for block in ("nodes", "edges"):
        r.none(getattr(b, block), "EMPTY_LAYOUT", block, "there are none")
    lost = lambda field: f"{field} names nothing known"
    edges = _marked(_marked(b.edges, "from_node", b.nodes, "node_id", "from_lost"), "to_node", b.nodes, "node_id", "to_lost")
    r.each(
        edges,
        *[(F.col(f"{e}_lost"), "UNKNOWN_NODE_REFERENCE", "error", f"edges.{e}_node", lost(f"edges.{e}_node"), "edge_id", f"{e}_node") for e in ("from", "to")],
        (F.col("distance_m") <= 0, "INVALID_EDGE_DISTANCE", "error", "edges.distance_m", "a length is greater than 0", "edge_id"),
        (F.col("from_node") == F.col("to_node"), "SELF_LOOP_EDGE", "warning", "edges", "an edge joins two nodes", "edge_id"),
        (F.coalesce(F.size("allowed_modes"), F.lit(0)) <= 0, "EDGE_WITHOUT_MODE", "error", "edges.allowed_modes", "no mode may use it", "edge_id"),
    )
    parts = network.components(b.nodes, b.edges)
    first = parts.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select(F.col("component").alias("__main"))
    r.once(parts.join(F.broadcast(first), F.col("component") == F.col("__main"), "left_anti"), "node_id", "DISCONNECTED_GRAPH", "error", "edges", "nodes outside the largest component")
    start, end = b.get("route_start_node"), b.get("route_end_node")
    r.fact(not start or not end, "MISSING_ROUTE_ENDPOINT", "error", "config", "routes need a start and an end node")
    for name, node in (("route_start_node", start), ("route_end_node", end)):
        r.none(b.nodes if not node else b.nodes.where(F.col("node_id") == node), "UNKNOWN_NODE_REFERENCE", f"config.{name}", "not a node")
    r.fact(b.get("default_mode") not in MODES, "UNKNOWN_MODE", "error", "config.default_mode", "not a known mode")
    r.fact(b.get("abc_basis") not in ABC_BASES, "UNKNOWN_ABC_BASIS", "error", "config.abc_basis", "not a known basis")
    t = b.get("abc_thresholds")
    r.fact(not 0 < t["A"] < t["B"] <= 1, "INVALID_ABC_THRESHOLDS", "error", "config.abc_thresholds", "0 < A < B <= 1")
    loc = b.locations
    r.each(
        _marked(loc, "access_node_id", b.nodes, "node_id", "access_lost"),
        (F.coalesce("access_node_id", F.lit("")) == "", "LOCATION_WITHOUT_ACCESS_NODE", "error", "locations.access_node_id", "missing", "location_id"),
        ((F.col("access_node_id") != "") & F.col("access_lost"), "UNKNOWN_NODE_REFERENCE", "error", "locations.access_node_id", lost("locations.access_node_id"), "location_id"),
        *[(F.col(c) <= 0, "INVALID_CAPACITY", "error", f"locations.{c}", "a capacity is greater than 0", "location_id") for c in ("capacity_volume_m3", "capacity_weight_kg", "max_unit_weight_kg")],
        (F.col("max_unit_weight_kg") > F.col("capacity_weight_kg"), "INCONSISTENT_CAPACITY", "error", "locations", "one unit may weigh more than all", "location_id"),
        (~F.col("location_type").isin(*LOCATION_TYPES), "UNKNOWN_LOCATION_TYPE", "error", "locations.location_type", "not a known type", "location_id"),
        (F.coalesce(F.size("allowed_modes"), F.lit(0)) <= 0, "LOCATION_WITHOUT_MODE", "warning", "locations.allowed_modes", "no mode may serve it", "location_id"),
    )
    r.each(
        b.items,
        *[(F.col(c) <= 0, "INVALID_ITEM_MEASURE", "error", f"items.{c}", "a measure is greater than 0", "sku") for c in ("unit_volume_m3", "unit_weight_kg")],
        (F.coalesce("description", F.lit("")) == "", "MISSING_ITEM_DESCRIPTION", "info", "items.description", "empty", "sku"),
    )
    _assigned(r)
    _picks(r)
    return r.table()


def _assigned(r: _Rules) -> None:
    b = r.b
    place = b.locations.select("location_id", "location_type", "max_unit_weight_kg", F.col("temperature_zone").alias("place_temperature"), "hazard_classes_allowed", "allowed_modes", F.lit(True).alias("place_known"))
    item = b.items.select("sku", "unit_weight_kg", "temperature_zone", "hazard_class", "handling_mode", F.lit(True).alias("item_known"))
    both = b.assignments.join(place, "location_id", "left").join(item, "sku", "left")
    at = ("sku", "location_id")
    met = F.col("place_known") & F.col("item_known")
    refused = lambda value, allowed: met & (F.size(allowed) > 0) & ~F.array_contains(allowed, F.col(value))
    r.each(
        both,
        (F.col("sku").isNotNull() & F.col("item_known").isNull(), "UNKNOWN_SKU", "error", "assignments.sku", "assignments.sku names nothing known", *at),
        (F.col("location_id").isNotNull() & F.col("place_known").isNull(), "UNKNOWN_LOCATION", "error", "assignments.location_id", "assignments.location_id names nothing known", *at),
        (F.col("max_units") <= 0, "INVALID_CAPACITY", "error", "assignments.max_units", "a capacity is greater than 0", *at),
        (F.col("current_units") > F.col("max_units"), "INCONSISTENT_CAPACITY", "error", "assignments", "more units than fit", *at),
        ((F.col("role") == "pick") & (F.col("location_type") != "pick"), "PICK_ROLE_ON_NON_PICK_LOCATION", "error", "assignments.role", "the location is no pick location", *at),
        (met & (F.col("unit_weight_kg") > F.col("max_unit_weight_kg")), "ITEM_TOO_HEAVY_FOR_LOCATION", "error", "assignments", "a unit weighs more than the location bears", *at),
        (met & (F.col("temperature_zone") != F.col("place_temperature")), "TEMPERATURE_INCOMPATIBLE", "error", "assignments", "temperature zones differ", *at),
        (refused("hazard_class", "hazard_classes_allowed"), "HAZARD_INCOMPATIBLE", "error", "assignments", "hazard_class is not allowed there", *at),
        (refused("handling_mode", "allowed_modes"), "MODE_NOT_ALLOWED", "error", "assignments", "handling_mode is not allowed there", *at),
    )
    picks = b.assignments.where("role = 'pick'")
    r.each(picks.groupBy("sku").count().where("count > 1"), (F.lit(True), "MULTIPLE_PICK_ASSIGNMENTS", "error", "assignments.sku", "more than one pick location", "sku"))
    shared = picks.groupBy("location_id").agg(F.countDistinct("sku").alias("n")).where("n > 1")
    r.each(shared, (F.lit(True), "SHARED_PICK_LOCATION", "error", "assignments.location_id", "more than one SKU", "location_id"))


def _picks(r: _Rules) -> None:
    b = r.b
    p = b.picks
    r.none(p, "NO_PICKS", "picks", "there are none")
    p = p.withColumn("__at", F.try_to_timestamp("timestamp"))
    stamp = F.col("__at")
    start, end = _stamp(b.meta.period_start), _stamp(b.meta.period_end)
    outside = F.lit(False)
    if start and end:
        # instants where stamp and period both carry an offset, else the wall clock of both
        plain = lambda c: F.try_to_timestamp(F.substring(c, 1, 19))
        offset = F.col("timestamp").rlike(r"(Z|[+-]\d\d:?\d\d)$")
        lo, hi = F.lit(b.meta.period_start), F.lit(b.meta.period_end)
        aware = offset & F.lit(start.tzinfo is not None)
        p = p.withColumn("__wall", plain(F.col("timestamp")))
        inside = F.when(aware, stamp.between(F.try_to_timestamp(lo), F.try_to_timestamp(hi))).otherwise(F.col("__wall").between(plain(lo), plain(hi)))
        outside = stamp.isNotNull() & ~inside
    marked = _marked(_marked(p, "sku", b.items, "sku", "sku_lost"), "location_id", b.locations, "location_id", "location_lost")
    r.each(
        marked,
        (F.col("sku_lost"), "UNKNOWN_SKU", "error", "picks.sku", "picks.sku names nothing known", "pick_id"),
        (F.col("location_lost"), "UNKNOWN_LOCATION", "error", "picks.location_id", "picks.location_id names nothing known", "pick_id"),
        (F.coalesce("order_id", F.lit("")) == "", "MISSING_ORDER_ID", "error", "picks.order_id", "missing", "pick_id"),
        (F.col("quantity") <= 0, "INVALID_QUANTITY", "error", "picks.quantity", "a quantity is greater than 0", "pick_id"),
        (F.col("pick_sequence") <= 0, "INVALID_PICK_SEQUENCE", "error", "picks.pick_sequence", "a sequence starts at 1", "pick_id"),
        (F.col("mode").isNotNull() & ~F.col("mode").isin(*MODES), "UNKNOWN_MODE", "error", "picks.mode", "not a known mode", "pick_id"),
        ((F.col("timestamp") != "") & stamp.isNull(), "INVALID_TIMESTAMP", "error", "picks.timestamp", "not an ISO 8601 time", "pick_id"),
        (outside, "TIMESTAMP_OUTSIDE_PERIOD", "error", "picks.timestamp", "outside the declared period", "pick_id"),
    )
    sequenced = p.where("pick_sequence is not null").select("order_id", "pick_sequence", "pick_id")
    shared = sequenced.groupBy("order_id", "pick_sequence").count().where("count > 1").drop("count")  # ids are gathered for these alone
    again = sequenced.join(shared, ["order_id", "pick_sequence"]).groupBy("order_id", "pick_sequence").agg(F.array_sort(F.collect_list("pick_id")).alias("ids"))
    r.made.append(again.select(r._issue("DUPLICATE_PICK_SEQUENCE", "error", "picks.pick_sequence", "picks of one order share a sequence", F.col("ids")).alias("x")).select("x.*"))
    per_order = p.groupBy("order_id").agg(F.max(F.col("pick_sequence").isNull()).alias("gap"), F.min("mode").alias("lo"), F.max("mode").alias("hi"))
    r.each(
        per_order,
        (F.col("gap"), "MISSING_PICK_SEQUENCE", "warning", "picks.pick_sequence", "the order has picks without a sequence", "order_id"),
        (F.col("lo") != F.col("hi"), "MIXED_ORDER_MODES", "error", "picks.mode", "the order's picks name several modes", "order_id"),
    )


def route_issues(routing: Routing) -> DataFrame:
    """One issue per unreachable leg, and one per order whose route fell for a reason of its own."""
    gone = routing.legs.where("distance_m is null").select(F.array("order_id", "from_node", "to_node").alias("affected"))
    legs = gone.select(F.lit(1000).alias("rule"), F.lit("DISCONNECTED_ROUTE").alias("code"), F.lit("error").alias("severity"), F.lit("picks").alias("field"), F.lit("no permitted path").alias("message"), "affected")
    other = routing.orders.where("reason in ('UNKNOWN_LOCATION', 'MISSING_ROUTE_ENDPOINTS')")
    rest = other.select(F.lit(1001).alias("rule"), F.col("reason").alias("code"), F.lit("error").alias("severity"), F.lit("picks").alias("field"), F.lit("the order has no route").alias("message"), F.array("order_id").alias("affected"))
    return legs.unionByName(rest)


def validate(bundle: Bundle) -> Report:
    """Issues and status; routes are built only where no structural error stands. Both are kept for several readers."""
    found = issues(bundle).cache()
    structural = (F.col("severity") == "error") & ~F.col("code").isin(*ORDER_LEVEL)
    seen = found.agg(F.count_if(structural).alias("structural"), F.count_if(F.col("severity") == "error").alias("errors")).first()
    if seen.structural:
        return Report(found, "data_error", None)
    routing = build(bundle).cached()
    done = routing.orders.agg(F.count("*").alias("n"), F.count_if("complete").alias("ok"), F.count_if(F.col("reason").isin("UNKNOWN_LOCATION", "MISSING_ROUTE_ENDPOINTS", "UNREACHABLE_SEGMENT")).alias("lost")).first()
    if not done.n or not done.ok:
        status = "insufficient_evidence"
    else:
        status = "partial" if done.ok < done.n or seen.errors or done.lost else "ok"
    return Report(found.unionByName(route_issues(routing)), status, routing)
