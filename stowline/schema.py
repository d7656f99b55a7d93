"""The six blocks, their Spark schemas, and the parameters that queries take."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The enumerations of the data model.
NODE_TYPES = ("junction", "depot", "receiving", "shipping", "packing", "location_access")
MODES = ("pedestrian", "forklift", "tugger")
LOCATION_TYPES = ("pick", "reserve", "buffer", "staging")
ROLES = ("pick", "reserve")
SEQUENCE_BASES = ("planned", "scan_confirmed", "observed", "unknown")
CONFIRMED_SEQUENCES = ("scan_confirmed", "observed")
DISTANCE_BASES = ("declared_graph_shortest_path",)
ABC_BASES = ("pick_lines", "units", "orders")

# The default of every query parameter.
DEFAULTS: dict[str, Any] = {
    "route_start_node": None,
    "route_end_node": None,
    "default_mode": "pedestrian",
    "abc_basis": "pick_lines",
    "abc_thresholds": {"A": 0.8, "B": 0.95},
    "xyz_time_bucket": "day",
    "xyz_minimum_buckets": 7,
    "xyz_thresholds": {"X": 0.5, "Y": 1.0},
    "minimum_improvement_percent": 1.0,
    "maximum_recommendations": 10,
    "maximum_candidate_swaps": 500,
    "affinity_minimum_co_picks": 2,
    "affinity_minimum_support": 0.05,
    "restrict_swaps_to_same_zone": False,
    "allow_level_change": False,
    "spaghetti_top_orders": 10,
}
#: For these an explicit 0 or empty value means the default.
ZERO_MEANS_DEFAULT = ("xyz_minimum_buckets", "affinity_minimum_co_picks", "maximum_candidate_swaps", "maximum_recommendations")


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(spec: str) -> T.StructType:
    """A schema from 'name type, ...'; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in spec.split(","))])


BLOCKS: dict[str, T.StructType] = {
    "nodes": _struct("node_id string, x_m double, y_m double, node_type string, zone_id string"),
    "edges": _struct("edge_id string, from_node string, to_node string, distance_m double, bidirectional boolean, allowed_modes array<string>"),
    "locations": _struct(
        "location_id string, access_node_id string, zone_id string, location_type string, capacity_volume_m3 double, capacity_weight_kg double, max_unit_weight_kg double,"
        " temperature_zone string, hazard_classes_allowed array<string>, allowed_modes array<string>, level int, fixed boolean"
    ),
    "items": _struct(
        "sku string, description string, unit_volume_m3 double, unit_weight_kg double, temperature_zone string, hazard_class string, handling_mode string, fixed_location boolean"
    ),
    "assignments": _struct("sku string, location_id string, role string, current_units int, max_units int"),
    "picks": _struct("pick_id string, order_id string, pick_sequence int, timestamp string, sku string, location_id string, quantity double, mode string"),
}
#: Columns without which a row of a block is refused.
REQUIRED = {
    "nodes": ("node_id", "x_m", "y_m", "node_type"),
    "edges": ("edge_id", "from_node", "to_node", "distance_m", "bidirectional"),
    "locations": ("location_id", "access_node_id", "location_type"),
    "items": ("sku",),
    "assignments": ("sku", "location_id", "role"),
    "picks": ("pick_id", "order_id", "sku", "location_id", "quantity"),
}
ENUMS = {("nodes", "node_type"): NODE_TYPES, ("locations", "location_type"): LOCATION_TYPES, ("assignments", "role"): ROLES}
IDS = {"nodes": "node_id", "edges": "edge_id", "locations": "location_id", "items": "sku", "picks": "pick_id"}


@dataclass(frozen=True)
class Meta:
    dataset_id: str = "dataset"
    site_id: str | None = None
    period_start: str | None = None
    period_end: str | None = None
    distance_unit: str = "m"
    time_zone: str | None = None
    source: str | None = None
    fictional: bool = True
    sequence_basis: str = "unknown"
    distance_basis: str = "declared_graph_shortest_path"


@dataclass(frozen=True)
class Bundle:
    """Six DataFrames under BLOCKS' schemas (assignments and picks with an `ordinal`, the input order), meta and config."""

    nodes: DataFrame
    edges: DataFrame
    locations: DataFrame
    items: DataFrame
    assignments: DataFrame
    picks: DataFrame
    meta: Meta = field(default_factory=Meta)
    config: dict[str, Any] = field(default_factory=dict)

    def get(self, key: str) -> Any:
        value = self.config.get(key, DEFAULTS[key])
        if key in ZERO_MEANS_DEFAULT and not value:
            return DEFAULTS[key]
        return DEFAULTS[key] | value if isinstance(DEFAULTS[key], dict) else value

    def with_config(self, **changes: Any) -> Bundle:
        return replace(self, config=self.config | changes)

    @property
    def spark(self):
        return self.picks.sparkSession
