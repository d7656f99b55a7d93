"""Nine three-valued checks of whether two items may swap locations.

Each check is pass, fail or insufficient_data; an unknown value is never a pass. Directional checks look at item A
in B's location and at item B in A's, and the worse outcome counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Bundle
from .metrics import pick_assignments

CHECKS = ("volume", "weight", "unit_weight", "temperature", "hazard", "handling_mode", "zone", "level", "fixed")
NAMES = ("pass", "insufficient_data", "fail")
SLACK = 1e-9


def _grade(unknown: Column, bad: Column) -> Column:
    return F.when(unknown, 1).when(bad, 2).otherwise(0)


def _one_way(i: str, l: str) -> dict[str, Column]:  # noqa: E741
    """Severities of item side i in location side l."""
    item, place = (lambda c: F.col(f"{i}_{c}")), (lambda c: F.col(f"{l}_{c}"))
    units = F.coalesce(item("max_units"), item("current_units"))
    null = lambda *cs: F.greatest(*[c.isNull() for c in cs]) if len(cs) > 1 else cs[0].isNull()
    listed = lambda value, allowed: _grade(value.isNull() | (F.coalesce(F.size(allowed), F.lit(0)) <= 0), ~F.array_contains(allowed, value))
    return {
        "volume": _grade(null(item("unit_volume_m3"), units, place("capacity_volume_m3")), item("unit_volume_m3") * units > place("capacity_volume_m3") + SLACK),
        "weight": _grade(null(item("unit_weight_kg"), units, place("capacity_weight_kg")), item("unit_weight_kg") * units > place("capacity_weight_kg") + SLACK),
        "unit_weight": _grade(null(item("unit_weight_kg"), place("max_unit_weight_kg")), item("unit_weight_kg") > place("max_unit_weight_kg") + SLACK),
        "temperature": _grade(null(item("temperature_zone"), place("temperature_zone")), item("temperature_zone") != place("temperature_zone")),
        "hazard": listed(item("hazard_class"), place("hazard_classes_allowed")),
        "handling_mode": listed(item("handling_mode"), place("allowed_modes")),
    }


def sides(bundle: Bundle) -> DataFrame:
    """(sku, item and location attributes) of each SKU with a pick assignment to a known location and an item row."""
    places = bundle.locations.dropDuplicates(["location_id"]).select(
        F.col("location_id"), "capacity_volume_m3", "capacity_weight_kg", "max_unit_weight_kg", F.col("temperature_zone").alias("place_temperature"), "hazard_classes_allowed", "allowed_modes", "level", F.col("fixed").alias("place_fixed"), F.col("zone_id").alias("place_zone"), "location_type"
    )
    items = bundle.items.dropDuplicates(["sku"]).select("sku", "unit_volume_m3", "unit_weight_kg", F.col("temperature_zone").alias("item_temperature"), "hazard_class", "handling_mode", F.col("fixed_location").alias("item_fixed"))
    return pick_assignments(bundle).join(items, "sku").join(places, "location_id")


def check_swaps(bundle: Bundle, swaps: DataFrame) -> DataFrame:
    """swaps: (sku_a, sku_b). Adds one column check_<name> per check, status, failed and insufficient (lists in check order)."""
    own = sides(bundle)
    wide = swaps
    for s in ("a", "b"):
        side = own.select(F.col("sku").alias(f"sku_{s}"), F.lit(True).alias(f"{s}_there"), *[
            F.col(c).alias(f"{s}_{c}") for c in ("location_id", "unit_volume_m3", "unit_weight_kg", "hazard_class", "handling_mode", "item_fixed", "current_units", "max_units", "item_temperature")
        ], *[F.col(c).alias(f"{s}l_{c}") for c in ("capacity_volume_m3", "capacity_weight_kg", "max_unit_weight_kg", "hazard_classes_allowed", "allowed_modes", "level", "place_fixed", "place_zone", "location_type")],
            F.col("item_temperature").alias(f"{s}_temperature_zone"), F.col("place_temperature").alias(f"{s}l_temperature_zone"))
        wide = wide.join(side, f"sku_{s}", "left")
    there, back = _one_way("a", "bl"), _one_way("b", "al")
    grades = {c: F.greatest(there[c], back[c]) for c in there}
    types = (F.col("al_location_type") != "pick") | (F.col("bl_location_type") != "pick")
    zone = F.when(types, 2)
    if bundle.get("restrict_swaps_to_same_zone"):
        zone = zone.when(F.col("al_place_zone").isNull() | F.col("bl_place_zone").isNull(), 1).when(F.col("al_place_zone") != F.col("bl_place_zone"), 2)
    grades["zone"] = zone.otherwise(0)
    grades["level"] = _grade(F.col("al_level").isNull() | F.col("bl_level").isNull(), (F.col("al_level") != F.col("bl_level")) & F.lit(not bundle.get("allow_level_change")))
    fixed = lambda c: F.coalesce(F.col(c), F.lit(False))
    grades["fixed"] = F.when(fixed("a_item_fixed") | fixed("b_item_fixed") | fixed("al_place_fixed") | fixed("bl_place_fixed"), 2).otherwise(0)
    missing = F.col("a_there").isNull() | F.col("b_there").isNull()
    g = {c: F.when(missing, 1).otherwise(grades[c]) for c in CHECKS}
    graded = wide.select(*swaps.columns, F.col("a_location_id").alias("location_a"), F.col("b_location_id").alias("location_b"), *[g[c].alias(f"g_{c}") for c in CHECKS])
    name = lambda c: F.element_at(F.array(*map(F.lit, NAMES)), F.col(c) + 1)
    listed = lambda level: F.filter(F.array(*[F.when(F.col(f"g_{c}") == level, F.lit(c)) for c in CHECKS]), lambda x: x.isNotNull())
    worst = F.greatest(*[F.col(f"g_{c}") for c in CHECKS])
    status = F.when(worst == 2, "constraint_violation").when(worst == 1, "insufficient_constraint_data").otherwise("ok")
    return graded.select(*swaps.columns, "location_a", "location_b", *[name(f"g_{c}").alias(f"check_{c}") for c in CHECKS], status.alias("status"), listed(2).alias("failed"), listed(1).alias("insufficient"))
