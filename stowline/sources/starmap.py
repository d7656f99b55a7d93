"""A view of the star-schema test tables as the six blocks.

Nations are nodes of a grid whose zones are regions, suppliers are locations with one item each, line items are picks.
Attributes without a counterpart are integer rules of the supplier key, with nulls, so that every outcome occurs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schema import Bundle, Meta

#: SQL that both engines run; lpad and the modulus behave alike on the key ranges used here.
NODES = """SELECT concat('N', lpad(CAST(n_nationkey AS varchar(9)), 2, '0')) AS node_id, CAST(n_nationkey % 5 AS double) * 10 AS x_m,
 CAST(n_nationkey - n_nationkey % 5 AS double) * 2 AS y_m, 'junction' AS node_type, r_name AS zone_id FROM nation JOIN region ON n_regionkey = r_regionkey"""
EDGES = """SELECT concat('H', lpad(CAST(n_nationkey AS varchar(9)), 2, '0')) AS edge_id, concat('N', lpad(CAST(n_nationkey AS varchar(9)), 2, '0')) AS from_node,
 concat('N', lpad(CAST(n_nationkey + 1 AS varchar(9)), 2, '0')) AS to_node, CAST(10 + n_nationkey % 3 AS double) AS distance_m, n_nationkey % 6 <> 5 AS bidirectional, n_nationkey % 4 <> 3 AS forklift
 FROM nation WHERE n_nationkey % 5 < 4
 UNION ALL SELECT concat('V', lpad(CAST(n_nationkey AS varchar(9)), 2, '0')), concat('N', lpad(CAST(n_nationkey AS varchar(9)), 2, '0')),
 concat('N', lpad(CAST(n_nationkey + 5 AS varchar(9)), 2, '0')), CAST(10 + n_nationkey % 4 AS double), true, n_nationkey % 7 <> 6 FROM nation WHERE n_nationkey < 20"""
PLACES = """SELECT concat('L', lpad(CAST(s_suppkey AS varchar(9)), 7, '0')) AS location_id, concat('S', lpad(CAST(s_suppkey AS varchar(9)), 7, '0')) AS sku,
 concat('N', lpad(CAST(s_nationkey AS varchar(9)), 2, '0')) AS access_node_id, CASE WHEN s_suppkey % 23 = 0 THEN NULL ELSE r_name END AS zone_id,
 CASE WHEN s_suppkey % 10 = 0 THEN 'reserve' ELSE 'pick' END AS location_type, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_suppkey % 5 + 1 AS double) END AS capacity_volume_m3,
 CAST(s_suppkey % 9 + 1 AS double) * 100 AS capacity_weight_kg, CAST(s_suppkey % 6 + 1 AS double) * 5 AS max_unit_weight_kg,
 CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'chilled' ELSE 'ambient' END AS temperature_zone, s_suppkey % 4 AS hazard_rule, s_suppkey % 8 = 0 AS forklift_only,
 CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE CAST(s_suppkey % 2 AS int) END AS level, s_suppkey % 17 = 0 AS fixed,
 CASE WHEN s_suppkey % 12 = 0 THEN NULL ELSE CAST(s_suppkey % 4 + 1 AS double) / 64 END AS unit_volume_m3, CAST(s_suppkey % 7 + 1 AS double) * 2 AS unit_weight_kg,
 CASE WHEN s_suppkey % 10 = 1 THEN NULL WHEN s_suppkey % 9 = 0 THEN 'flammable' ELSE 'none' END AS hazard_class, CASE WHEN s_suppkey % 5 = 0 THEN 'forklift' ELSE 'pedestrian' END AS handling_mode,
 s_suppkey % 19 = 0 AS fixed_location, CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE 50 END AS max_units
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
#: Some orders lack a sequence (key % 41 = 0), go by forklift (% 10 = 0) or mix modes (% 97 = 0); some picks are off their assigned location.
PICKS = """SELECT concat(CAST(l_orderkey AS varchar(19)), '-', lpad(CAST(n AS varchar(9)), 4, '0')) AS pick_id, lpad(CAST(l_orderkey AS varchar(19)), 12, '0') AS order_id,
 CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE n END AS pick_sequence, l_linenumber, l_shipdate, concat('S', lpad(CAST(l_suppkey AS varchar(9)), 7, '0')) AS sku,
 concat('L', lpad(CAST(CASE WHEN l_partkey % 50 = 0 AND l_suppkey > 1 THEN l_suppkey - 1 ELSE l_suppkey END AS varchar(9)), 7, '0')) AS location_id, l_quantity AS quantity,
 CASE WHEN l_orderkey % 97 = 0 AND n = 1 THEN 'tugger' WHEN l_orderkey % 97 = 0 THEN 'pedestrian' WHEN l_orderkey % 10 = 0 THEN 'forklift' ELSE NULL END AS mode
 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS int) AS n FROM lineitem) t"""
START = "N00"
PERIOD = ("1995-01-01T00:00:00", "2001-06-30T23:59:59")


def bundle(spark: SparkSession, sf_dir: str, **config) -> Bundle:
    """The blocks as DataFrames over the Parquet tables."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "region", "supplier", "lineitem")}

    def sql(query: str):
        for n in t:
            query = query.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n} ", f"JOIN {{{n}}} AS {n} ")
        return spark.sql(query, **{n: t[n] for n in t if f"{{{n}}}" in query})

    places = sql(PLACES)
    modes = "CASE WHEN forklift_only THEN array('forklift') ELSE array('pedestrian', 'forklift') END"
    hazards = "CASE hazard_rule WHEN 0 THEN cast(array() as array<string>) WHEN 1 THEN array('none', 'flammable') ELSE array('none') END"
    return Bundle(
        nodes=sql(NODES),
        edges=sql(EDGES).selectExpr("edge_id", "from_node", "to_node", "distance_m", "bidirectional", "CASE WHEN forklift THEN array('pedestrian', 'forklift') ELSE array('pedestrian') END AS allowed_modes"),
        locations=places.selectExpr("location_id", "access_node_id", "zone_id", "location_type", "capacity_volume_m3", "capacity_weight_kg", "max_unit_weight_kg", "temperature_zone", f"{hazards} AS hazard_classes_allowed", f"{modes} AS allowed_modes", "level", "fixed"),
        items=places.selectExpr("sku", "concat('Item ', sku) AS description", "unit_volume_m3", "unit_weight_kg", "temperature_zone", "hazard_class", "handling_mode", "fixed_location"),
        assignments=places.selectExpr("sku", "location_id", "'pick' AS role", "10 AS current_units", "max_units", "0L AS ordinal"),
        picks=sql(PICKS).selectExpr("pick_id", "order_id", "pick_sequence", "date_format(l_shipdate, \"yyyy-MM-dd'T'HH:mm:ss\") AS timestamp", "sku", "location_id", "quantity", "mode", "0L AS ordinal", "l_linenumber"),
        meta=Meta(dataset_id="star", sequence_basis="planned", period_start=PERIOD[0], period_end=PERIOD[1]),
        config={"route_start_node": START, "route_end_node": START, "affinity_minimum_support": 0.0005, "minimum_improvement_percent": 0.001, "maximum_candidate_swaps": 200} | config,
    )
