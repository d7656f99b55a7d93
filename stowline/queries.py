"""Registered queries over the star-schema tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import affinity, classify, constraints, metrics, network, normalise, quality, routes, slotting
from .plans import analyse, evidence
from .schema import DEFAULTS
from .sources import starmap

MODES = ["pedestrian", "forklift"]
_END = starmap.START

#: Blocks, arcs and shortest distances (by set semantics under a length that no shortest path of the grid exceeds).
_BASE = f"""WITH RECURSIVE nodes AS ({starmap.NODES}), edges AS ({starmap.EDGES}), places AS ({starmap.PLACES}), picks AS ({starmap.PICKS}),
modes AS (SELECT unnest(['pedestrian', 'forklift']) AS mode),
arcs AS (SELECT edge_id, from_node AS u, to_node AS v, distance_m AS w, mode FROM edges, modes WHERE mode = 'pedestrian' OR forklift
 UNION ALL SELECT edge_id, to_node, from_node, distance_m, mode FROM edges, modes WHERE bidirectional AND (mode = 'pedestrian' OR forklift)),
reach(src, mode, node, d) AS (SELECT node_id, mode, node_id, CAST(0 AS double) FROM nodes, modes
 UNION SELECT r.src, r.mode, a.v, r.d + a.w FROM reach r JOIN arcs a ON a.u = r.node AND a.mode = r.mode WHERE r.d + a.w <= 170),
dist AS (SELECT src, mode, node, min(d) AS d FROM reach GROUP BY ALL)"""
_PRED = """, pred AS (SELECT far.src, far.mode, far.node, min({'e': a.edge_id, 'u': a.u}) AS x FROM dist far JOIN arcs a ON a.v = far.node AND a.mode = far.mode
 JOIN dist near ON near.src = far.src AND near.mode = far.mode AND near.node = a.u WHERE abs(near.d + a.w - far.d) <= 1e-12 AND far.node <> far.src GROUP BY ALL)"""
_LEGS = f""", heads AS (SELECT order_id, count(*) AS lines, sum(quantity) AS units, bool_or(pick_sequence IS NULL) AS unseq, count(DISTINCT mode) AS nm, min(mode) AS m FROM picks GROUP BY ALL),
ord AS (SELECT order_id, lines, units, CASE WHEN unseq THEN 'MISSING_PICK_SEQUENCE' WHEN nm > 1 THEN 'MIXED_ORDER_MODES' END AS excluded, CASE WHEN nm = 1 THEN m ELSE 'pedestrian' END AS mode FROM heads),
seq AS (SELECT p.order_id, o.mode, p.pick_id, p.sku, p.location_id, l.access_node_id AS access, row_number() OVER s AS leg_no, lag(l.access_node_id, 1, '{_END}') OVER s AS before, lead(1) OVER s IS NULL AS is_last
 FROM picks p JOIN ord o USING (order_id) JOIN places l ON l.location_id = p.location_id WHERE o.excluded IS NULL WINDOW s AS (PARTITION BY p.order_id ORDER BY p.pick_sequence, p.pick_id)),
raw AS (SELECT order_id, mode, pick_id, sku, location_id, leg_no, before AS from_node, access AS to_node, false AS is_return FROM seq
 UNION ALL SELECT order_id, mode, pick_id, sku, location_id, leg_no + 1, access, '{_END}', true FROM seq WHERE is_last),
legs AS (SELECT raw.*, d.d AS distance_m, a.zone_id AS fz, b.zone_id AS tz FROM raw LEFT JOIN dist d ON d.src = from_node AND d.mode = raw.mode AND d.node = to_node
 JOIN nodes a ON a.node_id = from_node JOIN nodes b ON b.node_id = to_node),
sums AS (SELECT order_id, sum(distance_m) AS m, count(*) FILTER (distance_m IS NULL) AS lost, count(*) FILTER (distance_m IS NOT NULL AND fz <> tz) AS zt FROM legs GROUP BY ALL),
routes AS (SELECT o.order_id, o.mode, o.lines, o.units, COALESCE(excluded, CASE WHEN lost > 0 THEN 'UNREACHABLE_SEGMENT' END) AS reason, CASE WHEN excluded IS NULL AND lost = 0 THEN m END AS total_distance_m,
 COALESCE(zt, 0) AS zone_transitions FROM ord o LEFT JOIN sums USING (order_id)),
done AS (SELECT l.* FROM legs l JOIN routes r USING (order_id) WHERE r.reason IS NULL)"""
_ROUTED = _BASE + _LEGS
_ITEMS = f"WITH places AS ({starmap.PLACES}), picks AS ({starmap.PICKS})"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _star(spark: SparkSession, d: str, **config):
    return starmap.bundle(spark, d, **config)


def _routed(spark: SparkSession, d: str, **config):
    b = _star(spark, d, **config)
    return b, routes.build(b)


@_query(_BASE + " SELECT edge_id, u, v, w, mode FROM arcs")
def arcs(spark, d):
    b = _star(spark, d)
    return network.arcs(b.nodes, b.edges)


@_query(_BASE + " SELECT src, mode, node AS dst, d AS dist FROM dist")
def all_pairs_distance(spark, d):
    b = _star(spark, d)
    return network.all_pairs(b.nodes, b.edges, MODES).select("src", "mode", "dst", "dist")


@_query(_BASE + " SELECT src, mode, node, d AS dist FROM dist")
def distances_by_relaxation(spark, d):
    b = _star(spark, d)
    sources = b.nodes.select(F.col("node_id").alias("src"), F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    return network.relax(b.nodes, network.arcs(b.nodes, b.edges), sources)


@_query(_BASE + _PRED + " SELECT src, mode, node, x.e AS edge_id, x.u AS prev FROM pred")
def shortest_path_predecessor(spark, d):
    b = _star(spark, d)
    table = network.arcs(b.nodes, b.edges)
    pairs = network.all_pairs(b.nodes, b.edges, MODES).select("src", "mode", F.col("dst").alias("node"), "dist")
    return network.predecessors(table, pairs)


@_query(f"WITH nodes AS ({starmap.NODES}) SELECT node_id, (SELECT min(node_id) FROM nodes) AS component FROM nodes")
def weak_components(spark, d):
    b = _star(spark, d)
    return network.components(b.nodes, b.edges)


@_query(_BASE + f" SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node FROM dist WHERE src = '{_END}' AND mode = 'forklift')")
def unreachable_nodes(spark, d):
    b = _star(spark, d)
    return network.unreachable(b.nodes, b.edges, _END, "forklift")


@_query(_ROUTED + " SELECT order_id, leg_no, from_node, to_node, is_return, distance_m FROM legs")
def order_legs(spark, d):
    return _routed(spark, d)[1].legs.select("order_id", "leg_no", "from_node", "to_node", "is_return", "distance_m")


@_query(_ROUTED + " SELECT order_id, mode, lines, units, reason, total_distance_m, zone_transitions FROM routes")
def order_routes(spark, d):
    return _routed(spark, d)[1].orders.select("order_id", "mode", "lines", "units", "reason", "total_distance_m", "zone_transitions")


@_query(_ROUTED + """ SELECT count(*) AS total_orders, count(*) FILTER (reason IS NULL) AS total_valid_orders, CAST(sum(lines) FILTER (reason IS NULL) AS bigint) AS pick_lines_in_valid_orders,
 sum(total_distance_m) AS total_distance_m, sum(total_distance_m) / count(total_distance_m) AS average_distance_per_order_m, quantile_cont(total_distance_m, 0.5) AS median_distance_per_order_m,
 quantile_cont(total_distance_m, 0.9) AS p90_distance_per_order_m, CAST(sum(zone_transitions) FILTER (reason IS NULL) AS bigint) AS zone_transitions, count(*) FILTER (reason = 'UNREACHABLE_SEGMENT') AS unreachable_orders,
 count(*) FILTER (reason = 'MISSING_PICK_SEQUENCE') AS unsequenced_orders, count(*) FILTER (reason IS NOT NULL) AS excluded_orders, CAST(sum(lines) AS bigint) AS total_pick_lines, sum(units) AS total_units,
 sum(total_distance_m) / sum(lines) FILTER (reason IS NULL) AS average_distance_per_pick_m FROM routes""")  # fmt: skip
def flow_metrics(spark, d):
    return metrics.flow_metrics(*_routed(spark, d))


_LOCATIONS = f""", walked AS (SELECT location_id, count(*) FILTER (NOT is_return) AS visits, count(DISTINCT order_id) AS orders, sum(distance_m) AS m FROM done GROUP BY ALL),
used AS (SELECT location_id, sum(quantity) AS units FROM picks GROUP BY ALL),
located AS (SELECT l.location_id, l.zone_id, COALESCE(visits, 0) AS visits, COALESCE(orders, 0) AS orders, COALESCE(units, 0) AS units, COALESCE(m, 0) AS attributable_distance_m, d.d AS distance_from_start_m
 FROM places l LEFT JOIN walked w USING (location_id) LEFT JOIN used u USING (location_id) LEFT JOIN dist d ON d.src = '{_END}' AND d.mode = 'pedestrian' AND d.node = l.access_node_id)"""


@_query(_ROUTED + _LOCATIONS + " SELECT *, 100.0 * visits / (SELECT sum(visits) FROM located) AS pick_share_percent, 100.0 * attributable_distance_m / (SELECT sum(attributable_distance_m) FROM located) AS distance_share_percent FROM located")
def location_metrics(spark, d):
    return metrics.location_metrics(*_routed(spark, d))


@_query(_ROUTED + _LOCATIONS + " SELECT location_id, attributable_distance_m FROM located ORDER BY attributable_distance_m DESC, location_id LIMIT 10")
def top_locations(spark, d):
    return metrics.top_locations(metrics.location_metrics(*_routed(spark, d)), 10).select("location_id", "attributable_distance_m")


@_query(_ROUTED + """, p AS (SELECT sku, count(*) AS pick_lines, sum(quantity) AS units, count(DISTINCT order_id) AS orders FROM picks GROUP BY ALL),
 w AS (SELECT sku, sum(distance_m) AS m FROM done WHERE NOT is_return GROUP BY ALL)
 SELECT l.sku, l.location_id, COALESCE(pick_lines, 0) AS pick_lines, COALESCE(units, 0) AS units, COALESCE(orders, 0) AS orders, COALESCE(m, 0) AS attributable_distance_m,
 100.0 * COALESCE(pick_lines, 0) / (SELECT sum(pick_lines) FROM p) AS pick_share_percent, 100.0 * COALESCE(m, 0) / (SELECT sum(m) FROM w) AS distance_share_percent
 FROM places l LEFT JOIN p USING (sku) LEFT JOIN w USING (sku)""")  # fmt: skip
def sku_metrics(spark, d):
    return metrics.sku_metrics(*_routed(spark, d))


@_query(_BASE + _PRED + """, walk(src, mode, dst, here, edge_id) AS (SELECT src, mode, node, x.u, x.e FROM pred UNION ALL SELECT w.src, w.mode, w.dst, p.x.u, p.x.e FROM walk w JOIN pred p ON p.src = w.src AND p.mode = w.mode AND p.node = w.here)"""
 + _LEGS + """, n AS (SELECT edge_id, count(*) AS n FROM done JOIN walk k ON k.src = from_node AND k.mode = done.mode AND k.dst = to_node GROUP BY ALL)
 SELECT e.edge_id, COALESCE(n, 0) AS traversals, 100.0 * COALESCE(n, 0) / (SELECT sum(n) FROM n) AS share_percent, COALESCE(n, 0) * distance_m AS walked_m FROM edges e LEFT JOIN n USING (edge_id)""")  # fmt: skip
def edge_flows(spark, d):
    return metrics.edge_flows(*_routed(spark, d))


@_query(_ROUTED + ", z AS (SELECT COALESCE(zone_id, 'UNZONED') AS zone_id, count(*) AS visits FROM done JOIN places USING (location_id) WHERE NOT is_return GROUP BY ALL) SELECT zone_id, visits, 100.0 * visits / (SELECT sum(visits) FROM z) AS share_percent FROM z")
def zone_flows(spark, d):
    return metrics.zone_flows(*_routed(spark, d))


@_query(_ROUTED + " SELECT order_id, total_distance_m FROM routes WHERE reason IS NULL ORDER BY total_distance_m DESC, order_id LIMIT 10")
def top_orders(spark, d):
    return metrics.top_orders(_routed(spark, d)[1], 10).select("order_id", "total_distance_m")


@_query(_ROUTED + """ SELECT count(*) AS orders, count(*) FILTER (reason IS NULL) AS routed_orders, count(*) FILTER (reason IS NOT NULL) AS excluded_orders, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
 (SELECT count(*) FROM places) AS locations, (SELECT count(*) FROM places) AS items, (SELECT count(*) FROM places) AS assignments, (SELECT count(*) FROM picks) AS picks, (SELECT count(l_shipdate) FROM picks) AS picks_with_timestamp,
 (SELECT count(pick_sequence) FROM picks) AS picks_with_sequence, 100.0 * count(*) FILTER (reason IS NULL) / count(*) AS route_coverage_percent FROM routes""")  # fmt: skip
def data_quality(spark, d):
    return metrics.data_quality(*_routed(spark, d))


def _abc_sql(value: str) -> str:
    return _ITEMS + f""", v AS (SELECT l.sku, COALESCE(x.value, 0) AS value FROM places l LEFT JOIN (SELECT sku, CAST({value} AS double) AS value FROM picks GROUP BY sku) x USING (sku)),
 c AS (SELECT sku, value, row_number() OVER w AS rank, sum(value) OVER w AS cumulative_value, sum(value) OVER () AS total FROM v WINDOW w AS (ORDER BY value DESC, sku))
 SELECT sku, value, rank, cumulative_value, cumulative_value / total AS cumulative_share, CASE WHEN value <= 0 THEN 'C' WHEN (cumulative_value - value) / total < 0.8 - 1e-12 THEN 'A' WHEN (cumulative_value - value) / total < 0.95 - 1e-12 THEN 'B' ELSE 'C' END AS abc_class FROM c"""


_ABC = {"pick_lines": _abc_sql("count(*)"), "units": _abc_sql("sum(quantity)"), "orders": _abc_sql("count(DISTINCT order_id)")}


@_query(_ABC["pick_lines"])
def abc_pick_lines(spark, d):
    return classify.abc(_star(spark, d), "pick_lines")


@_query(_ABC["units"])
def abc_units(spark, d):
    return classify.abc(_star(spark, d), "units")


@_query(_ABC["orders"])
def abc_orders(spark, d):
    return classify.abc(_star(spark, d), "orders")


def _xyz_sql(key: str, prefix: str = "") -> str:
    lo, hi = (x[:10] for x in starmap.PERIOD)
    return _ITEMS + f""", b AS (SELECT DISTINCT {key.format("day")} AS bucket FROM (SELECT CAST(unnest(generate_series(DATE '{lo}', DATE '{hi}', INTERVAL 1 DAY)) AS date) AS day)), n AS (SELECT count(*) AS n FROM b),
 c AS (SELECT sku, {key.format("CAST(l_shipdate AS date)")} AS bucket, count(*) AS c FROM picks GROUP BY ALL), s AS (SELECT sku, sum(c) AS s, sum(c * c) AS q FROM c WHERE bucket IN (SELECT bucket FROM b) GROUP BY ALL),
 x AS (SELECT l.sku, CAST(COALESCE(s, 0) AS bigint) AS pick_lines, CAST(COALESCE(s, 0) AS double) / n AS mean_per_bucket, CASE WHEN s > 0 THEN sqrt(CAST(n * q - s * s AS double)) / CAST(s AS double) END AS cv FROM places l LEFT JOIN s USING (sku), n),
 xyz AS (SELECT *, CASE WHEN cv <= 0.5 THEN 'X' WHEN cv <= 1.0 THEN 'Y' WHEN cv IS NOT NULL THEN 'Z' END AS xyz_class FROM x)"""


_DAY, _WEEK = "strftime({0}, '%Y-%m-%d')", "printf('%d-W%02d', isoyear({0}), weekofyear({0}))"


@_query(_xyz_sql(_DAY) + " SELECT * FROM xyz")
def xyz_day(spark, d):
    return classify.xyz(_star(spark, d), "day")[0]


@_query(_xyz_sql(_WEEK) + " SELECT * FROM xyz")
def xyz_week(spark, d):
    return classify.xyz(_star(spark, d), "week")[0]


@_query(_xyz_sql(_WEEK) + f", abc AS ({_ABC['pick_lines'].removeprefix(_ITEMS + ', ').join(['WITH ', ''])}) SELECT sku, concat(abc_class, COALESCE(xyz_class, '')) AS combined_class FROM abc JOIN xyz USING (sku)")
def combined_classes(spark, d):
    b = _star(spark, d)
    return classify.combined(classify.abc(b), classify.xyz(b, "week")[0])


_PAIRS = _ITEMS + """, l AS (SELECT DISTINCT order_id, sku FROM picks), t AS (SELECT count(DISTINCT order_id) AS n FROM l), s AS (SELECT sku, count(*) AS n FROM l GROUP BY ALL),
 p AS (SELECT a.sku AS sku_a, b.sku AS sku_b, count(*) AS co_picks FROM l a JOIN l b ON a.order_id = b.order_id AND a.sku < b.sku GROUP BY ALL)
 SELECT sku_a, sku_b, co_picks, x.n AS orders_a, y.n AS orders_b, t.n AS total_orders, co_picks / t.n AS support, co_picks / x.n AS confidence_ab, co_picks / y.n AS confidence_ba, co_picks * t.n / (x.n * y.n) AS lift
 FROM p JOIN s x ON x.sku = sku_a JOIN s y ON y.sku = sku_b, t WHERE co_picks >= 2 AND co_picks / t.n >= 0.0005"""  # fmt: skip


@_query(_PAIRS)
def affinity_pairs(spark, d):
    return affinity.pairs(_star(spark, d))


def _issues(spark, d, code: str):
    return quality.issues(_star(spark, d)).where(F.col("code") == code).select("code", "severity", F.array_join("affected", ",").alias("affected"))


@_query(_ITEMS + " SELECT 'MIXED_ORDER_MODES' AS code, 'error' AS severity, order_id AS affected FROM picks GROUP BY order_id HAVING count(DISTINCT mode) > 1")
def mixed_mode_orders(spark, d):
    return _issues(spark, d, "MIXED_ORDER_MODES")


@_query(_ITEMS + " SELECT DISTINCT 'MISSING_PICK_SEQUENCE' AS code, 'warning' AS severity, order_id AS affected FROM picks WHERE pick_sequence IS NULL")
def missing_sequence_orders(spark, d):
    return _issues(spark, d, "MISSING_PICK_SEQUENCE")


@_query(_ITEMS + f" SELECT 'TIMESTAMP_OUTSIDE_PERIOD' AS code, 'error' AS severity, pick_id AS affected FROM picks WHERE l_shipdate < TIMESTAMP '{starmap.PERIOD[0]}' OR l_shipdate > TIMESTAMP '{starmap.PERIOD[1]}'")
def timestamp_outside_period(spark, d):
    return _issues(spark, d, "TIMESTAMP_OUTSIDE_PERIOD")


@_query(_ITEMS + " SELECT 'DUPLICATE_PICK_SEQUENCE' AS code, 'error' AS severity, string_agg(pick_id, ',' ORDER BY pick_id) AS affected FROM picks GROUP BY order_id, l_linenumber HAVING count(*) > 1")
def dup_pick_sequence(spark, d):
    b = _star(spark, d)
    raw = b.picks.withColumn("pick_sequence", F.col("l_linenumber"))
    b = type(b)(b.nodes, b.edges, b.locations, b.items, b.assignments, raw, b.meta, b.config)
    return quality.issues(b).where("code = 'DUPLICATE_PICK_SEQUENCE'").select("code", "severity", F.array_join("affected", ",").alias("affected"))


@_query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_ids(spark, d):
    """Picks named by order and line number only: rule DUPLICATE_PICK_ID."""
    b = _star(spark, d)
    b = replace(b, picks=b.picks.withColumn("pick_id", F.concat_ws("-", F.split("pick_id", "-")[0], "l_linenumber")))
    named = quality.issues(b).where("code = 'DUPLICATE_PICK_ID'").select(F.get("affected", F.lit(0)).alias("pick_id"))
    part = lambda k: F.split("pick_id", "-")[k].cast("long")
    return b.picks.join(named, "pick_id").groupBy(part(0).alias("l_orderkey"), part(1).cast("int").alias("l_linenumber")).agg(F.count("*").alias("copies"))


@_query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3)")
def dangling_refs(spark, d):
    """A tenth of the items taken out: rule UNKNOWN_SKU on picks."""
    b = _star(spark, d)
    b = replace(b, items=b.items.where("cast(substring(sku, 2) as long) % 10 <> 3"))
    lost = quality.issues(b).where("code = 'UNKNOWN_SKU' and field = 'picks.sku'").select(F.get("affected", F.lit(0)).alias("pick_id"))
    return b.picks.join(lost, "pick_id").select(F.substring("sku", 2, 9).cast("long").alias("l_suppkey")).distinct()


_CONFLICTS = {
    "PICK_ROLE_ON_NON_PICK_LOCATION": "location_type <> 'pick'",
    "ITEM_TOO_HEAVY_FOR_LOCATION": "unit_weight_kg > max_unit_weight_kg",
    "HAZARD_INCOMPATIBLE": "hazard_rule <> 0 AND hazard_class = 'flammable' AND hazard_rule <> 1",
    "MODE_NOT_ALLOWED": "forklift_only AND handling_mode <> 'forklift'",
}


@_query(f"WITH places AS ({starmap.PLACES}) " + " UNION ALL ".join(f"SELECT '{c}' AS code, 'error' AS severity, concat(sku, ',', location_id) AS affected FROM places WHERE {w}" for c, w in _CONFLICTS.items()))
def assignment_conflicts(spark, d):
    found = quality.issues(_star(spark, d)).where(F.col("code").isin(*_CONFLICTS))
    return found.select("code", "severity", F.array_join("affected", ",").alias("affected"))


@_query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1")
def multiple_assignments(spark, d):
    """Each order as an item assigned to its suppliers' locations: rule MULTIPLE_PICK_ASSIGNMENTS."""
    b = _star(spark, d)
    homes = b.picks.select(F.col("order_id").cast("long").cast("string").alias("sku"), F.substring("sku", 2, 9).alias("location_id")).distinct()
    b = replace(b, assignments=homes.selectExpr("sku", "location_id", "'pick' AS role", "1 AS current_units", "1 AS max_units", "0L AS ordinal"))
    several = quality.issues(b).where("code = 'MULTIPLE_PICK_ASSIGNMENTS'").select(F.get("affected", F.lit(0)).alias("sku"))
    return homes.join(several, "sku").groupBy(F.col("sku").cast("long").alias("l_orderkey")).agg(F.count("*").alias("suppliers"))


_G = "CASE WHEN {0} THEN 1 WHEN {1} THEN 2 ELSE 0 END"


def _check_sql(pairs: str) -> str:
    def way(i: str, l: str) -> list[str]:  # noqa: E741
        u = f"COALESCE({i}.max_units, 10)"
        hazards = f"CASE {l}.hazard_rule WHEN 1 THEN ['none', 'flammable'] ELSE ['none'] END"
        return [
            _G.format(f"{i}.unit_volume_m3 IS NULL OR {l}.capacity_volume_m3 IS NULL", f"{i}.unit_volume_m3 * {u} > {l}.capacity_volume_m3 + 1e-9"),
            _G.format("false", f"{i}.unit_weight_kg * {u} > {l}.capacity_weight_kg + 1e-9"),
            _G.format("false", f"{i}.unit_weight_kg > {l}.max_unit_weight_kg + 1e-9"),
            _G.format(f"{i}.temperature_zone IS NULL OR {l}.temperature_zone IS NULL", f"{i}.temperature_zone <> {l}.temperature_zone"),
            _G.format(f"{i}.hazard_class IS NULL OR {l}.hazard_rule = 0", f"NOT list_contains({hazards}, {i}.hazard_class)"),
            _G.format("false", f"{l}.forklift_only AND {i}.handling_mode <> 'forklift'"),
        ]

    both = [f"greatest({x}, {y})" for x, y in zip(way("a", "b"), way("b", "a"), strict=True)]
    both += [
        "CASE WHEN a.location_type <> 'pick' OR b.location_type <> 'pick' THEN 2 ELSE 0 END",
        _G.format("a.level IS NULL OR b.level IS NULL", "a.level <> b.level"),
        "CASE WHEN a.fixed OR b.fixed OR a.fixed_location OR b.fixed_location THEN 2 ELSE 0 END",
    ]
    names = ["pass", "insufficient_data", "fail"]
    cols = ", ".join(f"{g} AS g{k}" for k, g in enumerate(both))
    shown = ", ".join(f"(['{names[0]}', '{names[1]}', '{names[2]}'])[g{k} + 1] AS check_{c}" for k, c in enumerate(constraints.CHECKS))
    worst = "greatest(" + ", ".join(f"g{k}" for k in range(9)) + ")"
    return f"""{pairs}, graded AS (SELECT c.sku_a, c.sku_b, {cols} FROM cand c JOIN places a ON a.sku = c.sku_a JOIN places b ON b.sku = c.sku_b)
 SELECT sku_a, sku_b, {shown}, CASE {worst} WHEN 2 THEN 'constraint_violation' WHEN 1 THEN 'insufficient_constraint_data' ELSE 'ok' END AS status FROM graded"""


_CAND = _BASE + f""", f AS (SELECT l.sku, count(p.pick_id) AS n, any_value(d.d) AS d FROM places l JOIN dist d ON d.src = '{_END}' AND d.mode = 'pedestrian' AND d.node = l.access_node_id LEFT JOIN picks p ON p.sku = l.sku WHERE l.location_type = 'pick' GROUP BY l.sku),
 cand AS (SELECT a.sku AS sku_a, b.sku AS sku_b, (a.n - b.n) * (a.d - b.d) AS proxy FROM f a JOIN f b ON a.n > b.n AND a.d > b.d ORDER BY proxy DESC, sku_a, sku_b LIMIT 200)"""


@_query(_CAND + " SELECT sku_a, sku_b, proxy FROM cand")
def swap_candidates(spark, d):
    return slotting.candidates(_star(spark, d))


@_query(_check_sql(_CAND))
def constraint_checks(spark, d):
    b = _star(spark, d)
    out = constraints.check_swaps(b, slotting.candidates(b).select("sku_a", "sku_b"))
    return out.select("sku_a", "sku_b", *[f"check_{c}" for c in constraints.CHECKS], "status")


_MOST = {"maximum_candidate_swaps": DEFAULTS["maximum_candidate_swaps"]}
#: Every candidate swap replayed in full: all orders that hold a swapped item are walked again; a node is at 0 from itself in any mode.
_REPLAYED = _CAND.replace("LIMIT 200", f"LIMIT {_MOST['maximum_candidate_swaps']}") + f""", walk AS (SELECT src, mode, node, d FROM dist UNION ALL SELECT node_id, 'tugger', node_id, 0.0 FROM nodes),
 able AS (SELECT order_id, COALESCE(min(mode), 'pedestrian') AS mode FROM picks GROUP BY order_id HAVING NOT bool_or(pick_sequence IS NULL) AND count(DISTINCT mode) <= 1),
 line AS (SELECT p.order_id, a.mode, p.pick_sequence, p.pick_id, p.sku, there.access_node_id AS recorded, own.access_node_id AS assigned FROM picks p JOIN able a USING (order_id) JOIN places there ON there.location_id = p.location_id JOIN places own ON own.sku = p.sku),
 touched AS (SELECT DISTINCT c.sku_a, c.sku_b, l.order_id FROM cand c JOIN line l ON l.sku = c.sku_a UNION SELECT DISTINCT c.sku_a, c.sku_b, l.order_id FROM cand c JOIN line l ON l.sku = c.sku_b),
 stop AS (SELECT 'recorded' AS kind, '' AS sku_a, '' AS sku_b, order_id, mode, pick_sequence, pick_id, recorded AS node FROM line UNION ALL SELECT 'assigned', '', '', order_id, mode, pick_sequence, pick_id, assigned FROM line
  UNION ALL SELECT 'swapped', t.sku_a, t.sku_b, l.order_id, mode, pick_sequence, pick_id, CASE l.sku WHEN t.sku_a THEN y.access_node_id WHEN t.sku_b THEN x.access_node_id ELSE assigned END FROM touched t JOIN line l USING (order_id) JOIN places x ON x.sku = t.sku_a JOIN places y ON y.sku = t.sku_b),
 hop AS (SELECT kind, sku_a, sku_b, order_id, mode, lag(node, 1, '{_END}') OVER w AS before, node, lead(1) OVER w IS NULL AS is_last FROM stop WINDOW w AS (PARTITION BY kind, sku_a, sku_b, order_id ORDER BY pick_sequence, pick_id)),
 long AS (SELECT kind, sku_a, sku_b, order_id, CASE WHEN count(*) = count(one.d) AND count(*) FILTER (is_last AND two.d IS NULL) = 0 THEN sum(one.d) + sum(two.d) END AS m
  FROM hop LEFT JOIN walk one ON one.src = before AND one.mode = hop.mode AND one.node = hop.node LEFT JOIN walk two ON is_last AND two.src = hop.node AND two.mode = hop.mode AND two.node = '{_END}' GROUP BY ALL),
 met AS (SELECT c.sku_a, c.sku_b, b.m AS before, CASE WHEN s.order_id IS NULL THEN a.m ELSE s.m END AS after FROM long b JOIN long a ON b.kind = 'recorded' AND a.kind = 'assigned' AND a.order_id = b.order_id CROSS JOIN cand c
  LEFT JOIN long s ON s.kind = 'swapped' AND s.sku_a = c.sku_a AND s.sku_b = c.sku_b AND s.order_id = b.order_id),
 replayed AS (SELECT sku_a, sku_b, count(*) AS comparable_orders, count(*) FILTER (abs(after - before) > 1e-9) AS affected_orders, sum(before) AS baseline_m, sum(after) AS scenario_m, sum(before) - sum(after) AS reduction_m, 100.0 * (sum(before) - sum(after)) / sum(before) AS reduction_percent
  FROM met WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY ALL)"""  # fmt: skip


@_query(_REPLAYED + " SELECT * FROM replayed")
def swap_replay(spark, d):
    """Every candidate up to the default limit."""
    b = _star(spark, d, **_MOST)
    return slotting.replay_swaps(b, slotting.candidates(b).select("sku_a", "sku_b"))


_GRADED = _check_sql(_REPLAYED).replace(" SELECT sku_a, sku_b, (", ", checked AS (SELECT sku_a, sku_b, (").rstrip() + ")"
#: The ranked list, walked row by row: a swap stays if neither SKU was used by one that stayed.
_JUDGED = _GRADED + f""", ranked AS (SELECT sku_a, sku_b, row_number() OVER (ORDER BY round(reduction_m, 3) DESC, sku_a, sku_b) AS n FROM checked JOIN replayed USING (sku_a, sku_b) WHERE status = 'ok' AND reduction_percent >= 0.001),
 picked(n, used, taken, verdict) AS (SELECT CAST(0 AS bigint), CAST([] AS varchar[]), 0, '' UNION ALL
  SELECT r.n, CASE WHEN list_has_any(p.used, [r.sku_a, r.sku_b]) THEN p.used ELSE list_concat(p.used, [r.sku_a, r.sku_b]) END, CASE WHEN list_has_any(p.used, [r.sku_a, r.sku_b]) THEN p.taken ELSE p.taken + 1 END,
   CASE WHEN list_has_any(p.used, [r.sku_a, r.sku_b]) THEN 'superseded_by_higher_ranked_swap' WHEN p.taken < {DEFAULTS["maximum_recommendations"]} THEN 'accepted' ELSE 'beyond_maximum_recommendations' END
  FROM picked p JOIN ranked r ON r.n = p.n + 1),
 judged AS (SELECT c.*, CASE WHEN c.status <> 'ok' THEN c.status ELSE COALESCE(p.verdict, 'no_material_improvement') END AS verdict, p.taken FROM checked c LEFT JOIN ranked r USING (sku_a, sku_b) LEFT JOIN picked p ON p.n = r.n)"""


def _listed(outcome: str) -> str:
    return "list_aggregate([" + ", ".join(f"CASE WHEN check_{c} = '{outcome}' THEN '{c}' END" for c in constraints.CHECKS) + "], 'string_agg', '|')"


@_query(_JUDGED + """ SELECT printf('SWAP-%03d', taken) AS swap_id, taken AS rank, sku_a, sku_b, replace(sku_a, 'S', 'L') AS location_a, replace(sku_b, 'S', 'L') AS location_b, proxy, comparable_orders, affected_orders, baseline_m, scenario_m, reduction_m, reduction_percent
 FROM judged JOIN replayed USING (sku_a, sku_b) JOIN cand USING (sku_a, sku_b) WHERE verdict = 'accepted'""")  # fmt: skip
def recommendations(spark, d):
    accepted, _ = slotting.recommend(_star(spark, d, **_MOST))
    return accepted.select("swap_id", "rank", "sku_a", "sku_b", "location_a", "location_b", "proxy", "comparable_orders", "affected_orders", "baseline_m", "scenario_m", "reduction_m", "reduction_percent")


@_query(_JUDGED + f" SELECT sku_a, sku_b, verdict, CASE status WHEN 'constraint_violation' THEN {_listed('fail')} WHEN 'insufficient_constraint_data' THEN {_listed('insufficient_data')} ELSE '' END AS reasons FROM judged WHERE verdict <> 'accepted'")
def rejected_swaps(spark, d):
    _, rejected = slotting.recommend(_star(spark, d, **_MOST))
    return slotting.lines_of(rejected)


@_query("""SELECT upper(trim(p_name)) AS sku, replace(p_brand, '#', ' ') AS description, CAST(p_size AS double) / 1000 AS unit_volume_m3, p_retailprice / 1000 AS unit_weight_kg, p_size % 2 = 0 AS fixed_location FROM part""")
def normalised_items(spark, d):
    raw = spark.read.parquet(f"{d}/part.parquet").selectExpr("concat('  ', p_name, ' ') AS article", "replace(p_brand, '#', ' ') AS label", "cast(p_size AS string) AS litres", "cast(p_retailprice AS string) AS grams", "if(p_size % 2 = 0, 'Yes', 'no') AS pinned", "'someone' AS picker_name")
    rules = {
        "sku": {"source": "article", "transforms": ["upper"]}, "description": "label", "unit_volume_m3": {"source": "litres", "unit": "l"},
        "unit_weight_kg": {"source": "grams", "unit": "g"}, "fixed_location": {"source": "pinned"},
    }
    out, _ = normalise.block("items", raw, rules)
    return out.select("sku", "description", "unit_volume_m3", "unit_weight_kg", "fixed_location")


@_query()
def evidence_labels(spark, d):
    return evidence.table(analyse.analyse(_star(spark, d)))


@_query()
def findings(spark, d):
    return analyse.findings_table(analyse.analyse(_star(spark, d)))


@_query()
def svg_flow_map(spark, d):
    from .sinks import svg

    b, r = _routed(spark, d)
    return spark.createDataFrame([(svg.flow_map(b, metrics.edge_flows(b, r)),)], "svg string")


_STATUS = [(f"{c}", "error", f"SELECT 1 FROM places WHERE {w}") for c, w in _CONFLICTS.items()] + [
    ("TEMPERATURE_INCOMPATIBLE", "error", "SELECT 1 FROM places WHERE false"), ("MIXED_ORDER_MODES", "error", "SELECT 1 FROM picks GROUP BY order_id HAVING count(DISTINCT mode) > 1"),
    ("MISSING_PICK_SEQUENCE", "warning", "SELECT DISTINCT order_id FROM picks WHERE pick_sequence IS NULL"),
    ("TIMESTAMP_OUTSIDE_PERIOD", "error", f"SELECT 1 FROM picks WHERE l_shipdate < TIMESTAMP '{starmap.PERIOD[0]}' OR l_shipdate > TIMESTAMP '{starmap.PERIOD[1]}'"),
]


@_query(_ITEMS + ", n AS (" + " UNION ALL ".join(f"SELECT '{c}' AS code, '{level}' AS severity, (SELECT count(*) FROM ({rows})) AS issues" for c, level, rows in _STATUS) + ") SELECT code, severity, issues, 'data_error' AS status FROM n WHERE issues > 0")
def validation_status(spark, d):
    report = quality.validate(_star(spark, d))
    return report.issues.groupBy("code", "severity").agg(F.count("*").alias("issues")).withColumn("status", F.lit(report.status))


_CUT = "n_nationkey NOT BETWEEN 5 AND 9"  # without the way from the second row of the grid to the third
_ISLES = _BASE.replace("FROM nation WHERE n_nationkey < 20)", f"FROM nation WHERE n_nationkey < 20 AND {_CUT})")


def _isles(spark, d):
    b = _star(spark, d)
    return replace(b, edges=b.edges.where("edge_id NOT BETWEEN 'V05' AND 'V09'"))


@_query(_ISLES + ", near AS (SELECT u, v FROM arcs UNION SELECT v, u FROM arcs), grown(a, b) AS (SELECT node_id, node_id FROM nodes UNION SELECT a, v FROM grown JOIN near ON u = b) SELECT a AS node_id, min(b) AS component FROM grown GROUP BY a")
def island_components(spark, d):
    b = _isles(spark, d)
    return network.components(b.nodes, b.edges)


@_query(_ISLES + f" SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node FROM dist WHERE src = '{_END}' AND mode = 'forklift')")
def island_unreachable_nodes(spark, d):
    b = _isles(spark, d)
    return network.unreachable(b.nodes, b.edges, _END, "forklift")


@_query(_BASE + _PRED + """, walk(src, mode, dst, here, edge_id) AS (SELECT src, mode, node, x.u, x.e FROM pred UNION ALL SELECT w.src, w.mode, w.dst, p.x.u, p.x.e FROM walk w JOIN pred p ON p.src = w.src AND p.mode = w.mode AND p.node = w.here)"""
 + _LEGS + " SELECT order_id, edge_id, count(*) AS traversals FROM legs JOIN walk k ON k.src = from_node AND k.mode = legs.mode AND k.dst = to_node GROUP BY ALL")
def order_edges(spark, d):
    return routes.order_edges(_routed(spark, d)[1])


#: Faults put into the blocks, by expressions that both engines read alike, and what each rule has to find.
_FAULTS = {
    "edges": {"distance_m": "CASE WHEN edge_id LIKE 'H1%' THEN 0.0 ELSE distance_m END", "to_node": "CASE WHEN edge_id = 'V03' THEN 'N99' WHEN edge_id = 'V04' THEN from_node ELSE to_node END"},
    "locations": {"capacity_weight_kg": "CASE WHEN location_id LIKE '%7' THEN -1.0 WHEN location_id LIKE '%8' THEN 1.0 ELSE capacity_weight_kg END", "location_type": "CASE WHEN location_id LIKE '%4' THEN 'shelf' ELSE location_type END", "access_node_id": "CASE WHEN location_id LIKE '%1' THEN '' WHEN location_id LIKE '%2' THEN 'N77' ELSE access_node_id END"},
    "items": {"unit_weight_kg": "CASE WHEN sku LIKE '%6' THEN 0.0 ELSE unit_weight_kg END", "description": "CASE WHEN sku LIKE '%5' THEN '' ELSE 'x' END"},
    "picks": {"quantity": "CASE WHEN l_linenumber = 3 THEN 0.0 ELSE quantity END", "location_id": "CASE WHEN l_linenumber = 4 THEN 'LX' ELSE location_id END", "mode": "CASE WHEN l_linenumber = 5 THEN 'drone' ELSE mode END", "pick_sequence": "CASE WHEN l_linenumber = 6 THEN -pick_sequence ELSE pick_sequence END"},
}
_FOUND = {
    ("INVALID_EDGE_DISTANCE", "edges.distance_m"): "fedges WHERE distance_m <= 0", ("UNKNOWN_NODE_REFERENCE", "edges.to_node"): "fedges WHERE to_node NOT IN (SELECT node_id FROM nodes)", ("SELF_LOOP_EDGE", "edges"): "fedges WHERE from_node = to_node",
    ("INVALID_CAPACITY", "locations.capacity_weight_kg"): "flocations WHERE capacity_weight_kg <= 0", ("INCONSISTENT_CAPACITY", "locations"): "flocations WHERE max_unit_weight_kg > capacity_weight_kg", ("UNKNOWN_LOCATION_TYPE", "locations.location_type"): "flocations WHERE location_type = 'shelf'",
    ("LOCATION_WITHOUT_ACCESS_NODE", "locations.access_node_id"): "flocations WHERE access_node_id = ''", ("UNKNOWN_NODE_REFERENCE", "locations.access_node_id"): "flocations WHERE access_node_id = 'N77'",
    ("INVALID_ITEM_MEASURE", "items.unit_weight_kg"): "fitems WHERE unit_weight_kg <= 0", ("MISSING_ITEM_DESCRIPTION", "items.description"): "fitems WHERE description = ''",
    ("INVALID_QUANTITY", "picks.quantity"): "fpicks WHERE quantity <= 0", ("UNKNOWN_LOCATION", "picks.location_id"): "fpicks WHERE location_id NOT IN (SELECT location_id FROM places)", ("UNKNOWN_MODE", "picks.mode"): "fpicks WHERE mode = 'drone'", ("INVALID_PICK_SEQUENCE", "picks.pick_sequence"): "fpicks WHERE pick_sequence <= 0",
}
_FAULTY = _BASE + "".join(f", f{block} AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in changes.items())}) FROM {src})" for (block, changes), src in zip(_FAULTS.items(), ("edges", "places", "(SELECT *, 'x' AS description FROM places) t", "picks"), strict=True))


@_query(_FAULTY + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS code, '{f}' AS field, (SELECT count(*) FROM {w}) AS issues" for (c, f), w in _FOUND.items()) + ") t WHERE issues > 0")
def planted_faults(spark, d):
    """Issues per rule over blocks with planted faults."""
    b = _star(spark, d)
    b = replace(b, **{block: getattr(b, block).withColumns({c: F.expr(e) for c, e in changes.items()}) for block, changes in _FAULTS.items()})
    found = quality.issues(b).groupBy("code", "field").agg(F.count("*").alias("issues"))
    return found.where(F.struct("code", "field").isin(*[F.struct(F.lit(c).alias("code"), F.lit(f).alias("field")) for c, f in _FOUND]))
