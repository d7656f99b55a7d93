"""The engine on the yard layout, one changed field at a time, and properties on the star tables."""

import json

import pytest
from fixtures import yard
from pyspark.sql import functions as F

from stowline.operators import affinity, classify, constraints, metrics, network, normalise, quality, routes, slotting
from stowline.plans import analyse, evidence
from stowline.schema import DEFAULTS
from stowline.sinks import reports
from stowline.sources import documents, starmap


@pytest.fixture(scope="module")
def base(spark):
    return documents.from_object(spark, yard())


@pytest.fixture(scope="module")
def routing(base):
    return routes.build(base)


def bundle(spark, change, **config):
    doc = yard(**config)
    change(doc)
    return documents.from_object(spark, doc)


def by(df, key, *values):
    return {r[key]: tuple(r[v] for v in values) if len(values) > 1 else r[values[0]] for r in df.collect()}


def test_routes(routing):
    assert by(routing.orders, "order_id", "total_distance_m") == {"ord-a": 140, "ord-b": 140, "ord-c": 190, "ord-d": 90}
    legs = [(r.from_node, r.to_node, r.distance_m) for r in routing.legs.where("order_id = 'ord-a'").orderBy("leg_no").collect()]
    assert legs == [("dock", "east", 70), ("east", "west", 40), ("west", "dock", 30)]


def test_metrics(base, routing):
    m = metrics.flow_metrics(base, routing).first()
    assert (m.total_distance_m, m.average_distance_per_order_m, m.median_distance_per_order_m, m.p90_distance_per_order_m, m.average_distance_per_pick_m) == (560, 140, 140, 175, 112)
    assert (m.zone_transitions, m.total_units, m.excluded_orders) == (9, 15, 0)
    assert by(metrics.location_metrics(base, routing), "location_id", "attributable_distance_m", "visits") == {"bin-w": (70, 1), "bin-e": (210, 2), "bin-y": (190, 1), "bin-n": (90, 1)}
    assert by(metrics.edge_flows(base, routing), "edge_id", "traversals", "walked_m") == {"r1": (6, 180), "r2": (6, 240), "r3": (0, 0), "r4": (2, 90), "spur": (2, 50)}
    assert by(metrics.zone_flows(base, routing), "zone_id", "visits") == {"left": 1, "right": 3, "out": 1}
    assert by(metrics.sku_metrics(base, routing), "sku", "pick_lines", "units", "orders", "location_id")["bolt"] == (2, 7, 2, "bin-e")


def test_percentile(spark):
    df = spark.createDataFrame([(10,), (20,), (30,), (40,)], "v int")
    assert [df.agg(metrics.percentile("v", p)).first()[0] for p in (0, 50, 90, 100)] == [10, 25, 37, 40]
    assert df.limit(0).agg(metrics.percentile("v", 50)).first()[0] is None
    with pytest.raises(ValueError):
        metrics.percentile("v", 101)


def test_affinity(base):
    r = affinity.enriched(base, affinity.pairs(base)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.sku_a, r.sku_b, r.co_picks, r.confidence_ab, r.confidence_ba, r.location_a) == ("bolt", "glue", 1, 0.5, 1.0, "bin-e")
    assert r.support == pytest.approx(1 / 4) and r.lift == pytest.approx(2)


def test_graph(spark, base):
    assert network.components(base.nodes, base.edges).select("component").distinct().collect()[0][0] == "dock"
    assert [r.node_id for r in network.unreachable(base.nodes, base.edges, "dock", "forklift").collect()] == ["yard"]
    wanted = spark.createDataFrame([("yard", "pedestrian", "west"), ("west", "pedestrian", "west"), ("dock", "forklift", "yard"), ("NX", "pedestrian", "dock")], "src string, mode string, dst string")
    got = {(r.src, r.dst): (r.dist, r.path) for r in network.shortest_paths(base.nodes, base.edges, wanted).collect()}
    assert got == {("yard", "west"): (65, ["spur", "r2"]), ("west", "west"): (0, [])}


def test_relaxation_equals_the_task_local_solution(spark, monkeypatch):
    """A grid with parallel edges, ties, one-way edges and a part that is cut off."""
    import random

    r = random.Random(2)
    nodes = spark.createDataFrame([(f"N{k:02d}",) for k in range(14)], "node_id string")
    rows = [(f"E{k:02d}", f"N{r.randrange(12):02d}", f"N{r.randrange(12):02d}", float(r.randrange(0, 4)), r.random() < 0.6, ["pedestrian"]) for k in range(40)]
    edges = spark.createDataFrame([*rows, ("E98", "N12", "N13", 1.0, True, ["pedestrian"]), ("E99", "N00", "NXX", 1.0, True, ["pedestrian"])], "edge_id string, from_node string, to_node string, distance_m double, bidirectional boolean, allowed_modes array<string>")
    small = sorted(map(tuple, network.all_pairs(nodes, edges, ["pedestrian"], with_edges=True).collect()), key=str)
    monkeypatch.setattr(network, "MOST_ARCS", 1)
    large = sorted(map(tuple, network.all_pairs(nodes, edges, ["pedestrian"], with_edges=True).collect()), key=str)
    assert small == large and len(small) > 50
    assert {c for c, in network.components(nodes, edges).where("node_id in ('N12', 'N13')").select("component").collect()} == {"N12"}


def test_swap(spark, base, routing):
    totals, orders, checks = slotting.simulate(base, [("bolt", "glue")], routing)
    t = totals.first()
    assert (t.baseline_m, t.scenario_m, t.reduction_m, t.affected_orders) == (560, 480, 80, 1)
    assert t.reduction_percent == pytest.approx(100 / 7)
    assert [r.order_id for r in orders.where("delta_m <> 0").collect()] == ["ord-b"]
    assert checks.first().status == "ok"
    accepted, rejected = slotting.recommend(base)
    assert [(r.swap_id, r.sku_a, r.sku_b, r.reduction_m) for r in accepted.collect()] == [("SWAP-001", "bolt", "glue", 80)]
    assert slotting.recommend(base, top=0)[0].count() == 0


def test_replay_of_many_equals_one_by_one(spark):
    """Off-assignment picks, so that even orders without the swapped items change."""

    def change(doc):
        doc["picks"][3]["location_id"] = "bin-w"
        doc["picks"].append(doc["picks"][3] | {"pick_id": "p6", "order_id": "ord-e", "sku": "glue", "mode": "forklift"})

    b = bundle(spark, change)
    swaps = [("bolt", "glue"), ("bolt", "rope"), ("glue", "rope")]
    many = by(slotting.replay_swaps(b, spark.createDataFrame(swaps, "sku_a string, sku_b string")).withColumn("k", F.concat("sku_a", "sku_b")), "k", "comparable_orders", "affected_orders", "baseline_m", "scenario_m")
    for m in swaps:
        t = slotting.simulate(b, [m])[0].first()
        assert many["".join(m)] == (t.comparable_orders, t.affected_orders, t.baseline_m, t.scenario_m)


def test_swap_replay_takes_all_candidates(spark):
    from stowline import queries

    d = "/root/testdata/sf0.001"
    got = {(r.sku_a, r.sku_b): r for r in queries.QUERIES["swap_replay"](spark, d).collect()}
    b = starmap.bundle(spark, d, maximum_candidate_swaps=DEFAULTS["maximum_candidate_swaps"])
    want = [(r.sku_a, r.sku_b) for r in slotting.candidates(b).collect()]
    assert len(want) > 10 and set(got) == set(want)
    t, r = slotting.simulate(b, [want[-1]])[0].first(), got[want[-1]]  # a full replay of the last
    assert (r.comparable_orders, r.affected_orders) == (t.comparable_orders, t.affected_orders)
    assert (r.baseline_m, r.scenario_m) == pytest.approx((t.baseline_m, t.scenario_m))


def test_moves():
    assert slotting.parse_moves([{"sku_a": "a", "sku_b": " b "}]) == slotting.parse_moves({"moves": [{"type": "pair_swap", "sku_a": "a", "sku_b": "b"}]}) == [("a", "b")]
    for bad in ([], {}, [{"sku_a": "a", "sku_b": "a"}], [{"type": "shift"}], "x"):
        with pytest.raises(slotting.MoveError):
            slotting.parse_moves(bad)


def test_simulate_refuses(base, routing):
    for moves in ([("bolt", "glue"), ("glue", "rope")], [("bolt", "SX")]):
        with pytest.raises(slotting.MoveError):
            slotting.simulate(base, moves, routing)


@pytest.mark.parametrize(
    "block, row, change, check, outcome",
    [
        ("items", 0, {"unit_volume_m3": 0.5}, "volume", "fail"), ("items", 0, {"unit_weight_kg": 6}, "weight", "fail"), ("items", 0, {"unit_weight_kg": 26}, "unit_weight", "fail"),
        ("items", 0, {"unit_weight_kg": None}, "weight", "insufficient_data"), ("locations", 0, {"temperature_zone": "chilled"}, "temperature", "fail"), ("items", 0, {"temperature_zone": ""}, "temperature", "insufficient_data"),
        ("locations", 0, {"hazard_classes_allowed": ["acid"]}, "hazard", "fail"), ("locations", 0, {"hazard_classes_allowed": []}, "hazard", "insufficient_data"), ("items", 1, {"handling_mode": "tugger"}, "handling_mode", "fail"),
        ("locations", 0, {"location_type": "reserve"}, "zone", "fail"), ("locations", 0, {"level": 2}, "level", "fail"), ("locations", 0, {"level": None}, "level", "insufficient_data"),
        ("locations", 1, {"fixed": True}, "fixed", "fail"), ("items", 0, {"fixed_location": True}, "fixed", "fail"),
    ],
)
def test_constraints(spark, block, row, change, check, outcome):
    b = bundle(spark, lambda doc: doc[block][row].update(change))
    r = constraints.check_swaps(b, spark.createDataFrame([("bolt", "glue")], "sku_a string, sku_b string")).first()
    assert r[f"check_{check}"] == outcome
    assert r.status == ("constraint_violation" if outcome == "fail" else "insufficient_constraint_data")
    assert check in (r.failed if outcome == "fail" else r.insufficient)


def test_constraints_missing_side(spark, base):
    r = constraints.check_swaps(base, spark.createDataFrame([("bolt", "SX")], "sku_a string, sku_b string")).first()
    assert r.insufficient == list(constraints.CHECKS) and r.status == "insufficient_constraint_data"


def test_abc_classes(spark):
    def change(doc):
        pick = doc["picks"][0]
        doc["picks"] = [pick | {"pick_id": f"P{s}{k}", "order_id": f"O{s}{k}", "sku": s} for s, n in (("bolt", 7), ("glue", 2), ("rope", 1)) for k in range(n)]

    b = bundle(spark, change)
    assert by(classify.abc(b), "sku", "abc_class") == {"bolt": "A", "glue": "A", "rope": "B", "lamp": "C"}
    none = bundle(spark, lambda d: d.update(picks=[]))
    assert set(by(classify.abc(none), "sku", "abc_class").values()) == {"C"}


def test_xyz(spark, base):
    table, facts = classify.xyz(base)
    assert facts == {"bucket": "day", "buckets": 12, "minimum": 7, "computed": True}
    cv = by(table, "sku", "cv")
    assert cv["bolt"] == pytest.approx((12 * 2 - 4) ** 0.5 / 2)
    few, facts = classify.xyz(bundle(spark, lambda d: d["meta"].update(period_end="2026-03-04T00:00:00+01:00")))
    assert not facts["computed"] and few.count() == 0
    week = spark.sql("select date'2027-01-01' d").select(classify.bucket_key(F.col("d"), "week")).first()[0]
    assert week == "2026-W53"
    assert spark.sql("select '2026-03-02T00:00:00+01:00' t").select(classify.local_day(F.col("t")).cast("string")).first()[0] == "2026-03-02"


@pytest.mark.parametrize(
    "change, code, status",
    [
        (lambda d: None, None, "ok"),
        (lambda d: d["picks"][1].update(pick_id="p1"), "DUPLICATE_PICK_ID", "data_error"),
        (lambda d: d["edges"][0].update(to_node="NX"), "UNKNOWN_NODE_REFERENCE", "data_error"),
        (lambda d: d["edges"][0].update(distance_m=0), "INVALID_EDGE_DISTANCE", "data_error"),
        (lambda d: d["edges"].pop(), "DISCONNECTED_GRAPH", "data_error"),
        (lambda d: d["locations"][0].update(temperature_zone="chilled"), "TEMPERATURE_INCOMPATIBLE", "data_error"),
        (lambda d: d["assignments"][0].update(sku="SX"), "UNKNOWN_SKU", "data_error"),
        (lambda d: d["picks"][0].update(quantity=0), "INVALID_QUANTITY", "data_error"),
        (lambda d: d["picks"][0].update(timestamp="soon"), "INVALID_TIMESTAMP", "data_error"),
        (lambda d: d["picks"][0].update(timestamp="2027-01-01T00:00:00+01:00"), "TIMESTAMP_OUTSIDE_PERIOD", "data_error"),
        (lambda d: d["picks"][0].update(pick_sequence=2), "DUPLICATE_PICK_SEQUENCE", "data_error"),
        (lambda d: d["picks"][0].update(pick_sequence=None), "MISSING_PICK_SEQUENCE", "partial"),
        (lambda d: d["picks"][3].update(mode="forklift"), "DISCONNECTED_ROUTE", "partial"),
        (lambda d: d["picks"][0].update(mode="forklift") or d["picks"][1].update(mode="tugger"), "MIXED_ORDER_MODES", "partial"),
        (lambda d: d["config"].update(route_end_node=None), "MISSING_ROUTE_ENDPOINT", "data_error"),
        (lambda d: d["assignments"].append(d["assignments"][0] | {"location_id": "bin-w"}), "SHARED_PICK_LOCATION", "data_error"),
        (lambda d: d["meta"].update(sequence_basis="guess"), "UNKNOWN_SEQUENCE_BASIS", "data_error"),
    ],
)
def test_validation(spark, change, code, status):
    report = quality.validate(bundle(spark, change))
    codes = {r.code for r in report.issues.collect()}
    assert report.status == status and report.exit_code == {"ok": 0, "data_error": 1, "partial": 2}[status]
    assert code in codes if code else codes == {"SEQUENCE_BASIS_UNKNOWN"}


def test_a_node_reaches_itself_in_any_mode(spark):
    """An order by a vehicle that no edge admits is complete if all its stops are the start node (F4 to F10 in REPLY_r01.md)."""

    def change(doc):
        doc["picks"] = [doc["picks"][1] | {"mode": "tugger"}, doc["picks"][3] | {"mode": "tugger"}]
        doc["locations"][0]["access_node_id"] = "dock"

    b = bundle(spark, change)
    orders = routes.build(b).orders
    assert by(orders, "order_id", "total_distance_m", "reason") == {"ord-a": (0.0, None), "ord-c": (None, "UNREACHABLE_SEGMENT")}


def test_unknown_locations_and_segments_are_named(spark):
    def change(doc):
        doc["picks"][1]["location_id"] = "LX"
        doc["picks"][3]["mode"] = "forklift"

    r = routes.build(bundle(spark, change))
    assert by(r.orders, "order_id", "reason", "unknown_at_pick") == {"ord-a": ("UNKNOWN_LOCATION", "p2"), "ord-b": (None, None), "ord-c": ("UNREACHABLE_SEGMENT", None), "ord-d": (None, None)}
    assert sorted(tuple(x) for x in routes.unreachable_segments(r).collect() if x.pick_id) == [("ord-c", "p4", "dock", "yard", "forklift")]
    assert by(routes.order_edges(r).where("order_id = 'ord-b'"), "edge_id", "traversals") == {"r1": 2, "r2": 2}


def test_routes_of_a_layout_without_a_small_table(spark, monkeypatch):
    """Distances solved for the used pairs only: the same routes and replays."""
    swaps = spark.createDataFrame([("bolt", "glue"), ("bolt", "rope")], "sku_a string, sku_b string")
    small, large = [], []
    for out, most in ((small, network.MOST_PAIRS), (large, 3)):
        monkeypatch.setattr(network, "MOST_PAIRS", most)
        b = bundle(spark, lambda d: d["picks"][0].update(location_id="bin-w"))
        out += sorted(map(str, routes.build(b).orders.drop("skus", "location_ids").collect())) + sorted(map(str, slotting.replay_swaps(b, swaps).collect()))
    assert small == large


def test_partial_routes(spark):
    b = bundle(spark, lambda d: d["picks"][3].update(mode="forklift"))
    r = routes.build(b)
    assert by(r.orders, "order_id", "reason")["ord-c"] == "UNREACHABLE_SEGMENT"
    assert metrics.flow_metrics(b, r).first().total_distance_m == 370
    assert [x.order_id for x in routes.touching(r, skus=["rope"]).collect()] == ["ord-c"]


@pytest.mark.parametrize("block, change", [("nodes", {"x_m": "far"}), ("nodes", {"node_id": ""}), ("edges", {"bidirectional": "perhaps"}), ("assignments", {"role": "spare"}), ("picks", {"pick_sequence": "1.5"})])
def test_strict_rows(spark, block, change):
    with pytest.raises(Exception, match=next(iter(change))):
        getattr(bundle(spark, lambda d: d[block][0].update(change)), block).collect()


def test_files(spark, tmp_path, base):
    path = tmp_path / "data.json"
    path.write_text(json.dumps(yard()))
    b = documents.load(spark, str(path))
    for name in ("nodes", "edges", "locations", "items", "assignments", "picks"):
        assert sorted(map(str, getattr(b, name).collect())) == sorted(map(str, getattr(base, name).collect()))
    assert documents.Catalog(tmp_path).load(spark, "yard").nodes.count() == 5
    for bad in (lambda: documents.Catalog(tmp_path).load(spark, "other"), lambda: documents.read_json(tmp_path / "none.json"), lambda: documents.load_mapping(__file__)):
        with pytest.raises(documents.SourceError):
            bad()
    a = analyse.analyse(b)
    doc = reports.write_reports(a, tmp_path / "out")
    assert doc["status"] == "ok" and {f["claim"] for f in doc["findings"]} >= {"observed", "calculated", "simulated"}
    names = {p.name for p in (tmp_path / "out").iterdir()}
    assert names == {"analysis.json", "recommendations.csv", "moves.json", "report.md", "report.html", "flow-map.svg", "spaghetti.svg", "spaghetti-aggregate.svg"}
    assert documents.load_moves(tmp_path / "out/moves.json") == [("bolt", "glue")]
    assert 'stroke-width="10.00"' in (tmp_path / "out/flow-map.svg").read_text()


def test_command_line_writes_whole_tables(spark, tmp_path):
    from stowline import __main__ as cli

    doc = yard()
    doc["locations"] += [doc["locations"][0] | {"location_id": f"X{k}"} for k in range(60)]
    (tmp_path / "data.json").write_text(json.dumps(doc))
    for command in ("recommend", "analyze"):
        cli._run(spark, cli._parser().parse_args([command, str(tmp_path / "data.json"), "--output", str(tmp_path / command)]))
    shown = json.loads((tmp_path / "analyze/analysis.json").read_text())
    assert shown["shortened"]
    for name, n in shown["shortened"].items():
        assert n > 50 and spark.read.parquet(str(tmp_path / "analyze/tables" / name)).count() == n
    assert spark.read.parquet(str(tmp_path / "recommend/tables/accepted")).count() == 1
    assert len(reports.moves([{"sku_a": f"a{k}", "sku_b": f"b{k}"} for k in range(60)])["moves"]) == 60


def test_csv_and_normaliser(spark, tmp_path):
    (tmp_path / "items.csv").write_text('﻿article; text ;litres;gram;picker_name;badge_no\n a1 ;"x; y";1,5;2 000;Ann;7\nb2;;;;Bob;8\n', encoding="utf-8")
    raw = documents.read_csv(spark, str(tmp_path / "items.csv"))
    assert raw.columns == ["article", "text", "litres", "gram", "picker_name", "badge_no"] and raw.first().text == "x; y"
    rules = {"sku": {"source": "article", "transforms": ["upper"]}, "description": "text", "unit_volume_m3": {"source": "litres", "transforms": ["decimal_comma_to_point"], "unit": "l"}, "unit_weight_kg": {"source": "gram", "transforms": ["remove_thousands_separator"], "unit": "g"}, "hazard_class": {"constant": "none"}, "handling_mode": {"default": "pedestrian"}}
    out, notes = normalise.block("items", raw, rules)
    rows = [tuple(r) for r in out.select("sku", "description", "unit_volume_m3", "unit_weight_kg", "hazard_class", "handling_mode", "fixed_location").collect()]
    assert rows == [("A1", "x; y", 0.0015, 2.0, "none", "pedestrian", False), ("B2", "", None, None, "none", "pedestrian", False)]
    assert notes.dropped == ["picker_name"] and ("SUSPECTED_PERSONAL_COLUMN", "warning", "badge_no") in notes.issues
    for bad in ({"sku": "picker_name"}, {}, {"sku": "missing"}, rules | {"unit_weight_kg": {"source": "gram"}}, rules | {"sku": {"source": "article", "transforms": ["shout"]}}):
        with pytest.raises(normalise.MappingQuestion):
            normalise.block("items", raw, bad)


def test_evidence():
    t = evidence.THRESHOLDS
    assert evidence.route(t, 30, 95.0, "scan_confirmed", True).quality == "high"
    assert evidence.route(t, 30, 95.0, "planned", True).quality == "medium"
    assert evidence.route(t, 30, 95.0, "planned", False).quality == "low"
    assert evidence.route(t, 2, 100.0, "observed", True).quality == "insufficient"
    assert evidence.xyz(t, 5, "day", 1.0, 7, False).quality == "insufficient"
    assert evidence.affinity(t, 500, 40, 0.01, 2).quality == "low"
    assert evidence.constraint(t, 9, 0).quality == "medium" and evidence.constraint(t, 9, 0, True).quality == "high"
    assert evidence.thresholds({"evidence_thresholds": {"route_orders_low": 1, "other": 2, "abc_orders_low": "x"}}) == t | {"route_orders_low": 1}
    assert evidence.period_days("2026-01-01", "2026-01-10") == 10 and evidence.period_days(None, "x") is None


def test_zero_parameters(base):
    assert base.with_config(maximum_candidate_swaps=0).get("maximum_candidate_swaps") == DEFAULTS["maximum_candidate_swaps"]
    assert base.with_config(minimum_improvement_percent=0).get("minimum_improvement_percent") == 0


def test_properties_of_the_star_tables(spark):
    b = starmap.bundle(spark, "/root/testdata/sf0.001")
    r = routes.build(b)
    total = metrics.flow_metrics(b, r).first().total_distance_m
    assert metrics.location_metrics(b, r).agg(F.sum("attributable_distance_m")).first()[0] == total
    assert metrics.edge_flows(b, r).agg(F.sum("walked_m")).first()[0] == total
    assert classify.abc(b).agg(F.max("cumulative_share")).first()[0] == 1
    full = slotting.candidates(b, 5000)
    some = slotting.candidates(b, 7)
    assert [tuple(x) for x in some.collect()] == [tuple(x) for x in full.collect()][:7]
