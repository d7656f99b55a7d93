"""Canonical documents with a layout, saved datasets, regression cases and the tools."""

import io
import json

import pytest

from stowline import evals, service
from stowline.schema import BLOCKS
from stowline.sources import documents
from tests.fixtures import yard


def canonical(**config) -> dict:
    d = yard(**config)
    return d | {"layout": {k: d.pop(k) for k in ("nodes", "edges")}}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    p = tmp_path_factory.mktemp("data")
    (p / "yard.json").write_text(json.dumps(canonical()))
    return p


def test_layout_and_saved_folder(spark, folder, tmp_path):
    first = documents.load(spark, str(folder / "yard.json"))
    documents.save(first, str(tmp_path / "set"))
    again = documents.load(spark, str(tmp_path / "set"))
    assert (again.meta, again.config) == (first.meta, first.config)
    built = documents.from_object(spark, canonical())
    for block in BLOCKS:
        rows = [sorted(map(str, getattr(b, block).collect())) for b in (first, again, built)]
        assert rows[0] and rows[0] == rows[1] == rows[2]
    for bad in ("[]", "{", json.dumps(canonical() | {"layout": [1]}), json.dumps(canonical() | {"config": [1]})):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(documents.SourceError):
            documents.load(spark, str(tmp_path / "bad.json"))
    with pytest.raises(documents.SourceError):
        documents.load(spark, str(tmp_path / "none.json"))


def test_cases(spark, folder, tmp_path):
    good = {
        "case_id": "good", "category": "metrics", "dataset": canonical(), "expected_status": "ok", "expected_exit_code": 0, "forbidden_issue_codes": ["UNKNOWN_SKU"],
        "expected_metrics": {"total_distance_m": {"value": 560, "tolerance": 0.001}, "unreachable_order_count": 0}, "allowed_recommendations": ["glue|bolt"], "expected_recommendation_count": 1,
        "expected_claim_types": ["simulated"], "forbidden_claim_types": ["hypothesis"], "expected_affinity": {"pair": "glue|bolt", "co_pick_count": 1}, "forbidden_report_substrings": ["guaranteed"],
    }
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps({"category": "routing", "dataset_path": str(folder / "yard.json"), "expected_status": "partial", "required_issue_codes": ["UNKNOWN_SKU"]}))
    (tmp_path / "c.json").write_text("{}")
    a, b, c = evals.run(spark, tmp_path)
    assert a.passed and a.checks == 11, a.failures
    assert not b.passed and len(b.failures) == b.checks == 2 and b.case_id == "b"
    assert not c.passed and "overall: 1 of 3 FAIL" in evals.summary([a, b, c])


def _hello(s):
    return s.answer({"jsonrpc": "2.0", "id": 0, "method": "initialize", "params": {"protocolVersion": "2025-06-18", "capabilities": {}, "clientInfo": {"name": "t", "version": "1"}}})


def test_tools(spark, folder):
    s = service.Service(spark, str(folder))
    assert _hello(s)["result"]["protocolVersion"] == "2025-06-18"
    call = lambda name, **a: s.answer({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]
    read = lambda r: json.loads(r["content"][0]["text"])
    assert read(call("list_demo_datasets"))["datasets"][0] | {"site_id": None} == {"dataset_id": "yard", "site_id": None, "fictional": True, "period_start": "2026-03-02T00:00:00+01:00", "period_end": "2026-03-13T23:59:59+01:00", "orders": 4, "pick_lines": 5}
    summed = read(call("get_demo_summary", dataset_id="yard"))
    assert (summed["nodes"], summed["travel_modes"], summed["zones"]) == (5, ["forklift", "pedestrian"], ["left", "out", "right"])
    assert read(call("validate_demo_dataset", dataset_id="yard"))["status"] == "ok"
    flows = read(call("analyze_demo_flows", dataset_id="yard", top=1))
    assert flows["metrics"]["total_distance_m"] == 560 and len(flows["edge_flows"]) == 1
    assert [r["sku_a"] for r in read(call("recommend_demo_slotting", dataset_id="yard"))["recommendations"]] == ["bolt"]
    moved = read(call("simulate_demo_moves", dataset_id="yard", moves=[{"type": "pair_swap", "sku_a": "bolt", "sku_b": "glue"}]))
    assert moved["totals"]["reduction_m"] == 80
    for name, args in (("none", {}), ("get_demo_summary", {}), ("get_demo_summary", {"dataset_id": "../x"}), ("analyze_demo_flows", {"dataset_id": "yard", "top": 51}), ("analyze_demo_flows", {"dataset_id": "yard", "top": True}),
                       ("get_demo_summary", {"dataset_id": "yard", "path": "x"}), ("simulate_demo_moves", {"dataset_id": "yard", "moves": []}), ("simulate_demo_moves", {"dataset_id": "yard", "moves": [{"type": "pair_swap", "sku_a": "bolt", "sku_b": "bolt"}]})):
        assert call(name, **args)["isError"], (name, args)


def test_protocol(spark, folder):
    s = service.Service(spark, str(folder))
    meta = {service.VERSION_KEY: "2026-07-28", service.ABILITIES_KEY: {}}
    ask = lambda method, **p: s.answer({"jsonrpc": "2.0", "id": "x", "method": method, "params": p})
    assert ask("tools/list")["error"]["code"] == service.BAD_PARAMS  # neither a handshake nor a version
    assert len(ask("tools/list", _meta=meta)["result"]["tools"]) == 6
    assert ask("server/discover", _meta=meta)["result"]["resultType"] == "complete"
    assert ask("ping", _meta=meta | {service.VERSION_KEY: "1999-01-01"})["error"]["code"] == service.BAD_VERSION
    assert ask("none", _meta=meta)["error"]["code"] == service.NO_METHOD
    assert ask("initialize", protocolVersion="2026-07-28")["error"]["code"] == service.BAD_PARAMS
    _hello(s)
    assert "resultType" not in ask("tools/list")["result"]
    out = io.StringIO()
    s.serve(io.StringIO('\n{\n[]\n{"jsonrpc": "2.0", "method": "ping"}\n{"jsonrpc": "2.0", "id": true, "method": "ping"}\n{"jsonrpc": "2.0", "id": 5, "method": "ping"}\n'), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g.get("error", {}).get("code") for g in got] == [service.BAD_JSON, service.BAD_REQUEST, service.BAD_REQUEST, None] and got[3]["id"] == 5
