"""The whole analysis: validation, routes, metrics, classes, affinity, swaps, grades and findings.

Tables stay DataFrames; the driver handles single rows and the heads of ranked tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import affinity, classify, metrics, quality, routes, slotting
from ..schema import DEFAULTS, Bundle
from . import evidence


@dataclass
class Finding:
    claim: str  # observed, calculated, simulated or hypothesis
    title: str
    text: str
    grade: evidence.Grade | None = None
    figures: dict = field(default_factory=dict)


@dataclass
class Analysis:
    bundle: Bundle
    report: quality.Report
    routing: routes.Routing
    tables: dict[str, DataFrame]
    totals: dict
    xyz_facts: dict
    grades: dict[str, evidence.Grade] = field(default_factory=dict)
    findings: list[Finding] = field(default_factory=list)

    @property
    def status(self) -> str:
        return self.report.status


def thresholds(bundle: Bundle) -> dict:
    """Every parameter with the value that was used."""
    return {k: bundle.get(k) for k in DEFAULTS} | {"evidence_thresholds": evidence.thresholds(bundle.config), "percentile_method": "linear interpolation"}


def analyse(bundle: Bundle, *, slots: bool = True) -> Analysis:
    report = quality.validate(bundle)
    routing = report.routing or routes.build(bundle).cached()
    tables = {
        "flow": metrics.flow_metrics(bundle, routing), "locations": metrics.location_metrics(bundle, routing), "skus": metrics.sku_metrics(bundle, routing),
        "edges": metrics.edge_flows(bundle, routing), "zones": metrics.zone_flows(bundle, routing), "top_orders": metrics.top_orders(routing, bundle.get("spaghetti_top_orders")),
        "abc": classify.abc(bundle), "affinity": affinity.enriched(bundle, affinity.pairs(bundle)),
    }
    tables = {k: df.cache() for k, df in tables.items()}  # findings and every report read them again
    tables["top_locations"] = metrics.top_locations(tables["locations"], 10)
    tables["xyz"], facts = classify.xyz(bundle)
    tables["xyz"] = tables["xyz"].cache()
    tables["classes"] = classify.combined(tables["abc"], tables["xyz"])
    if slots and report.status != "data_error":
        tables["accepted"], tables["rejected"] = (df.cache() for df in slotting.recommend(bundle))
    totals = tables["flow"].first().asDict() | metrics.data_quality(bundle, routing).first().asDict()
    out = Analysis(bundle, report, routing, tables, totals, facts)
    _grade(out)
    _find(out)
    return out


def _grade(a: Analysis) -> None:
    t, x, m = evidence.thresholds(a.bundle.config), a.totals, a.bundle.meta
    days = evidence.period_days(m.period_start, m.period_end)
    rate = x["picks_with_timestamp"] / x["picks"] if x["picks"] else 0.0
    a.grades["route"] = evidence.route(t, x["routed_orders"], x["route_coverage_percent"], m.sequence_basis, not x["unreachable_orders"])
    a.grades["abc"] = evidence.abc(t, x["orders"], days, a.bundle.get("abc_basis"))
    a.grades["xyz"] = evidence.xyz(t, a.xyz_facts["buckets"], a.xyz_facts["bucket"], rate, a.xyz_facts["minimum"], a.xyz_facts["computed"])
    if top := a.tables["affinity"].first():
        a.grades["affinity"] = evidence.affinity(t, x["orders"], top.co_picks, top.support, a.bundle.get("affinity_minimum_co_picks"))


def _find(a: Analysis) -> None:
    x, f, add = a.totals, a.findings, a.findings.append
    add(Finding("observed", "Coverage", f"{x['routed_orders']} of {x['orders']} orders have a modelled route ({x['route_coverage_percent']:.1f} %).", a.grades["route"]))
    if x["routed_orders"]:
        add(Finding("calculated", "Distance per order", f"Modelled distance per order: mean {x['average_distance_per_order_m']:.1f} m, median {x['median_distance_per_order_m']:.1f} m, 90th percentile {x['p90_distance_per_order_m']:.1f} m.", a.grades["route"], {"total_m": x["total_distance_m"]}))
    if top := a.tables["top_locations"].first():
        add(Finding("calculated", "Dominant location", f"{top.location_id} draws {top.distance_share_percent:.1f} % of the modelled distance with {top.visits} visits.", a.grades["route"]))
    if (edge := a.tables["edges"].orderBy(F.desc("traversals"), "edge_id").first()) and edge.traversals:
        add(Finding("calculated", "Busiest aisle segment", f"{edge.edge_id} is walked {edge.traversals} times ({edge.share_percent:.1f} %).", a.grades["route"]))
    counts = {r.abc_class: r["count"] for r in a.tables["abc"].groupBy("abc_class").count().collect()}
    add(Finding("calculated", "ABC", f"By {a.bundle.get('abc_basis')}: " + ", ".join(f"{counts.get(k, 0)} in {k}" for k in "ABC") + ".", a.grades["abc"]))
    if a.xyz_facts["computed"]:
        counts = {r.xyz_class: r["count"] for r in a.tables["xyz"].groupBy("xyz_class").count().collect()}
        add(Finding("calculated", "XYZ", f"Over {a.xyz_facts['buckets']} {a.xyz_facts['bucket']} buckets: " + ", ".join(f"{counts.get(k, 0)} in {k}" for k in "XYZ") + ".", a.grades["xyz"]))
    else:
        add(Finding("observed", "XYZ not computed", f"{a.xyz_facts['buckets']} buckets; at least {a.xyz_facts['minimum']} with time stamps are needed.", a.grades["xyz"]))
    if top := a.tables["affinity"].first():
        add(Finding("calculated", "Top pair", f"{top.sku_a} and {top.sku_b} share {top.co_picks} orders (lift {top.lift:.2f}).", a.grades["affinity"]))
    if "accepted" not in a.tables:
        return
    t, basis = evidence.thresholds(a.bundle.config), a.bundle.meta.sequence_basis
    accepted = a.tables["accepted"].collect()  # at most maximum_recommendations rows
    for r in accepted:
        g = evidence.simulation(t, x["route_coverage_percent"], r.comparable_orders, r.affected_orders, True, basis)
        add(Finding("simulated", r.swap_id, f"Swapping {r.sku_a} and {r.sku_b} shortens the modelled distance by {r.reduction_m:.1f} m ({r.reduction_percent:.4f} %) over {r.affected_orders} orders.", g))
    fallen = {r.verdict: r["count"] for r in a.tables["rejected"].groupBy("verdict").count().collect()}
    if n := fallen.get("constraint_violation"):
        add(Finding("observed", "Blocked swaps", f"{n} candidates fail a constraint."))
    if n := fallen.get("insufficient_constraint_data"):
        add(Finding("observed", "Unknown constraints", f"{n} candidates wait for constraint values; an unknown value is never a pass.", evidence.constraint(t, 9, 1)))
    if not accepted:
        f.append(Finding("hypothesis", "No swap stands out", "No candidate reaches the minimum improvement; other layouts were not examined."))


def findings_table(a: Analysis) -> DataFrame:
    rows = [(f"F-{k:03d}", x.claim, x.title, x.text, x.grade.quality if x.grade else None) for k, x in enumerate(a.findings, 1)]
    return a.bundle.spark.createDataFrame(rows, "finding_id string, claim string, title string, text string, quality string")
