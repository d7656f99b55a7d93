"""Evidence grades: the first rung that holds, then caps that lower it and say why. Acts on aggregate facts only."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from ..schema import CONFIRMED_SEQUENCES

LEVELS = ("insufficient", "low", "medium", "high")
# The rungs' thresholds.
THRESHOLDS = {
    "route_orders_high": 30, "route_orders_medium": 10, "route_orders_low": 3, "route_coverage_high": 95.0, "route_coverage_medium": 80.0,
    "abc_orders_high": 30, "abc_orders_medium": 10, "abc_orders_low": 3, "abc_period_days_high": 28, "abc_period_days_medium": 7,
    "xyz_day_buckets_high": 90, "xyz_day_buckets_medium": 28, "xyz_week_buckets_high": 26, "xyz_week_buckets_medium": 12,
    "xyz_timestamp_rate_high": 0.98, "xyz_timestamp_rate_medium": 0.90,
    "affinity_orders_high": 200, "affinity_orders_medium": 50, "affinity_co_picks_high": 30, "affinity_co_picks_medium": 10, "affinity_support_floor": 0.02,
    "simulation_comparable_high": 30, "simulation_comparable_medium": 10, "simulation_affected_high": 30, "simulation_affected_medium": 10,
    "constraint_checks_expected": 9, "constraint_unknowns_medium": 2,
}


@dataclass(frozen=True)
class Grade:
    quality: str
    rationale: str
    caps: tuple[str, ...] = ()
    factors: dict = field(default_factory=dict)


def thresholds(config: dict) -> dict:
    """The defaults under the config's own numbers; unknown keys and values that are no numbers are ignored."""
    own = config.get("evidence_thresholds") or {}
    return THRESHOLDS | {k: v for k, v in own.items() if k in THRESHOLDS and isinstance(v, (int, float)) and not isinstance(v, bool)}


def _grade(rungs: list[bool], caps: list[tuple[bool, str, str]], rationale: str, **factors) -> Grade:
    """rungs: for high, medium, low."""
    level = next((name for ok, name in zip(rungs, ("high", "medium", "low"), strict=True) if ok), "insufficient")
    said = []
    for applies, most, why in caps:
        if applies and LEVELS.index(level) > LEVELS.index(most):
            level = most
            said.append(why)
    return Grade(level, rationale, tuple(said), factors)


def route(t: dict, orders: int, coverage: float | None, basis: str, complete: bool) -> Grade:
    c = coverage or 0.0
    rungs = [orders >= t[f"route_orders_{k}"] and c >= t[f"route_coverage_{k}"] for k in ("high", "medium")] + [orders >= t["route_orders_low"]]
    caps = [(basis not in CONFIRMED_SEQUENCES, "medium", f"the sequence ({basis}) was not confirmed at the pick face"), (not complete, "low", "some order has no route on the declared graph")]
    return _grade(rungs, caps, f"{orders} orders routed, coverage {coverage} %", orders=orders, coverage=coverage, sequence_basis=basis)


def abc(t: dict, orders: int, days: int | None, basis: str, complete: bool = True) -> Grade:
    d = days or 0
    rungs = [orders >= t[f"abc_orders_{k}"] and d >= t[f"abc_period_days_{k}"] for k in ("high", "medium")] + [orders >= t["abc_orders_low"]]
    return _grade(rungs, [(not complete, "low", f"{basis} is not known for every pick line")], f"{orders} orders over {days} days", orders=orders, days=days, basis=basis)


def xyz(t: dict, buckets: int, kind: str, rate: float, minimum: int, computed: bool = True) -> Grade:
    if not computed:
        return Grade("insufficient", "variability was not computed", (), {"buckets": buckets})
    kind = "week" if kind == "week" else "day"
    rungs = [buckets >= t[f"xyz_{kind}_buckets_{k}"] and rate >= t[f"xyz_timestamp_rate_{k}"] for k in ("high", "medium")] + [buckets >= minimum]
    return _grade(rungs, [], f"{buckets} {kind} buckets, {100 * rate:.1f} % of lines stamped", buckets=buckets, rate=rate)


def affinity(t: dict, orders: int, co_picks: int, support: float, minimum: int) -> Grade:
    rungs = [orders >= t[f"affinity_orders_{k}"] and co_picks >= t[f"affinity_co_picks_{k}"] for k in ("high", "medium")] + [co_picks >= max(2, minimum)]
    return _grade(rungs, [(support < t["affinity_support_floor"], "low", "the pair is rare")], f"{co_picks} common orders of {orders}", orders=orders, co_picks=co_picks, support=support)


def simulation(t: dict, coverage: float | None, comparable: int, affected: int, constraints_complete: bool, basis: str, site_verified: bool = False) -> Grade:
    c = coverage or 0.0
    rungs = [c >= t[f"route_coverage_{k}"] and comparable >= t[f"simulation_comparable_{k}"] and affected >= t[f"simulation_affected_{k}"] for k in ("high", "medium")] + [affected >= 1]
    caps = [
        (not site_verified, "medium", "not verified on site; a simulated reduction is no realised saving"),
        (not constraints_complete, "low", "a constraint value is unknown"),
        (basis == "unknown", "low", "the source of the sequence is not declared"),
    ]
    return _grade(rungs, caps, f"{affected} of {comparable} comparable orders change", comparable=comparable, affected=affected)


def constraint(t: dict, checks: int, unknown: int, site_verified: bool = False) -> Grade:
    full = checks >= t["constraint_checks_expected"]
    rungs = [full and unknown == 0, full and unknown <= t["constraint_unknowns_medium"], checks > 0]
    return _grade(rungs, [(not site_verified, "medium", "values come from the data and were not confirmed on site")], f"{checks} checks, {unknown} unknown", checks=checks, unknown=unknown)


def period_days(start: str | None, end: str | None) -> int | None:
    """Days of the declared period, both ends counted."""
    try:
        return (datetime.fromisoformat(end).date() - datetime.fromisoformat(start).date()).days + 1
    except (TypeError, ValueError):
        return None


def table(analysis):
    """(family, quality, rationale) of the analysis' grades as a DataFrame."""
    rows = [(k, g.quality, g.rationale) for k, g in analysis.grades.items()]
    return analysis.bundle.spark.createDataFrame(rows, "family string, quality string, rationale string")
