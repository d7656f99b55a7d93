"""Regression cases: a dataset and what its analysis must and must not say. One JSON file per case."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import quality
from .plans import analyse
from .sinks import reports
from .sources import documents

# The categories of cases, in the order of the summary, and what a refused variability class is called.
CATEGORIES = ("validation", "routing", "metrics", "classification", "constraint handling", "unsupported claims")
XYZ_REFUSED = "XYZ_NOT_COMPUTED_INSUFFICIENT_PERIODS"
#: Names that cases use for totals which the tables here name otherwise.
NAMES = {"unreachable_order_count": "unreachable_orders", "unsequenced_order_count": "unsequenced_orders", "excluded_order_count": "excluded_orders"}
#: Keys that validation alone can answer.
_VALIDATION = {"expected_status", "expected_exit_code", "required_issue_codes", "forbidden_issue_codes"}
_ANALYSIS = {
    "expected_metrics", "expected_abc_classes", "expected_xyz_marker", "expected_affinity", "allowed_recommendations", "forbidden_recommendations",
    "expected_recommendation_count", "expected_rejected_reasons", "expected_claim_types", "forbidden_claim_types", "forbidden_report_substrings",
}


@dataclass
class Outcome:
    case_id: str
    category: str
    checks: int = 0
    failures: list[str] = field(default_factory=list)

    def expect(self, holds: bool, what: str) -> None:
        self.checks += 1
        if not holds:
            self.failures.append(what)

    @property
    def passed(self) -> bool:
        return not self.failures


def _pair(row) -> frozenset:
    return frozenset(row.split("|")) if isinstance(row, str) else frozenset((row["sku_a"], row["sku_b"]))


def run_case(spark: SparkSession, path: str | Path) -> Outcome:
    case = documents.read_json(path)
    out = Outcome(str(case.get("case_id") or Path(path).stem), str(case.get("category") or "other"))
    bundle = documents.from_object(spark, case["dataset"]) if "dataset" in case else documents.load(spark, str((Path(path).parent / case["dataset_path"]).resolve()))
    if set(case) & _ANALYSIS:
        done = analyse.analyse(bundle)
        _judge_analysis(out, case, done)
        report = done.report
    else:
        report = quality.validate(bundle)
    if set(case) & _VALIDATION:
        _judge_report(out, case, report)
    return out


def _judge_report(out: Outcome, case: dict, report: quality.Report) -> None:
    if (status := case.get("expected_status")) is not None:
        out.expect(report.status == status, f"status {report.status}, not {status}")
    if (code := case.get("expected_exit_code")) is not None:
        out.expect(report.exit_code == int(code), f"exit code {report.exit_code}, not {code}")
    found = {r.code for r in report.issues.select("code").distinct().collect()}  # at most as many as there are rules
    for code in case.get("required_issue_codes") or ():
        out.expect(code in found, f"no issue {code}")
    for code in case.get("forbidden_issue_codes") or ():
        out.expect(code not in found, f"an issue {code}")


def _judge_analysis(out: Outcome, case: dict, done: analyse.Analysis) -> None:
    for name, wanted in (case.get("expected_metrics") or {}).items():
        value, band = (wanted.get("value"), wanted.get("tolerance", 0.0)) if isinstance(wanted, dict) else (wanted, 0.0)
        own = done.totals.get(NAMES.get(name, name))
        near = own == value if own is None or value is None else abs(round(float(own), 3) - float(value)) <= float(band) + 1e-9
        out.expect(near, f"{name} is {own}, not {value} within {band}")
    accepted, rejected = ([r.asDict() for r in done.tables[k].collect()] if k in done.tables else [] for k in ("accepted", "rejected"))  # at most the candidate limit
    pairs = {_pair(r) for r in accepted}
    if (allowed := case.get("allowed_recommendations")) is not None:
        out.expect(pairs <= set(map(_pair, allowed)), f"recommended beyond {allowed}")
    for p in case.get("forbidden_recommendations") or ():
        out.expect(_pair(p) not in pairs, f"recommended {p}")
    if (n := case.get("expected_recommendation_count")) is not None:
        out.expect(len(accepted) == int(n), f"{len(accepted)} recommendations, not {n}")
    why = {_pair(r): {r["verdict"], *(r["reasons"] or ())} for r in rejected}
    for p, reason in (case.get("expected_rejected_reasons") or {}).items():
        out.expect(reason in why.get(_pair(p), ()), f"{p} rejected for {sorted(why.get(_pair(p), ()))}, not {reason}")
    if "expected_xyz_marker" in case:
        marker = None if done.xyz_facts["computed"] else XYZ_REFUSED
        out.expect(marker == case["expected_xyz_marker"], f"XYZ marker {marker}")
    if classes := case.get("expected_abc_classes"):
        own = {r.sku: r.abc_class for r in done.tables["abc"].where(done.tables["abc"].sku.isin(*classes)).collect()}
        for sku, wanted in classes.items():
            out.expect(own.get(sku) == wanted, f"{sku} in class {own.get(sku)}, not {wanted}")
    if wanted := case.get("expected_affinity"):
        a, b = sorted(wanted["pair"].split("|"))
        row = done.tables["affinity"].where((done.tables["affinity"].sku_a == a) & (done.tables["affinity"].sku_b == b)).first()
        count = wanted.get("co_pick_count")
        out.expect(row is not None and count in (None, row.co_picks), f"pair {wanted['pair']}: {row and row.co_picks} common orders, not {count}")
    claims = {f.claim for f in done.findings}
    for c in case.get("expected_claim_types") or ():
        out.expect(c in claims, f"no {c} finding")
    for c in case.get("forbidden_claim_types") or ():
        out.expect(c not in claims, f"a {c} finding")
    if words := case.get("forbidden_report_substrings"):
        text = json.dumps(reports.document(done), ensure_ascii=False, default=str).lower()
        for w in words:
            out.expect(w.lower() not in text, f"the report says {w!r}")


def run(spark: SparkSession, folder: str | Path) -> list[Outcome]:
    """All cases of a folder by file name; a case that can't run counts as failed."""
    outcomes = []
    for path in sorted(Path(folder).glob("*.json")):
        try:
            outcomes.append(run_case(spark, path))
        except Exception as e:  # noqa: BLE001  one broken case doesn't stop the others
            outcomes.append(Outcome(path.stem, "other", 1, [f"could not run: {e}"]))
    return outcomes


def summary(outcomes: list[Outcome]) -> str:
    """A line per category, one for all, then each failure."""
    named = [c for c in CATEGORIES if any(o.category == c for o in outcomes)] + sorted({o.category for o in outcomes} - set(CATEGORIES))
    groups = [(c, [o for o in outcomes if o.category == c]) for c in named] + [("overall", outcomes)]
    lines = [f"{c}: {sum(o.passed for o in g)} of {len(g)} {'PASS' if all(o.passed for o in g) else 'FAIL'}" for c, g in groups]
    return "\n".join(lines + [f"{o.case_id}: {what}" for o in outcomes for what in o.failures])
