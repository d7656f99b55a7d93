"""python -m stowline: normalize, validate, analyze, recommend, simulate or describe a dataset, run cases, serve the tools."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import evals, service
from .operators import quality, slotting
from .operators.normalise import MappingQuestion
from .plans import analyse
from .sinks import reports
from .sources import documents


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stowline")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("normalize", "validate", "analyze", "recommend", "simulate", "describe", "run-evals", "serve"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("--output", default="out")
        if name == "normalize":
            s.add_argument("--mapping", required=True)
        if name == "simulate":
            s.add_argument("--moves", required=True)
        if name == "recommend":
            s.add_argument("--top", type=int)
    return p


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "serve":
        service.Service(spark, a.input).serve(sys.stdin, sys.stdout)
        return 0
    if a.command == "run-evals":
        outcomes = evals.run(spark, a.input)
        print(evals.summary(outcomes))
        return int(not all(o.passed for o in outcomes))
    out = Path(a.output)
    out.mkdir(parents=True, exist_ok=True)
    if a.command == "normalize":
        bundle, notes = documents.normalise_folder(spark, a.input, documents.load_mapping(a.mapping))
        documents.save(bundle, str(out / "dataset"))
        reports.write_json(out / "issues.json", notes)
        return 0
    bundle = documents.load(spark, a.input)
    if a.command == "describe":
        print(json.dumps({n: getattr(bundle, n).count() for n in ("nodes", "edges", "locations", "items", "assignments", "picks")}))
        return 0
    tables = (out / "tables").absolute().as_uri()  # whole tables, whatever the JSON shows
    if a.command == "analyze":
        done = analyse.analyse(bundle)
        reports.write_reports(done, out)
        reports.write_tables(done.tables | {"issues": done.report.issues}, tables)
        return done.report.exit_code
    report = quality.validate(bundle)
    if a.command == "validate" or report.status == "data_error":
        issues = reports.head(report.issues.drop("rule"), 10_000)
        reports.write_json(out / "validation.json", {"status": report.status, "issues": issues, "shortened": reports.cut({"issues": report.issues}, {"issues": issues})})
        reports.write_tables({"issues": report.issues}, tables)
        return report.exit_code
    if a.command == "recommend":
        accepted, rejected = slotting.recommend(bundle, a.top)
        whole = {"accepted": accepted, "rejected": rejected}
        doc = {"accepted": reports.head(accepted, accepted.count()), "rejected": reports.head(rejected, 500)}
        reports.write_json(out / "recommendations.json", doc | {"shortened": reports.cut(whole, doc), "thresholds": analyse.thresholds(bundle)})
        reports.write_json(out / "moves.json", reports.moves(doc["accepted"]))
        reports.write_tables(whole, tables)
    else:
        totals, orders, checks = slotting.simulate(bundle, documents.load_moves(a.moves), report.routing)
        whole = {"orders": orders, "checks": checks}
        doc = {"orders": reports.head(orders, 10_000), "checks": reports.head(checks)}
        reports.write_json(out / "simulation.json", {"totals": reports.head(totals)[0]} | doc | {"shortened": reports.cut(whole, doc)})
        reports.write_tables(whole, tables)
    return report.exit_code


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("stowline").getOrCreate()
    try:
        return _run(spark, args)
    except (documents.SourceError, MappingQuestion, slotting.MoveError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
