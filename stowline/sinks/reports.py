"""Files of an analysis: JSON, CSV, Markdown, HTML, SVG and the move list. Rounding happens here."""

from __future__ import annotations

import csv
import json
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators import slotting
from ..plans.analyse import Analysis, thresholds
from . import svg

#: Rows of ranked tables that a report shows; whole tables are written by write_tables().
SHOWN = 50


def write_json(path: str | Path, value: object) -> None:
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def write_csv(path: str | Path, rows: list[dict], columns: list[str]) -> None:
    """A header and the named columns; others are left out."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, columns, extrasaction="ignore")
        out.writeheader()
        out.writerows(rows)


def write_text(path: str | Path, text: str) -> None:
    Path(path).write_text(text, encoding="utf-8")


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table in full, as Parquet written by the executors."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def _round(value: object) -> object:
    if isinstance(value, float):
        return round(value, 4)
    return [_round(v) for v in value] if isinstance(value, list) else value


def head(df: DataFrame, n: int = SHOWN) -> list[dict]:
    return [{k: _round(v) for k, v in r.asDict(recursive=True).items()} for r in df.limit(n).collect()]


def cut(frames: dict[str, DataFrame], shown: dict[str, list]) -> dict[str, int]:
    """The total count of each list that shows less than its table."""
    totals = {k: df.count() for k, df in frames.items()}
    return {k: n for k, n in totals.items() if n > len(shown[k])}


def document(a: Analysis) -> dict:
    tables, issues = {k: head(df) for k, df in a.tables.items()}, head(a.report.issues.drop("rule"), 500)
    return {
        "status": a.status, "dataset_id": a.bundle.meta.dataset_id, "meta": vars(a.bundle.meta), "thresholds": thresholds(a.bundle),
        "totals": {k: _round(v) for k, v in a.totals.items()}, "xyz": a.xyz_facts, "issues": issues,
        "tables": tables, "shortened": cut(a.tables | {"issues": a.report.issues}, tables | {"issues": issues}), "grades": {k: vars(g) for k, g in a.grades.items()},
        "findings": [{"id": f"F-{k:03d}", "claim": f.claim, "title": f.title, "text": f.text, "quality": f.grade.quality if f.grade else None, "caps": list(f.grade.caps) if f.grade else []} for k, f in enumerate(a.findings, 1)],
    }


def moves(accepted: list) -> dict:
    """The accepted swaps, all of them, as a move list that simulate() reads."""
    return {"moves": [{"type": "pair_swap", "sku_a": r["sku_a"], "sku_b": r["sku_b"]} for r in accepted]}


def _rows(table: list[dict]) -> list[list[str]]:
    return [list(table[0])] + [["" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v) for v in r.values()] for r in table] if table else []


def markdown(doc: dict) -> str:
    out = [f"# Pick-flow analysis of {doc['dataset_id']}", "", f"Status: **{doc['status']}**. Distances are modelled on the declared aisle graph, never measured.", "", "## Findings", ""]
    out += [f"- **{f['id']}** ({f['claim']}, evidence {f['quality'] or 'not graded'}) {f['title']}: {f['text']}" + "".join(f" Capped: {c}." for c in f["caps"]) for f in doc["findings"]]
    out += ["", "## Totals", ""] + [f"- {k}: {v}" for k, v in doc["totals"].items()]
    for name, table in doc["tables"].items():
        total = doc["shortened"].get(name, len(table))
        out += ["", f"## {name}" + (f" (first 20 of {total})" if total > 20 else ""), ""]
        rows = _rows(table[:20])
        if not rows:
            out.append("none")
            continue
        cell = lambda v: v.replace("|", "\\|").replace("\n", " ")
        out += ["| " + " | ".join(map(cell, r)) + " |" for r in (rows[0], ["---"] * len(rows[0]), *rows[1:])]
    out += ["", "## Issues" + (f" (first {len(doc['issues'])} of {doc['shortened']['issues']})" if "issues" in doc["shortened"] else ""), ""] + ([f"- {i['severity']} {i['code']} ({i['field']}): {', '.join(i['affected'])}" for i in doc["issues"]] or ["none"])
    out += ["", "## Parameters", ""] + [f"- {k}: {v}" for k, v in doc["thresholds"].items()]
    return "\n".join(out) + "\n"


def html(doc: dict, drawings: list[str]) -> str:
    """One self-contained page."""
    parts = [f"<h1>Pick-flow analysis of {escape(doc['dataset_id'])}</h1><p>Status: <b>{escape(doc['status'])}</b>. Distances are modelled, never measured.</p><h2>Findings</h2><ul>"]
    parts += [f"<li><b>{escape(f['id'])}</b> {escape(f['title'])}: {escape(f['text'])} <i>({escape(f['claim'])}, {escape(f['quality'] or 'not graded')})</i></li>" for f in doc["findings"]]
    parts.append("</ul>" + "".join(drawings))
    for name, table in doc["tables"].items():
        rows = _rows(table)
        if rows:
            more = f" ({len(table)} of {doc['shortened'][name]})" if name in doc["shortened"] else ""
            parts.append(f"<h2>{escape(name + more)}</h2><table>" + "".join("<tr>" + "".join(f"<td>{escape(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>")
    return "<!doctype html><meta charset='utf-8'><title>Pick-flow analysis</title><style>body{font-family:sans-serif;margin:2em}td{border:1px solid #ccc;padding:2px 6px}</style>" + "\n".join(parts) + "\n"


def write_reports(a: Analysis, folder: str | Path) -> dict:
    """All files of an analysis; returns the JSON document."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    doc = document(a)
    flow = svg.flow_map(a.bundle, a.tables["edges"])
    one = svg.spaghetti(a.bundle, a.routing.legs, svg.chosen(a.routing.orders, top=1))
    many = svg.spaghetti(a.bundle, a.routing.legs, svg.chosen(a.routing.orders, top=a.bundle.get("spaghetti_top_orders")))
    write_json(folder / "analysis.json", doc)
    accepted = a.tables["accepted"].count() if "accepted" in a.tables else 0
    rows = head(slotting.lines_of(a.tables["accepted"]), accepted) if "accepted" in a.tables else []
    write_csv(folder / "recommendations.csv", rows, list(rows[0]) if rows else ["swap_id", "sku_a", "sku_b"])
    write_json(folder / "moves.json", moves(head(a.tables["accepted"], accepted) if "accepted" in a.tables else []))
    write_text(folder / "report.md", markdown(doc))
    write_text(folder / "report.html", html(doc, [flow, many]))
    for name, text in (("flow-map", flow), ("spaghetti", one), ("spaghetti-aggregate", many)):
        write_text(folder / f"{name}.svg", text)
    return doc
