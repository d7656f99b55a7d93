"""Drawings of the layout and of routes. Only node positions and finished figures come to the driver."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Bundle

WIDTH, MARGIN = 900, 60


def _places(bundle: Bundle) -> tuple[dict[str, tuple[float, float]], float]:
    """Pixels per node (y upwards) and the height."""
    rows = bundle.nodes.select("node_id", "x_m", "y_m").orderBy("node_id").collect()
    xs, ys = [r.x_m for r in rows] or [0.0], [r.y_m for r in rows] or [0.0]
    scale = (WIDTH - 2 * MARGIN) / max(max(xs) - min(xs), max(ys) - min(ys), 1e-9)
    height = 2 * MARGIN + (max(ys) - min(ys)) * scale
    return {r.node_id: (MARGIN + (r.x_m - min(xs)) * scale, height - MARGIN - (r.y_m - min(ys)) * scale) for r in rows}, height


def _page(height: float, body: list[str], title: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{height:.0f}" role="img"><title>{escape(title)}</title><defs><marker id="tip" markerWidth="6" markerHeight="6" refX="5" refY="3" orient="auto"><path d="M0,0 L6,3 L0,6 z"/></marker></defs>\n' + "\n".join(body) + "\n</svg>\n"


def _nodes(bundle: Bundle, at: dict) -> list[str]:
    out = []
    start, end = bundle.get("route_start_node"), bundle.get("route_end_node")
    for n, (x, y) in at.items():
        role = "start" if n == start else "end" if n == end else ""
        size = 7 if role else 4
        out.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{size}" class="node {role}"/><text x="{x + 8:.1f}" y="{y - 6:.1f}" font-size="11">{escape(n)}{" (" + role + ")" if role else ""}</text>')
    return out


def flow_map(bundle: Bundle, flows: DataFrame) -> str:
    """Aisle segments by traversals; arrows where an edge goes one way only."""
    at, height = _places(bundle)
    rows = bundle.edges.select("edge_id", "from_node", "to_node", "bidirectional").join(flows.select("edge_id", "traversals"), "edge_id").orderBy("edge_id").collect()
    most = max((r.traversals for r in rows), default=0) or 1
    body = []
    for r in rows:
        if r.from_node in at and r.to_node in at:
            (x1, y1), (x2, y2), ratio = at[r.from_node], at[r.to_node], r.traversals / most
            tip = "" if r.bidirectional else ' marker-end="url(#tip)"'
            body.append(f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" stroke="#1f5fa8" stroke-width="{1.5 + 8.5 * ratio:.2f}" stroke-opacity="{0.25 + 0.65 * ratio:.2f}"{tip}><title>{escape(r.edge_id)}: {r.traversals}</title></line>')
    return _page(height, body + _nodes(bundle, at), "Modelled flow by aisle segment")


def chosen(orders: DataFrame, order_id: str | None = None, top: int = 10) -> list[str]:
    """One order, or the longest ones (at least one)."""
    done = orders.where("complete")
    if order_id is not None:
        done = done.where(F.col("order_id") == order_id)
    return [r.order_id for r in done.orderBy(F.desc("total_distance_m"), "order_id").limit(max(1, top)).select("order_id").collect()]


def spaghetti(bundle: Bundle, legs: DataFrame, orders: list[str]) -> str:
    """The legs of a few orders, each order a little aside of the others."""
    at, height = _places(bundle)
    body = []
    rows = legs.where(F.col("order_id").isin(orders)).select("order_id", "leg_no", "from_node", "to_node").orderBy("order_id", "leg_no").collect()
    for r in rows:
        if r.from_node in at and r.to_node in at and r.from_node != r.to_node:
            aside = (orders.index(r.order_id) - (len(orders) - 1) / 2) * 2.6
            (x1, y1), (x2, y2) = at[r.from_node], at[r.to_node]
            body.append(f'<line x1="{x1 + aside:.1f}" y1="{y1 + aside:.1f}" x2="{x2 + aside:.1f}" y2="{y2 + aside:.1f}" stroke="hsl({orders.index(r.order_id) * 47 % 360},70%,45%)" stroke-opacity="0.7"><title>{escape(r.order_id)} leg {r.leg_no}</title></line>')
    return _page(height, body + _nodes(bundle, at), "Modelled routes")
