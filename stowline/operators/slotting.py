"""Swap candidates, replay under a new layout, and recommendations.

A replay puts every assigned SKU at its assigned location, then applies the moves. Many candidates at once are
replayed by the legs they change: a swap moves the stops of two SKUs, so an order's new length is that of its replay
under the unswapped assignment plus the differences of the legs beside those stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import checkpoint
from ..schema import Bundle
from .constraints import check_swaps
from .metrics import pick_assignments
from .network import away_from
from .routes import Distances, Routing, build, in_order, places, whole_order, with_order_facts

CHANGED = 1e-9


class MoveError(ValueError):
    """A move list that cannot be replayed."""


def _demand(bundle: Bundle) -> DataFrame:
    """(sku, location_id, lines, away): items at pick-type locations with a distance from the start."""
    start, mode = bundle.get("route_start_node"), bundle.get("default_mode")
    counts = bundle.picks.groupBy("sku").agg(F.count("*").alias("n"))
    picked = bundle.locations.where("location_type = 'pick'").dropDuplicates(["location_id"]).select("location_id", "access_node_id")
    away = away_from(bundle, start, mode)
    own = bundle.items.select("sku").distinct().join(pick_assignments(bundle).select("sku", "location_id"), "sku").join(picked, "location_id").join(away, "access_node_id")
    return own.join(counts, "sku", "left").select("sku", "location_id", F.coalesce("n", F.lit(0)).alias("lines"), "away")


def candidates(bundle: Bundle, limit: int | None = None) -> DataFrame:
    """(sku_a, sku_b, proxy): a picked more often and farther away than b; the greatest products of both gaps.

    The pairs are a theta join of the item master with itself. Before it, pairs of the outermost items give a bound
    that the wanted ones reach; items whose own best gaps stay below it cannot be in any of them and are left out.
    """
    limit = limit or bundle.get("maximum_candidate_swaps")
    own = checkpoint(_demand(bundle))
    ends = own.agg(F.min("lines").alias("f0"), F.max("lines").alias("f1"), F.min("away").alias("d0"), F.max("away").alias("d1"))
    marked = own.crossJoin(F.broadcast(ends)).select("sku", "lines", "away", ((F.col("lines") - F.col("f0")) * (F.col("away") - F.col("d0"))).alias("as_a"), ((F.col("f1") - F.col("lines")) * (F.col("d1") - F.col("away"))).alias("as_b"))  # one row

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        x, y = a.select(F.col("sku").alias("sku_a"), F.col("lines").alias("fa"), F.col("away").alias("da")), b.select(F.col("sku").alias("sku_b"), F.col("lines").alias("fb"), F.col("away").alias("db"))
        return x.join(y, (F.col("fa") > F.col("fb")) & (F.col("da") > F.col("db"))).select("sku_a", "sku_b", ((F.col("fa") - F.col("fb")) * (F.col("da") - F.col("db"))).alias("proxy"))

    some = max(64, 2 * int(limit**0.5) + 2)
    seen = meet(marked.orderBy(F.desc("as_a"), "sku").limit(some), marked.orderBy(F.desc("as_b"), "sku").limit(some)).orderBy(F.desc("proxy")).limit(limit)
    bound = seen.agg(F.count("*").alias("n"), F.min("proxy").alias("p")).first()
    least = bound.p if bound.n >= limit else 0.0
    found = meet(marked.where(F.col("as_a") >= least), marked.where(F.col("as_b") >= least))
    return found.orderBy(F.desc("proxy"), "sku_a", "sku_b").limit(limit)


def compare(base: DataFrame, other: DataFrame) -> DataFrame:
    """(order_id, before_m, after_m, delta_m) of the orders that are complete in both."""
    pick = lambda o, n: o.where("complete").select("order_id", F.col("total_distance_m").alias(n))
    return pick(base, "before_m").join(pick(other, "after_m"), "order_id").withColumn("delta_m", F.col("after_m") - F.col("before_m"))


def totals(orders: DataFrame) -> DataFrame:
    """One row: comparable and affected orders, both totals, reduction in metres and percent (null without a base)."""
    out = orders.agg(F.count("*").alias("comparable_orders"), F.count_if(F.abs("delta_m") > CHANGED).alias("affected_orders"), F.coalesce(F.sum("before_m"), F.lit(0.0)).alias("baseline_m"), F.coalesce(F.sum("after_m"), F.lit(0.0)).alias("scenario_m"))
    return _reduction(out)


def _reduction(df: DataFrame) -> DataFrame:
    gain = F.col("baseline_m") - F.col("scenario_m")
    return df.withColumn("reduction_m", gain).withColumn("reduction_percent", F.when(F.col("baseline_m") != 0, 100.0 * gain / F.col("baseline_m")))


def assigned(bundle: Bundle) -> DataFrame:
    """(sku, to_location): the override that puts every SKU at its assigned location."""
    return pick_assignments(bundle).select("sku", F.col("location_id").alias("to_location"))


#: Swaps up to which they go out by broadcast.
MOST_SWAPS = 100_000


def replay_swaps(bundle: Bundle, swaps: DataFrame) -> DataFrame:
    """swaps: distinct (sku_a, sku_b). Per swap the totals of compare() between the recorded routes and the replay.

    One pass: picks are shuffled by order once; each stop of a swapped SKU meets its swaps there and gives the change of
    the leg before it and, unless the next stop moves too, of the leg behind it.
    """
    start, end = (F.lit(bundle.get(k)).cast("string") for k in ("route_start_node", "route_end_node"))
    own = checkpoint(assigned(bundle))
    place = places(bundle).select("location_id", F.when(F.col("access_known"), F.col("access")).alias("node"))
    home = own.join(place.toDF("to_location", "home"), "to_location", "left").select("sku", "home")
    ends = swaps.join(home.toDF("sku_a", "home_a"), "sku_a").join(home.toDF("sku_b", "home_b"), "sku_b")
    ends = checkpoint(ends.withColumn("swap", F.struct("sku_a", "sku_b")))
    by_sku = ends.select("swap", "home_a", "home_b", F.explode(F.array("sku_a", "sku_b")).alias("sku")).groupBy("sku").agg(F.collect_list(F.struct("swap", "home_a", "home_b")).alias("swaps"))
    by_sku = F.broadcast(by_sku) if ends.count() <= MOST_SWAPS else by_sku
    p = bundle.picks.select("order_id", "pick_id", "pick_sequence", "ordinal", "sku", "location_id", "mode")
    p = p.join(own, "sku", "left").withColumn("to_location", F.coalesce("to_location", "location_id"))
    p = p.join(place.toDF("location_id", "then"), "location_id", "left").join(place.toDF("to_location", "now"), "to_location", "left")
    p = p.withColumns({
        "leg_no": F.row_number().over(in_order()), "then_before": F.lag("then", 1).over(in_order()), "now_before": F.lag("now", 1).over(in_order()), "now_next": F.lead("now", 1).over(in_order()),
        "sku_before": F.lag("sku", 1).over(in_order()), "sku_next": F.lead("sku", 1).over(in_order()), "is_last": F.lead(F.lit(1), 1).over(in_order()).isNull(),
    })
    first = F.col("leg_no") == 1
    p = p.withColumns({"then_before": F.when(first, start).otherwise(F.col("then_before")), "now_before": F.when(first, start).otherwise(F.col("now_before")), "now_next": F.when(F.col("is_last"), end).otherwise(F.col("now_next"))})
    p = with_order_facts(p, bundle).where("excluded is null")
    d = Distances(bundle)
    if not d.small:
        p = checkpoint(p)
        moved = ends.select(F.explode(F.array("home_a", "home_b")).alias("x")).distinct()
        near = p.select("mode", F.explode(F.array("then_before", "then", "now_before", "now", "now_next", end)).alias("x")).union(p.select("mode").distinct().crossJoin(moved))  # modes are few
        near = near.where("x is not null").distinct()
        some = p.select(F.col("then_before").alias("src"), "mode", F.col("then").alias("dst")).union(p.select("now_before", "mode", "now")).union(p.select("now", "mode", "now_next")).union(p.where("is_last").select("then", "mode", end))
        aside = near.join(moved.toDF("y"), F.col("x").isNotNull() & F.col("y").isNotNull())  # nodes of the layout with those of the moved
        d.solve(some.union(aside.select("x", "mode", "y")).union(aside.select("y", "mode", "x")).where("src is not null and dst is not null").distinct())
    known = lambda c: F.col(c).isNotNull()  # noqa: E731  nodes outside the layout are null here
    p = d.add(p, "then_in", F.col("then_before"), F.col("then"), known("then"))
    p = d.add(p, "then_back", F.col("then"), F.when(F.col("is_last"), end), known("then"))
    p = d.add(p, "now_in", F.col("now_before"), F.col("now"), known("now"))
    p = d.add(p, "now_out", F.col("now"), F.col("now_next"), known("now"))
    gone, length = (lambda c: F.col(c).isNull().cast("long")), (lambda c: F.coalesce(c, F.lit(0.0)))
    last = lambda c: F.when(F.col("is_last"), c).otherwise(0)
    whole = {
        "b": length("then_in") + last(length("then_back")), "b_lost": gone("then_in") + last(gone("then_back")),
        "u": length("now_in") + last(length("now_out")), "u_lost": gone("now_in") + last(gone("now_out")),
    }
    p = p.withColumns({k: F.sum(c).over(whole_order()) for k, c in whole.items()})
    all_orders = F.when(first, F.array(F.expr("named_struct('swap', cast(null as struct<sku_a:string,sku_b:string>), 'home_a', cast(null as string), 'home_b', cast(null as string))"))).otherwise(F.expr("array()"))
    p = p.join(by_sku, "sku", "left").withColumn("x", F.explode(F.concat(all_orders, F.coalesce("swaps", F.expr("array()"))))).select("*", "x.*").drop("x", "swaps")
    one, two = F.col("swap.sku_a"), F.col("swap.sku_b")
    new = lambda sku, old: F.when(F.col(sku) == one, F.col("home_b")).when(F.col(sku) == two, F.col("home_a")).otherwise(F.col(old))
    p = p.withColumns({"to": new("sku", "now"), "to_before": new("sku_before", "now_before"), "next_moves": F.coalesce(F.col("sku_next").isin(one, two), F.lit(False))})
    p = d.add(p, "new_in", F.col("to_before"), F.col("to"), known("to"))
    p = d.add(p, "new_out", F.col("to"), F.col("now_next"), known("to"))
    behind = lambda c: F.when(F.col("next_moves"), 0).otherwise(c)
    longer = length("new_in") - length("now_in") + behind(length("new_out") - length("now_out"))
    more_lost = gone("new_in") - gone("now_in") + behind(gone("new_out") - gone("now_out"))
    keep = [F.first(c).alias(c) for c in whole]
    per = p.groupBy("order_id", "swap").agg(*keep, F.sum(F.when(known("swap"), longer).otherwise(0.0)).alias("longer"), F.sum(F.when(known("swap"), more_lost).otherwise(0)).alias("more_lost"))
    based = F.col("b_lost") == 0
    old, fresh = based & (F.col("u_lost") == 0), based & (F.col("u_lost") + F.col("more_lost") == 0)
    s = F.col("u") + F.col("longer")
    z = lambda ok, c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0.0))
    sums = per.groupBy("swap").agg(
        F.count_if(old).alias("n_old"), F.count_if(fresh).alias("n_new"), F.count_if(old & (F.abs(F.col("u") - F.col("b")) > CHANGED)).alias("moved_old"), F.count_if(fresh & (F.abs(s - F.col("b")) > CHANGED)).alias("moved_new"),
        z(old, F.col("b")).alias("b_old"), z(fresh, F.col("b")).alias("b_new"), z(old, F.col("u")).alias("u_old"), z(fresh, s).alias("s_new"),
    )
    sums = checkpoint(sums)  # a row per swap and one for all orders
    names = ["n_old", "moved_old", "b_old", "u_old"]
    every = sums.where("swap is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in names])
    out = ends.select("sku_a", "sku_b", "swap").join(sums, "swap", "left").crossJoin(F.broadcast(every))  # one row
    rest = lambda kind, new_name: F.col(f"all_{kind}_old") - F.coalesce(f"{kind}_old", F.lit(0)) + F.coalesce(new_name, F.lit(0))
    out = out.select(
        "sku_a", "sku_b", rest("n", "n_new").alias("comparable_orders"), rest("moved", "moved_new").alias("affected_orders"),
        rest("b", "b_new").cast("double").alias("baseline_m"), rest("u", "s_new").cast("double").alias("scenario_m"),
    )
    return _reduction(out)


def recommend(bundle: Bundle, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): ranked swaps with ids SWAP-001 ..., and every other candidate with the reason it fell."""
    spark = bundle.spark
    checked = checkpoint(check_swaps(bundle, candidates(bundle)))
    ok = checked.where("status = 'ok'")
    replayed = replay_swaps(bundle, ok.select("sku_a", "sku_b"))
    scored = checkpoint(ok.join(replayed, ["sku_a", "sku_b"]))
    least = bundle.get("minimum_improvement_percent") or 0.0
    top = bundle.get("maximum_recommendations") if top is None else top
    gain = scored.where(F.coalesce(F.col("reduction_percent") >= least, F.lit(False)))
    # walk the ranked list (at most the candidate limit) and keep a swap if neither SKU was used
    ranked = gain.select("sku_a", "sku_b", F.round("reduction_m", 3).alias("r")).orderBy(F.desc("r"), "sku_a", "sku_b").collect()
    used: set[str] = set()
    verdicts = []
    for row in ranked:
        if row.sku_a in used or row.sku_b in used:
            verdicts.append((row.sku_a, row.sku_b, "superseded_by_higher_ranked_swap", None))
            continue
        used |= {row.sku_a, row.sku_b}
        rank = sum(v[3] is not None for v in verdicts) + 1
        verdicts.append((row.sku_a, row.sku_b, "accepted", rank) if rank <= top else (row.sku_a, row.sku_b, "beyond_maximum_recommendations", None))
    said = spark.createDataFrame(verdicts, "sku_a string, sku_b string, verdict string, rank int")
    judged = scored.join(said, ["sku_a", "sku_b"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("no_material_improvement")))
    accepted = judged.where("verdict = 'accepted'").withColumn("swap_id", F.format_string("SWAP-%03d", "rank")).orderBy("rank")
    blocked = checked.where("status <> 'ok'").select("sku_a", "sku_b", F.col("status").alias("verdict"), F.when(F.size("failed") > 0, F.col("failed")).otherwise(F.col("insufficient")).alias("reasons"))
    others = judged.where("verdict <> 'accepted'").select("sku_a", "sku_b", "verdict", F.expr("cast(array() as array<string>)").alias("reasons"))
    return accepted, blocked.unionByName(others).orderBy("verdict", "sku_a", "sku_b")


def parse_moves(document: object) -> list[tuple[str, str]]:
    """Pairs of SKUs from a move list, or from an object that holds one under 'moves'."""
    moves = document.get("moves") if isinstance(document, dict) else document
    if not isinstance(moves, list) or not moves:
        raise MoveError("a non-empty list of moves is needed")
    out = []
    for m in moves:
        if not isinstance(m, dict) or m.get("type", "pair_swap") != "pair_swap":
            raise MoveError("only moves of type pair_swap are known")
        a, b = (str(m.get(k) or "").strip() for k in ("sku_a", "sku_b"))
        if not a or not b or a == b:
            raise MoveError("a pair_swap names two different SKUs")
        out.append((a, b))
    return out


def simulate(bundle: Bundle, moves: list[tuple[str, str]], base: Routing | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, orders, checks) of all moves together; the comparison is given even where a check fails."""
    spark = bundle.spark
    flat = [s for m in moves for s in m]
    own = assigned(bundle)
    known = {r.sku: r.to_location for r in own.where(F.col("sku").isin(flat)).collect()}
    if len(set(flat)) < len(flat):
        raise MoveError("a SKU may move once")
    if missing := sorted(set(flat) - set(known)):
        raise MoveError(f"no pick assignment: {', '.join(missing)}")
    goes = [(a, known[b]) for a, b in moves] + [(b, known[a]) for a, b in moves]
    to = spark.createDataFrame(goes, "sku string, new string")
    override = own.join(F.broadcast(to), "sku", "left").select("sku", F.coalesce("new", "to_location").alias("to_location"))
    base = base or build(bundle)
    orders = compare(base.orders, build(bundle, override).orders)
    return totals(orders), orders, check_swaps(bundle, spark.createDataFrame(moves, "sku_a string, sku_b string"))


def lines_of(checks: DataFrame) -> DataFrame:
    """Flat export rows: list columns joined by a bar."""
    return checks.withColumns({c: F.array_join(c, "|") for c, t in checks.dtypes if t == "array<string>"})


