"""Co-pick affinity: pairs of SKUs that share orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Bundle
from .metrics import pick_assignments


def pairs(bundle: Bundle) -> DataFrame:
    """(sku_a, sku_b, co_picks, orders_a, orders_b, total_orders, support, confidence_ab, confidence_ba, lift), above the thresholds.

    Pairs are made inside each order's own set of SKUs, so the work is that of the orders' lines squared.
    """
    least, share = bundle.get("affinity_minimum_co_picks"), bundle.get("affinity_minimum_support")
    lines = bundle.picks.select("order_id", "sku").distinct()
    total = lines.select("order_id").distinct().agg(F.count("*").alias("total_orders"))
    single = lines.groupBy("sku").agg(F.count("*").alias("n"))
    sets = lines.groupBy("order_id").agg(F.array_sort(F.collect_list("sku")).alias("s"))
    rest = F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("sku_a"), b.alias("sku_b"))))
    both = sets.select(F.explode(F.flatten(rest)).alias("p")).groupBy("p.sku_a", "p.sku_b").agg(F.count("*").alias("co_picks")).where(F.col("co_picks") >= least)
    out = both.join(single.toDF("sku_a", "orders_a"), "sku_a").join(single.toDF("sku_b", "orders_b"), "sku_b").crossJoin(F.broadcast(total))  # one row
    out = out.withColumn("support", F.col("co_picks") / F.col("total_orders")).where(F.col("support") >= share)
    return out.select(
        "sku_a", "sku_b", "co_picks", "orders_a", "orders_b", "total_orders", "support", (F.col("co_picks") / F.col("orders_a")).alias("confidence_ab"),
        (F.col("co_picks") / F.col("orders_b")).alias("confidence_ba"), (F.col("co_picks") * F.col("total_orders") / (F.col("orders_a") * F.col("orders_b"))).alias("lift"),
    )


def enriched(bundle: Bundle, table: DataFrame) -> DataFrame:
    """pairs with descriptions and pick locations, in report order."""
    words = bundle.items.groupBy("sku").agg(F.first("description").alias("d"))
    place = pick_assignments(bundle).select("sku", F.col("location_id").alias("l"))
    for side in ("a", "b"):
        table = table.join(words.toDF(f"sku_{side}", f"description_{side}"), f"sku_{side}", "left").join(place.toDF(f"sku_{side}", f"location_{side}"), f"sku_{side}", "left")
        table = table.withColumn(f"description_{side}", F.coalesce(f"description_{side}", F.lit("")))
    return table.orderBy(F.desc("co_picks"), F.desc(F.round("lift", 6)), "sku_a", "sku_b")
