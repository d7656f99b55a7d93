"""ABC by cumulative share and XYZ by variation over time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..schema import ABC_BASES, Bundle

EDGE = 1e-12  # a share this close to a threshold has reached it


def abc(bundle: Bundle, basis: str | None = None) -> DataFrame:
    """(sku, value, rank, cumulative_value, cumulative_share, abc_class) of every item, zero-filled.

    The item that crosses a threshold belongs to the class it completes. The running sum goes over the item master
    (one row per SKU, of a catalogue's size), never over picks.
    """
    basis = basis or bundle.get("abc_basis")
    if basis not in ABC_BASES:
        raise ValueError(f"abc_basis is one of {ABC_BASES}")
    value = {"pick_lines": F.count("*"), "units": F.sum("quantity"), "orders": F.countDistinct("order_id")}[basis]
    counts = bundle.picks.groupBy("sku").agg(value.cast("double").alias("value"))
    own = bundle.items.select("sku").distinct().join(counts, "sku", "left").select("sku", F.coalesce("value", F.lit(0.0)).alias("value"))
    order = W.orderBy(F.desc("value"), "sku")
    ranked = own.select("sku", "value", F.row_number().over(order).alias("rank"), F.sum("value").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("cumulative_value"), F.sum("value").over(W.partitionBy()).alias("total"))
    before = (F.col("cumulative_value") - F.col("value")) / F.col("total")
    t = bundle.get("abc_thresholds")
    cls = F.when(F.col("value") <= 0, "C").when(before < t["A"] - EDGE, "A").when(before < t["B"] - EDGE, "B").otherwise("C")
    return ranked.select("sku", "value", "rank", "cumulative_value", F.coalesce(F.try_divide("cumulative_value", "total"), F.lit(0.0)).alias("cumulative_share"), cls.alias("abc_class"))


def bucket_key(day: Column, bucket: str) -> Column:
    """ISO date or ISO week of a date."""
    if bucket == "week":
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))
    return F.date_format(day, "yyyy-MM-dd")


def local_day(stamp: Column) -> Column:
    """The calendar day in the stamp's own offset; null for junk."""
    return F.try_to_date(F.substring(stamp, 1, 10), "yyyy-MM-dd")


def expected_buckets(bundle: Bundle, bucket: str) -> DataFrame:
    """(bucket): all buckets from the declared start to the declared end, or from the first to the last pick."""
    start, end = (local_day(F.lit(x)) for x in (bundle.meta.period_start, bundle.meta.period_end))
    day = local_day(F.col("timestamp"))
    ends = bundle.picks.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    both = start.isNotNull() & end.isNotNull()
    ends = ends.select(F.when(both, start).otherwise(F.col("lo")).alias("lo"), F.when(both, end).otherwise(F.col("hi")).alias("hi")).where("lo <= hi")
    return ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("d")).select(bucket_key(F.col("d"), bucket).alias("bucket")).distinct()


def xyz(bundle: Bundle, bucket: str | None = None) -> tuple[DataFrame, dict]:
    """((sku, lines, mean, cv, xyz_class), facts): facts says whether the classes were computed, and over how many buckets.

    With B buckets and counts c the variation is sqrt(B * sum(c^2) - sum(c)^2) / sum(c), so empty buckets need no rows.
    """
    bucket = bucket or bundle.get("xyz_time_bucket")
    buckets = expected_buckets(bundle, bucket)
    n = buckets.count()
    dated = bundle.picks.select("sku", bucket_key(local_day(F.col("timestamp")), bucket).alias("bucket"))
    facts = {"bucket": bucket, "buckets": n, "minimum": bundle.get("xyz_minimum_buckets")}
    stamped = dated.where("bucket is not null").limit(1).count()
    facts["computed"] = bool(n >= facts["minimum"] and stamped)
    counts = dated.join(F.broadcast(buckets) if n <= 100_000 else buckets, "bucket", "left_semi").groupBy("sku", "bucket").agg(F.count("*").alias("c"))
    sums = counts.groupBy("sku").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    own = bundle.items.select("sku").distinct().join(sums, "sku", "left").select("sku", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("q", F.lit(0)).alias("q"))
    cv = F.when(F.col("s") > 0, F.sqrt((n * F.col("q") - F.col("s") * F.col("s")).cast("double")) / F.col("s"))
    t = bundle.get("xyz_thresholds")
    cls = F.when(cv <= t["X"], "X").when(cv <= t["Y"], "Y").when(cv.isNotNull(), "Z")
    out = own.select("sku", F.col("s").alias("pick_lines"), (F.col("s") / F.lit(max(n, 1))).alias("mean_per_bucket"), cv.alias("cv"), cls.alias("xyz_class"))
    return (out if facts["computed"] else out.limit(0)), facts


def combined(abc_table: DataFrame, xyz_table: DataFrame) -> DataFrame:
    """(sku, combined_class): 'AX', or the ABC class alone where no XYZ class exists."""
    return abc_table.join(xyz_table.select("sku", "xyz_class"), "sku", "left").select("sku", F.concat("abc_class", F.coalesce("xyz_class", F.lit(""))).alias("combined_class"))
