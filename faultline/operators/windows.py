"""Sliding windows, buckets and gap filling over irregular event times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_windows(events: DataFrame, entity: str, ts: str, width: int, step: int, sums: dict[str, str] | None = None) -> DataFrame:
    """Windows ``[t0 + k * step, t0 + k * step + width)`` of each entity, anchored at its first event t0.

    One row per distinct (lo, hi): entity, lo, hi (ranks of the first event
    inside and the first one after), k (the first window of that pair), n (events
    inside), start_t and last_t (the first and last event inside), next_t (the
    first after, null if none), and one column per entry of ``sums`` (name ->
    column summed over the window). Window starts and ends merge with the events
    in one shuffle, sorted either way: no event is repeated per window. Windows without events are left out;
    k runs to the first window that reaches the last event.
    """
    sums = sums or {}
    e = events.select(F.col(entity).alias("entity"), F.col(ts).alias("t"), *[F.col(c).cast("double").alias(f"_{n}") for n, c in sums.items()])
    span = e.groupBy("entity").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    last = F.greatest(F.lit(0), F.ceil((F.col("t1") - F.col("t0") - width + 1) / step))
    marks = span.select("entity", "t0", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("k"))
    zero = [F.lit(0.0).alias(f"_{n}") for n in sums]
    rows = (
        e.select("entity", "t", F.lit(None).cast("long").alias("k"), F.lit(1).alias("is_event"), F.lit(None).cast("int").alias("edge"), *[F.col(f"_{n}") for n in sums])
        .unionByName(marks.select("entity", (F.col("t0") + F.col("k") * step).alias("t"), "k", F.lit(0).alias("is_event"), F.lit(0).alias("edge"), *zero))
        .unionByName(marks.select("entity", (F.col("t0") + F.col("k") * step + width).alias("t"), "k", F.lit(0).alias("is_event"), F.lit(1).alias("edge"), *zero))
    )
    before = Window.partitionBy("entity").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    since = Window.partitionBy("entity").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("is_event") == 1, F.col("t"))
    counted = rows.select(
        "entity", "k", "edge", F.coalesce(F.sum("is_event").over(before), F.lit(0)).alias("rank"), F.max(at).over(before).alias("last"), F.min(at).over(since).alias("next"),
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0.0)).alias(n) for n in sums],
    ).where("k is not null")
    pick = lambda c, edge: F.max(F.when(F.col("edge") == edge, F.col(c)))
    times = [pick("next", 0).alias("start_t"), pick("last", 1).alias("last_t"), pick("next", 1).alias("next_t")]
    per_k = counted.groupBy("entity", "k").agg(pick("rank", 0).alias("lo"), pick("rank", 1).alias("hi"), *times, *[(pick(n, 1) - pick(n, 0)).alias(n) for n in sums])
    out = per_k.where("lo < hi").groupBy("entity", "lo", "hi").agg(F.min("k").alias("k"), *[F.first(n).alias(n) for n in ("start_t", "last_t", "next_t", *sums)])
    return out.withColumn("n", F.col("hi") - F.col("lo"))


def window_times(windows: DataFrame, end: str = "inside") -> DataFrame:
    """Adds end_t: the last event ``inside``, or the first one ``after`` (the last of all if none)."""
    return windows.withColumn("end_t", F.col("last_t") if end == "inside" else F.coalesce("next_t", "last_t"))


def bucket_values(windows: DataFrame, value: str, step: int) -> DataFrame:
    """One value per (entity, bucket) of windows with start_t; of several, that of the greatest hi, then the greatest lo."""
    w = windows.withColumn("t0", F.min("start_t").over(Window.partitionBy("entity"))).withColumn("bucket", F.floor((F.col("start_t") - F.col("t0")) / step))
    return w.groupBy("entity", "bucket").agg(F.max_by(value, F.struct("hi", "lo")).alias("value"))


def dense_grid(values: DataFrame, length: int | None = None) -> DataFrame:
    """All buckets from 0 to each entity's last (or to ``length`` - 1), null where empty."""
    top = F.max("bucket").alias("top") if length is None else F.lit(length - 1).cast("long").alias("top")
    grid = values.groupBy("entity").agg(top).select("entity", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("bucket"))
    return grid.join(values, ["entity", "bucket"], "left")


def nearest_fill(grid: DataFrame) -> DataFrame:
    """Empty buckets take the nearest populated one's value, the earlier of two as near."""
    back = Window.partitionBy("entity").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("entity").orderBy("bucket").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.struct("bucket", "value"))
    g = grid.withColumn("_p", F.last(at, True).over(back)).withColumn("_n", F.first(at, True).over(ahead))
    earlier = F.col("_n").isNull() | (F.col("bucket") - F.col("_p.bucket") <= F.col("_n.bucket") - F.col("bucket"))
    return g.withColumn("value", F.when(earlier & F.col("_p").isNotNull(), F.col("_p.value")).otherwise(F.col("_n.value"))).drop("_p", "_n")


def hold_fill(grid: DataFrame, hold: int = 10) -> DataFrame:
    """Empty buckets hold the last value for ``hold`` buckets less one, then take the mean of the values before the last one (the last itself if none); 0 before the first."""
    back = Window.partitionBy("entity").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    strict = Window.partitionBy("entity").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("value").isNotNull(), F.struct("bucket", "value", F.avg("value").over(strict).alias("mean")))
    g = grid.withColumn("_s", seen).withColumn("_l", F.last("_s", True).over(back))
    far = F.col("bucket") - F.col("_l.bucket") >= hold
    return g.withColumn("value", F.when(F.col("_l").isNull(), 0.0).when(far, F.coalesce(F.col("_l.mean"), F.col("_l.value"))).otherwise(F.col("_l.value"))).drop("_s", "_l")


def session_windows(events: DataFrame, entity: str, ts: str, gap: int) -> DataFrame:
    """Runs of events no more than ``gap`` apart: entity, session, start_t, end_t, n."""
    order = Window.partitionBy("entity").orderBy("t")
    e = events.select(F.col(entity).alias("entity"), F.col(ts).alias("t"))
    e = e.withColumn("_new", (F.col("t") - F.lag("t").over(order) > gap).cast("int"))
    e = e.withColumn("session", F.coalesce(F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return e.groupBy("entity", "session").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n"))


def template_frequencies(windows: DataFrame, events: DataFrame, entity: str, ts: str, template: str) -> DataFrame:
    """``windows`` with ``frequencies``, a map of the templates inside each to how often they occur.

    Every template's events are counted up to a window's first and last event by
    running sums in a union of both, so no event is repeated per window; a window
    has a row for each template of its entity, not for each event.
    """
    ranked = events.select(F.col(entity).alias("entity"), F.col(ts).alias("t"), F.col(template).alias("template"))
    ranked = ranked.withColumn("i", F.row_number().over(Window.partitionBy("entity").orderBy("t", "template")) - 1)
    kinds = ranked.select("entity", "template").distinct()
    edges = windows.select("entity", "lo", "hi", F.explode(F.array("lo", "hi")).alias("i")).join(kinds, "entity")
    none = F.lit(None).cast("int")
    rows = ranked.select("entity", "template", "i", F.lit(1).alias("one"), none.alias("lo"), none.alias("hi")).unionByName(edges.select("entity", "template", "i", F.lit(0).alias("one"), F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi")))
    before = Window.partitionBy("entity", "template").orderBy("i").rangeBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("c", F.coalesce(F.sum("one").over(before), F.lit(0))).where("one = 0")
    per = counted.groupBy("entity", "lo", "hi", "template").agg((F.max("c") - F.min("c")).alias("n")).where("n > 0")
    return per.groupBy("entity", "lo", "hi").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("template", "n")))).alias("frequencies"))


def entity_spans(events: DataFrame, entity: str, ts: str) -> DataFrame:
    """Per entity its first and last event, and over the entities up to it, by name, the latest start and the earliest end: what all of them cover."""
    span = events.groupBy(F.col(entity).alias("entity")).agg(F.min(ts).alias("start_t"), F.max(ts).alias("end_t"))
    upto = Window.orderBy("entity").rowsBetween(Window.unboundedPreceding, 0)  # a row per entity
    return span.withColumn("last_start", F.max("start_t").over(upto)).withColumn("least_end", F.min("end_t").over(upto))
