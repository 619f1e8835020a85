"""Alignment of series in time and of entities across metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collapse(obs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean of the samples that share the keys."""
    return obs.groupBy(*keys).agg(F.avg(value).alias(value))


def sample_gate(obs: DataFrame, entity: str, least: int, distinct: str | None = None) -> DataFrame:
    """Rows of the entities that have at least ``least`` rows, or distinct values of a column."""
    n = F.count_distinct(distinct) if distinct else F.count("*")
    return obs.join(obs.groupBy(entity).agg(n.alias("_n")).where(F.col("_n") >= least).select(entity), entity, "left_semi")


def common_timestamps(obs: DataFrame, kpi: DataFrame, case: str, entity: str = "entity", ts: str = "ts") -> DataFrame:
    """Rows of ``obs`` at times that every entity of the case and its KPI have.

    Counting entities per time replaces an intersection of as many sets as there are entities.
    """
    everyone = obs.groupBy(case).agg(F.count_distinct(entity).alias("_all"))
    per_time = obs.select(case, ts, entity).distinct().groupBy(case, ts).agg(F.count("*").alias("_n"))
    full = per_time.join(everyone, case).where("_n = _all").select(case, ts)
    full = full.join(kpi.select(case, ts).distinct(), [case, ts], "left_semi")
    return obs.join(full, [case, ts], "left_semi")


def common_entities(obs: DataFrame, entity: str = "entity", metric: str = "metric") -> DataFrame:
    """Rows of the entities that every metric has."""
    pairs = obs.select(entity, metric).distinct()
    total = pairs.agg(F.count_distinct(metric).alias("_all"))
    full = pairs.groupBy(entity).agg(F.count("*").alias("_n")).join(F.broadcast(total)).where("_n = _all").select(entity)
    return obs.join(full, entity, "left_semi")


def pivot_metrics(obs: DataFrame, keys: list[str], metric: str, value: str, metrics: list[str]) -> DataFrame:
    """One column per metric, for keys that all of them have."""
    wide = obs.groupBy(*keys).pivot(metric, metrics).agg(F.avg(value))
    return wide.where(reduce(lambda a, b: a & b, [F.col(f"`{m}`").isNotNull() for m in metrics]))


def unpivot_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return wide.unpivot(keys, metrics, "metric", "value")


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, width: int | None = None) -> DataFrame:
    """``left`` with the value of the latest row of ``right`` at or before its time, null if none; a sort of the union, no range join.

    With ``width``, times are cut into ranges of it, so a hot key, or no key at
    all, is sorted in as many tasks as it has ranges; a range starts with the last
    value of the ranges before it, which one small row per range tells.
    """
    if width is not None:
        at = "_range"
        l, r = (df.withColumn(at, F.floor(F.col(ts) / width)) for df in (left, right))
        inside = asof_backward(l, r, [*keys, at], ts, value)
        ends = r.where(F.col(value).isNotNull()).groupBy(*keys, at).agg(F.max_by(value, ts).alias("_last"))
        marks = ends.unionByName(l.select(*keys, at).distinct(), allowMissingColumns=True).groupBy(*keys, at).agg(F.max("_last").alias("_last"))
        before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        marks = marks.select(*keys, at, F.last("_last", True).over(before).alias("_before"))
        return inside.join(marks, [*keys, at]).withColumn(value, F.coalesce(value, "_before")).drop(at, "_before")
    r = right.groupBy(*keys, ts).agg(F.max(value).alias(value))
    both = left.withColumn("_right", F.lit(0)).withColumn(value, F.lit(None).cast(r.schema[value].dataType)).unionByName(r.withColumn("_right", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(ts), F.col("_right").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, True).over(w)).where("_right = 0").drop("_right")


def nearest_time(obs: DataFrame, at, ts: str = "ts") -> DataFrame:
    """The time nearest to ``at``, the earlier of two as near."""
    return obs.agg(F.min_by(ts, F.struct(F.abs(F.col(ts) - at), F.col(ts))).alias(ts))


def fault_segments(obs: DataFrame, segments: DataFrame, ts: str = "ts") -> DataFrame:
    """``obs`` once for each segment whose ``lo``..``hi``, ends included, holds it, with segment_id and part.

    Segments are a list of known faults, so they are broadcast.
    """
    return obs.join(F.broadcast(segments), F.col(ts).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def batch_slice(obs: DataFrame, start: int, width: int, ts: str = "ts") -> DataFrame:
    """Rows with start <= ts <= start + width but for those of the last time: one row of an aligned matrix, whose times are distinct."""
    inside = obs.where(F.col(ts).between(start, start + width))
    last = inside.agg(F.max(ts).alias("_last"))
    return inside.join(F.broadcast(last), F.col(ts) < F.col("_last")).drop("_last")
