"""Preparation of aligned series for detection: pooling, gates, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Beginnings of names, and one part of a name, of columns that don't count.
EXTRA = r"^(main_|PassthroughCluster_|redis_|rabbitmq|queue|session|istio-proxy)|frontend-external|^time\.1$"
#: Parts of names that mark a KPI, and those that unmark it.
KPI_NAMES = r"Score|golden_signal|cost|occurrence|latency|Latency|latency-50|_error"
NOT_KPI = r"queue-master|rabbitmq_"


def time_index(obs: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """(keys, ts, row): 0-based position of each distinct time within the keys."""
    return obs.select(*keys, ts).distinct().withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1)


def patches(obs: DataFrame, keys: list[str], series: list[str], size: int, ts: str = "ts", value: str = "value", how: str = "sum") -> DataFrame:
    """Sum (or mean) of every ``size`` consecutive rows of each series; the incomplete rest at the end goes.

    Rows are numbered once per distinct time of ``keys``, not per entity.
    """
    index = time_index(obs, keys, ts)
    total = index.groupBy(*keys).agg(F.count("*").alias("_n"))
    index = index.join(total, keys).where(F.col("row") < F.floor(F.col("_n") / size) * size).withColumn("patch", F.floor(F.col("row") / size)).drop("_n", "row")
    agg = F.sum(value) if how == "sum" else F.avg(value)
    return obs.join(index, [*keys, ts]).groupBy(*dict.fromkeys([*keys, *series]), "patch").agg(agg.alias(value))


def drop_constant(obs: DataFrame, series: list[str], value: str = "value") -> DataFrame:
    """Without the series whose values are all equal."""
    keep = obs.groupBy(*series).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).where("_a <> _b").select(*series)
    return obs.join(keep, series, "left_semi")


def drop_near_constant(obs: DataFrame, series: list[str], ts: str = "ts", value: str = "value", share: float = 0.1) -> DataFrame:
    """Without the series in which at most ``share`` of the values differ from the first."""
    first = obs.groupBy(*series).agg(F.min_by(value, ts).alias("_first"))
    keep = obs.join(first, series).groupBy(*series).agg(F.avg((F.col(value) != F.col("_first")).cast("double")).alias("_s")).where(F.col("_s") > share).select(*series)
    return obs.join(keep, series, "left_semi")


def variance_gate(obs: DataFrame, metric_keys: list[str], series: list[str], value: str = "value", least: float = 1e-5) -> DataFrame:
    """Series of positive population variance, of the metrics with some series that deviates by more than ``least``."""
    s = obs.groupBy(*series).agg(F.var_pop(value).alias("_v"), F.stddev_pop(value).alias("_d"))
    alive = s.groupBy(*metric_keys).agg(F.max("_d").alias("_m")).where(F.col("_m") > least).select(*metric_keys)
    keep = s.where("_v > 0").join(alive, metric_keys, "left_semi").select(*series)
    return obs.join(keep, series, "left_semi")


def drop_extra(obs: DataFrame, entity: str = "entity") -> DataFrame:
    return obs.where(~F.col(entity).rlike(EXTRA))


def useful(obs: DataFrame, name: str = "entity", value: str = "value") -> DataFrame:
    """Rows of the CPU and memory series with a sample deviation over 1 and of the median latencies with one over 0.01."""
    sd = obs.groupBy(name).agg(F.stddev_samp(value).alias("_sd"))
    keep = sd.where((F.col(name).rlike("_(cpu|mem)$") & (F.col("_sd") > 1)) | (F.col(name).contains("lat50") & (F.col("_sd") * 1000 > 10)) | F.col(name).contains("time")).select(name)
    return obs.join(keep, name, "left_semi")


def kpi_columns(obs: DataFrame, name: str = "entity") -> DataFrame:
    return obs.where(F.col(name).rlike(KPI_NAMES) & ~F.col(name).rlike(NOT_KPI))


def forward_fill(grid: DataFrame, series: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Nulls take the last value before them, 0 if none."""
    w = Window.partitionBy(*series).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn(value, F.coalesce(F.last(value, True).over(w), F.lit(0.0)))


def train_test(obs: DataFrame, keys: list[str], ts: str = "ts", test: float = 0.6) -> DataFrame:
    """Adds ``part``: the last ceil(test * n) times of the keys are ``test``, those before ``train``."""
    index = time_index(obs, keys, ts)
    n = index.groupBy(*keys).agg(F.count("*").alias("_n"))
    index = index.join(n, keys).withColumn("part", F.when(F.col("row") < F.col("_n") - F.ceil(F.col("_n") * test), "train").otherwise("test")).drop("row", "_n")
    return obs.join(index, [*keys, ts])


def context_windows(obs: DataFrame, series: list[str], context: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """Overlapping runs of ``context`` values with the run one step later as target."""
    order = Window.partitionBy(*series).orderBy(ts)
    run = order.rowsBetween(0, context - 1)
    later = order.rowsBetween(1, context)
    return obs.withColumn("input", F.collect_list(value).over(run)).withColumn("target", F.collect_list(value).over(later)).where(F.size("target") == context)


def lags(obs: DataFrame, series: list[str], lag: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """Adds lag_1 .. lag_n and drops the rows that lack one."""
    order = Window.partitionBy(*series).orderBy(ts)
    for k in range(1, lag + 1):
        obs = obs.withColumn(f"lag_{k}", F.lag(value, k).over(order))
    return obs.where(F.col(f"lag_{lag}").isNotNull())
