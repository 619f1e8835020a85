"""Scorers and detectors that aggregates and windows express."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prep import time_index


def halves(series: DataFrame, keys: list[str], changes: DataFrame, ts: str = "ts") -> DataFrame:
    """Each row of ``series`` with half ``normal`` (first min(a, n - 3) times) and/or ``anomalous`` (last max(n - a, 3)); the halves may overlap.

    ``changes(keys, a)`` has the row of the first change; without one, a = n.
    """
    index = time_index(series, keys, ts)
    n = index.groupBy(*keys).agg(F.count("*").alias("_n")).join(changes, keys, "left").withColumn("_a", F.coalesce("a", "_n")).drop("a")
    tagged = index.join(n, keys).select(*keys, ts, F.explode(F.filter(F.array(
        F.when(F.col("row") < F.least(F.col("_a"), F.col("_n") - 3), F.lit("normal")),
        F.when(F.col("row") >= F.col("_n") - F.greatest(F.col("_n") - F.col("_a"), F.lit(3)), F.lit("anomalous")),
    ), lambda x: x.isNotNull())).alias("half"))
    return series.join(tagged, [*keys, ts])


def robust_scores(split: DataFrame, keys: list[str], entity: str = "entity", value: str = "value", keep_flat_normal: bool = False) -> DataFrame:
    """Greatest (x - median) / IQR of the anomalous half, with median and IQR of the normal one (an IQR of 0 counts as 1).

    Entities flat in either half are left out; ``keep_flat_normal`` keeps those flat before the fault.
    """
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    flat = F.min(value) == F.max(value)
    normal = split.where("half = 'normal'").groupBy(*keys, entity).agg(q.alias("_q"), flat.alias("_flat"))
    normal = normal if keep_flat_normal else normal.where("not _flat")
    after = split.where("half = 'anomalous'").groupBy(*keys, entity).agg(F.max(value).alias("_top"), flat.alias("_flat2")).where("not _flat2")
    iqr = F.col("_q")[2] - F.col("_q")[0]
    return normal.join(after, [*keys, entity]).select(*keys, entity, ((F.col("_top") - F.col("_q")[1]) / F.when(iqr == 0, 1.0).otherwise(iqr)).alias("score"))


def nsigma_scores(split: DataFrame, keys: list[str], entity: str = "entity", value: str = "value") -> DataFrame:
    """Greatest (x - mean) / deviation of the anomalous half, with mean and population deviation of the normal one (0 counts as 1)."""
    flat = F.min(value) == F.max(value)
    normal = split.where("half = 'normal'").groupBy(*keys, entity).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), flat.alias("_f")).where("not _f")
    after = split.where("half = 'anomalous'").groupBy(*keys, entity).agg(F.max(value).alias("_top"), flat.alias("_f2")).where("not _f2")
    return normal.join(after, [*keys, entity]).select(*keys, entity, ((F.col("_top") - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).alias("score"))


def expanding_nsigma(series: DataFrame, keys: list[str], k: float = 3.0, starts: int = 100, ts: str = "ts", value: str = "value") -> DataFrame:
    """Rows further than k sample deviations from the mean of all rows before them, from row ``starts`` on."""
    order = Window.partitionBy(*keys).orderBy(ts)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    s = series.withColumn("row", F.row_number().over(order) - 1).withColumn("mean", F.avg(value).over(past)).withColumn("sd", F.stddev_samp(value).over(past))
    return s.where((F.col("row") >= starts) & (F.abs(F.col(value) - F.col("mean")) > k * F.col("sd")))


def threshold_anomalies(series: DataFrame, keys: list[str], threshold: float, gap: int = 5, ts: str = "ts", value: str = "value") -> DataFrame:
    """Rows over the threshold that follow the one before by more than ``gap`` rows."""
    order = Window.partitionBy(*keys).orderBy(ts)
    s = series.withColumn("row", F.row_number().over(order) - 1).where(F.col(value) > threshold)
    s = s.withColumn("_p", F.lag("row").over(order))
    return s.where(F.col("_p").isNull() | (F.col("row") - F.col("_p") > gap)).drop("_p")


def anomalies_or_peak(series: DataFrame, keys: list[str], threshold: float, gap: int = 5, skip: int = 5, ts: str = "ts", value: str = "value") -> DataFrame:
    """:func:`threshold_anomalies`, and for a series without any its greatest value after the first ``skip`` rows, the earliest of equals."""
    found = threshold_anomalies(series, keys, threshold, gap, ts, value)
    order = Window.partitionBy(*keys).orderBy(ts)
    top = Window.partitionBy(*keys).orderBy(F.desc(value), ts)
    rest = series.withColumn("row", F.row_number().over(order) - 1).join(found.select(*keys).distinct(), keys, "left_anti").where(F.col("row") >= skip)
    return found.unionByName(rest.withColumn("_t", F.row_number().over(top)).where("_t = 1").drop("_t"))


def run_length_changes(maxima: DataFrame, keys: list[str], index: str = "i", value: str = "m") -> DataFrame:
    """Indices at which the likeliest run length jumps by more than 1."""
    order = Window.partitionBy(*keys).orderBy(index)
    return maxima.withColumn("jump", F.abs(F.col(value) - F.lag(value).over(order))).where("jump > 1")


def second_moment(series: DataFrame, keys: list[str], row: str, entity: str = "entity", value: str = "value") -> DataFrame:
    """Uncentred mean of the products of each two entities (a <= b); joined by row, so as wide as the entities only."""
    a = series.select(*keys, row, F.col(entity).alias("a"), F.col(value).alias("_x"))
    b = series.select(*keys, row, F.col(entity).alias("b"), F.col(value).alias("_y"))
    return a.join(b, [*keys, row]).where("a <= b").groupBy(*keys, "a", "b").agg(F.avg(F.col("_x") * F.col("_y")).alias("m"))


def log_euclidean(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of two second-moment matrices, given by their upper halves: elementwise logarithms of 1 + m, off-diagonal ones twice."""
    j = left.select(*keys, "a", "b", F.col("m").alias("_l")).join(right.select(*keys, "a", "b", F.col("m").alias("_r")), [*keys, "a", "b"])
    d = F.pow(F.log1p("_l") - F.log1p("_r"), 2) * F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    return j.groupBy(*keys).agg(F.sqrt(F.sum(d)).alias("distance"))


def correlations(series: DataFrame, keys: list[str], row: str, entity: str = "entity", value: str = "value") -> DataFrame:
    """Pearson correlation of each two entities (a < b)."""
    a = series.select(*keys, row, F.col(entity).alias("a"), F.col(value).alias("_x"))
    b = series.select(*keys, row, F.col(entity).alias("b"), F.col(value).alias("_y"))
    return a.join(b, [*keys, row]).where("a < b").groupBy(*keys, "a", "b").agg(F.corr("_x", "_y").alias("r"), F.count("*").alias("n"))


def epsilon_scores(split: DataFrame, keys: list[str], entity: str = "entity", value: str = "value") -> DataFrame:
    """Two-sample energy statistic of an entity's halves: 2 E|x - y| - E|x - x'| - E|y - y'|.

    Mean absolute differences come from sorted ranks, without pairs.
    """
    def spread(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*keys, entity).orderBy(value, "ts")
        r = df.withColumn("_r", F.row_number().over(w)).groupBy(*keys, entity).agg(F.sum(F.col("_r") * F.col(value)).alias("_rv"), F.sum(value).alias("_v"), F.count("*").alias("_n"))
        return r.select(*keys, entity, (2 * (2 * F.col("_rv") - (F.col("_n") + 1) * F.col("_v")) / (F.col("_n") * F.col("_n"))).alias(name), F.col("_n").alias(f"{name}_n"))

    x, y = spread(split.where("half = 'normal'"), "xx"), spread(split.where("half = 'anomalous'"), "yy")
    both = spread(split, "zz")
    j = x.join(y, [*keys, entity]).join(both, [*keys, entity])
    n, m = F.col("xx_n"), F.col("yy_n")
    cross = (F.col("zz") * (n + m) * (n + m) - F.col("xx") * n * n - F.col("yy") * m * m) / (n * m)
    return j.select(*keys, entity, (cross - F.col("xx") - F.col("yy")).alias("score"))
