"""Sensor tables of plants: kinds, stages, sums and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages of the two plants and their positions.
SWAT_STAGES = {
    "S1": ("101", "102"),
    "S2": ("201", "202", "203", "204", "205", "206"),
    "S3": ("301", "302", "303", "304"),
    "S4": ("401", "402", "403", "404"),
    "S5": ("501", "502", "503", "504"),
    "S6": ("601", "602", "603"),
}
WADI_STAGES = {
    "S1": ("1_001", "1_002", "1_003", "1_004", "1_005", "1_006"),
    "S2": ("2_101", "2_201", "2_301", "2_401", "2_501", "2_601", "2_001", "2_002", "2_003", "2_004", "2_005", "2_006", "2_007", "2_009"),
    "S3": ("3_001", "3_002", "3_003", "3_004", "3_005"),
}


def swat_kind(sensor: Column) -> Column:
    """Letters that a sensor's name begins with: DPIT301 is a DPIT, not a PIT."""
    return F.regexp_extract(sensor, "^([A-Z]+)", 1)


def swat_position(sensor: Column) -> Column:
    return F.regexp_extract(sensor, "([0-9]+)$", 1)


def wadi_name(sensor: Column) -> Column:
    r"""Canonical ``stage_kind_position`` of names such as ``\\host\path\2A_AIT_001_PV``; a line's letter goes. The name itself where it doesn't fit."""
    last = F.element_at(F.split(sensor, r"\\"), -1)
    return F.when(F.rlike(last, F.lit("^[0-9][AB]?_[A-Z]+_[0-9]{3}")), F.regexp_replace(last, "^([0-9])[AB]?_([A-Z]+)_([0-9]{3}).*$", "$1_$2_$3")).otherwise(last)


def label(raw: Column) -> Column:
    """1 for normal, -1 for attack, in any of the spellings; null for others."""
    text = F.lower(F.regexp_replace(raw.cast("string"), r"\s+", ""))
    return F.when(text.isin("normal", "0", "1"), 1).when(text.isin("attack", "-1"), -1)


def kind_sums(obs: DataFrame, members: DataFrame, kinds: list[str]) -> DataFrame:
    """Per ts, group and kind the sum over the group's sensors, 0 where it has none of the kind.

    ``obs(ts, sensor, kind, value)``; ``members(sensor, grp)`` is a plant's plan and is broadcast.
    """
    j = obs.where(F.col("kind").isin(kinds)).join(F.broadcast(members), "sensor")
    sums = j.groupBy("ts", "grp", "kind").agg(F.sum("value").alias("value"))
    groups = members.select("grp").distinct()
    grid = obs.select("ts").distinct().join(F.broadcast(groups)).withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    return grid.join(sums, ["ts", "grp", "kind"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def pair_sums(obs: DataFrame) -> DataFrame:
    """Sensors of the two lines of a stage summed under their canonical name."""
    return obs.groupBy("ts", wadi_name(F.col("sensor")).alias("sensor")).agg(F.sum("value").alias("value"))


def common_metrics(left: DataFrame, right: DataFrame, metrics: list[str]) -> DataFrame:
    """Names in both tables whose second of at least three parts is one of the metrics."""
    def names(df):
        parts = F.split("sensor", "_")
        return df.where((F.size(parts) >= 3) & parts[1].isin(metrics)).select("sensor").distinct()

    return names(left).intersect(names(right))


def attack_label(obs: DataFrame, windows: DataFrame) -> DataFrame:
    """label -1 inside any attack window (lo..hi, ends included), else 1. Windows are a list of known attacks."""
    hit = obs.select("ts").distinct().join(F.broadcast(windows), F.col("ts").between(F.col("lo"), F.col("hi")), "left_semi").withColumn("_h", F.lit(True))
    return obs.join(hit, "ts", "left").withColumn("label", F.when(F.col("_h"), -1).otherwise(1)).drop("_h")
