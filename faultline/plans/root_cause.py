"""Offline root-cause analysis: align, pool, normalise, gate, detect, score, combine, rank.

Scorers are looked up by name, so users add their own with :func:`register`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import l1
from ..operators import align, causal, detect, prep, rank, scorers
from ..operators.frames import materialised

#: name -> function of (pooled, gated series incl. KPI, changes(case_id, metric, a)) giving (case_id, metric, entity, score).
METHODS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}
_KEYS = ["case_id", "metric"]
KPI = "kpi"


def register(name: str):
    def add(f):
        METHODS[name] = f
        return f

    return add


@register("baro")
def _baro(series: DataFrame, changes: DataFrame) -> DataFrame:
    return scorers.robust_scores(scorers.halves(series, _KEYS, changes), _KEYS)


@register("nsigma")
def _nsigma(series: DataFrame, changes: DataFrame) -> DataFrame:
    return scorers.nsigma_scores(scorers.halves(series, _KEYS, changes), _KEYS)


@register("epsilon_diagnosis")
def _epsilon(series: DataFrame, changes: DataFrame) -> DataFrame:
    return scorers.epsilon_scores(scorers.halves(series, _KEYS, changes), _KEYS)


@register("rcd")
def _rcd(series: DataFrame, changes: DataFrame) -> DataFrame:
    return causal.discretised_fnode_scores(prep.train_test(series, _KEYS), _KEYS, "ts")


@register("circa")
def _circa(series: DataFrame, changes: DataFrame) -> DataFrame:
    return causal.regression_scores(prep.train_test(series, _KEYS), causal.pc_edges(series, _KEYS, "ts", alpha=0.01), _KEYS, "ts")


@register("spot")
def _spot(series: DataFrame, changes: DataFrame) -> DataFrame:
    return detect.spot_scores(series, _KEYS)


@register("fastpc")
def _fastpc(series: DataFrame, changes: DataFrame) -> DataFrame:
    """Walk on the causal graph from the KPI, by each entity's partial correlation with it given their parents."""
    edges = causal.pc_edges(series, _KEYS, "ts", alpha=0.01)
    return causal.walk(causal.transitions(edges, causal.partial_strengths(series, edges, _KEYS, "ts", KPI), _KEYS), _KEYS, KPI)


@register("granger")
def _granger(series: DataFrame, changes: DataFrame) -> DataFrame:
    """The same walk on linear Granger causes above the 0.95 quantile of the graph's weights."""
    n = series.groupBy(*_KEYS).agg(F.count_distinct("entity").alias("n"))
    edges = rank.quantile_edges(causal.granger_edges(series, _KEYS, "ts").where("src <> dst").join(n, _KEYS), _KEYS, "n").drop("n", "weight")
    return causal.walk(causal.transitions(edges, causal.partial_strengths(series, edges, _KEYS, "ts", KPI), _KEYS), _KEYS, KPI)


def offline(obs: DataFrame, kpi: DataFrame, patch: int = 100, method: str = "baro") -> DataFrame:
    """Ranking(case_id, entity, score, rank) from obs(case_id, metric, entity, ts, value) and kpi(case_id, ts, value).

    Times that an entity or the KPI lacks are left out, rows are pooled by
    ``patch``, series scaled to shares, flat ones dropped; the first change point
    of the KPI splits each metric's series, and an entity's scores add up over
    the metrics. The KPI itself is not ranked.
    """
    return ranking(*prepared(obs, kpi, patch), method)


def prepared(obs: DataFrame, kpi: DataFrame, patch: int) -> tuple[DataFrame, DataFrame]:
    """(series, changes) for :func:`ranking`, from the inputs of :func:`offline`; both are computed once."""
    tagged = obs.withColumn("_case", F.struct("case_id", "metric"))
    every = obs.select("case_id", "metric").distinct().join(kpi.withColumnRenamed("value", "_k"), "case_id")
    aligned = align.common_timestamps(tagged, every.withColumn("_case", F.struct("case_id", "metric")), "_case").drop("_case")
    with_kpi = aligned.unionByName(every.join(aligned.select("case_id", "metric", "ts").distinct(), ["case_id", "metric", "ts"], "left_semi").select("case_id", "metric", F.lit(KPI).alias("entity"), "ts", F.col("_k").alias("value")))
    pooled = prep.patches(with_kpi, _KEYS, [*_KEYS, "entity"], patch).withColumn("value", l1(F.col("value"), *_KEYS, "entity")).withColumnRenamed("patch", "ts")
    gated = materialised(prep.variance_gate(pooled, _KEYS, [*_KEYS, "entity"]))
    changes = materialised(detect.bocpd_changes(gated.where(F.col("entity") == KPI), _KEYS).groupBy(*_KEYS).agg(F.min("change").alias("a")))
    return gated, changes


def ranking(series: DataFrame, changes: DataFrame, method: str) -> DataFrame:
    """(case_id, entity, score, rank) of pooled, gated series(case_id, metric, entity, ts, value) by a registered method."""
    scores = METHODS[method](series, changes).where(F.col("entity") != KPI)
    return rank.ranked(rank.sum_over_metrics(scores, ["case_id"]), ["case_id"])
