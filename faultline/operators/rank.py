"""Scores into rankings, and rankings into measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import l1, l2, normal_quantile, student_quantile


def ranked(scores: DataFrame, keys: list[str], score: str = "score", name: str = "entity", top: int | None = None) -> DataFrame:
    """Adds ``rank`` by falling score, then name; at most ``top`` per keys."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), name)))
    return out.where(F.col("rank") <= top) if top else out


def sum_over_metrics(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys, "entity").agg(F.sum("score").alias("score"))


def mean_over_metrics(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of an entity's scores, then shares of their sum."""
    return scores.groupBy(*keys, "entity").agg(F.avg("score").alias("score")).withColumn("score", l1(F.col("score"), *keys))


def weighted_combine(individual: DataFrame, scores: DataFrame, prior: DataFrame, case: str) -> DataFrame:
    """Scores weighted by metric: a metric weighs the share of its greatest individual score times its prior, and the sum has length 1."""
    w = individual.groupBy(case, "metric").agg(F.max("score").alias("w")).withColumn("w", l1(F.col("w"), case))
    w = w.join(F.broadcast(prior), "metric").withColumn("w", F.col("w") * F.col("prior")).withColumn("w", l1(F.col("w"), case)).select(case, "metric", "w")
    out = scores.join(w, [case, "metric"]).groupBy(case, "entity").agg(F.sum(F.col("w") * F.col("score")).alias("score"))
    return out.withColumn("score", l2(F.col("score"), case))


def blend(individual: DataFrame, topological: DataFrame, keys: list[str], alpha: float, scale_individual: bool = True) -> DataFrame:
    """alpha * individual + (1 - alpha) * topological; the individual part unscaled on request."""
    a = individual.select(*keys, F.col("score").alias("_i"))
    factor = alpha if scale_individual else 1.0
    return a.join(topological.select(*keys, F.col("score").alias("_t")), keys).select(*keys, (factor * F.col("_i") + (1 - alpha) * F.col("_t")).alias("score"))


def hierarchical(pods: DataFrame, nodes: DataFrame, pod_to_node: DataFrame, case: str) -> DataFrame:
    """Pod score times its node's, as shares of their sum, then of length 1; pods without a node go."""
    j = pods.join(F.broadcast(pod_to_node), "pod").join(nodes.select(case, "node", F.col("score").alias("_n")), [case, "node"])
    j = j.select(case, "pod", (F.col("score") * F.col("_n")).alias("score")).withColumn("score", l1(F.col("score"), case))
    return j.withColumn("score", l2(F.col("score"), case))


def kth_threshold(edges: DataFrame, keys: list[str], n_nodes: str, share: float = 0.3, weight: str = "weight") -> DataFrame:
    """Edges of at least the k-th largest weight, k = floor(share * n^2); only positive ones where that weight is 0."""
    w = Window.partitionBy(*keys).orderBy(F.desc(weight), "src", "dst")
    e = edges.withColumn("_r", F.row_number().over(w)).withColumn("_k", F.floor(F.col(n_nodes) * F.col(n_nodes) * share))
    e = e.withColumn("_kth", F.max(F.when(F.col("_r") == F.col("_k"), F.col(weight))).over(Window.partitionBy(*keys)))
    out = e.where(F.col("_kth").isNull() | (F.col(weight) >= F.col("_kth")))
    return out.where(F.col(weight) > 0).drop("_r", "_k", "_kth")


def online_threshold(edges: DataFrame, keys: list[str], n_nodes: str, weight: str = "weight", floor: float = 0.99) -> DataFrame:
    """Edges above the k-th largest of the n^2 weights, k = ceil(0.6 n^2) below 50 cells and ceil(0.3 n^2) from there, and above ``floor``; absent edges weigh 0."""
    cells = F.col(n_nodes) * F.col(n_nodes)
    k = F.ceil(cells * F.when(cells < 50, 0.6).otherwise(0.3))
    w = Window.partitionBy(*keys).orderBy(F.desc(weight), "src", "dst")
    e = edges.withColumn("_r", F.row_number().over(w)).withColumn("_kth", F.max(F.when(F.col("_r") == k, F.col(weight))).over(Window.partitionBy(*keys)))
    return e.where(F.col(weight) > F.greatest(F.lit(floor), F.coalesce("_kth", F.lit(0.0)))).drop("_r", "_kth")


def quantile_edges(edges: DataFrame, keys: list[str], n_nodes: str, share: float = 0.95, weight: str = "weight") -> DataFrame:
    """Edges above the ``share`` quantile of the n^2 weights of their graph; absent edges weigh 0, and count by their number."""
    absent = edges.groupBy(*keys).agg((F.first(n_nodes) * F.first(n_nodes) - F.count("*")).alias("_n")).select(*keys, F.lit(0.0).alias("_w"), "_n")
    cells = edges.select(*keys, F.col(weight).cast("double").alias("_w"), F.lit(1).cast("long").alias("_n")).unionByName(absent.withColumn("_n", F.col("_n").cast("long")).where("_n > 0"))
    cut = cells.groupBy(*keys).agg(F.expr(f"percentile(_w, {share}, _n)").alias("_cut"))
    return edges.join(cut, keys).where(F.col(weight) > F.col("_cut")).drop("_cut")


def relabel_edges(edges: DataFrame, merged: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Distinct edges after nodes are merged: ``merged(node, into)``; other nodes stay, loops go."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(merged.select(F.col("node").alias(end), F.col("into").alias("_into")), end, "left").withColumn(end, F.coalesce("_into", end)).drop("_into")
    return out.where("src <> dst").select(*keys, "src", "dst").distinct()


def effects_on(edges: DataFrame, label: str, keys: list[str] = ()) -> DataFrame:
    """(Cause, Effect, Strength) of the edges that end at ``label``."""
    return edges.where(F.col("dst") == label).select(*keys, F.col("src").alias("Cause"), F.col("dst").alias("Effect"), F.col("weight").alias("Strength"))


def precision_at(ranking: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(k, precision): mean over cases of hits among the first k over min(k, true causes)."""
    n = truth.groupBy("case_id").agg(F.count_distinct("entity").alias("n"))
    k = ranking.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    hits = ranking.join(truth.select("case_id", "entity").distinct(), ["case_id", "entity"], "left_semi").select("case_id", "rank")
    cases = n.join(F.broadcast(k))  # a row per case and k
    per = cases.join(hits, (cases["case_id"] == hits["case_id"]) & (hits["rank"] <= cases["k"]), "left").groupBy(cases["case_id"], "k", "n").agg(F.count("rank").alias("hit"))
    return per.groupBy("k").agg(F.avg(F.col("hit") / F.least("k", "n")).alias("precision"))


def mean_average_precision(ranking: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return precision_at(ranking, truth, list(range(1, k + 1))).agg(F.avg("precision").alias("map"))


def reciprocal_rank(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean over cases of 1 over the best rank of a true cause; 0 where none is ranked."""
    best = ranking.join(truth.select("case_id", "entity").distinct(), ["case_id", "entity"], "left_semi").groupBy("case_id").agg(F.min("rank").alias("best"))
    return truth.select("case_id").distinct().join(best, "case_id", "left").agg(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr"))


def hit_rate(ranking: DataFrame, truth: DataFrame, ks: list[int], score: str = "score") -> DataFrame:
    """(k, hit_rate): share of the cases with a true cause among the first k groups of equal score."""
    groups = ranking.withColumn("_g", F.dense_rank().over(Window.partitionBy("case_id").orderBy(F.desc(score))))
    best = groups.join(truth.select("case_id", "entity").distinct(), ["case_id", "entity"], "left_semi").groupBy("case_id").agg(F.min("_g").alias("best"))
    k = ranking.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    cases = truth.select("case_id").distinct().join(best, "case_id", "left")
    return cases.join(F.broadcast(k)).groupBy("k").agg(F.avg(F.coalesce(F.col("best") <= F.col("k"), F.lit(False)).cast("double")).alias("hit_rate"))


def rank_percentile(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """Per true cause, the share in hundredths of the entities ranked before it; null where it isn't ranked."""
    n = ranking.groupBy("case_id").agg(F.count("*").alias("n"))
    return truth.join(ranking.select("case_id", "entity", "rank"), ["case_id", "entity"], "left").join(n, "case_id", "left").select("case_id", "entity", ((F.col("rank") - 1) / F.col("n") * 100).alias("percentile"))


def confidence(ranking: DataFrame, level: float = 0.99) -> DataFrame:
    """Per case of over three entities, in tenths, how far the first score exceeds the rest.

    The upper end of the rest's confidence interval plus four deviations is the
    full scale; the first score's place among its tenths is the confidence.
    """
    rest = ranking.where("rank > 1").groupBy("case_id").agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.stddev_samp("score").alias("s"))
    first = ranking.where("rank = 1").select("case_id", F.col("score").alias("top"))
    p = 0.5 + level / 2
    quantile = F.lit(normal_quantile(p))
    for n in range(29, 1, -1):
        quantile = F.when(F.col("n") == n, student_quantile(p, n - 1)).otherwise(quantile)
    ub = F.col("m") + quantile * F.col("s") / F.sqrt("n") + 4 * F.col("s")
    out = first.join(rest, "case_id").where("n >= 3").withColumn("ub", ub)
    tenths = sum(((F.col("top") >= 0.1 * i * F.col("ub")).cast("int") for i in range(2, 10)), (F.col("top") >= 0.1 * F.col("ub")).cast("int"))
    return out.select("case_id", (tenths / 10).alias("confidence"))


def average_overlap(a: list[str], b: list[str], depth: int = 5) -> float:
    """Mean over d of the share of the first d that two rankings have in common."""
    depth = min(depth, max(len(a), len(b), 1))
    return sum(len(set(a[:d]) & set(b[:d])) / d for d in range(1, depth + 1)) / depth
