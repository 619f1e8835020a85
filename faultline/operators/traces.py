"""Span events, event graphs and pattern scores."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType


def span_events(spans: DataFrame, logs: DataFrame, alarms: DataFrame | None = None, alarms_from: int = 0) -> DataFrame:
    """Ordered events of each span: its start, its logs, its end; the end moves to one after its last log if that is later.

    ``spans(trace, span, parent, pod, operation, start_ns, end_ns)``,
    ``logs(trace, span, ns, event)``, ``alarms(pod, metric_type, position)``: the
    alarms of the pod go right after the start, one nanosecond after another by
    their position; with columns ``from_ns`` and ``to_ns`` only into spans that
    start in that time. ``alarms_from`` events is what a span must have without
    them. Adds seq, 0-based in the span.
    """
    last = logs.groupBy("trace", "span").agg(F.max("ns").alias("_last"))
    s = spans.join(last, ["trace", "span"], "left")
    end = F.when(F.col("_last") > F.col("end_ns"), F.col("_last") + 1).otherwise(F.col("end_ns"))
    base = ["trace", "span", "parent", "pod"]
    start = s.select(*base, F.col("start_ns").alias("ns"), F.lit(0).alias("part"), F.concat_ws(" ", "pod", "operation", F.lit("start")).alias("event"))
    finish = s.select(*base, end.alias("ns"), F.lit(3).alias("part"), F.concat_ws(" ", "pod", "operation", F.lit("end")).alias("event"))
    inside = logs.join(spans.select(*base), ["trace", "span"]).select(*base, "ns", F.lit(2).alias("part"), "event")
    out = start.unionByName(inside).unionByName(finish)
    if alarms is not None:
        size = logs.groupBy("trace", "span").agg(F.count("*").alias("_size"))
        some = spans.join(size, ["trace", "span"], "left").where(F.coalesce("_size", F.lit(0)) + 2 >= alarms_from).join(alarms, "pod")
        if "from_ns" in alarms.columns:
            some = some.where((F.col("start_ns") >= F.col("from_ns")) & (F.col("start_ns") < F.col("to_ns")))
        out = out.unionByName(some.select(*base, (F.col("start_ns") + F.col("position") + 1).alias("ns"), F.lit(1).alias("part"), F.col("metric_type").alias("event")))
    # starts and ends keep their places whatever the log times say
    order = Window.partitionBy("trace", "span").orderBy(F.when(F.col("part") <= 1, 0).when(F.col("part") == 3, 2).otherwise(1), "part", "ns", "event")
    return out.withColumn("seq", F.row_number().over(order) - 1).drop("part")


def chain_edges(events: DataFrame) -> DataFrame:
    """Edges between consecutive events of a span: trace, src, dst and their seqs."""
    order = Window.partitionBy("trace", "span").orderBy("seq")
    e = events.withColumn("dst", F.lead("event").over(order)).withColumn("dst_seq", F.lead("seq").over(order)).where("dst is not null")
    return e.select("trace", F.col("span").alias("src_span"), F.col("span").alias("dst_span"), F.col("event").alias("src"), "dst", F.col("seq").alias("src_seq"), "dst_seq")


def call_edges(events: DataFrame) -> DataFrame:
    """Edges from a parent span to its child's first event.

    In the same pod the source is the parent's latest event at or before the
    child's start, if the parent has a later one; in another pod it is the
    parent's first event.
    """
    child = events.where("seq = 0").select("trace", F.col("span").alias("dst_span"), F.col("parent").alias("span"), F.col("event").alias("dst"), F.col("pod").alias("_pod"), F.col("ns").alias("_at"))
    j = child.join(events.select("trace", "span", "pod", "event", "seq", "ns"), ["trace", "span"])
    g = j.groupBy("trace", "span", "dst_span", "dst").agg(
        F.first(F.col("pod") == F.col("_pod")).alias("same"),
        F.max_by(F.when(F.col("ns") <= F.col("_at"), F.struct("event", "seq")), F.when(F.col("ns") <= F.col("_at"), F.struct("ns", "seq"))).alias("latest"),
        F.max((F.col("ns") > F.col("_at")).cast("int")).alias("later"),
        F.min_by(F.struct("event", "seq"), "seq").alias("first"),
    )
    src = F.when(~F.col("same"), F.col("first")).when(F.col("later") == 1, F.col("latest"))
    return g.withColumn("_s", src).where("_s is not null").select("trace", F.col("span").alias("src_span"), "dst_span", F.col("_s.event").alias("src"), "dst", F.col("_s.seq").alias("src_seq"), F.lit(0).alias("dst_seq"))


def pair_support(edges: DataFrame, keys: list[str] = ()) -> DataFrame:
    return edges.groupBy(*keys, "src", "dst").agg(F.count("*").alias("support"))


def pattern_scores(normal: DataFrame, abnormal: DataFrame, support: int = 5, least: float = 0.67) -> DataFrame:
    """Pairs seen over ``support`` times in normal traces with n / (n + a) of at least ``least``."""
    j = normal.select("src", "dst", F.col("support").alias("n")).join(abnormal.select("src", "dst", F.col("support").alias("a")), ["src", "dst"], "left")
    j = j.withColumn("score", F.col("n") / (F.col("n") + F.coalesce("a", F.lit(0))))
    return j.where((F.col("n") > support) & (F.col("score") >= least)).select("src", "dst", "n", "score")


def abnormal_patterns(normal: DataFrame, abnormal: DataFrame, support: int = 5, least: float = 0.67) -> DataFrame:
    """Pairs of abnormal traces, by the share of abnormal support, in falling order of ``src_dst``."""
    j = abnormal.select("src", "dst", F.col("support").alias("a")).join(normal.select("src", "dst", F.col("support").alias("n")), ["src", "dst"], "left")
    j = j.withColumn("score", F.col("a") / (F.col("a") + F.coalesce("n", F.lit(0)))).where((F.col("a") > support) & (F.col("score") >= least))
    return j.withColumn("pattern", F.concat_ws("_", "src", "dst")).orderBy(F.desc("pattern"))


def eliminate_followers(scored: DataFrame, exempt: str = "(?i)cpu|network|memory") -> DataFrame:
    """Without the pairs whose source is the end of another pair that scores at least as high; pairs ending in a resource event stay."""
    other = scored.groupBy(F.col("dst").alias("src")).agg(F.max("score").alias("_best"), F.max_by("src", F.struct("score", "src")).alias("_from"))
    j = scored.join(other, "src", "left")
    return j.where(F.col("_best").isNull() | (F.col("_best") < F.col("score")) | F.col("dst").rlike(exempt)).drop("_best", "_from")


def event_depths(edges: DataFrame, order: list[str], counts: Column | None = None) -> DataFrame:
    """(trace, event, depth, pod): how many counted events lie on the way from an event back to a root of its graph, and the pod where the event is first entered.

    ``edges(trace, src, dst, dst_pod)``; the way back goes over the first edge, by
    ``order``, into each event, and ends where it would meet an event again.
    ``counts``, over ``src``, tells which events count: by default the starts of
    operations.
    """
    counts = counts if counts is not None else F.contains("src", F.lit("start")) & ~F.contains("src", F.lit("TraceID"))
    into = edges.groupBy("trace", F.col("dst").alias("event")).agg(F.min_by(F.struct(F.col("src"), F.col("dst_pod").alias("pod"), counts.cast("int").alias("counts")), F.struct(*order)).alias("_f"))
    into = into.select("trace", "event", F.col("_f.src").alias("src"), F.col("_f.pod").alias("pod"), F.col("_f.counts").alias("counts"))
    schema = StructType([into.schema["trace"], into.schema["event"], StructField("depth", IntegerType()), into.schema["pod"]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = {"trace": [], "event": [], "depth": [], "pod": []}
            for trace, steps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                back = {s["event"]: s for s in steps}
                for event, first in back.items():
                    depth, seen, at = 0, {event}, event
                    while at in back:
                        depth += back[at]["counts"]
                        at = back[at]["src"]
                        if at in seen:
                            break
                        seen.add(at)
                    for name, value in zip(rows, (trace, event, depth, first["pod"]), strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=arrow)

    return into.groupBy("trace").agg(F.collect_list(F.struct("event", "src", "pod", "counts")).alias("steps")).mapInArrow(run, schema)


def deepest(depths: DataFrame) -> DataFrame:
    """(event, depth, pod): the greatest depth over all traces, above 0, and the pod of the first trace that has it."""
    best = F.max_by(F.struct("depth", "pod"), F.struct(F.col("depth"), (-F.col("trace").cast("long")).alias("first")))
    return depths.where("depth > 0").groupBy("event").agg(best.alias("_b")).select("event", "_b.depth", "_b.pod")


def rank_patterns(scored: DataFrame, depths: DataFrame, alarms: DataFrame, default_pod: str = "frontend") -> DataFrame:
    """(src, dst, score, depth, pod, resource, rank): patterns by falling score, then depth.

    A pattern has the depth and pod of its source, or depth 1 and ``default_pod``
    if it has none, and the first alarm of its pod as resource. Of an alarmed
    pod's patterns only the deepest stays, the first by name of several.
    """
    resource = alarms.groupBy("pod").agg(F.min_by("metric_type", "position").alias("resource"))
    j = scored.select("src", "dst", "score").join(depths.select(F.col("event").alias("src"), "depth", "pod"), "src", "left")
    j = j.select("src", "dst", "score", F.coalesce("depth", F.lit(1)).alias("depth"), F.coalesce("pod", F.lit(default_pod)).alias("pod")).join(resource, "pod", "left")
    place = Window.partitionBy("pod").orderBy(F.desc("depth"), "src", "dst")
    kept = j.withColumn("_p", F.row_number().over(place)).where("resource is null or _p = 1").drop("_p")
    # ranks by counts of equal (score, depth), which are few, so that no task sorts all patterns
    ties = kept.groupBy("score", "depth").agg(F.count("*").alias("_n"))
    order = Window.orderBy(F.desc("score"), F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    inside = Window.partitionBy("score", "depth").orderBy("src", "dst")
    return kept.join(ties, ["score", "depth"]).withColumn("rank", F.col("_before") + F.row_number().over(inside)).drop("_before").select("src", "dst", "score", "depth", "pod", "resource", "rank")


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(least, patterns, best): for each least score, how many patterns reach it and the greatest score among them."""
    at = scored.withColumn("least", F.explode(F.array(*map(F.lit, thresholds)))).where("score >= least")
    return at.groupBy("least").agg(F.count("*").alias("patterns"), F.max("score").alias("best"))


def alarm(metric: Column, value: Column, ns: str) -> Column:
    """Whether a sample is an alarm: CPU and memory rates over 80, other metrics over 200 (hipster) or 300 (ts), none in other systems."""
    limit = {"hipster": 200, "ts": 300}.get(ns)
    rate = metric.rlike("(?i)cpu|mem")
    return F.coalesce(F.when(rate, value > 80).otherwise(value > limit if limit else F.lit(False)), F.lit(False))


def first_alarms(samples: DataFrame, ns: str) -> DataFrame:
    """One alarm per (pod, ts): the first metric, by its position, that raises one."""
    return samples.where(alarm(F.col("metric"), F.col("value"), ns)).groupBy("pod", "ts").agg(F.min_by("metric", F.struct("position", "metric")).alias("metric_type"))


def network_latency(spans: DataFrame, percent: float = 0.9) -> DataFrame:
    """Per pod, the percentile of parent end less child end, in ms, over calls from other pods."""
    p = spans.select("trace", F.col("span").alias("parent"), F.col("pod").alias("_pod"), F.col("end_ns").alias("_end"))
    j = spans.join(p, ["trace", "parent"]).where("pod <> _pod")
    return j.groupBy("pod").agg(F.percentile((F.col("_end") - F.col("end_ns")) / 1e6, percent).alias("latency"))


def metric_profile(samples: DataFrame) -> DataFrame:
    """Mean and population deviation per service and metric."""
    from ..functions.text import service_name

    return samples.groupBy(service_name(F.col("pod")).alias("service"), "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def span_depths(spark, spans: DataFrame) -> DataFrame:
    """Least distance of each span from a root, a span whose parent isn't in its trace, however deep it is.

    Spans that no root leads to, those of a cycle and what hangs on it, have no
    distance and no row. A trace is walked breadth first in one task, so the work
    is linear in its spans; spans of a null trace are roots.
    """
    slim = spans.select("trace", "span", "parent")
    trace, span = slim.schema["trace"].dataType, slim.schema["span"].dataType
    schema = StructType([StructField("trace", trace), StructField("span", span), StructField("depth", IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = {"trace": [], "span": [], "depth": []}
            for one in range(batch.num_rows):
                name, pairs = batch.column(0)[one].as_py(), batch.column(1)[one].as_py()
                out = _depths(pairs) if name is not None else {p["span"]: 0 for p in pairs}
                rows["trace"] += [name] * len(out)
                rows["span"] += out
                rows["depth"] += out.values()
                if len(rows["span"]) >= 10_000 or one == batch.num_rows - 1:
                    yield pa.RecordBatch.from_pydict(rows, schema=arrow)
                    rows = {"trace": [], "span": [], "depth": []}

    return slim.groupBy("trace").agg(F.collect_list(F.struct("span", "parent")).alias("spans")).mapInArrow(run, schema)


def _depths(pairs: list[dict]) -> dict:
    names = {p["span"] for p in pairs if p["span"] is not None}
    children: dict = {}
    at = []
    for p in pairs:
        if p["parent"] in names:
            children.setdefault(p["parent"], []).append(p["span"])
        else:
            at.append(p["span"])
    out: dict = {}
    depth = 0
    while at:
        new = [x for x in dict.fromkeys(at) if x not in out]
        out.update(dict.fromkeys(new, depth))
        at = [c for x in new for c in children.get(x, ())]
        depth += 1
    return out


def synthetic_traces(logs: DataFrame) -> DataFrame:
    """Traces from logs(pod, ts, event): the pod is the trace, each line of an event a span, its parent the event that first appeared before this one.

    span_no is the event's place by first appearance, n how many lines it has.
    Events, not lines, are ordered: a pod's events are few.
    """
    first = logs.groupBy("pod", "event").agg(F.min("ts").alias("_first"), F.count("*").alias("n"))
    order = Window.partitionBy("pod").orderBy("_first", "event")
    first = first.withColumn("span_no", F.row_number().over(order)).withColumn("parent", F.coalesce(F.lag("event").over(order), F.lit("root"))).drop("_first")
    return logs.select("pod", "event", "ts").join(first, ["pod", "event"])
