"""Readers of raw telemetry into the tidy model, and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import extract_message, split_by_format, strip_timestamps, trim_quotes


def log_dump(spark: SparkSession, path: str) -> DataFrame:
    """Search-engine log dumps, one JSON document per file: a pod row if the hit names a pod, a node row if it has systemd fields, both if both.

    Pod messages are freed of timestamps, node messages aren't.
    """
    hits = spark.read.schema(schema.LOG_DUMP).option("multiLine", True).json(path).select(F.explode("hits.hits").alias("h")).select("h._source.*")
    body = trim_quotes(extract_message(F.col("message")))
    common = [F.col("`@timestamp`").alias("ts_raw"), F.try_to_timestamp("`@timestamp`").alias("ts")]
    pods = hits.where("kubernetes.pod_name is not null").select(F.lit("pod").alias("level"), F.col("kubernetes.pod_name").alias("entity"), *common, strip_timestamps(body).alias("message"))
    nodes = hits.where("systemd.t is not null").select(F.lit("node").alias("level"), F.col("hostname").alias("entity"), *common, body.alias("message"))
    return pods.unionByName(nodes)


def metric_dump(spark: SparkSession, path: str, level: str, metric: str, kpi_label: str = "") -> DataFrame:
    """Metric dumps into observations; the entity is the ``pod`` or ``instance`` label. Unreadable values become null, NaN and infinities stay."""
    r = spark.read.schema(schema.METRIC_DUMP).option("multiLine", True).json(path).select(F.explode("data.result").alias("r"))
    v = r.select(F.col("r.metric")["pod" if level == "pod" else "instance"].alias("entity"), F.explode("r.values").alias("v"))
    return v.select(F.lit(kpi_label).alias("kpi_label"), F.lit(level).alias("level"), "entity", F.lit(metric).alias("metric"), F.expr("cast(floor(try_cast(v[0] as double)) as bigint)").alias("ts"), F.expr("try_cast(v[1] as double)").alias("value"))


def metric_dumps(spark: SparkSession, root: str, level: str, metrics: list[str]) -> DataFrame:
    """A tree of metric dumps, ``<namespace>/<namespace>_<metric>*.json`` below ``root``, in one scan: namespace and metric come from each file's path.

    Of metrics that a name could begin with the longest is taken; files of other metrics are left out.
    """
    known = "|".join(_literal(m) for m in sorted(metrics, key=len, reverse=True))
    raw = spark.read.schema(schema.METRIC_DUMP).option("multiLine", True).option("recursiveFileLookup", True).json(root)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)$", 2)
    space = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)$", 1)
    rest = F.expr("substring(_name, length(_space) + 2)")
    r = raw.select(F.explode("data.result").alias("r"), name.alias("_name"), space.alias("_space"))
    r = r.where(F.col("_name").startswith(F.concat("_space", F.lit("_")))).withColumn("_metric", F.regexp_extract(rest, f"^({known})", 1)).where("_metric <> ''")
    v = r.select(F.col("r.metric")["pod" if level == "pod" else "instance"].alias("entity"), "_space", "_metric", F.explode("r.values").alias("v"))
    return v.select(F.col("_space").alias("kpi_label"), F.lit(level).alias("level"), "entity", F.col("_metric").alias("metric"), F.expr("cast(floor(try_cast(v[0] as double)) as bigint)").alias("ts"), F.expr("try_cast(v[1] as double)").alias("value"))


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"[{c}]" for c in text)


def _csv(spark: SparkSession, path: str, fields: list[tuple[str, str]], **options) -> DataFrame:
    """The named columns of CSV files with a header, whatever others they have; what can't be cast is null."""
    raw = spark.read.options(header=True, **options).csv(path)
    return raw.select(*[F.expr(f"try_cast(`{name}` as {kind})").alias(name) for name, kind in fields])


def kpi_csv(spark: SparkSession, path: str, unit: int = 1_000_000, label: str | None = None) -> DataFrame:
    """KPI tables with a header, (ts, label, latency); ``unit`` epoch units make a second (1000 for load-test logs)."""
    df = _csv(spark, path, [("timeStamp", "bigint"), ("label", "string"), ("Latency", "double")])
    df = df.select((F.col("timeStamp") / unit).cast("long").alias("ts"), "label", F.col("Latency").alias("latency"))
    return df.where(F.col("label") == label) if label else df


def log_lines(spark: SparkSession, path: str, log_format: str = "<Time>\t<Content>") -> DataFrame:
    """Text logs into the format's fields, with line_id in the order of file and line; lines that don't fit are dropped and take no id."""
    raw = spark.read.text(path).withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())
    fields = split_by_format(F.col("value"), log_format)
    from pyspark.sql import Window

    from ..functions.text import format_fields

    df = raw.where(F.col("value").rlike(format_fields(log_format)[1])).select(*[c.alias(n.lower()) for n, c in fields.items()], "_file", "_at")
    return df.withColumn("line_id", F.row_number().over(Window.partitionBy("_file").orderBy("_at"))).withColumn("file", F.element_at(F.split("_file", "/"), -1)).drop("_file", "_at")


def sensor_csv(spark: SparkSession, path: str, banner: int = 0, ts: str = "Timestamp") -> DataFrame:
    r"""Wide sensor tables, after ``banner`` lines, as (ts, sensor, value, label); headers keep what follows their last backslash."""
    head = [x.value for x in spark.read.text(path).limit(banner + 1).collect()][banner]
    names = [h.strip().strip('"').split("\\")[-1] for h in head.split(",")]
    raw = spark.read.csv(path, header=False, schema=", ".join(f"`{i}` string" for i in range(len(names))))
    at = names.index(ts)
    raw = raw.withColumn("_ts", F.try_to_timestamp(f"`{at}`")).where("_ts is not null")
    label = next((i for i, n in enumerate(names) if n.lower() == "label"), None)
    sensors = [(i, n) for i, n in enumerate(names) if i not in (at, label)]
    pairs = F.array(*[F.struct(F.lit(n).alias("sensor"), F.expr(f"try_cast(`{i}` as double)").alias("value")) for i, n in sensors])
    return raw.select(F.col("_ts").alias("ts"), (F.col(f"`{label}`") if label is not None else F.lit(None).cast("string")).alias("label"), F.explode(pairs).alias("p")).select("ts", "p.sensor", "p.value", "label")


def spans_csv(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path, [(f.name, f.dataType.simpleString()) for f in schema.SPANS])
    return df.select(F.col("TraceID").alias("trace"), F.col("SpanID").alias("span"), F.col("ParentID").alias("parent"), F.col("PodName").alias("pod"), F.col("OperationName").alias("operation"), F.col("StartTimeUnixNano").alias("start_ns"), F.col("EndTimeUnixNano").alias("end_ns"))


def span_logs_csv(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path, [(f.name, f.dataType.simpleString()) for f in schema.SPAN_LOGS], escape='"')
    return df.select(F.col("TimeUnixNano").alias("ns"), F.col("SpanID").alias("span"), F.col("Log").alias("log"))


def fault_list(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth: {date: [{inject_time, inject_timestamp, inject_pod, inject_type}]}."""
    kind = "map<string,array<struct<inject_time:string,inject_timestamp:string,inject_pod:string,inject_type:string>>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", kind))).select(F.col("key").alias("date"), F.explode("value").alias("f")).select("date", "f.*")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Case files of ``key: value`` lines, with nested maps by indentation, as rows of (case_id, config as JSON)."""
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("case_id"), "value")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(config=[json.dumps(simple_yaml(v)) for v in pdf["value"]])[["case_id", "config"]]

    return text.mapInPandas(run, "case_id string, config string")


def simple_yaml(text: str) -> dict:
    """Nested maps of scalars, by indentation; quotes, comments, numbers and ``- `` lists are understood."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    last: tuple[dict, str] | None = None
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth = len(body) - len(body.lstrip())
        body = body.strip()
        if body.startswith("- ") and last:
            if not isinstance(last[0][last[1]], list):
                last[0][last[1]] = []
            last[0][last[1]].append(_scalar(body[2:]))
            continue
        key, _, value = body.partition(":")
        while depth <= stack[-1][0]:
            stack.pop()
        here = stack[-1][1]
        key = key.strip().strip("'\"")
        if value.strip():
            here[key] = _scalar(value)
        else:
            here[key] = {}
            stack.append((depth, here[key]))
            last = (here, key)
    return root


def _scalar(value: str):
    value = value.strip()
    if value[:1] in "'\"" and value[-1:] == value[:1]:
        return value[1:-1]
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "~": None}.get(value.lower(), value)


def matrix_npy(spark: SparkSession, path: str, metric: str, allow_pickle: bool = False) -> DataFrame:
    """Aligned matrices of one metric from .npy files that the user trusts, as observations; the last column is the KPI's, entity ``kpi``.

    Every file of the path is read, one at a time, where its task runs. Files of
    pickled objects can run code when read, so they need ``allow_pickle``.
    """
    if not allow_pickle:
        raise ValueError("a pickled matrix is only read with allow_pickle=True")

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                for label, blob in np.load(io.BytesIO(bytes(content)), allow_pickle=True).item().items():
                    names = blob.get("Pod_Name") if "Pod_Name" in blob else blob["Node_Name"]
                    x = np.asarray(blob["Sequence"], float)
                    x = x.squeeze(-1).T if x.ndim == 3 else x
                    for name, column in zip([*names, *["kpi"] * (x.shape[1] - len(names))], x.T, strict=True):
                        n = min(len(blob["time"]), len(column))
                        yield pd.DataFrame({"kpi_label": str(label), "level": "pod" if "Pod_Name" in blob else "node", "entity": str(name), "metric": metric, "ts": np.asarray(blob["time"][:n], np.int64), "value": column[:n]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema.OBSERVATIONS)


def write_by_entity(logs: DataFrame, path: str) -> None:
    """Text files of ``time TAB message``, in order of time, in a folder per entity; an entity's lines go to several files, each a range of its time, where they are many."""
    ranges = int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.concat_ws("\t", "ts_raw", "message").alias("value")
    logs.repartitionByRange(ranges, "entity", "ts_raw").sortWithinPartitions("entity", "ts_raw").select("entity", line).write.mode("overwrite").partitionBy("entity").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays and maps as JSON."""
    cols = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_rankings(rankings: DataFrame, combined: DataFrame, confidence: DataFrame, path: str) -> None:
    """The result layout: a CSV folder per metric (root_cause, score), the combined ranking (sensor, final_score) and the confidence, best first."""
    per = rankings.select("metric", F.col("entity").alias("root_cause"), "score").repartition("metric").sortWithinPartitions("metric", F.desc("score"), "root_cause")
    per.write.mode("overwrite").partitionBy("metric").option("header", True).csv(f"{path}/metrics")
    final = combined.select(F.col("entity").alias("sensor"), F.col("score").alias("final_score")).orderBy(F.desc("final_score"), "sensor")
    final.write.mode("overwrite").option("header", True).csv(f"{path}/combined")
    confidence.select("confidence").write.mode("overwrite").option("header", True).csv(f"{path}/confidence")


def write_segments(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("segment_id").parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A topic's values as text; needs the connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load().select(F.col("value").cast("string"), "timestamp")


