"""Stand-ins for raw telemetry over the synthetic tables, each as a DataFrame and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _epoch(column: str):
    return F.unix_seconds(F.col(column).cast("timestamp"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular samples: ten entities, a metric per event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id") % 10).alias("entity"), F.col("event_type").alias("metric"), _epoch("ts").alias("ts"), "value", "event_id")


def kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the property k per five minutes."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.groupBy((F.floor(_epoch("ts") / 300) * 300).alias("ts")).agg(F.avg(k).alias("value"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.lit(380) + F.get_json_object("props", "$.k").cast("int")
    return e.select(F.concat(F.lit("u"), F.col("user_id") % 10).alias("entity"), _epoch("ts").alias("ts"), F.concat_ws(" ", "event_type", F.lit("status"), status).alias("message"), F.col("event_type").alias("template"), "event_id")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense series by week: four entities, four metrics."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("entity"), F.floor(_epoch("l_shipdate") / 604800).alias("ts"))
    wide = g.agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.sum("l_discount").alias("discount"), F.sum("l_tax").alias("tax"))
    return wide.unpivot(["entity", "ts"], ["quantity", "price", "discount", "tax"], "metric", "value")


def weekly_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.floor(_epoch("l_shipdate") / 604800).alias("ts")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a trace, a turn a span called by the turn before; a turn lasts as long as its text."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 1000
    return c.select(
        F.col("conv_id").cast("string").alias("trace"), F.col("turn").cast("string").alias("span"), (F.col("turn") - 1).cast("string").alias("parent"), F.col("role").alias("pod"),
        F.lit("say").alias("operation"), start.alias("start_ns"), (start + F.length("text")).alias("end_ns"),
    ).dropDuplicates(["trace", "span"])


def span_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line in every span, a tenth of the text after its start; its template is the text's first word."""
    c = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    return c.where("text <> ''").select(F.col("conv_id").cast("string").alias("trace"), F.col("turn").cast("string").alias("span"), (F.col("turn") * 1000 + F.floor(F.length("text") / 10)).alias("ns"), F.concat(F.lit("word"), F.length(F.regexp_extract("text", "^([A-Za-z]*)", 1)).cast("string")).alias("event"))


SQL = {
    "obs": "SELECT 'u' || (user_id % 10) AS entity, event_type AS metric, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, event_id FROM events",
    "kpi": "SELECT CAST(floor(floor(epoch(ts)) / 300) * 300 AS BIGINT) AS ts, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS value FROM events GROUP BY 1",
    "logs": "SELECT 'u' || (user_id % 10) AS entity, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type || ' status ' || (380 + CAST(json_extract_string(props, '$.k') AS INT)) AS message, event_type AS template, event_id FROM events",
    "weekly0": "SELECT 's' || (l_suppkey % 4) AS entity, CAST(floor(floor(epoch(l_shipdate)) / 604800) AS BIGINT) AS ts, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price, sum(l_discount) AS discount, sum(l_tax) AS tax FROM lineitem GROUP BY 1, 2",
    "weekly": "SELECT entity, ts, metric, value FROM (UNPIVOT weekly0 ON quantity, price, discount, tax INTO NAME metric VALUE value)",
    "weekly_kpi": "SELECT CAST(floor(floor(epoch(l_shipdate)) / 604800) AS BIGINT) AS ts, sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem GROUP BY 1",
    "spans": "SELECT DISTINCT ON (conv_id, turn) CAST(conv_id AS VARCHAR) AS trace, CAST(turn AS VARCHAR) AS span, CAST(turn - 1 AS VARCHAR) AS parent, role AS pod, 'say' AS operation, turn * 1000 AS start_ns, turn * 1000 + length(text) AS end_ns FROM conversations",
    "span_logs": "SELECT DISTINCT ON (conv_id, turn) CAST(conv_id AS VARCHAR) AS trace, CAST(turn AS VARCHAR) AS span, turn * 1000 + CAST(floor(length(text) / 10) AS BIGINT) AS ns, 'word' || length(regexp_extract(text, '^([A-Za-z]*)', 1)) AS event FROM conversations WHERE text <> ''",
}


def ctes(*names: str) -> str:
    """``WITH`` clause of the stand-ins, in the order given."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
