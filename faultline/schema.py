"""The tidy model: entities and metrics are data, never columns."""

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType


def _struct(**fields) -> StructType:
    return StructType([StructField(name.replace("__", "@"), kind) for name, kind in fields.items()])


S, L, D, I = StringType(), LongType(), DoubleType(), IntegerType()  # noqa: E741

OBSERVATIONS = _struct(kpi_label=S, level=S, entity=S, metric=S, ts=L, value=D)
KPI = _struct(kpi_label=S, ts=L, feature=S, value=D)
LOGS = _struct(level=S, entity=S, ts_raw=S, ts=TimestampType(), message=S)
STRUCTURED = _struct(line_id=L, time=S, content=S, event_id=S, template=S, params=ArrayType(S))
CATALOGUE = _struct(event_id=S, template=S, occurrence=L)
SPANS = _struct(TraceID=S, SpanID=S, ParentID=S, PodName=S, OperationName=S, StartTimeUnixNano=L, EndTimeUnixNano=L)
SPAN_LOGS = _struct(TimeUnixNano=L, SpanID=S, Log=S)
ALARMS = _struct(pod=S, metric_type=S)
EDGES = _struct(src=S, dst=S)
RANKING = _struct(case_id=S, method=S, metric=S, entity=S, score=D, rank=I)
TRUTH = _struct(case_id=S, entity=S)
CASES = _struct(case_id=S, label=S, log_label=S, online_start=L, failure_time=L, metrics=MapType(S, I), root_cause=S)

HIT = StructType([
    StructField("_source", StructType([
        StructField("@timestamp", S), StructField("message", S), StructField("hostname", S),
        StructField("kubernetes", _struct(pod_name=S)), StructField("systemd", _struct(t=S)),
    ]))
])
LOG_DUMP = StructType([StructField("hits", StructType([StructField("hits", ArrayType(HIT))]))])
METRIC_DUMP = StructType([StructField("data", StructType([StructField("result", ArrayType(StructType([
    StructField("metric", MapType(S, S)), StructField("values", ArrayType(ArrayType(S)))])))]))])
