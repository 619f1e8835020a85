"""The registered queries: one per operator, with the DuckDB SQL that its rows must equal where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sources, views
from .functions import numeric, text
from .operators import align, causal, detect, prep, rank, scorers, sensors, templates, traces, windows
from .operators.frames import materialised, shared_folder
from .views import ctes, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(column: str, name: str | None = None):
    return F.round(F.col(column), 6).alias(name or column)


# ------------------------------------------------------------- filters, joins, collapses


@query("SELECT CAST(floor(epoch(ts)) * 1000 AS BIGINT) // 1000 AS ts, event_type AS label, value AS latency FROM events WHERE event_type = 'purchase'")
def kpi_label_filter(spark, d):
    e = table(spark, d, "events").withColumn("timeStamp", F.unix_seconds(F.col("ts").cast("timestamp")) * 1000)
    return e.select(F.expr("timeStamp div 1000").alias("ts"), F.col("event_type").alias("label"), F.col("value").alias("latency")).where("label = 'purchase'")


@query(ctes("obs") + " SELECT entity, metric, ts, round(avg(value), 6) AS value FROM obs GROUP BY 1, 2, 3")
def metric_dup_collapse(spark, d):
    return align.collapse(views.observations(spark, d), ["entity", "metric", "ts"]).select("entity", "metric", "ts", r6("value"))


@query(ctes("obs") + ", k AS (SELECT entity, metric FROM obs GROUP BY 1, 2 HAVING count(DISTINCT ts) >= 20) SELECT o.entity, o.metric, o.event_id FROM obs o JOIN k USING (entity, metric)")
def sample_gate(spark, d):
    o = views.observations(spark, d).withColumn("series", F.struct("entity", "metric"))
    return align.sample_gate(o, "series", 20, distinct="ts").select("entity", "metric", "event_id")


@query(ctes("weekly0", "weekly", "weekly_kpi") + """, n AS (SELECT metric, count(DISTINCT entity) AS n FROM weekly GROUP BY 1), c AS (SELECT w.metric, w.ts FROM weekly w JOIN n USING (metric) WHERE ts IN (SELECT ts FROM weekly_kpi) GROUP BY 1, 2, n HAVING count(DISTINCT entity) = n)
SELECT metric, ts, entity, round(value, 4) AS value FROM weekly JOIN c USING (metric, ts)""")
def common_timestamps(spark, d):
    kpi = views.weekly_kpi(spark, d).join(F.broadcast(spark.createDataFrame([(m,) for m in ("quantity", "price", "discount", "tax")], "metric string")))
    return align.common_timestamps(views.weekly(spark, d), kpi, "metric").select("metric", "ts", "entity", F.round("value", 4).alias("value"))


@query(ctes("obs") + ", few AS (SELECT * FROM obs WHERE NOT (metric = 'error' AND entity IN ('u1', 'u2'))) SELECT event_id, entity, metric FROM few WHERE entity IN (SELECT entity FROM few GROUP BY 1 HAVING count(DISTINCT metric) = (SELECT count(DISTINCT metric) FROM few))")
def common_entities(spark, d):
    few = views.observations(spark, d).where("not (metric = 'error' and entity in ('u1', 'u2'))")
    return align.common_entities(few).select("event_id", "entity", "metric")


@query(ctes("weekly0") + " SELECT entity, ts, round(quantity, 4) AS quantity, round(price, 4) AS price FROM weekly0 WHERE quantity IS NOT NULL AND price IS NOT NULL")
def metric_pivot_merge(spark, d):
    w = align.pivot_metrics(views.weekly(spark, d), ["entity", "ts"], "metric", "value", ["quantity", "price"])
    return w.select("entity", "ts", F.round("quantity", 4).alias("quantity"), F.round("price", 4).alias("price"))


@query(ctes("weekly0", "weekly") + " SELECT entity, ts, metric, round(value, 4) AS value FROM weekly WHERE metric IN ('quantity', 'tax')")
def metric_unpivot(spark, d):
    w = align.pivot_metrics(views.weekly(spark, d), ["entity", "ts"], "metric", "value", ["quantity", "tax"])
    return align.unpivot_metrics(w, ["entity", "ts"], ["quantity", "tax"]).select("entity", "ts", "metric", F.round("value", 4).alias("value"))


@query(ctes("obs") + ", s AS (SELECT * FROM (VALUES (0, 'before', 1704067200, 1704326400), (0, 'attack', 1704326401, 1704412800), (1, 'attack', 1704300000, 1704350000), (1, 'after', 1704350001, 1704600000)) t(segment_id, part, lo, hi)) SELECT segment_id, part, event_id FROM obs JOIN s ON ts BETWEEN lo AND hi")
def fault_segments(spark, d):
    seg = spark.createDataFrame([(0, "before", 1704067200, 1704326400), (0, "attack", 1704326401, 1704412800), (1, "attack", 1704300000, 1704350000), (1, "after", 1704350001, 1704600000)], "segment_id int, part string, lo long, hi long")
    return align.fault_segments(views.observations(spark, d), seg).select("segment_id", "part", "event_id")


@query(ctes("obs") + ", w AS (SELECT * FROM obs WHERE ts BETWEEN 1704200000 AND 1704300000) SELECT event_id, ts FROM w WHERE ts < (SELECT max(ts) FROM w)")
def online_batch_slice(spark, d):
    return align.batch_slice(views.observations(spark, d), 1704200000, 100000).select("event_id", "ts")


@query(ctes("obs") + " SELECT ts FROM obs ORDER BY abs(ts - 1704250000), ts LIMIT 1")
def nearest_timestamp(spark, d):
    return align.nearest_time(views.observations(spark, d), 1704250000)


@query(ctes("obs") + " SELECT event_id, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS minute FROM obs WHERE ts >= 1704153600 AND ts < 1704157200")
def minute_filter(spark, d):
    o = views.observations(spark, d).where("ts >= 1704153600 and ts < 1704157200")
    return o.select("event_id", F.from_unixtime("ts", "yyyy-MM-dd HH:mm").alias("minute"))


@query(ctes("obs", "kpi") + " SELECT o.event_id, o.ts, round(k.value, 6) AS kpi FROM obs o ASOF LEFT JOIN kpi k ON o.ts >= k.ts")
def kpi_asof(spark, d):
    left = views.observations(spark, d).select("event_id", "ts")
    right = views.kpi(spark, d).select("ts", F.col("value").alias("kpi"))
    return align.asof_backward(left, right, [], "ts", "kpi", width=6 * 3600).select("event_id", "ts", r6("kpi"))


@query(ctes("obs") + ", l AS (SELECT event_id, entity, ts FROM obs WHERE metric <> 'error'), r AS (SELECT entity, ts, max(value) AS error FROM obs WHERE metric = 'error' GROUP BY 1, 2) SELECT l.event_id, round(r.error, 6) AS error FROM l ASOF LEFT JOIN r ON l.entity = r.entity AND l.ts >= r.ts")
def entity_asof(spark, d):
    o = views.observations(spark, d)
    left, right = o.where("metric <> 'error'").select("event_id", "entity", "ts"), o.where("metric = 'error'").select("entity", "ts", F.col("value").alias("error"))
    return align.asof_backward(left, right, ["entity"], "ts", "error", width=24 * 3600).select("event_id", r6("error"))


# ------------------------------------------------------------- readers: stand-ins written in the raw formats, and read back


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"


@query("SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS label, round(value, 6) AS latency FROM events WHERE event_type = 'purchase'")
def read_kpi_csv(spark, d):
    where = _folder(spark)
    e = table(spark, d, "events").select((F.unix_seconds(F.col("ts").cast("timestamp")) * numeric.digits_scale(10, 13)).alias("timeStamp"), F.lit(1).alias("elapsed"), F.col("event_type").alias("label"), F.col("value").alias("Latency"))
    sources.write_csv(e, where)
    return sources.kpi_csv(spark, where, unit=1000, label="purchase").select("ts", "label", r6("latency"))


@query(ctes("obs") + " SELECT 'shop' AS kpi_label, 'pod' AS level, entity, CASE metric WHEN 'error' THEN 'cpu_usage' ELSE 'cpu' END AS metric, ts, round(value, 6) AS value FROM obs WHERE metric IN ('error', 'click')")
def read_metric_dumps(spark, d):
    """Two metrics in a tree of JSON dumps; a third name in the tree is left out."""
    where, o = _folder(spark), views.observations(spark, d)
    for metric, name in (("error", "cpu_usage"), ("click", "cpu"), ("view", "disk")):
        series = o.where(F.col("metric") == metric).groupBy("entity").agg(F.collect_list(F.array(F.col("ts").cast("string"), F.col("value").cast("string"))).alias("values"))
        hit = F.struct(F.create_map(F.lit("pod"), "entity").alias("metric"), "values")
        dump = series.agg(F.collect_list(hit).alias("result")).select(F.to_json(F.struct(F.struct("result").alias("data"))).alias("value"))
        (line,) = dump.collect()  # a stand-in of one file; the reader takes any number
        spark.createDataFrame([(line["value"],)], "value string").coalesce(1).write.text(f"{where}/t/{name}")
    _rename(spark, where)
    return sources.metric_dumps(spark, f"{where}/shop", "pod", ["cpu", "cpu_usage"]).withColumn("value", F.round("value", 6))


def _rename(spark, where: str) -> None:
    """Moves the one part file of each ``t/<metric>`` to ``shop/shop_<metric>_0.json``."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(where).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{where}/shop"))
    for folder in fs.listStatus(path(f"{where}/t")):
        for f in fs.listStatus(folder.getPath()):
            if f.getPath().getName().startswith("part-"):
                fs.rename(f.getPath(), path(f"{where}/shop/shop_{folder.getPath().getName()}_0.json"))


@query(ctes("logs") + " SELECT entity, ts, message FROM logs WHERE entity < 'u3'")
def read_log_dump(spark, d):
    where, logs = _folder(spark), views.logs(spark, d).where("entity < 'u3'")
    at = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    body = F.concat(F.lit('"'), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "message", F.lit('"'))
    source = F.struct(at.alias("@timestamp"), body.alias("message"), F.struct(F.col("entity").alias("pod_name")).alias("kubernetes"))
    hits = logs.groupBy("entity").agg(F.collect_list(F.struct(source.alias("_source"))).alias("hits"))
    hits.select(F.to_json(F.struct(F.struct("hits").alias("hits"))).alias("value")).repartition(3, "value").write.option("maxRecordsPerFile", 1).text(where)
    return sources.log_dump(spark, where).select("entity", F.unix_seconds("ts").alias("ts"), "message")


@query(ctes("logs") + " SELECT 't' || ts AS time, message AS content FROM logs WHERE event_id % 3 <> 0")
def read_log_lines(spark, d):
    where = _folder(spark)
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("no tab in "), "message")).otherwise(F.concat(F.lit("t"), F.col("ts").cast("string"), F.lit("\t"), "message"))
    views.logs(spark, d).select(line.alias("value")).write.text(where)
    return sources.log_lines(spark, where).select("time", "content")


@query(ctes("spans") + " SELECT trace, span, parent, pod, operation, start_ns, end_ns FROM spans")
def read_spans_csv(spark, d):
    where, s = _folder(spark), views.spans(spark, d)
    s.select(F.lit("x").alias("Other"), F.col("pod").alias("PodName"), F.col("trace").alias("TraceID"), F.col("span").alias("SpanID"), F.col("parent").alias("ParentID"), F.col("operation").alias("OperationName"), F.col("start_ns").alias("StartTimeUnixNano"), F.col("end_ns").alias("EndTimeUnixNano")).write.option("header", True).csv(where)
    return sources.spans_csv(spark, where)


@query(ctes("weekly0") + " SELECT ts * 604800 AS ts, 'quantity_' || entity AS sensor, round(quantity, 4) AS value, CAST(CASE WHEN ts % 5 = 0 THEN -1 ELSE 1 END AS INT) AS label FROM weekly0")
def read_sensor_csv(spark, d):
    where = _folder(spark)
    w = views.weekly(spark, d).where("metric = 'quantity'").groupBy("ts").pivot("entity", ["s0", "s1", "s2", "s3"]).agg(F.round(F.first("value"), 4))
    at = F.date_format(F.timestamp_seconds(F.col("ts") * 604800), "yyyy-MM-dd HH:mm:ss")
    w.select(at.alias("Timestamp"), *(F.col(e).alias(f"\\\\host\\quantity_{e}") for e in ("s0", "s1", "s2", "s3")), F.when(F.col("ts") % 5 == 0, "A ttack").otherwise("Normal").alias("label")).coalesce(1).write.option("header", True).csv(where)
    return sources.sensor_csv(spark, where).where("value is not null").select(F.unix_seconds("ts").alias("ts"), "sensor", "value", sensors.label(F.col("label")).alias("label"))


# ------------------------------------------------------------- text

_DATED = "[2024-01-01 10:00:00] {0} 2024-01-02T03:04:05Z tail 01/02/2024 03:04:05 {1} 2024.01.02 03:04:05 Jan 3, 2024 at 4 Feb 2024 05:06 PM 2024/01/02 03:04:05 2024-01-02 03:04:05"


def _fold_sql(column: str, patterns) -> str:
    for p in patterns:
        column = f"regexp_replace({column}, '{p}', '', 'g')"
    return column


@query(ctes("logs") + f", m AS (SELECT event_id, '{_DATED.split('{0}')[0]}' || message || '{_DATED.split('{0}')[1].split('{1}')[0]}' || template || '{_DATED.split('{1}')[1]}' AS m FROM logs) SELECT event_id, regexp_replace({_fold_sql('m', text.TIMESTAMPS)}, '^\\s+|\\s+$', '', 'g') AS message FROM m")
def msg_strip_timestamps(spark, d):
    a, rest = _DATED.split("{0}")
    b, c = rest.split("{1}")
    return views.logs(spark, d).select("event_id", text.strip_timestamps(F.concat(F.lit(a), "message", F.lit(b), "template", F.lit(c))).alias("message"))


_RAW_LOG = {0: """'level=info msg="' || message || '" x=1'""", 1: """'{"msg":"' || message || '","a":1}'""", 2: """'msg="' || message""", 3: "' ' || message || ' '", 4: """'{"msg": broken ' || message"""}


@query(ctes("logs") + ", r AS (SELECT event_id, CASE event_id % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _RAW_LOG.items()) + """ END AS log FROM logs) SELECT event_id, regexp_replace(regexp_replace(CASE WHEN contains(log, 'msg:') OR contains(log, '"msg":') THEN CASE WHEN json_valid(log) THEN coalesce(json_extract_string(CASE WHEN json_valid(log) THEN log END, '$.msg'), '') ELSE log END
 WHEN contains(log, 'msg=') OR contains(log, '"msg"=') THEN regexp_extract(log, 'msg"?=[^"]*"([^"]*)', 1) ELSE log END, '^\\s+|\\s+$', '', 'g'), '^"|"$', '', 'g') AS message FROM r""")
def msg_extract(spark, d):
    raw = F.expr("case event_id % 5 " + " ".join(f"when {k} then {v}" for k, v in _RAW_LOG.items()) + " end")
    return views.logs(spark, d).select("event_id", text.trim_quotes(text.extract_message(raw)).alias("message"))


@query(ctes("logs") + r""", l AS (SELECT event_id, ts || '  ' || entity || ': ' || message AS line FROM logs) SELECT event_id, regexp_extract(line, '^(.*?)\s+(.*?):\s+(.*?)$', 1) AS time, regexp_extract(line, '^(.*?)\s+(.*?):\s+(.*?)$', 2) AS component, regexp_extract(line, '^(.*?)\s+(.*?):\s+(.*?)$', 3) AS content FROM l""")
def log_format_split(spark, d):
    lines = views.logs(spark, d).select("event_id", F.concat(F.col("ts").cast("string"), F.lit("  "), "entity", F.lit(": "), "message").alias("line"))
    f = text.split_by_format(F.col("line"), "<Time> <Component>: <Content>")
    return lines.select("event_id", f["Time"].alias("time"), f["Component"].alias("component"), f["Content"].alias("content"))


_MASK_SQL = "message"
for _p, _by in text.MASKS:
    _MASK_SQL = f"regexp_replace({_MASK_SQL}, '{_p}', '{_by}', 'g')"


@query(ctes("logs") + f", m AS (SELECT event_id, {_MASK_SQL} AS template FROM logs) SELECT event_id, template, substr(md5(template), 1, 8) AS id, CAST(len(regexp_split_to_array(template, '\\s+')) AS INT) AS n_tokens, CAST(len(list_filter(regexp_split_to_array(template, '\\s+'), lambda x: regexp_matches(x, '[0-9]'))) AS INT) AS n_digits FROM m")
def template_mask_hash(spark, d):
    m = views.logs(spark, d).select("event_id", text.mask(F.col("message")).alias("template"))
    toks = text.tokens(F.col("template"))
    return m.select("event_id", "template", text.template_id(F.col("template")).alias("id"), F.size(toks).alias("n_tokens"), F.size(F.filter(toks, text.has_digit)).alias("n_digits"))


@query(ctes("logs") + ", m AS (SELECT event_id, message, template || ' status <*>' AS template FROM logs) SELECT event_id, template, regexp_extract(message, ' status (.*?)$', 1) AS parameter, count(*) OVER (PARTITION BY template) AS occurrence, row_number() OVER (PARTITION BY template ORDER BY event_id) AS so_far FROM m")
def template_counts(spark, d):
    m = views.logs(spark, d).withColumn("template", F.concat("template", F.lit(" status <*>")))
    w = Window.partitionBy("template")
    p = text.template_parameters(F.col("message"), F.col("template"))
    return m.select("event_id", "template", p[0].alias("parameter"), F.count("*").over(w).alias("occurrence"), F.row_number().over(w.orderBy("event_id")).cast("long").alias("so_far"))


@query(ctes("logs") + f", m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN message WHEN 1 THEN 'id 15034 ' || template WHEN 2 THEN 'Azure ' || message ELSE template || ' fine' END AS m FROM logs) SELECT event_id, CAST(regexp_matches(m, '{text.ABNORMAL}') AS INT) AS abnormal FROM m")
def abnormal_flag(spark, d):
    m = F.expr("case event_id % 4 when 0 then message when 1 then concat('id 15034 ', template) when 2 then concat('Azure ', message) else concat(template, ' fine') end")
    return views.logs(spark, d).select("event_id", text.abnormal(m).alias("abnormal"))


@query("SELECT DISTINCT l_shipmode AS pod, l_shipmode AS service FROM (SELECT 'x' AS l_shipmode) WHERE false UNION ALL SELECT DISTINCT event_type || '-' || (user_id % 3) || 'f-' || user_id AS pod, regexp_replace(event_type || '-' || (user_id % 3) || 'f-' || user_id, '-[^-]*-[^-]*$', '') AS service FROM events")
def service_name(spark, d):
    pod = F.concat("event_type", F.lit("-"), F.col("user_id") % 3, F.lit("f-"), "user_id")
    return table(spark, d, "events").select(pod.alias("pod")).distinct().select("pod", text.service_name(F.col("pod")).alias("service"))


@query(ctes("logs") + """, r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'adservice-1-2' WHEN 1 THEN 'frontend-7-8' ELSE 'ts-order-service-9-x' END AS pod,
 CASE event_id % 3 WHEN 0 THEN '{"log":"' || message || '  "}' WHEN 1 THEN '{"log":"{\\"message\\":\\"' || message || '\\"}"}' ELSE '{"log":"a  call#' || template || ' b"}' END AS log FROM logs)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'adservice' WHEN 1 THEN 'frontend' ELSE 'ts-order-service' END AS service, CASE event_id % 3 WHEN 0 THEN rtrim(json_extract_string(log, '$.log')) WHEN 1 THEN json_extract_string(json_extract_string(log, '$.log'), '$.message') ELSE regexp_extract(json_extract_string(log, '$.log'), '  (.+?#.+?) ', 1) END AS message FROM r""".replace("\\\\", "\\"))
def unwrap_json(spark, d):
    m, t = F.col("message"), F.col("template")
    kind = F.col("event_id") % 3
    pod = F.when(kind == 0, "adservice-1-2").when(kind == 1, "frontend-7-8").otherwise("ts-order-service-9-x")
    log = F.when(kind == 0, F.concat(F.lit('{"log":"'), m, F.lit('  "}'))).when(kind == 1, F.concat(F.lit('{"log":"{\\"message\\":\\"'), m, F.lit('\\"}"}'))).otherwise(F.concat(F.lit('{"log":"a  call#'), t, F.lit(' b"}')))
    out, service = text.unwrap_service(log, pod)
    return views.logs(spark, d).select("event_id", service.alias("service"), out.alias("message"))


@query(ctes("logs") + " SELECT event_id, CAST(to_json({'log': {'message': message, 'severity': 'info', 'timestamp': CAST(ts AS VARCHAR)}, 'stream': 'stdout', 'time': CAST(ts AS VARCHAR)}) AS VARCHAR) AS line, strftime(to_timestamp(ts + 32400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS local, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date, CAST(hour(to_timestamp(ts) AT TIME ZONE 'UTC') AS INT) AS hour FROM logs")
def log_envelope(spark, d):
    ts = F.col("ts")
    at = text.date_hour(ts)
    return views.logs(spark, d).select("event_id", text.log_envelope(F.col("message"), ts.cast("string")).alias("line"), text.local_time(ts).alias("local"), at["date"].cast("string").alias("date"), at["hour"].alias("hour"))


# ------------------------------------------------------------- windows

_WINDOWS = """, t AS (SELECT entity, ts AS t, {extra} FROM {source}), span AS (SELECT entity, min(t) AS t0, max(t) AS t1, count(*) AS total FROM t GROUP BY 1
), k AS (SELECT entity, t0, unnest(range(0, greatest(0, CAST(ceil((t1 - t0 - {width} + 1) / {step}) AS BIGINT)) + 1)) AS k FROM span
), cum AS (SELECT entity, t, count(*) OVER w AS c {cums} FROM t WINDOW w AS (PARTITION BY entity ORDER BY t RANGE UNBOUNDED PRECEDING)
), one AS (SELECT entity, t, max(c) AS c {maxes} FROM cum GROUP BY 1, 2
), lo AS (SELECT k.entity, k.k, coalesce(o.c, 0) AS c {reads} FROM k ASOF LEFT JOIN one o ON k.entity = o.entity AND k.t0 + k.k * {step} > o.t
), hi AS (SELECT k.entity, k.k, coalesce(o.c, 0) AS c {reads} FROM k ASOF LEFT JOIN one o ON k.entity = o.entity AND k.t0 + k.k * {step} + {width} > o.t
), win AS (SELECT lo.entity, lo.c AS lo, hi.c AS hi, min(lo.k) AS k {diffs} FROM lo JOIN hi USING (entity, k) WHERE lo.c < hi.c GROUP BY 1, 2, 3)
, ranked AS (SELECT entity, t, row_number() OVER (PARTITION BY entity ORDER BY t) - 1 AS i FROM t)"""


def _windows_sql(source: str, width: int, step: int, sums: dict[str, str] | None = None) -> str:
    sums = sums or {}
    return _WINDOWS.format(
        source=source, width=width, step=step, extra=", ".join(f"{v} AS _{n}" for n, v in sums.items()) or "0 AS _z",
        cums="".join(f", sum(_{n}) OVER w AS {n}" for n in sums), maxes="".join(f", arg_max({n}, c) AS {n}" for n in sums),
        reads="".join(f", coalesce(o.{n}, 0) AS {n}" for n in sums), diffs="".join(f", any_value(hi.{n} - lo.{n}) AS {n}" for n in sums),
    )


@query(ctes("logs") + _windows_sql("logs", 1800, 30) + " SELECT w.entity, w.lo, w.hi, w.k, w.hi - w.lo AS occurrence, s.t AS start_t, e.t AS end_t FROM win w JOIN ranked s ON s.entity = w.entity AND s.i = w.lo JOIN ranked e ON e.entity = w.entity AND e.i = w.hi - 1")
def sliding_log_frequency(spark, d):
    logs = views.logs(spark, d)
    w = windows.window_times(windows.sliding_windows(logs, "entity", "ts", 1800, 30))
    return w.select("entity", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "k", F.col("n").cast("long").alias("occurrence"), "start_t", "end_t")


@query(ctes("logs") + _windows_sql("logs", 600, 30, {"abnormal": f"CAST(regexp_matches(message, '{text.ABNORMAL}') AS INT)"}) + ", tot AS (SELECT entity, count(*) AS n FROM t GROUP BY 1) SELECT w.entity, w.lo, w.hi, CAST(w.abnormal AS BIGINT) AS abnormal, e.t AS end_t FROM win w JOIN tot ON tot.entity = w.entity JOIN ranked e ON e.entity = w.entity AND e.i = least(w.hi, tot.n - 1)")
def sliding_golden_signal(spark, d):
    logs = views.logs(spark, d).withColumn("flag", text.abnormal(F.col("message")))
    w = windows.window_times(windows.sliding_windows(logs, "entity", "ts", 600, 30, {"abnormal": "flag"}), end="after")
    return w.select("entity", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.col("abnormal").cast("long").alias("abnormal"), "end_t")


@query(ctes("obs") + ", o2 AS (SELECT metric AS entity, ts, value FROM obs)" + _windows_sql("o2", 7200, 600, {"total": "value"}) + " SELECT entity, lo, hi, round(total / (hi - lo), 6) AS mean FROM win")
def sliding_kpi_mean(spark, d):
    w = windows.sliding_windows(views.observations(spark, d), "metric", "ts", 7200, 600, {"total": "value"})
    return w.select("entity", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.round(F.col("total") / F.col("n"), 6).alias("mean"))


_BUCKETS = ctes("logs") + _windows_sql("logs", 1800, 30) + """, v AS (SELECT w.entity, s.t AS start_t, w.lo, w.hi FROM win w JOIN ranked s ON s.entity = w.entity AND s.i = w.lo
), b AS (SELECT entity, (start_t - min(start_t) OVER (PARTITION BY entity)) // 3600 AS bucket, lo, hi FROM v
), f AS (SELECT entity, bucket, arg_max(hi - lo, hi * 1000000000 + lo) AS value FROM b GROUP BY 1, 2
), g AS (SELECT entity, unnest(range(0, max(bucket) + 1)) AS bucket FROM f GROUP BY 1
), d AS (SELECT g.entity, g.bucket, f.value FROM g LEFT JOIN f USING (entity, bucket))"""


def _dense(spark, d):
    logs = views.logs(spark, d)
    w = windows.window_times(windows.sliding_windows(logs, "entity", "ts", 1800, 30)).withColumn("v", F.col("n").cast("double"))
    return windows.dense_grid(windows.bucket_values(w, "v", 3600))


@query(_BUCKETS + """ SELECT entity, bucket, CAST(value AS DOUBLE) AS value FROM (SELECT d.entity, d.bucket, x.value, row_number() OVER (PARTITION BY d.entity, d.bucket ORDER BY abs(x.bucket - d.bucket), x.bucket) AS r FROM d JOIN f x ON x.entity = d.entity) WHERE r = 1""")
def bucket_nearest_fill(spark, d):
    return windows.nearest_fill(_dense(spark, d)).select("entity", "bucket", "value")


@query(_BUCKETS + """, p AS (SELECT entity, bucket, value, avg(value) OVER (PARTITION BY entity ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM f)
SELECT d.entity, d.bucket, round(CASE WHEN p.bucket IS NULL THEN 0 WHEN d.bucket - p.bucket >= 10 THEN coalesce(p.m, p.value) ELSE p.value END, 6) AS value FROM d ASOF LEFT JOIN p ON d.entity = p.entity AND d.bucket >= p.bucket""")
def bucket_hold_fill(spark, d):
    return windows.hold_fill(_dense(spark, d)).select("entity", "bucket", r6("value"))


@query(ctes("logs") + ", g AS (SELECT entity, ts, coalesce(CAST(ts - lag(ts) OVER (PARTITION BY entity ORDER BY ts) > 3600 AS INT), 0) AS new FROM logs), s AS (SELECT entity, ts, sum(new) OVER (PARTITION BY entity ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g) SELECT entity, CAST(s AS BIGINT) AS session, min(ts) AS start_t, max(ts) AS end_t, count(*) AS n FROM s GROUP BY 1, 2")
def session_runs(spark, d):
    return windows.session_windows(views.logs(spark, d), "entity", "ts", 3600)


@query(ctes("logs") + _windows_sql("logs", 1800, 30) + ", ev AS (SELECT entity, template, row_number() OVER (PARTITION BY entity ORDER BY ts) - 1 AS i, ts FROM logs), n AS (SELECT w.entity, w.lo, w.hi, e.template, count(*) AS n FROM win w JOIN ev e ON e.entity = w.entity AND e.i >= w.lo AND e.i < w.hi GROUP BY 1, 2, 3, 4) SELECT entity, lo, hi, string_agg(template || '=' || n, ',' ORDER BY template) AS frequencies FROM n GROUP BY 1, 2, 3")
def window_templates(spark, d):
    logs = views.logs(spark, d)
    f = windows.template_frequencies(windows.sliding_windows(logs, "entity", "ts", 1800, 30), logs, "entity", "ts", "template")
    pairs = F.transform(F.map_entries("frequencies"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return f.select("entity", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.array_join(pairs, ",").alias("frequencies"))


@query(ctes("logs") + ", s AS (SELECT entity, min(ts) AS start_t, max(ts) AS end_t FROM logs GROUP BY 1) SELECT *, max(start_t) OVER (ORDER BY entity) AS last_start, min(end_t) OVER (ORDER BY entity) AS least_end FROM s")
def entity_spans(spark, d):
    return windows.entity_spans(views.logs(spark, d), "entity", "ts")


# ------------------------------------------------------------- preparation

_W = ctes("weekly0", "weekly", "weekly_kpi")
_PATCH = _W + """, idx AS (SELECT metric, ts, row_number() OVER (PARTITION BY metric ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM (SELECT DISTINCT metric, ts FROM weekly)
), pat AS (SELECT w.metric, w.entity, i // 10 AS patch, sum(value) AS value FROM weekly w JOIN idx USING (metric, ts) WHERE i < n // 10 * 10 GROUP BY 1, 2, 3)"""


def _patched(spark, d):
    return prep.patches(views.weekly(spark, d), ["metric"], ["metric", "entity"], 10)


@query(_PATCH + " SELECT metric, entity, patch, round(value, 4) AS value FROM pat")
def patch_sum(spark, d):
    return _patched(spark, d).select("metric", "entity", "patch", F.round("value", 4).alias("value"))


@query(_W + ", i AS (SELECT ts, value, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM weekly_kpi) SELECT i // 15 AS patch, round(avg(value), 4) AS value FROM i WHERE i < n // 15 * 15 GROUP BY 1")
def patch_mean(spark, d):
    k = views.weekly_kpi(spark, d).withColumn("case", F.lit("a"))
    return prep.patches(k, ["case"], ["case"], 15, how="mean").select("patch", F.round("value", 4).alias("value"))


@query(_W + " SELECT metric, entity, ts, round(value / nullif(sum(abs(value)) OVER (PARTITION BY metric, entity), 0), 9) AS share FROM weekly")
def l1_normalise(spark, d):
    return views.weekly(spark, d).select("metric", "entity", "ts", F.round(numeric.l1(F.col("value"), "metric", "entity"), 9).alias("share"))


@query(_W + " SELECT metric, entity, ts, round(coalesce((value - min(value) OVER s) / nullif(max(value) OVER s - min(value) OVER s, 0), 0), 6) AS scaled, round(coalesce((value - avg(value) OVER s) / nullif(stddev_samp(value) OVER s, 0), 0), 6) AS z, round(value / sqrt(sum(value * value) OVER s), 8) AS unit FROM weekly WINDOW s AS (PARTITION BY metric, entity)")
def minmax(spark, d):
    v, s = F.col("value"), ("metric", "entity")
    return views.weekly(spark, d).select("metric", "entity", "ts", F.round(numeric.min_max(v, *s), 6).alias("scaled"), F.round(numeric.z_score(v, *s), 6).alias("z"), F.round(numeric.l2(v, *s), 8).alias("unit"))


@query(_W + ", x AS (SELECT metric, entity, ts, CASE WHEN entity = 's1' AND metric = 'tax' THEN 1.0 WHEN entity = 's2' AND metric = 'tax' AND ts % 20 <> 0 THEN 7.0 ELSE value END AS value FROM weekly), v AS (SELECT metric, entity, var_pop(value) AS v, min(value) <> max(value) AS moves, avg(CAST(value <> f AS INT)) > 0.1 AS often FROM (SELECT *, first_value(value) OVER (PARTITION BY metric, entity ORDER BY ts) AS f FROM x) GROUP BY 1, 2) SELECT metric, entity, count(*) AS n FROM x JOIN v USING (metric, entity) WHERE v > 0 AND moves AND often GROUP BY 1, 2")
def variance_gate(spark, d):
    x = views.weekly(spark, d).withColumn("value", F.expr("case when entity = 's1' and metric = 'tax' then 1.0D when entity = 's2' and metric = 'tax' and ts % 20 <> 0 then 7.0D else value end"))
    s = ["metric", "entity"]
    return prep.variance_gate(prep.drop_constant(prep.drop_near_constant(x, s), s), ["metric"], s).groupBy(*s).agg(F.count("*").alias("n"))


@query("""WITH n(entity) AS (VALUES ('main_a'), ('redis_x'), ('rabbitmq-1'), ('cart_cpu'), ('cart_mem'), ('a_lat50'), ('x-frontend-external'), ('session'), ('time.1'), ('Score_1'), ('queue-master_latency'), ('pay_latency')), o AS (SELECT entity, event_id, value * CASE WHEN entity = 'cart_mem' THEN 0.000001 ELSE 1 END AS value FROM n, events)
, k AS (SELECT * FROM o WHERE NOT regexp_matches(entity, '^(main_|PassthroughCluster_|redis_|rabbitmq|queue|session|istio-proxy)|frontend-external|^time\\.1$')), s AS (SELECT entity, stddev_samp(value) AS sd FROM k GROUP BY 1)
SELECT s.entity, (ends_with(entity, '_cpu') OR ends_with(entity, '_mem')) AND sd > 1 OR contains(entity, 'lat50') AND sd * 1000 > 10 AS useful, regexp_matches(entity, 'Score|golden_signal|cost|occurrence|latency|Latency|latency-50|_error') AND NOT regexp_matches(entity, 'queue-master|rabbitmq_') AS is_kpi, round(CASE WHEN ends_with(entity, '_mem') THEN m / 1e6 ELSE m END, 9) AS mean_mb FROM s JOIN (SELECT entity, avg(value) AS m FROM k GROUP BY 1) USING (entity)""".replace("\\\\", "\\"))
def column_rules(spark, d):
    return _column_rules(table(spark, d, "events"))


def _column_rules(events):
    names = ["main_a", "redis_x", "rabbitmq-1", "cart_cpu", "cart_mem", "a_lat50", "x-frontend-external", "session", "time.1", "Score_1", "queue-master_latency", "pay_latency"]
    e = events.withColumn("entity", F.explode(F.array(*map(F.lit, names))))
    o = prep.drop_extra(e.select("entity", (F.col("value") * F.when(F.col("entity") == "cart_mem", 1e-6).otherwise(1.0)).alias("value")))
    use, kpi = prep.useful(o).select("entity").distinct().withColumn("useful", F.lit(True)), prep.kpi_columns(o).select("entity").distinct().withColumn("is_kpi", F.lit(True))
    m = o.groupBy("entity").agg(F.avg("value").alias("m"))
    return m.join(use, "entity", "left").join(kpi, "entity", "left").select("entity", F.coalesce("useful", F.lit(False)).alias("useful"), F.coalesce("is_kpi", F.lit(False)).alias("is_kpi"), F.round(numeric.megabytes(F.col("entity"), F.col("m")), 9).alias("mean_mb"))


@query(_W + ", g AS (SELECT metric, entity, ts, CASE WHEN ts % 3 = 0 THEN value END AS value FROM weekly) SELECT metric, entity, ts, round(coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY metric, entity ORDER BY ts ROWS UNBOUNDED PRECEDING), 0), 4) AS value FROM g")
def forward_fill(spark, d):
    g = views.weekly(spark, d).withColumn("value", F.when(F.col("ts") % 3 == 0, F.col("value")))
    return prep.forward_fill(g, ["metric", "entity"]).select("metric", "entity", "ts", F.round("value", 4).alias("value"))


@query(ctes("obs") + " SELECT event_id, (ts // 300 + 1) * 300 AS next FROM obs")
def next_on_grid(spark, d):
    return views.observations(spark, d).select("event_id", numeric.next_on_grid(F.col("ts"), 300).alias("next"))


@query("SELECT DISTINCT a.s AS sensor FROM (SELECT (user_id % 3) || '_' || event_type || '_' || (user_id % 7) AS s, event_type AS m FROM events WHERE event_id % 2 = 0) a JOIN (SELECT (user_id % 3) || '_' || event_type || '_' || (user_id % 7) AS s FROM events WHERE event_id % 2 = 1 AND user_id % 5 > 1) b USING (s) WHERE m IN ('error', 'click')")
def common_metrics(spark, d):
    e = table(spark, d, "events").withColumn("sensor", F.concat_ws("_", F.col("user_id") % 3, "event_type", F.col("user_id") % 7))
    return sensors.common_metrics(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1 and user_id % 5 > 1"), ["error", "click"])


@query(_W + ", i AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM weekly_kpi) SELECT ts, CASE WHEN i < n - ceil(n * 0.6) THEN 'train' ELSE 'test' END AS part FROM i")
def train_test_split(spark, d):
    return prep.train_test(views.weekly_kpi(spark, d).withColumn("case", F.lit("a")), ["case"]).select("ts", "part")


@query(_W + ", g AS (SELECT metric, entity, ts, value, lag(value, 1) OVER s AS l1, lag(value, 2) OVER s AS l2 FROM weekly WINDOW s AS (PARTITION BY metric, entity ORDER BY ts)) SELECT metric, entity, ts, round(l1, 4) AS lag_1, round(l2, 4) AS lag_2 FROM g WHERE l2 IS NOT NULL")
def lag_matrix(spark, d):
    return prep.lags(views.weekly(spark, d), ["metric", "entity"], 2).select("metric", "entity", "ts", F.round("lag_1", 4).alias("lag_1"), F.round("lag_2", 4).alias("lag_2"))


@query(_W + ", g AS (SELECT metric, entity, ts, list(CAST(round(value) AS BIGINT)) OVER (PARTITION BY metric, entity ORDER BY ts ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS i, list(CAST(round(value) AS BIGINT)) OVER (PARTITION BY metric, entity ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS t FROM weekly) SELECT metric, entity, ts, array_to_string(i, ',') AS input, array_to_string(t, ',') AS target FROM g WHERE len(t) = 5")
def context_windows(spark, d):
    c = prep.context_windows(views.weekly(spark, d), ["metric", "entity"], 5)
    whole = lambda a: F.array_join(F.transform(a, lambda x: F.round(x).cast("long").cast("string")), ",").alias(a)
    return c.select("metric", "entity", "ts", whole("input"), whole("target"))


# ------------------------------------------------------------- scorers

_SPLIT = _PATCH + """, norm AS (SELECT metric, entity, patch, value / nullif(sum(abs(value)) OVER (PARTITION BY metric, entity), 0) AS value FROM pat
), pi AS (SELECT DISTINCT metric, patch FROM norm), pr AS (SELECT metric, patch, row_number() OVER (PARTITION BY metric ORDER BY patch) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM pi
), h AS (SELECT n.*, i < least(floor(0.6 * n.n0), n.n0 - 3) AS normal, i >= n.n0 - greatest(n.n0 - floor(0.6 * n.n0), 3) AS anomalous FROM (SELECT norm.*, pr.i, pr.n AS n0 FROM norm JOIN pr USING (metric, patch)) n
), ok AS (SELECT metric, entity FROM h GROUP BY 1, 2 HAVING var_pop(value) > 0)"""


def _split(spark, d):
    p = _patched(spark, d).withColumn("value", numeric.l1(F.col("value"), "metric", "entity")).withColumnRenamed("patch", "ts")
    p = prep.variance_gate(p, ["metric"], ["metric", "entity"], least=0.0)
    a = prep.time_index(p, ["metric"]).groupBy("metric").agg(F.floor(F.count("*") * 0.6).alias("a"))
    return scorers.halves(p, ["metric"], a)


_ROBUST = _SPLIT + """, q AS (SELECT metric, entity, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b, avg(value) AS mean, stddev_pop(value) AS sd FROM h JOIN ok USING (metric, entity) WHERE normal GROUP BY 1, 2 HAVING min(value) <> max(value)
), t AS (SELECT metric, entity, max(value) AS top FROM h JOIN ok USING (metric, entity) WHERE anomalous GROUP BY 1, 2 HAVING min(value) <> max(value))"""


@query(_ROBUST + ", s AS (SELECT entity, sum((top - m) / CASE WHEN b = a THEN 1 ELSE b - a END) AS score FROM q JOIN t USING (metric, entity) GROUP BY 1) SELECT entity, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, entity) AS INT) AS rank FROM s")
def robust_scorer(spark, d):
    """The flagship: weekly series to pooled, normalised, gated matrices, robust scores per metric, their sum, and the ranking."""
    s = rank.sum_over_metrics(scorers.robust_scores(_split(spark, d), ["metric"]).withColumn("case_id", F.lit("a")), ["case_id"])
    return rank.ranked(s, ["case_id"]).select("entity", r6("score"), "rank")


@query(_ROBUST + " SELECT metric, entity, round((top - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS score FROM q JOIN t USING (metric, entity)")
def nsigma_scorer(spark, d):
    return scorers.nsigma_scores(_split(spark, d), ["metric"]).select("metric", "entity", r6("score"))


@query(_SPLIT + """, x AS (SELECT metric, entity, value FROM h JOIN ok USING (metric, entity) WHERE normal), y AS (SELECT metric, entity, value FROM h JOIN ok USING (metric, entity) WHERE anomalous)
, xy AS (SELECT metric, entity, avg(abs(x.value - y.value)) AS d FROM x JOIN y USING (metric, entity) GROUP BY 1, 2), xx AS (SELECT a.metric, a.entity, avg(abs(a.value - b.value)) AS d FROM x a JOIN x b USING (metric, entity) GROUP BY 1, 2), yy AS (SELECT a.metric, a.entity, avg(abs(a.value - b.value)) AS d FROM y a JOIN y b USING (metric, entity) GROUP BY 1, 2)
SELECT metric, entity, round(2 * xy.d - xx.d - yy.d, 8) AS score FROM xy JOIN xx USING (metric, entity) JOIN yy USING (metric, entity)""")
def epsilon_stat(spark, d):
    return scorers.epsilon_scores(_split(spark, d), ["metric"]).select("metric", "entity", F.round("score", 8).alias("score"))


@query(_W + ", e AS (SELECT metric, entity, ts, value, row_number() OVER o - 1 AS i, avg(value) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, stddev_samp(value) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sd FROM weekly WINDOW o AS (PARTITION BY metric, entity ORDER BY ts)) SELECT metric, entity, ts, i AS row FROM e WHERE i >= 20 AND abs(value - m) > 1.5 * sd")
def expanding_nsigma(spark, d):
    return scorers.expanding_nsigma(views.weekly(spark, d), ["metric", "entity"], k=1.5, starts=20).select("metric", "entity", "ts", F.col("row").cast("long").alias("row"))


@query(ctes("obs") + ", i AS (SELECT entity, event_id, value, row_number() OVER (PARTITION BY entity ORDER BY event_id) - 1 AS row FROM obs), a AS (SELECT *, lag(row) OVER (PARTITION BY entity ORDER BY event_id) AS p FROM i WHERE value > 80) SELECT entity, event_id, row FROM a WHERE p IS NULL OR row - p > 5")
def anomaly_merge(spark, d):
    o = views.observations(spark, d)
    return scorers.threshold_anomalies(o, ["entity"], 80.0, ts="event_id").select("entity", "event_id", F.col("row").cast("long").alias("row"))


@query(ctes("obs") + ", i AS (SELECT entity, event_id, value, row_number() OVER (PARTITION BY entity ORDER BY event_id) - 1 AS row FROM obs), a AS (SELECT *, lag(row) OVER (PARTITION BY entity ORDER BY event_id) AS p FROM i WHERE value > CASE WHEN entity < 'u5' THEN 80 ELSE 1e9 END), k AS (SELECT entity, event_id, row FROM a WHERE p IS NULL OR row - p > 5) SELECT * FROM k UNION ALL SELECT entity, arg_max(event_id, (value, -row)), arg_max(row, (value, -row)) FROM i WHERE row >= 5 AND entity NOT IN (SELECT entity FROM k) GROUP BY 1")
def anomaly_or_peak(spark, d):
    o = views.observations(spark, d).withColumn("value", F.when(F.col("entity") < "u5", F.col("value")).otherwise(F.col("value") - 1e9))
    return scorers.anomalies_or_peak(o, ["entity"], 80.0, ts="event_id").select("entity", "event_id", F.col("row").cast("long").alias("row"))


@query(ctes("obs") + ", m AS (SELECT entity, event_id AS i, CAST(floor(value / 40) AS BIGINT) AS m FROM obs), j AS (SELECT *, abs(m - lag(m) OVER (PARTITION BY entity ORDER BY i)) AS jump FROM m) SELECT entity, i, jump FROM j WHERE jump > 1")
def change_point_jumps(spark, d):
    m = views.observations(spark, d).select("entity", F.col("event_id").alias("i"), F.floor(F.col("value") / 40).alias("m"))
    return scorers.run_length_changes(m, ["entity"]).select("entity", "i", "jump")


_MOMENT = _W + ", g AS (SELECT metric, entity, ts, value / 1000 AS value, ts % 2 AS half FROM weekly), mom AS (SELECT a.metric, a.half, a.entity AS a, b.entity AS b, avg(a.value * b.value) AS m FROM g a JOIN g b ON a.metric = b.metric AND a.ts = b.ts AND a.entity <= b.entity GROUP BY 1, 2, 3, 4)"


def _moments(spark, d):
    g = views.weekly(spark, d).withColumn("value", F.col("value") / 1000).withColumn("half", F.col("ts") % 2)
    return scorers.second_moment(g, ["metric", "half"], "ts")


@query(_MOMENT + " SELECT metric, half, a, b, round(m, 4) AS m FROM mom")
def second_moment(spark, d):
    return _moments(spark, d).select("metric", "half", "a", "b", F.round("m", 4).alias("m"))


@query(_MOMENT + " SELECT l.metric, round(sqrt(sum(power(ln(1 + l.m) - ln(1 + r.m), 2) * CASE WHEN l.a = l.b THEN 1 ELSE 2 END)), 6) AS distance FROM mom l JOIN mom r ON l.metric = r.metric AND l.a = r.a AND l.b = r.b AND l.half = 0 AND r.half = 1 GROUP BY 1")
def log_euclid(spark, d):
    m = _moments(spark, d)
    return scorers.log_euclidean(m.where("half = 0"), m.where("half = 1"), ["metric"]).select("metric", r6("distance"))


@query(ctes("obs") + """, s AS (SELECT entity, metric, row_number() OVER (PARTITION BY entity, metric ORDER BY ts, event_id) - 1 AS i, value / 100 AS v FROM obs)
, g AS (SELECT entity, metric, i, v, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, false AS alarm FROM s WHERE i = 0
 UNION ALL SELECT n.entity, n.metric, n.i, n.v, CASE WHEN greatest(0, g.up + n.v - g.v - 0.05) > 0.8 OR greatest(0, g.down - (n.v - g.v) - 0.05) > 0.8 THEN 0 ELSE greatest(0, g.up + n.v - g.v - 0.05) END, CASE WHEN greatest(0, g.up + n.v - g.v - 0.05) > 0.8 OR greatest(0, g.down - (n.v - g.v) - 0.05) > 0.8 THEN 0 ELSE greatest(0, g.down - (n.v - g.v) - 0.05) END, greatest(0, g.up + n.v - g.v - 0.05) > 0.8 OR greatest(0, g.down - (n.v - g.v) - 0.05) > 0.8 FROM g JOIN s n ON n.entity = g.entity AND n.metric = g.metric AND n.i = g.i + 1)
SELECT entity, metric, i AS alarm FROM g WHERE alarm""")
def cusum_alarms(spark, d):
    return detect.cusum_alarms(_numbered(spark, d), ["entity", "metric"], 0.8, 0.05, ts="at").select("entity", "metric", "alarm")


def _numbered(spark, d):
    return views.observations(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("entity", "metric").orderBy("ts", "event_id"))).withColumn("value", F.col("value") / 100)


@query()
def cusum_ends(spark, d):
    return detect.cusum_ends(_numbered(spark, d), ["entity", "metric"], 0.8, 0.05, ts="at").select("entity", "metric", "alarm", "start", "end", r6("amplitude"))


_CORR = _W + ", c AS (SELECT a.metric, a.entity AS a, b.entity AS b, corr(a.value, b.value) AS r, count(*) AS n FROM weekly a JOIN weekly b ON a.metric = b.metric AND a.ts = b.ts AND a.entity < b.entity GROUP BY 1, 2, 3)"


def _corr(spark, d):
    return scorers.correlations(views.weekly(spark, d), ["metric"], "ts")


@query(_CORR + " SELECT metric, a, b, round(r, 6) AS r, n FROM c")
def corr_matrix(spark, d):
    return _corr(spark, d).select("metric", "a", "b", r6("r"), "n")


@query(_CORR + f" SELECT metric, a, b, round(0.5 * ln(1 + 2 * least(abs(r), 0.999999) / (1 - least(abs(r), 0.999999))), 6) AS z, round({numeric.normal_quantile(1 - 1e-6 / 2)!r} / sqrt(n - 3), 6) AS critical FROM c")
def ci_tests_l0(spark, d):
    return causal.tests_order_0(_corr(spark, d), ["metric"]).select("metric", "a", "b", r6("z"), r6("critical"))


_PARTIAL = _CORR + ", u AS (SELECT metric, a, b, r, n FROM c UNION ALL SELECT metric, b, a, r, n FROM c), p AS (SELECT c.metric, c.a, c.b, x.b AS c, c.n, (c.r - x.r * y.r) / sqrt(greatest((1 - x.r * x.r) * (1 - y.r * y.r), 1e-12)) AS p FROM c JOIN u x ON x.metric = c.metric AND x.a = c.a AND x.b <> c.b JOIN u y ON y.metric = c.metric AND y.a = c.b AND y.b = x.b)"


@query(_PARTIAL + " SELECT metric, a, b, c, round(p, 6) AS partial FROM p")
def partial_corr_order1(spark, d):
    return causal.partial_order_1(_corr(spark, d), ["metric"]).select("metric", "a", "b", "c", r6("partial"))


@query(_PARTIAL + " SELECT metric, a, b, round(min(0.5 * ln(1 + 2 * least(abs(p), 0.999999) / (1 - least(abs(p), 0.999999)))), 6) AS z FROM p GROUP BY 1, 2, 3")
def ci_tests_l1(spark, d):
    return causal.tests_order_1(_corr(spark, d), ["metric"]).select("metric", "a", "b", r6("z"))


# ------------------------------------------------------------- graphs and walks

_EDGES = [("s0", "s1"), ("s1", "s2"), ("s3", "s2"), ("s2", "kpi"), ("s0", "kpi"), ("s1", "s0")]
_KR = _W + ", rk AS (SELECT w.metric, w.entity, abs(corr(w.value, k.value)) AS r FROM weekly w JOIN weekly_kpi k USING (ts) GROUP BY 1, 2 UNION ALL SELECT DISTINCT metric, 'kpi', 0.0 FROM weekly), ed(src, dst) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _EDGES) + """), bk AS (SELECT metric, dst AS src, src AS dst, r AS w FROM ed JOIN rk ON entity = src
), fw AS (SELECT metric, src, dst, 0.01 * r AS w FROM ed e JOIN rk ON entity = dst WHERE NOT EXISTS (SELECT 1 FROM ed f WHERE f.src = e.dst AND f.dst = e.src)), st AS (SELECT metric, src, dst, max(w) AS w FROM (SELECT * FROM bk UNION ALL SELECT * FROM fw) GROUP BY 1, 2, 3
), sf AS (SELECT rk.metric, entity AS src, entity AS dst, greatest(0, r - coalesce((SELECT max(w) FROM bk WHERE bk.metric = rk.metric AND bk.src = entity), 0)) AS w FROM rk), al AS (SELECT * FROM st UNION ALL SELECT * FROM sf
), tr AS (SELECT metric, src, dst, w / nullif(sum(w) OVER (PARTITION BY metric, src), 0) AS p FROM al)"""


def _transitions(spark, d):
    w, k = views.weekly(spark, d), views.weekly_kpi(spark, d).withColumnRenamed("value", "k")
    r = w.join(k, "ts").groupBy("metric", "entity").agg(F.abs(F.corr("value", "k")).alias("r"))
    r = r.unionByName(w.select("metric").distinct().select("metric", F.lit("kpi").alias("entity"), F.lit(0.0).alias("r")))
    e = w.select("metric").distinct().join(F.broadcast(spark.createDataFrame(_EDGES, "src string, dst string")))
    return causal.transitions(e, r, ["metric"])


@query(_KR + " SELECT metric, src, dst, round(p, 6) AS p FROM tr WHERE p > 0")
def transition_matrix(spark, d):
    return _transitions(spark, d).select("metric", "src", "dst", r6("p"))


@query(_KR + """, nd AS (SELECT DISTINCT metric, src AS entity FROM al UNION SELECT DISTINCT metric, dst FROM al), wk AS (SELECT metric, entity, CAST(entity = 'kpi' AS INT)::DOUBLE AS p, 0 AS i FROM nd
 UNION ALL SELECT n.metric, n.entity, coalesce(m.p, 0) + CASE WHEN n.entity = 'kpi' THEN 1 - t.s ELSE 0 END, n.i FROM (SELECT nd.metric, nd.entity, w.i + 1 AS i FROM nd JOIN (SELECT DISTINCT metric, i FROM wk) w USING (metric) WHERE w.i < 30) n
 LEFT JOIN (SELECT tr.metric, tr.dst AS entity, sum(0.95 * w.p * tr.p) AS p FROM wk w JOIN tr ON tr.metric = w.metric AND tr.src = w.entity WHERE tr.p > 0 GROUP BY 1, 2) m ON m.metric = n.metric AND m.entity = n.entity
 JOIN (SELECT w.metric, coalesce(sum(0.95 * w.p * tr.p), 0) AS s FROM wk w LEFT JOIN tr ON tr.metric = w.metric AND tr.src = w.entity AND tr.p > 0 GROUP BY 1) t ON t.metric = n.metric)
SELECT metric, entity, round(p, 6) AS score FROM wk WHERE i = 30""")
def walk_power_iteration(spark, d):
    return causal.walk(_transitions(spark, d), ["metric"], "kpi", steps=30).select("metric", "entity", r6("score"))


@query(_CORR + ", e AS (SELECT metric, a AS src, b AS dst, abs(r) AS weight FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY weight DESC, src, dst) AS i FROM e) SELECT metric, src, dst FROM k e WHERE weight >= (SELECT weight FROM k WHERE k.metric = e.metric AND i = 4) AND weight > 0")
def kth_threshold(spark, d):
    e = _corr(spark, d).select("metric", F.col("a").alias("src"), F.col("b").alias("dst"), F.abs("r").alias("weight"), F.lit(4).alias("n"))
    return rank.kth_threshold(e, ["metric"], "n").select("metric", "src", "dst")


@query(_CORR + ", e AS (SELECT metric, a AS src, b AS dst, abs(r) AS weight FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY weight DESC, src, dst) AS i FROM e) SELECT metric, src, dst FROM k e WHERE weight > greatest(0.02, coalesce((SELECT weight FROM k WHERE k.metric = e.metric AND i = 10), 0))")
def online_threshold(spark, d):
    e = _corr(spark, d).select("metric", F.col("a").alias("src"), F.col("b").alias("dst"), F.abs("r").alias("weight"), F.lit(4).alias("n"))
    return rank.online_threshold(e, ["metric"], "n", floor=0.02).select("metric", "src", "dst")


@query(_CORR + ", e AS (SELECT metric, a AS src, b AS dst, abs(r) AS weight FROM c), z AS (SELECT metric, weight FROM e UNION ALL SELECT metric, 0.0 FROM (SELECT metric, 16 - count(*) AS n FROM e GROUP BY 1), range(16) t(i) WHERE i < n), q AS (SELECT metric, quantile_cont(weight, 0.95) AS cut FROM z GROUP BY 1) SELECT metric, src, dst FROM e JOIN q USING (metric) WHERE weight > cut")
def quantile_edges(spark, d):
    e = _corr(spark, d).select("metric", F.col("a").alias("src"), F.col("b").alias("dst"), F.abs("r").alias("weight"), F.lit(4).alias("n"))
    return rank.quantile_edges(e, ["metric"], "n").select("metric", "src", "dst")


@query(_CORR + ", e AS (SELECT metric, a AS src, b AS dst FROM c UNION ALL SELECT metric, b, a FROM c), m AS (SELECT metric, CASE WHEN src IN ('s1', 's2') THEN 's12' ELSE src END AS src, CASE WHEN dst IN ('s1', 's2') THEN 's12' ELSE dst END AS dst FROM e) SELECT DISTINCT metric, src, dst FROM m WHERE src <> dst")
def node_merge(spark, d):
    c = _corr(spark, d)
    e = c.select("metric", F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(c.select("metric", F.col("b").alias("src"), F.col("a").alias("dst")))
    return rank.relabel_edges(e, spark.createDataFrame([("s1", "s12"), ("s2", "s12")], "node string, into string"), ["metric"])


@query(_CORR + " SELECT metric, a AS Cause, b AS Effect, round(abs(r), 6) AS Strength FROM c WHERE b = 's3'")
def effect_export(spark, d):
    e = _corr(spark, d).select("metric", F.col("a").alias("src"), F.col("b").alias("dst"), F.round(F.abs("r"), 6).alias("weight"))
    return rank.effects_on(e, "s3", ["metric"])


# ------------------------------------------------------------- combining and evaluating

_SC = _ROBUST + ", sc AS (SELECT metric, entity, (top - m) / CASE WHEN b = a THEN 1 ELSE b - a END AS score FROM q JOIN t USING (metric, entity))"


def _scores(spark, d):
    return scorers.robust_scores(_split(spark, d), ["metric"]).withColumn("case_id", F.lit("a"))


@query(_SC + " SELECT entity, round(sum(score), 6) AS score FROM sc GROUP BY 1")
def score_sum(spark, d):
    return rank.sum_over_metrics(_scores(spark, d), ["case_id"]).select("entity", r6("score"))


@query(_SC + ", a AS (SELECT entity, avg(score) AS s FROM sc GROUP BY 1) SELECT entity, round(s / sum(abs(s)) OVER (), 6) AS score FROM a")
def score_mean_l1(spark, d):
    return rank.mean_over_metrics(_scores(spark, d), ["case_id"]).select("entity", r6("score"))


@query(_SC + ", w AS (SELECT metric, max(score) AS w FROM sc GROUP BY 1), w2 AS (SELECT metric, w / sum(abs(w)) OVER () * p AS w FROM w JOIN (VALUES ('quantity', 1.0), ('price', 2.0), ('discount', 1.0), ('tax', 0.5)) p(metric, p) USING (metric)), w3 AS (SELECT metric, w / sum(abs(w)) OVER () AS w FROM w2), s AS (SELECT entity, sum(w * score) AS s FROM sc JOIN w3 USING (metric) GROUP BY 1) SELECT entity, round(s / sqrt(sum(s * s) OVER ()), 6) AS score FROM s")
def metric_weight_combine(spark, d):
    prior = spark.createDataFrame([("quantity", 1.0), ("price", 2.0), ("discount", 1.0), ("tax", 0.5)], "metric string, prior double")
    s = _scores(spark, d)
    return rank.weighted_combine(s, s, prior, "case_id").select("entity", r6("score"))


@query(_SC + " SELECT i.metric, i.entity, round(0.4 * i.score + 0.6 * n.score, 6) AS score FROM sc i JOIN (SELECT metric, entity, score / (1 + score) AS score FROM sc) n USING (metric, entity)")
def score_blend(spark, d):
    s = _scores(spark, d)
    return rank.blend(s, s.withColumn("score", F.col("score") / (1 + F.col("score"))), ["metric", "entity"], 0.4).select("metric", "entity", r6("score"))


@query("WITH p AS (SELECT s_suppkey AS pod, s_nationkey AS node, abs(s_acctbal) AS s FROM supplier), n AS (SELECT n_nationkey AS node, 1.0 + n_nationkey AS s FROM nation WHERE n_nationkey <> 3), j AS (SELECT pod, p.s * n.s AS s FROM p JOIN n USING (node)), k AS (SELECT pod, s / sum(s) OVER () AS s FROM j) SELECT pod, round(s / sqrt(sum(s * s) OVER ()), 6) AS score FROM k")
def hierarchical_score(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation").where("n_nationkey <> 3")
    pods = s.select(F.lit("a").alias("case_id"), F.col("s_suppkey").alias("pod"), F.abs("s_acctbal").alias("score"))
    nodes = n.select(F.lit("a").alias("case_id"), F.col("n_nationkey").alias("node"), (1.0 + F.col("n_nationkey")).alias("score"))
    p2n = s.select(F.col("s_suppkey").alias("pod"), F.col("s_nationkey").alias("node"))
    return rank.hierarchical(pods, nodes, p2n, "case_id").select("pod", r6("score"))


_RANKS = ctes("obs") + ", rg AS (SELECT metric AS case_id, entity, avg(value) AS score FROM obs GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, entity) AS rank FROM rg), tr AS (SELECT DISTINCT metric AS case_id, CASE WHEN length(metric) % 2 = 0 THEN 'u3' ELSE 'u7' END AS entity FROM obs UNION SELECT DISTINCT metric, 'u' || (length(metric) % 10) FROM obs UNION SELECT 'error', 'missing')"


def _ranking(spark, d):
    s = views.observations(spark, d).groupBy(F.col("metric").alias("case_id"), "entity").agg(F.avg("value").alias("score"))
    return rank.ranked(s, ["case_id"])


def _truth(spark, d):
    m = views.observations(spark, d).select("metric").distinct()
    a = m.select(F.col("metric").alias("case_id"), F.when(F.length("metric") % 2 == 0, "u3").otherwise("u7").alias("entity"))
    b = m.select(F.col("metric").alias("case_id"), F.concat(F.lit("u"), F.length("metric") % 10).alias("entity"))
    return a.union(b).union(spark.createDataFrame([("error", "missing")], a.schema)).distinct()


@query(_RANKS + " SELECT case_id, entity, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM rk WHERE rank <= 5")
def rank_topk(spark, d):
    return rank.ranked(_ranking(spark, d).drop("rank"), ["case_id"], top=5).select("case_id", "entity", "rank", r6("score"))


_PR = _RANKS + ", n AS (SELECT case_id, count(*) AS n FROM tr GROUP BY 1), pr AS (SELECT k, avg((SELECT count(*) FROM rk JOIN tr USING (case_id, entity) WHERE rk.case_id = n.case_id AND rk.rank <= k) / least(k, n)) AS precision FROM n, unnest(range(1, 11)) t(k) GROUP BY 1)"


@query(_PR + " SELECT CAST(k AS INT) AS k, round(precision, 6) AS precision FROM pr WHERE k IN (1, 3, 5, 10)")
def pr_at_k(spark, d):
    return rank.precision_at(_ranking(spark, d), _truth(spark, d), [1, 3, 5, 10]).select("k", r6("precision"))


@query(_PR + " SELECT round(avg(precision), 6) AS map FROM pr WHERE k <= 5")
def map_at_k(spark, d):
    return rank.mean_average_precision(_ranking(spark, d), _truth(spark, d), 5).select(r6("map"))


@query(_RANKS + " SELECT round(avg(coalesce(1.0 / b, 0)), 6) AS mrr FROM (SELECT DISTINCT case_id FROM tr) LEFT JOIN (SELECT case_id, min(rank) AS b FROM rk JOIN tr USING (case_id, entity) GROUP BY 1) USING (case_id)")
def mrr(spark, d):
    return rank.reciprocal_rank(_ranking(spark, d), _truth(spark, d)).select(r6("mrr"))


@query(_RANKS + " SELECT CAST(k AS INT) AS k, round(avg(coalesce(CAST(b <= k AS INT), 0)), 6) AS hit_rate FROM (SELECT DISTINCT case_id FROM tr) LEFT JOIN (SELECT case_id, min(g) AS b FROM (SELECT *, dense_rank() OVER (PARTITION BY case_id ORDER BY score DESC) AS g FROM rk) JOIN tr USING (case_id, entity) GROUP BY 1) USING (case_id), (VALUES (1), (3), (5)) t(k) GROUP BY 1")
def hit_rate(spark, d):
    return rank.hit_rate(_ranking(spark, d), _truth(spark, d), [1, 3, 5]).select("k", r6("hit_rate"))


@query(_RANKS + " SELECT tr.case_id, tr.entity, round((rank - 1) / n * 100, 6) AS percentile FROM tr LEFT JOIN rk USING (case_id, entity) LEFT JOIN (SELECT case_id, count(*) AS n FROM rk GROUP BY 1) c ON c.case_id = tr.case_id")
def rank_percentile(spark, d):
    return rank.rank_percentile(_ranking(spark, d), _truth(spark, d)).select("case_id", "entity", r6("percentile"))


@query(_RANKS + f", c AS (SELECT case_id, max(score) FILTER (rank = 1) AS top, count(*) FILTER (rank > 1) AS n, avg(score) FILTER (rank > 1) AS m, stddev_samp(score) FILTER (rank > 1) AS s FROM rk GROUP BY 1), u AS (SELECT *, m + {numeric.student_quantile(0.995, 8)!r} * s / sqrt(n) + 4 * s AS ub FROM c WHERE n >= 3) SELECT case_id, (SELECT count(*) FROM range(1, 10) t(i) WHERE top >= 0.1 * i * ub) / 10 AS confidence FROM u")
def confidence(spark, d):
    return rank.confidence(_ranking(spark, d)).select("case_id", "confidence")


# ------------------------------------------------------------- sensors

_SENSORS = "WITH s AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS ts, CASE event_type WHEN 'error' THEN 'FIT' WHEN 'click' THEN 'P' WHEN 'view' THEN 'DPIT' ELSE 'PIT' END AS kind, 101 + (user_id % 3) * 100 AS pos, sum(value) AS value FROM events GROUP BY 1, 2, 3)"


def _sensors(spark, d):
    e = table(spark, d, "events")
    kind = F.expr("case event_type when 'error' then 'FIT' when 'click' then 'P' when 'view' then 'DPIT' else 'PIT' end")
    s = e.groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("ts"), F.concat(kind, 101 + F.col("user_id") % 3 * 100).alias("sensor")).agg(F.sum("value").alias("value"))
    return s.withColumn("kind", sensors.swat_kind(F.col("sensor"))).withColumn("pos", sensors.swat_position(F.col("sensor")))


@query(_SENSORS + " SELECT t.ts, g.grp, k.kind, round(coalesce(sum(s.value), 0), 4) AS value FROM (SELECT DISTINCT ts FROM s) t, (VALUES ('S1', 101), ('S2', 201), ('S3', 301)) g(grp, pos), (VALUES ('P'), ('PIT'), ('DPIT'), ('MV')) k(kind) LEFT JOIN s ON s.ts = t.ts AND s.pos = g.pos AND s.kind = k.kind GROUP BY 1, 2, 3")
def sensor_kind_sum(spark, d):
    s = _sensors(spark, d)
    stage = {p: n for n, ps in sensors.SWAT_STAGES.items() for p in ps}
    plan = spark.createDataFrame([(f"{k}{p}", stage[p]) for k in ("P", "PIT", "DPIT", "MV", "FIT") for p in ("101", "201", "301")], "sensor string, grp string")
    return sensors.kind_sums(s, plan, ["P", "PIT", "DPIT", "MV"]).select("ts", "grp", "kind", F.round("value", 4).alias("value"))


@query("SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS ts, CASE WHEN user_id % 3 < 2 THEN '2_AIT_00' || (user_id % 2 + 1) ELSE '1_P_001' END AS sensor, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def sensor_pair_sum(spark, d):
    raw = F.when(F.col("user_id") % 3 < 2, F.concat(F.lit("\\\\host\\p\\2"), F.when(F.col("event_type") == "error", "A").otherwise("B"), F.lit("_AIT_00"), F.col("user_id") % 2 + 1, F.lit("_PV"))).otherwise("1_P_001_STATUS")
    o = table(spark, d, "events").select(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("ts"), raw.alias("sensor"), "value")
    return sensors.pair_sums(o).select("ts", "sensor", F.round("value", 4).alias("value"))


@query(ctes("obs") + " SELECT event_id, CASE WHEN ts BETWEEN 1704200000 AND 1704300000 OR ts BETWEEN 1704400000 AND 1704410000 THEN -1 ELSE 1 END AS label, CASE metric WHEN 'error' THEN -1 WHEN 'click' THEN 1 ELSE 0 END AS raw FROM obs")
def sensor_labels(spark, d):
    o = views.observations(spark, d).withColumn("word", F.expr("case metric when 'error' then 'A ttack' when 'click' then 'Normal' else 'other' end"))
    w = spark.createDataFrame([(1704200000, 1704300000), (1704400000, 1704410000)], "lo long, hi long")
    return sensors.attack_label(o, w).select("event_id", "label", F.coalesce(sensors.label(F.col("word")), F.lit(0)).alias("raw"))


# ------------------------------------------------------------- traces

_EV = ctes("spans", "span_logs") + """, la AS (SELECT trace, span, max(ns) AS l FROM span_logs GROUP BY 1, 2), ev AS (
 SELECT trace, span, parent, pod, start_ns AS ns, 0 AS part, pod || ' say start' AS event FROM spans UNION ALL SELECT trace, span, parent, pod, l.ns, 2, l.event FROM span_logs l JOIN spans USING (trace, span)
 UNION ALL SELECT trace, span, parent, pod, CASE WHEN l > end_ns THEN l + 1 ELSE end_ns END, 3, pod || ' say end' FROM spans LEFT JOIN la USING (trace, span)), sq AS (SELECT *, row_number() OVER (PARTITION BY trace, span ORDER BY part, ns, event) - 1 AS seq FROM ev)
, ch AS (SELECT trace, span, event AS src, lead(event) OVER (PARTITION BY trace, span ORDER BY seq) AS dst, seq FROM sq)
, cl AS (SELECT c.trace, c.parent AS src_span, c.span AS dst_span, c.event AS dst, any_value(p.pod = c.pod) AS same, arg_max(CASE WHEN p.ns <= c.ns THEN p.event END, CASE WHEN p.ns <= c.ns THEN p.ns * 1000 + p.seq END) AS latest, bool_or(p.ns > c.ns) AS later, arg_min(p.event, p.seq) AS f FROM sq c JOIN sq p ON p.trace = c.trace AND p.span = c.parent WHERE c.seq = 0 GROUP BY 1, 2, 3, 4)
, ce AS (SELECT trace, src_span, dst_span, CASE WHEN NOT same THEN f WHEN later THEN latest END AS src, dst FROM cl)
, ed AS (SELECT trace, src, dst FROM ch WHERE dst IS NOT NULL UNION ALL SELECT trace, src, dst FROM ce WHERE src IS NOT NULL)
, su AS (SELECT CAST(trace AS BIGINT) % 2 AS half, src, dst, count(*) AS support FROM ed GROUP BY 1, 2, 3)"""


def _events(spark, d):
    return traces.span_events(views.spans(spark, d), views.span_logs(spark, d))


def _graph(spark, d):
    e = _events(spark, d)
    return traces.chain_edges(e).select("trace", "src", "dst").unionByName(traces.call_edges(e).select("trace", "src", "dst"))


def _supports(spark, d):
    s = traces.pair_support(_graph(spark, d).withColumn("half", F.col("trace").cast("long") % 2), ["half"])
    return s.where("half = 0"), s.where("half = 1")


@query(_EV + " SELECT trace, span, ns, event, CAST(seq AS INT) AS seq FROM sq")
def span_events(spark, d):
    return _events(spark, d).select("trace", "span", "ns", "event", "seq")


@query(_EV + " SELECT trace, span, src, dst, CAST(seq AS INT) AS seq FROM ch WHERE dst IS NOT NULL")
def span_edges(spark, d):
    return traces.chain_edges(_events(spark, d)).select("trace", F.col("src_span").alias("span"), "src", "dst", F.col("src_seq").alias("seq"))


@query(_EV + " SELECT trace, src_span, dst_span, src, dst FROM ce WHERE src IS NOT NULL")
def parent_child_edges(spark, d):
    return traces.call_edges(_events(spark, d)).select("trace", "src_span", "dst_span", "src", "dst")


@query(_EV + " SELECT half, src, dst, support FROM su")
def pair_support(spark, d):
    return traces.pair_support(_graph(spark, d).withColumn("half", F.col("trace").cast("long") % 2), ["half"])


_PS = _EV + ", ps AS (SELECT n.src, n.dst, n.support AS n, n.support / (n.support + coalesce(a.support, 0)) AS score FROM (SELECT * FROM su WHERE half = 0) n LEFT JOIN (SELECT * FROM su WHERE half = 1) a USING (src, dst))"


@query(_PS + " SELECT src, dst, n, round(score, 6) AS score FROM ps WHERE n > 2 AND score >= 0.4")
def pattern_score(spark, d):
    return traces.pattern_scores(*_supports(spark, d), support=2, least=0.4).select("src", "dst", "n", r6("score"))


@query(_EV + " SELECT a.src || '_' || a.dst AS pattern, a.support AS a FROM (SELECT * FROM su WHERE half = 1) a LEFT JOIN (SELECT * FROM su WHERE half = 0) n USING (src, dst) WHERE a.support > 2 AND a.support / (a.support + coalesce(n.support, 0)) >= 0.4")
def abnormal_pattern(spark, d):
    return traces.abnormal_patterns(*_supports(spark, d), support=2, least=0.4).select("pattern", "a")


@query(_PS + ", k AS (SELECT * FROM ps WHERE n > 2 AND score >= 0.4) SELECT src, dst, round(score, 6) AS score FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.dst = k.src AND o.score >= k.score) OR regexp_matches(dst, '(?i)cpu|network|memory')")
def root_elimination(spark, d):
    return traces.eliminate_followers(traces.pattern_scores(*_supports(spark, d), support=2, least=0.4)).select("src", "dst", r6("score"))


@query(ctes("obs") + ", a AS (SELECT entity AS pod, ts // 86400 AS ts, CASE metric WHEN 'error' THEN 'CpuUsageRate' ELSE metric END AS metric, max(value) AS value FROM obs GROUP BY 1, 2, 3) SELECT pod, ts, min(metric) AS metric_type FROM a WHERE value > CASE WHEN metric = 'CpuUsageRate' THEN 80 ELSE 200 END GROUP BY 1, 2")
def alarms(spark, d):
    o = views.observations(spark, d).groupBy(F.col("entity").alias("pod"), F.expr("ts div 86400").alias("ts"), F.when(F.col("metric") == "error", "CpuUsageRate").otherwise(F.col("metric")).alias("metric")).agg(F.max("value").alias("value"))
    return traces.first_alarms(o.withColumn("position", F.lit(0)), "hipster").select("pod", "ts", "metric_type")


_AL = ctes("spans", "span_logs") + """, al(pod, metric_type, position) AS (VALUES ('user', 'CpuUsageRate', 0), ('user', 'NetworkP90', 1), ('system', 'MemoryUsageRate', 0))
, la AS (SELECT trace, span, max(ns) AS l, count(*) AS n FROM span_logs GROUP BY 1, 2), ev AS (
 SELECT trace, span, pod, start_ns AS ns, 0 AS part, pod || ' say start' AS event FROM spans UNION ALL SELECT trace, span, pod, l.ns, 2, l.event FROM span_logs l JOIN spans USING (trace, span)
 UNION ALL SELECT s.trace, s.span, s.pod, start_ns + position + 1, 1, metric_type FROM spans s JOIN al USING (pod) JOIN la ON la.trace = s.trace AND la.span = s.span WHERE n + 2 > 2 AND start_ns < 3000
 UNION ALL SELECT trace, span, pod, CASE WHEN l > end_ns THEN l + 1 ELSE end_ns END, 3, pod || ' say end' FROM spans LEFT JOIN la USING (trace, span))"""


@query(_AL + " SELECT trace, span, ns, event, CAST(row_number() OVER (PARTITION BY trace, span ORDER BY CASE WHEN part <= 1 THEN 0 WHEN part = 3 THEN 2 ELSE 1 END, part, ns, event) - 1 AS INT) AS seq FROM ev")
def span_alarms(spark, d):
    """Alarms enter the spans of their pod that hold more than two events and start in the alarms' time."""
    al = spark.createDataFrame([("user", "CpuUsageRate", 0, 0, 3000), ("user", "NetworkP90", 1, 0, 3000), ("system", "MemoryUsageRate", 0, 0, 3000)], "pod string, metric_type string, position int, from_ns long, to_ns long")
    return traces.span_events(views.spans(spark, d), views.span_logs(spark, d), al, alarms_from=3).select("trace", "span", "ns", "event", "seq")


_DEPTH = _EV + """, ed2 AS (SELECT trace, src, dst, span AS dst_span, seq + 1 AS dst_seq FROM ch WHERE dst IS NOT NULL UNION ALL SELECT trace, src, dst, dst_span, 0 FROM ce WHERE src IS NOT NULL
), pr AS (SELECT trace, dst AS event, src, pod, CAST(contains(src, 'start') AND NOT contains(src, 'TraceID') AS INT) AS c FROM (SELECT e.*, s.pod, row_number() OVER (PARTITION BY e.trace, e.dst ORDER BY e.dst_span, e.dst_seq) AS r FROM ed2 e JOIN spans s ON s.trace = e.trace AND s.span = e.dst_span) WHERE r = 1
), wk AS (SELECT trace, event AS target, event AS at, [event] AS path, 0 AS depth, false AS stop FROM pr
 UNION ALL SELECT w.trace, w.target, p.src, list_append(w.path, p.src), w.depth + p.c, list_contains(w.path, p.src) FROM wk w JOIN pr p ON p.trace = w.trace AND p.event = w.at WHERE NOT w.stop
), dp AS (SELECT w.trace, target AS event, max(depth) AS depth, any_value(p.pod) AS pod FROM wk w JOIN pr p ON p.trace = w.trace AND p.event = w.target GROUP BY 1, 2
), db AS (SELECT event, depth, pod FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY depth DESC, CAST(trace AS BIGINT)) AS r FROM dp WHERE depth > 0) WHERE r = 1)"""


def _depths(spark, d):
    e, pods = _events(spark, d), views.spans(spark, d).select("trace", F.col("span").alias("dst_span"), F.col("pod").alias("dst_pod"))
    edges = traces.chain_edges(e).select("trace", "src", "dst", "dst_span", "dst_seq").unionByName(traces.call_edges(e).select("trace", "src", "dst", "dst_span", "dst_seq"))
    return traces.event_depths(edges.join(pods, ["trace", "dst_span"]), ["dst_span", "dst_seq"])


@query(_DEPTH + " SELECT trace, event, depth, pod FROM dp")
def event_depth(spark, d):
    return _depths(spark, d).select("trace", "event", "depth", "pod")


@query(_DEPTH + " SELECT event, depth, pod FROM db")
def deepest_pod(spark, d):
    return traces.deepest(_depths(spark, d))


_RANKED = _DEPTH + """, ps AS (SELECT n.src, n.dst, n.support / (n.support + coalesce(a.support, 0)) AS score FROM (SELECT * FROM su WHERE half = 0) n LEFT JOIN (SELECT * FROM su WHERE half = 1) a USING (src, dst) WHERE n.support > 2
), al(pod, resource) AS (VALUES ('user', 'CpuUsageRate')), jn AS (SELECT p.src, p.dst, p.score, coalesce(b.depth, 1) AS depth, coalesce(b.pod, 'frontend') AS pod FROM ps p LEFT JOIN db b ON b.event = p.src WHERE p.score >= 0.4
), rs AS (SELECT jn.*, resource, row_number() OVER (PARTITION BY jn.pod ORDER BY depth DESC, src, dst) AS r FROM jn LEFT JOIN al USING (pod))"""


@query(_RANKED + " SELECT src, dst, round(score, 6) AS score, depth, pod, resource, row_number() OVER (ORDER BY score DESC, depth DESC, src, dst) AS rank FROM rs WHERE resource IS NULL OR r = 1")
def pattern_ranking(spark, d):
    alarmed = spark.createDataFrame([("user", "CpuUsageRate", 0), ("user", "NetworkP90", 1)], "pod string, metric_type string, position int")
    scored = traces.pattern_scores(*_supports(spark, d), support=2, least=0.4)
    return traces.rank_patterns(scored, traces.deepest(_depths(spark, d)), alarmed).withColumn("score", F.round("score", 6))


@query(_PS + ", t(least) AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) SELECT CAST(least AS DOUBLE) AS least, count(*) AS patterns, round(max(score), 6) AS best FROM ps, t WHERE n > 2 AND score >= CAST(least AS DOUBLE) GROUP BY 1")
def threshold_sweep(spark, d):
    scored = traces.pattern_scores(*_supports(spark, d), support=2, least=0.0)
    return traces.threshold_sweep(scored, [k / 10 for k in range(1, 10)]).withColumn("best", F.round("best", 6))


@query(ctes("spans") + " SELECT s.pod, round(quantile_cont((p.end_ns - s.end_ns) / 1e6, 0.9), 9) AS latency FROM spans s JOIN spans p ON p.trace = s.trace AND p.span = s.parent AND p.pod <> s.pod GROUP BY 1")
def network_p90(spark, d):
    return traces.network_latency(views.spans(spark, d)).select("pod", F.round("latency", 9).alias("latency"))


@query(ctes("obs") + " SELECT 'svc' || length(metric) AS service, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM obs GROUP BY 1, 2")
def metric_profile(spark, d):
    o = views.observations(spark, d).withColumn("pod", F.concat(F.lit("svc"), F.length("metric"), F.lit("-a-"), "entity"))
    return traces.metric_profile(o).select("service", "metric", r6("mean"), r6("sd"))


@query(ctes("spans") + ", w AS (SELECT trace, span, 0 AS depth FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace = s.trace AND p.span = s.parent) UNION ALL SELECT s.trace, s.span, w.depth + 1 FROM w JOIN spans s ON s.trace = w.trace AND s.parent = w.span) SELECT trace, span, min(depth) AS depth FROM w GROUP BY 1, 2")
def span_depth(spark, d):
    return traces.span_depths(spark, views.spans(spark, d))


@query(ctes("logs") + ", f AS (SELECT entity AS pod, template AS event, min(ts) AS first, count(*) AS n FROM logs GROUP BY 1, 2), g AS (SELECT pod, event, n, CAST(row_number() OVER o AS INT) AS span_no, coalesce(lag(event) OVER o, 'root') AS parent FROM f WINDOW o AS (PARTITION BY pod ORDER BY first, event)) SELECT g.*, l.ts FROM logs l JOIN g ON g.pod = l.entity AND g.event = l.template")
def synthetic_trace(spark, d):
    logs = views.logs(spark, d).select(F.col("entity").alias("pod"), "ts", F.col("template").alias("event"))
    return traces.synthetic_traces(logs).select("pod", "event", "ts", "n", "span_no", "parent")


# ------------------------------------------------------------- kernels: no SQL


@query()
def drain_templates(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "content")).withColumn("line_id", F.col("doc_id") * (1 << 31) + F.col("line_no"))
    return templates.mine(lines).select("line_id", "event_id", "template", "occurrence")


@query(ctes("logs") + " SELECT template || ' status <*>' AS template, substr(md5(template || ' status <*>'), 1, 8) AS event_id, count(*) AS occurrence FROM logs GROUP BY 1, 2")
def drain_log_catalogue(spark, d):
    lines = views.logs(spark, d).select(F.col("event_id").alias("line_id"), F.col("message").alias("content"))
    return templates.catalogue(templates.mine(lines)).select("template", "event_id", "occurrence")


@query(ctes("logs") + " SELECT event_id AS line_id, template || ' status <*>' AS template, substr(md5(template || ' status <*>'), 1, 8) AS event_id FROM logs")
def template_match(spark, d):
    """Every line, matched by the catalogue mined from the even ones, without learning."""
    lines = views.logs(spark, d).select(F.col("event_id").alias("line_id"), F.col("message").alias("content"))
    known = templates.catalogue(templates.mine(lines.where("line_id % 2 = 0")))
    return templates.match_only(lines, known).select("line_id", "template", "event_id")


@query(ctes("logs") + ", f AS (SELECT template, min(event_id) AS first FROM logs GROUP BY 1), n AS (SELECT template, CAST(row_number() OVER (ORDER BY first) AS INT) AS cluster_id FROM f) SELECT event_id AS line_id, cluster_id FROM logs JOIN n USING (template)")
def template_numbers(spark, d):
    lines = views.logs(spark, d).select(F.col("event_id").alias("line_id"), F.col("message").alias("content"))
    return templates.numbered(templates.mine(lines)).select("line_id", "cluster_id")


@query(ctes("logs") + " SELECT event_id AS line_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE template || ' status <*>' END AS template FROM logs")
def template_lookup(spark, d):
    lines = views.logs(spark, d).select(F.col("event_id").alias("line_id"), F.col("message").alias("content"))
    mined = templates.mine(lines)
    events = mined.select("line_id", F.when(F.col("line_id") % 7 == 0, "unknown").otherwise(F.col("event_id")).alias("event_id"))
    return templates.template_of(events, templates.catalogue(mined)).select("line_id", "template")


@query()
def bocpd_changepoints(spark, d):
    p = _patched(spark, d).withColumnRenamed("patch", "ts")
    return detect.bocpd_changes(p, ["metric"])


@query()
def spot_scores(spark, d):
    return detect.spot_scores(views.weekly(spark, d), ["metric"], n_init=60).select("metric", "entity", r6("score"))


def _with_kpi(spark, d):
    w = views.weekly(spark, d)
    k = w.select("metric").distinct().join(F.broadcast(views.weekly_kpi(spark, d)))  # a few hundred weeks
    return w.unionByName(k.select(F.lit("kpi").alias("entity"), "ts", "metric", "value"))


@query()
def fastpc_edges(spark, d):
    return causal.pc_edges(_with_kpi(spark, d), ["metric"], "ts", alpha=0.01)


@query()
def partial_strengths(spark, d):
    s = _with_kpi(spark, d)
    return causal.partial_strengths(s, causal.pc_edges(s, ["metric"], "ts", alpha=0.01), ["metric"], "ts", "kpi").select("metric", "entity", r6("r"))


@query()
def granger_edges(spark, d):
    return causal.granger_edges(_with_kpi(spark, d), ["metric"], "ts").select("metric", "src", "dst", r6("weight"))


@query()
def offline_ranking(spark, d):
    """The whole offline plan by every registered method."""
    from .plans import root_cause

    obs = views.weekly(spark, d).withColumn("case_id", F.lit("a"))
    kpi = views.weekly_kpi(spark, d).withColumn("case_id", F.lit("a"))
    series, changes = root_cause.prepared(obs, kpi, 5)
    out = None
    for method in sorted(root_cause.METHODS):
        one = materialised(root_cause.ranking(series, changes, method).select(F.lit(method).alias("method"), "case_id", "entity", r6("score"), "rank"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def rcd(spark, d):
    return causal.discretised_fnode_scores(prep.train_test(_with_kpi(spark, d), ["metric"]), ["metric"], "ts", alpha=0.9).select("metric", "entity", r6("score"))


@query()
def ht_scores(spark, d):
    s = _with_kpi(spark, d)
    return causal.regression_scores(prep.train_test(s, ["metric"]), causal.pc_edges(s, ["metric"], "ts", alpha=0.01), ["metric"], "ts").select("metric", "entity", r6("score"))


@query()
def log_pca(spark, d):
    counts = views.logs(spark, d).groupBy("entity", F.expr("ts div 3600").alias("hour"), F.col("message").alias("event")).agg(F.count("*").alias("n"))
    return detect.principal_scores(counts, ["entity"], "hour", "event", "n").select("entity", "hour", r6("score"), r6("spe"))


@query("WITH e AS (SELECT event_type, epoch(ts) AS t, value FROM events), w AS (SELECT CAST(floor(t / 600) * 600 - k * 600 AS BIGINT) AS start, event_type, value FROM e, (SELECT unnest([0, 1, 2]) AS k)) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2")
def stream_hopping(spark, d):
    from .streaming import run_hopping

    return run_hopping(spark, d)


@query(_W + """, lim AS (SELECT min(ts) AS lo, max(ts) AS hi FROM weekly), d0 AS (SELECT batch, metric, entity, ts, value FROM weekly, lim, (SELECT unnest([0, 1, 2, 3, 4]) AS batch) WHERE ts < lo + (hi - lo + 1) * (batch + 1) // 5
), c AS (SELECT batch, metric, ts FROM d0 GROUP BY 1, 2, 3 HAVING count(DISTINCT entity) = 4), dd AS (SELECT batch, metric, entity, ts, value / nullif(sum(abs(value)) OVER (PARTITION BY batch, metric, entity), 0) AS value FROM d0 JOIN c USING (batch, metric, ts)
), i AS (SELECT batch, metric, ts, row_number() OVER (PARTITION BY batch, metric ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY batch, metric) AS n FROM c
), h AS (SELECT dd.*, i < least(floor(0.6 * n), n - 3) AS normal, i >= n - greatest(n - floor(0.6 * n), 3) AS anomalous FROM dd JOIN i USING (batch, metric, ts)
), q AS (SELECT batch, metric, entity, avg(value) AS mean, stddev_pop(value) AS sd FROM h WHERE normal GROUP BY 1, 2, 3 HAVING min(value) <> max(value)), t AS (SELECT batch, metric, entity, max(value) AS top FROM h WHERE anomalous GROUP BY 1, 2, 3 HAVING min(value) <> max(value)
), m AS (SELECT batch, entity, avg((top - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END) AS score FROM q JOIN t USING (batch, metric, entity) GROUP BY 1, 2), s AS (SELECT batch, entity, score / nullif(sum(abs(score)) OVER (PARTITION BY batch), 0) AS score FROM m
), e AS (SELECT batch, lo + (hi - lo + 1) * (batch + 1) // 5 - 1 >= lo + (hi - lo + 1) // 2 AS late FROM lim, (SELECT unnest([0, 1, 2, 3, 4]) AS batch))
SELECT batch, entity, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY batch ORDER BY score DESC, entity) AS INT) AS rank, batch = (SELECT min(batch) FROM e WHERE late) AS early FROM s""")
def online_ranking(spark, d):
    from .streaming import run_ranking

    return run_ranking(spark, d)


@query()
def stream_online_rca(spark, d):
    from .streaming import run_online

    return run_online(spark, d)
