"""Column functions over log messages; all stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Timestamp formats that are cut out of messages, in this order.
TIMESTAMPS = (
    r"\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\]",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z",
    r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}",
    r"\d{4}\.\d{2}\.\d{2} \d{2}:\d{2}:\d{2}",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}\+\d{4}",
    r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    r"\[\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} \w{3}\]",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}\+\d{2}:\d{2}",
    r"\w{3} \d{1,2}, \d{4}",
    r"\d{1,2} \w{3} \d{4}",
    r"\d{2}:\d{2} [AP]M",
    r"\[\d{2}/\w{3}/\d{4} \d{2}:\d{2}:\d{2}\]",
    r"^I\d{4} \d{2}:\d{2}:\d{2}\.\d{6}\s+\d+\s+\w+.\w+:\d+\] ",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z",
)

#: Words that mark a message as abnormal, case aside.
KEYWORDS = (
    "error", "exception", "critical", "fatal", "timeout", "connection refused", "No space left on device", "out of memory",
    "terminated unexpectedly", "backtrace", "stack trace", "service unavailable", "502 Bad Gateway", "503 Service Unavailable",
    "504 Gateway Timeout", "unable to connect to", "rate limit exceeded", "request limit exceeded", "cloud system down",
    "cloud service not responding", "failure", "corrupted data", "data loss", "file not found", "high CPU utilization", "CPU spike",
    "CPU saturation", "excessive CPU usage", "failed", "shutdown", "Permission denied", "DEBUG", "cannot be contacted",
)
ABNORMAL = "(?i)" + "|".join((*KEYWORDS, r"\b(4\d{2}|5\d{2})\b", r"\b(AWS|Azure|Google Cloud)\b", r"<\*> send error:.*"))

#: Services whose log line is one JSON object, and those whose ``log`` holds another.
PLAIN_SERVICES = ("adservice", "cartservice")
WRAPPED_SERVICES = (
    "checkoutservice", "currencyservice", "emailservice", "frontend", "paymentservice", "productcatalogservice",
    "recommendationservice", "shippingservice",
)

#: What masks the variable parts of a message, in order.
MASKS = ((r"\b\d{1,3}(\.\d{1,3}){3}(:\d+)?\b", "<*>"), (r"\b0x[0-9a-fA-F]+\b", "<*>"), (r"\b\d+\b", "<*>"))


def strip_timestamps(message: Column) -> Column:
    """Cuts out TIMESTAMPS one after another, then trims."""
    for pattern in TIMESTAMPS:
        message = F.regexp_replace(message, pattern, "")
    return F.regexp_replace(message, r"^\s+|\s+$", "")


def extract_message(log: Column) -> Column:
    """The ``msg`` of a JSON or key-value line: JSON field (missing: empty; unreadable: the line), text in quotes after ``msg=`` (unclosed: to the end), else the line; trimmed."""
    is_json = F.contains(log, F.lit("msg:")) | F.contains(log, F.lit('"msg":'))
    field = F.get_json_object(log, "$.msg")
    readable = F.get_json_object(log, "$").isNotNull()
    quoted = F.regexp_extract(log, r'(?s)msg"?=[^"]*"([^"]*)', 1)
    out = F.when(is_json, F.when(readable, F.coalesce(field, F.lit(""))).otherwise(log)).when(F.contains(log, F.lit("msg=")) | F.contains(log, F.lit('"msg"=')), quoted).otherwise(log)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def trim_quotes(message: Column) -> Column:
    """One leading and one trailing double quote less."""
    return F.regexp_replace(message, '^"|"$', "")


def abnormal(message: Column) -> Column:
    """1 if the message has an abnormal keyword, an HTTP status of 400 to 599, or names a cloud provider; else 0."""
    return F.coalesce(F.rlike(message, F.lit(ABNORMAL)), F.lit(False)).cast("int")


def service_name(pod: Column) -> Column:
    """A pod's name without its last two ``-`` parts; shorter names stay."""
    return F.regexp_replace(pod, "-[^-]*-[^-]*$", "")


def unwrap_service(log: Column, pod: Column) -> tuple[Column, Column]:
    """(message, service) of a container log line by the pod's name; what can't be read stays as it is, right-trimmed."""
    outer = F.get_json_object(log, "$.log")
    inner = F.get_json_object(outer, "$.message")
    call = F.coalesce(F.nullif(F.regexp_extract(outer, "  (.+?#.+?) ", 1), F.lit("")), F.nullif(F.regexp_extract(outer, " (.+?#.+?) ", 1), F.lit("")), outer)
    message, service = log, F.lit("")
    for name, value in reversed([*((s, outer) for s in PLAIN_SERVICES), *((s, inner) for s in WRAPPED_SERVICES), ("alarm", log)]):
        message, service = F.when(F.contains(pod, F.lit(name)), value).otherwise(message), F.when(F.contains(pod, F.lit(name)), F.lit(name)).otherwise(service)
    known = F.lit(False)
    for name in (*PLAIN_SERVICES, *WRAPPED_SERVICES, "alarm"):
        known = known | F.contains(pod, F.lit(name))
    ticket = ~known & F.contains(pod, F.lit("ts-"))
    message, service = F.when(ticket, call).otherwise(message), F.when(ticket, service_name(pod)).otherwise(service)
    return F.regexp_replace(F.coalesce(message, log), r"\s+$", ""), service


def format_fields(log_format: str) -> tuple[list[str], str]:
    """Field names and the anchored Java pattern of a format such as ``<Time> <Level>: <Content>``; runs of blanks match any white space."""
    names, pattern = [], ""
    for i, part in enumerate(re.split(r"(<[^<>]+>)", log_format)):
        if i % 2:
            names.append(part[1:-1])
            pattern += "(.*?)"
        else:
            pattern += r"\s+".join(re.escape(p) for p in re.split(" +", part))
    return names, f"^{pattern}$"


def split_by_format(line: Column, log_format: str) -> dict[str, Column]:
    """A column per field of the format; empty where a line doesn't fit."""
    names, pattern = format_fields(log_format)
    return {name: F.regexp_extract(line, pattern, i) for i, name in enumerate(names, 1)}


def mask(message: Column, masks=MASKS) -> Column:
    for pattern, by in masks:
        message = F.regexp_replace(message, pattern, by)
    return message


def tokens(message: Column) -> Column:
    return F.split(F.regexp_replace(message, r"^\s+|\s+$", ""), r"\s+")


def has_digit(token: Column) -> Column:
    return F.rlike(token, F.lit(r"\p{Nd}"))


def template_id(template: Column) -> Column:
    """First 8 hexadecimal digits of the template's MD5."""
    return F.substring(F.md5(template.cast("binary")), 1, 8)


def template_parameters(message: Column, template: Column) -> Column:
    """What stands for each ``<*>`` of the row's own template; an empty array where the template has none or doesn't fit."""
    quoted = F.regexp_replace(template, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.replace(quoted, F.lit(r"<\*>"), F.lit("(.*?)")), r"\s+", r"\\s+"), F.lit("$"))
    n = (F.length(template) - F.length(F.replace(template, F.lit("<*>"), F.lit("")))) / 3
    groups = F.transform(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), lambda i: F.call_function("regexp_extract", message, pattern, i))
    return F.when((n >= 1) & F.rlike(message, pattern), groups).otherwise(F.array().cast("array<string>"))


def span_event(service: Column, operation: Column, what: str) -> Column:
    return F.concat_ws(" ", service, operation, F.lit(what))


def log_envelope(message: Column, time: Column) -> Column:
    """A container runtime's JSON line around a log message: log (message, severity, timestamp), stream, time."""
    log = F.struct(message.alias("message"), F.lit("info").alias("severity"), time.alias("timestamp"))
    return F.to_json(F.struct(log.alias("log"), F.lit("stdout").alias("stream"), time.alias("time")))


def local_time(seconds: Column, hours: int = 9) -> Column:
    """Epoch seconds as the clock reads ``hours`` east of Greenwich, whatever the session's zone."""
    return F.date_format(F.to_timestamp_ntz(F.concat(F.lit("1970-01-01 00:00:00"))) + F.make_dt_interval(secs=(seconds + 3600 * hours).cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss")


def date_hour(seconds: Column) -> Column:
    """(date, hour) of epoch seconds, in UTC."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    return F.struct(day.alias("date"), F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("int").alias("hour"))
