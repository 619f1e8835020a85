"""Operators against hand-made expectations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions import numeric, text
from faultline.operators import align, causal, detect, prep, rank, scorers, templates, traces, windows
from faultline.plans import offline
from faultline.streaming.online import Convergence, OnlineDetector


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def series(spark, values, entity="a"):
    return spark.createDataFrame([(entity, i, float(v)) for i, v in enumerate(values)], "entity string, ts long, value double")


@pytest.mark.parametrize("t, width, step, want", [
    ([0, 10, 25, 70], 30, 10, {(0, 3), (1, 3), (2, 3), (3, 4)}),
    ([0, 100], 30, 10, {(0, 1), (1, 2)}),
    ([5], 30, 10, {(0, 1)}),
    ([0, 0, 0], 5, 1, {(0, 3)}),
])
def test_sliding_windows(spark, t, width, step, want):
    e = spark.createDataFrame([("a", x) for x in t], "entity string, ts long")
    got = windows.sliding_windows(e, "entity", "ts", width, step).collect()
    assert {(r["lo"], r["hi"]) for r in got} == want and len(got) == len(want)


def test_sliding_windows_brute_force(spark):
    rng = np.random.default_rng(3)
    t = sorted(rng.integers(0, 4000, 120).tolist())
    e = spark.createDataFrame([("a", x, 1.0) for x in t], "entity string, ts long, v double")
    want, k = set(), 0
    while True:
        lo, hi = sum(x < t[0] + k * 30 for x in t), sum(x < t[0] + k * 30 + 200 for x in t)
        want |= {(lo, hi)} if lo != hi else set()
        if hi == len(t):
            break
        k += 1
    got = windows.sliding_windows(e, "entity", "ts", 200, 30, {"total": "v"}).collect()
    assert {(r["lo"], r["hi"]) for r in got} == want
    assert all(r["total"] == r["n"] for r in got)


def test_bucket_collision(spark):
    w = spark.createDataFrame([("a", 0, 2, 0, 1.0), ("a", 1, 3, 5, 2.0), ("a", 0, 3, 7, 3.0)], "entity string, lo int, hi int, start_t long, v double")
    assert rows(windows.bucket_values(w, "v", 10), "bucket", "value") == [(0, 2.0)]


@pytest.mark.parametrize("length, tail", [(25, [8.0] * 5), (35, [8.0] * 10 + [4.0] * 5)])
def test_hold_fill(spark, length, tail):
    v = spark.createDataFrame([("a", 2, 4.0), ("a", 20, 8.0)], "entity string, bucket long, value double")
    got = [x for _, x in rows(windows.hold_fill(windows.dense_grid(v, length)), "bucket", "value")]
    assert got == [0.0] * 2 + [4.0] * 18 + tail


def test_nearest_fill(spark):
    v = spark.createDataFrame([("a", 1, 1.0), ("a", 5, 5.0)], "entity string, bucket long, value double")
    assert [x for _, x in rows(windows.nearest_fill(windows.dense_grid(v)), "bucket", "value")] == [1, 1, 1, 1, 5, 5]


def test_patches(spark):
    got = prep.patches(series(spark, range(1, 8)), ["entity"], ["entity"], 3)
    assert rows(got, "patch", "value") == [(0, 6.0), (1, 15.0)]


@pytest.mark.parametrize("normal, after, want", [([1, 2, 3, 4, 5], [3, 9], 3.0), ([2, 2, 3, 2, 2], [2, 5], 3.0)])
def test_robust_scores(spark, normal, after, want):
    d = [("k", "e", float(v), "normal") for v in normal] + [("k", "e", float(v), "anomalous") for v in after]
    df = spark.createDataFrame(d, "metric string, entity string, value double, half string")
    assert scorers.robust_scores(df, ["metric"]).first()["score"] == want


def test_flat_entities(spark):
    d = [("k", "e", 1.0, "normal")] * 3 + [("k", "e", v, "anomalous") for v in (1.0, 6.0)]
    df = spark.createDataFrame(d, "metric string, entity string, value double, half string")
    assert scorers.robust_scores(df, ["metric"]).count() == 0
    assert scorers.robust_scores(df, ["metric"], keep_flat_normal=True).first()["score"] == 5.0


def test_cusum():
    assert [a for a, _ in detect.cusum(np.array([0, 0, 0, 5, 5, 5, 0, 0.0]), 2)] == [3, 6]
    assert detect.cusum(np.zeros(0), 1) == []


def test_run_length_jumps(spark):
    m = spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 1, 2, 0, 1])], "entity string, i int, m int")
    assert rows(scorers.run_length_changes(m, ["entity"]), "i", "jump") == [(3, 2)]


def test_bocpd():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.05, 60), rng.normal(1, 0.05, 60)])
    found = detect.change_points(x, drop_sentinel=True)
    assert any(58 <= c <= 64 for c in found) and len(found) <= 3
    m = detect.run_lengths(x)
    assert (len(x) in detect.change_points(x)) == (m[len(x) - 1] > 1)


def test_spot():
    rng = np.random.default_rng(1)
    x = rng.normal(size=1500)
    assert detect.spot_score(x) < 20
    x[1200] += 30
    assert detect.spot_score(x) > 1
    spot = detect.Spot()
    assert [spot.step(float(v)) for v in x][1200] == 1


@pytest.mark.parametrize("log, want", [('level=info msg="a b" x=1', "a b"), ('{"msg":"hi"}', "hi"), ('msg="open', "open"), ('{"msg": bad', '{"msg": bad'), ('{"msg:x":1}', ""), (" plain ", "plain")])
def test_extract_message(spark, log, want):
    assert spark.createDataFrame([(log,)], "l string").select(text.extract_message(F.col("l"))).first()[0] == want


def test_text_functions(spark):
    df = spark.createDataFrame([("GET /x 503", 1), ("id 15034", 0), ("Azure ok", 1), ("all fine", 0), (None, 0)], "m string, want int")
    assert all(r[0] == r[1] for r in df.select(text.abnormal(F.col("m")), "want").collect())
    one = spark.createDataFrame([("cart-7f-x9", "open (file) <*> of <*>", "open (file) 7 of b c")], "pod string, t string, m string")
    assert one.select(text.service_name(F.col("pod"))).first()[0] == "cart"
    assert one.select(text.template_parameters(F.col("m"), F.col("t"))).first()[0] == ["7", "b c"]
    assert one.select(text.template_parameters(F.col("m"), F.lit("none"))).first()[0] == []


def test_templates(spark):
    df = spark.createDataFrame([(1, "open file a"), (2, "open file b"), (3, "close file a"), (4, ""), (5, None), (6, "x")], "line_id long, content string")
    got = {r["line_id"]: r["template"] for r in templates.mine(df).collect()}
    assert got[1] == got[2] == "open file <*>" and got[3] == "close file a" and got[4] == got[5] == "" and got[6] == "x"
    running = {r["line_id"]: r["template"] for r in templates.mine(df, running=True).collect()}
    assert running[1] == "open file a" and running[2] == "open file <*>"


def _ranking(spark, lists):
    return spark.createDataFrame([(c, e, i, float(-i)) for c, es in lists.items() for i, e in enumerate(es, 1)], "case_id string, entity string, rank int, score double")


def test_evaluation(spark):
    truth = spark.createDataFrame([("1", "b"), ("1", "c")], "case_id string, entity string")
    assert rank.precision_at(_ranking(spark, {"1": ["a", "b", "c"]}), truth, [2]).first()["precision"] == 0.5
    two = spark.createDataFrame([("1", "b"), ("2", "z")], "case_id string, entity string")
    r = _ranking(spark, {"1": ["a", "b"], "2": ["a"]})
    assert rank.reciprocal_rank(r, two).first()["mrr"] == 0.25
    assert {x["case_id"]: x["percentile"] for x in rank.rank_percentile(r, two).collect()} == {"1": 50.0, "2": None}
    assert rank.average_overlap(list("abc"), list("abd"), 3) == pytest.approx((1 + 1 + 2 / 3) / 3)


def test_student_quantile():
    assert numeric.student_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert numeric.student_quantile(0.5, 3) == pytest.approx(0, abs=1e-7)


def test_transitions_and_walk(spark):
    e = spark.createDataFrame([("m", "a", "kpi"), ("m", "b", "a")], "metric string, src string, dst string")
    r = spark.createDataFrame([("m", "a", 0.9), ("m", "b", 0.2), ("m", "kpi", 1.0), ("m", "c", 0.0)], "metric string, entity string, r double")
    t = causal.transitions(e, r, ["metric"])
    sums = {x["src"]: x["s"] for x in t.groupBy("src").agg(F.sum("p").alias("s")).collect()}
    assert "c" not in sums and all(v == pytest.approx(1) for v in sums.values())
    w = {x["entity"]: x["score"] for x in causal.walk(t, ["metric"], "kpi").collect()}
    assert sum(w.values()) == pytest.approx(1) and set(w) == {"a", "b", "kpi"} and w["a"] > w["kpi"]


def test_pc_chain():
    rng = np.random.default_rng(5)
    a = rng.normal(size=3000)
    b = a + rng.normal(size=3000)
    c = b + rng.normal(size=3000)
    adj, apart = causal.pc_kernel(np.stack([a, b, c], 1), 0.001)
    assert adj[0, 1] and adj[1, 2] and not adj[0, 2] and apart[0, 2] == (1,)
    x, y = rng.normal(size=(2, 3000))
    d = causal.orient(*causal.pc_kernel(np.stack([x, y, x + y + rng.normal(size=3000)], 1), 0.001))
    assert d[0, 2] and d[1, 2] and not d[2, 0] and not d[2, 1]


def test_cycles():
    assert causal.break_cycles([("a", "b"), ("b", "c"), ("c", "a")]) == [("b", "c"), ("c", "a")]


def test_common_timestamps(spark):
    obs = spark.createDataFrame([("x", "a", t) for t in (1, 2, 3)] + [("x", "b", t) for t in (2, 3)], "case string, entity string, ts long")
    kpi = spark.createDataFrame([("x", 3), ("x", 4)], "case string, ts long")
    assert rows(align.common_timestamps(obs, kpi, "case"), "entity", "ts") == [("a", 3), ("b", 3)]


def test_span_edges(spark):
    s = spark.createDataFrame([("t", "1", "root", "p", "op", 0, 100), ("t", "2", "1", "p", "op", 50, 60), ("t", "3", "1", "q", "op", 55, 58)], "trace string, span string, parent string, pod string, operation string, start_ns long, end_ns long")
    logs = spark.createDataFrame([("t", "1", 40, "log"), ("t", "3", 70, "late")], "trace string, span string, ns long, event string")
    e = traces.span_events(s, logs)
    assert e.where("span = '3' and event like '%end'").first()["ns"] == 71
    got = rows(traces.call_edges(e), "dst_span", "src")
    assert got == [("2", "log"), ("3", "p op start")]


def test_alarm_limits(spark):
    df = spark.createDataFrame([("CpuUsageRate", 81.0), ("latency", 250.0)], "m string, v double")
    got = {ns: [r[0] for r in df.select(traces.alarm(F.col("m"), F.col("v"), ns)).collect()] for ns in ("hipster", "ts", "other")}
    assert got == {"hipster": [True, True], "ts": [True, False], "other": [True, False]}


def test_planted_fault(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8, 2000))
    x[3, 1200:] += 8
    kpi = rng.normal(size=2000)
    kpi[1205:] += 8
    obs = spark.createDataFrame([("c", "m", f"e{i}", t, float(x[i, t])) for i in range(8) for t in range(2000)], "case_id string, metric string, entity string, ts long, value double")
    k = spark.createDataFrame([("c", t, float(v)) for t, v in enumerate(kpi)], "case_id string, ts long, value double")
    r = offline(obs, k, patch=20)
    assert r.where("rank = 1").first()["entity"] == "e3"
    truth = spark.createDataFrame([("c", "e3")], "case_id string, entity string")
    assert rank.reciprocal_rank(r, truth).first()["mrr"] == 1.0


def test_online_detector_splits_alike():
    rng = np.random.default_rng(4)
    x = np.abs(np.concatenate([rng.normal(1, 0.05, (400, 2)), rng.normal(3, 0.05, (200, 2))])).tolist()
    whole = OnlineDetector().push(x)
    d, parts = OnlineDetector(), []
    for i in range(0, len(x), 37):
        d = OnlineDetector().load(d.dump())
        parts += d.push(x[i : i + 37])
    assert parts == whole and any(380 <= c <= 480 for c in whole)


def test_convergence():
    c = Convergence(depth=2, times=2)
    assert [c.add(r) for r in (["a", "b"], ["a", "b"], ["a", "b"])] == [False, False, True]


def test_span_depths_of_deep_traces_and_cycles(spark):
    chain = [("a", str(i), str(i - 1)) for i in range(300)]
    odd = [("b", "x", "y"), ("b", "y", "x"), ("b", "z", "y"), ("b", "r", None), ("b", "s", "r"), ("b", "s", "t"), ("b", "t", "s"), ("b", "u", "t"), ("b", "u", "r"), (None, "n", "n")]
    got = traces.span_depths(spark, spark.createDataFrame(chain + odd, "trace string, span string, parent string"))
    assert {(r["trace"], r["span"]): r["depth"] for r in got.collect()} == {("a", str(i)): i for i in range(300)} | {("b", "r"): 0, ("b", "s"): 1, ("b", "t"): 2, ("b", "u"): 1, (None, "n"): 0}
