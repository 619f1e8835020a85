"""Readers and writers on small files."""

import json

from faultline import sources


def test_log_dump(spark, tmp_path):
    hits = [
        {"_source": {"@timestamp": "2023-12-03T01:02:03.000Z", "message": '"2023-12-03 01:02:03 hello"', "kubernetes": {"pod_name": "p-1"}}},
        {"_source": {"@timestamp": "x", "message": 'msg="2023-12-03 01:02:03 n"', "hostname": "h", "systemd": {"t": "1"}}},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"hits": {"hits": hits}}))
    got = {r["level"]: (r["entity"], r["message"]) for r in sources.log_dump(spark, str(tmp_path / "*.json")).collect()}
    assert got == {"pod": ("p-1", "hello"), "node": ("h", "2023-12-03 01:02:03 n")}


def test_metric_dump(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"data": {"result": [{"metric": {"pod": "p"}, "values": [[10, "1.5"], [11, "NaN"], [12, "x"]]}]}}))
    got = sorted(sources.metric_dump(spark, str(tmp_path), "pod", "cpu").collect(), key=lambda r: r["ts"])
    assert [r["ts"] for r in got] == [10, 11, 12] and got[0]["value"] == 1.5 and got[1]["value"] != got[1]["value"] and got[2]["value"] is None


def test_kpi_csv(spark, tmp_path):
    (tmp_path / "k.csv").write_text("timeStamp,elapsed,label,Latency\n5000000,1,a,7\n6999999,1,b,8\n")
    assert [tuple(r) for r in sources.kpi_csv(spark, str(tmp_path), label="a").collect()] == [(5, "a", 7.0)]


def test_log_lines_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_text("t1\thello a\nbroken\nt2\thello b\n")
    lines = sources.log_lines(spark, str(tmp_path / "in"))
    assert [(r["line_id"], r["time"], r["content"]) for r in lines.orderBy("line_id").collect()] == [(1, "t1", "hello a"), (2, "t2", "hello b")]
    logs = spark.createDataFrame([("e1", "t", "m")], "entity string, ts_raw string, message string")
    sources.write_by_entity(logs, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "entity=e1")).first()[0] == "t\tm"
    sources.write_csv(spark.createDataFrame([([1, 2],)], "a array<int>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()[0] == "[1,2]"


def test_sensor_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("banner,,\nTimestamp,\\\\h\\p\\1_AIT_001_PV,label\n2015-12-26 00:00:00,1.5,Normal\n")
    r = sources.sensor_csv(spark, str(tmp_path / "s.csv"), banner=1).first()
    assert (r["sensor"], r["value"], r["label"]) == ("1_AIT_001_PV", 1.5, "Normal")


def test_cases_and_faults(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("label: 'x'\nonline_start: 12\nmetrics:\n  cpu: 1\n  mem: 2 # two\nroot_cause: p\n")
    assert json.loads(sources.cases(spark, str(tmp_path / "c.yaml")).first()["config"]) == {"label": "x", "online_start": 12, "metrics": {"cpu": 1, "mem": 2}, "root_cause": "p"}
    (tmp_path / "f.json").write_text(json.dumps({"2024": [{"inject_time": "t", "inject_timestamp": "1", "inject_pod": "p", "inject_type": "cpu"}]}))
    assert sources.fault_list(spark, str(tmp_path / "f.json")).first()["inject_pod"] == "p"


def test_metric_tree(spark, tmp_path):
    for space, name in (("shop", "shop_cpu_usage_1.json"), ("shop", "shop_cpu.json"), ("bank", "bank_cpu_2.json"), ("bank", "other_cpu.json"), ("bank", "bank_disk.json")):
        (tmp_path / space).mkdir(exist_ok=True)
        (tmp_path / space / name).write_text(json.dumps({"data": {"result": [{"metric": {"instance": name}, "values": [[1.9, "2"]]}]}}))
    got = {(r["kpi_label"], r["metric"], r["entity"], r["ts"], r["value"]) for r in sources.metric_dumps(spark, str(tmp_path), "node", ["cpu", "cpu_usage"]).collect()}
    assert got == {("shop", "cpu_usage", "shop_cpu_usage_1.json", 1, 2.0), ("shop", "cpu", "shop_cpu.json", 1, 2.0), ("bank", "cpu", "bank_cpu_2.json", 1, 2.0)}


def test_matrices_of_every_file(spark, tmp_path):
    import numpy as np
    import pytest

    for k in range(3):
        np.save(tmp_path / f"m{k}.npy", {f"case{k}": {"Pod_Name": ["a", "b"], "Sequence": np.arange(6.0).reshape(2, 3) + k, "time": np.array([10, 11])}}, allow_pickle=True)
    with pytest.raises(ValueError):
        sources.matrix_npy(spark, str(tmp_path), "cpu")
    got = {(r["kpi_label"], r["entity"], r["ts"]): r["value"] for r in sources.matrix_npy(spark, str(tmp_path / "*.npy"), "cpu", allow_pickle=True).collect()}
    assert len(got) == 18 and got["case2", "kpi", 11] == 7.0 and got["case0", "a", 10] == 0.0


def test_lines_of_an_entity_are_in_time_order(spark, tmp_path):
    logs = spark.createDataFrame([("e1", f"t{i:03d}", f"m{i}") for i in reversed(range(200))] + [("e2", "t1", "x")], "entity string, ts_raw string, message string").repartition(5)
    sources.write_by_entity(logs, str(tmp_path / "out"))
    lines = [line for f in sorted((tmp_path / "out" / "entity=e1").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == [f"t{i:03d}\tm{i}" for i in range(200)]


def test_ranking_layout(spark, tmp_path):
    r = spark.createDataFrame([("cpu", "a", 1.0), ("cpu", "b", 2.0), ("mem", "a", 3.0)], "metric string, entity string, score double")
    sources.write_rankings(r, r.groupBy("entity").agg({"score": "sum"}).withColumnRenamed("sum(score)", "score"), spark.createDataFrame([(0.5,)], "confidence double"), str(tmp_path / "o"))
    assert [tuple(x) for x in spark.read.option("header", True).csv(str(tmp_path / "o" / "metrics" / "metric=cpu")).collect()] == [("b", "2.0"), ("a", "1.0")]
    assert [x["sensor"] for x in spark.read.option("header", True).csv(str(tmp_path / "o" / "combined")).collect()] == ["a", "b"]
    assert spark.read.option("header", True).csv(str(tmp_path / "o" / "confidence")).first()["confidence"] == "0.5"


def test_span_logs_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text('TimeUnixNano,Other,SpanID,Log\n5,x,s1,"{""log"": ""a, b""}"\n')
    assert [tuple(r) for r in sources.span_logs_csv(spark, str(tmp_path)).collect()] == [(5, "s1", '{"log": "a, b"}')]
