"""Registered queries against DuckDB on the smallest tables."""

import glob
import os

import pytest

from faultline import queries

CHEAP = sorted(queries.ORACLES)


def _norm(df):
    cols = sorted(df.columns)
    fix = lambda v: "null" if v is None or v != v else repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v)
    return cols, sorted(tuple(fix(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", CHEAP)
def test_oracle(spark, data, duck, name):
    got, want = queries.QUERIES[name](spark, data).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert len(got) > 0
    assert _norm(got) == _norm(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows(spark, data, name):
    got = queries.QUERIES[name](spark, data).collect()
    assert got or name in ("bocpd_changepoints", "spot_scores", "stream_online_rca", "fastpc_edges", "rcd")


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_needs_no_llm():
    import ast

    root = os.path.dirname(queries.__file__)
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" in path:
            continue
        for node in ast.walk(ast.parse(open(path).read())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n for n in names), path


def test_column_rules_read_every_event(spark, tmp_path):
    """Only event 1 moves the deviations and the mean."""
    values = [(i, 4000.0 if i == 1 else 1.0) for i in range(101)]
    spark.createDataFrame(values, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["entity"]: r for r in queries.QUERIES["column_rules"](spark, str(tmp_path)).collect()}
    assert got["cart_cpu"]["useful"] and got["a_lat50"]["useful"]
    assert got["pay_latency"]["mean_mb"] == pytest.approx(sum(v for _, v in values) / len(values))


def test_every_metric_has_alarms_and_kpis(spark, data):
    """Alarms of all series by a plain loop; as-of values by scanning the KPI for each of some events."""
    from faultline import views

    obs = views.observations(spark, data).collect()
    series = {}
    for r in sorted(obs, key=lambda r: (r["ts"], r["event_id"])):
        series.setdefault((r["entity"], r["metric"]), []).append(r["value"] / 100)
    want = []
    for key, x in series.items():
        up = down = 0.0
        for i in range(1, len(x)):
            up, down = max(0.0, up + x[i] - x[i - 1] - 0.05), max(0.0, down - (x[i] - x[i - 1]) - 0.05)
            if up > 0.8 or down > 0.8:
                want.append((*key, i))
                up = down = 0.0
    assert sorted(tuple(r) for r in queries.QUERIES["cusum_alarms"](spark, data).collect()) == sorted(want)
    assert len({m for _, m, _ in want}) > 1
    kpi = [(r["ts"], r["value"]) for r in views.kpi(spark, data).collect()]
    got = {r["event_id"]: r["kpi"] for r in queries.QUERIES["kpi_asof"](spark, data).collect()}
    assert len(got) == len(obs)
    for r in obs[::7]:
        assert got[r["event_id"]] == pytest.approx(max(k for k in kpi if k[0] <= r["ts"])[1], abs=1e-6)
