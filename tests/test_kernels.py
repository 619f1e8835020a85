"""Operators that SQL can't say, against plain re-computations."""

import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline import queries, views
from faultline.operators import align, causal, detect, rank, scorers, templates, traces
from faultline.plans import root_cause
from faultline.streaming import Convergence, OnlineRanking, online


def long_frame(spark, x, names, extra="a"):
    return spark.createDataFrame([(extra, n, t, float(x[t, k])) for t in range(len(x)) for k, n in enumerate(names)], "g string, entity string, ts long, value double")


# ------------------------------------------------------------- change points


def _plain_cusum(x, threshold, drift):
    up = down = 0.0
    out = []
    for i in range(1, len(x)):
        up, down = max(0.0, up + x[i] - x[i - 1] - drift), max(0.0, down - x[i] + x[i - 1] - drift)
        if up > threshold or down > threshold:
            out.append(i)
            up = down = 0.0
    return out


def test_cusum_equals_plain_loop():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.normal(size=int(rng.integers(1, 400)))
        x = np.cumsum(x) if rng.random() < 0.5 else x
        threshold, drift = float(rng.choice([0.5, 2, 6])), float(rng.choice([0, 0.1]))
        found = detect.cusum(x, threshold, drift)
        assert [a for a, _ in found] == _plain_cusum(x, threshold, drift)
        for (_, before), (alarm, start) in zip([(0, 0), *found], found, strict=False):
            assert before <= start <= alarm


def test_cusum_rounds_as_the_recurrence_does():
    """The sums of 0.4 and 0.5 less the drift are 0.8 on paper; step by step they round to no more than that."""
    assert detect.cusum(np.array([0.7, 1.1, 1.6]), 0.8, 0.05) == []
    rng = np.random.default_rng(33)
    for _ in range(300):
        x = rng.integers(0, 20, 60) / 10
        up = down = 0.0
        want = []
        for i in range(1, len(x)):
            up, down = max(0.0, up + x[i] - x[i - 1] - 0.05), max(0.0, down - (x[i] - x[i - 1]) - 0.05)
            if up > 0.8 or down > 0.8:
                want.append(i)
                up = down = 0.0
        assert [a for a, _ in detect.cusum(x, 0.8, 0.05)] == want


def test_cusum_goes_on_after_a_missing_value():
    assert detect.cusum(np.array([0.0, np.nan, 0.0, 5.0]), 2.0) == [(3, 2)]


def test_cusum_ends_are_the_starts_of_the_reversed_series():
    x = np.concatenate([np.zeros(20), np.full(20, 5.0), np.zeros(20)])
    found = detect.cusum_changes(x, 2.0)
    assert [(alarm, end) for alarm, _, end, _ in found][-1][0] in (20, 40)
    assert detect.cusum_changes(np.array([0, 0, 0, 5, 5, 5, 0, 0.0]), 2.0) == [(3, 0, 7, 0.0)]
    assert detect.cusum_changes(np.zeros(5), 1.0) == [] and detect.cusum_changes(np.zeros(0), 1.0) == []
    ramp = np.concatenate([np.zeros(10), np.arange(0, 9, 3.0), np.full(10, 6.0)])
    for alarm, start, end, amplitude in detect.cusum_changes(ramp, 2.0):
        assert start <= alarm <= end and amplitude == ramp[end] - ramp[start]


def _plain_run_lengths(x, hazard):
    """Run-length posterior with every run's density worked out from its rows anew."""
    n, d = x.shape

    def log_density(seen, row):
        m = len(seen)
        kappa, dof = 1.0 + m, d + 1.0 + m
        mean = seen.sum(0) / kappa if m else np.zeros(d)
        centre = seen.mean(0) if m else np.zeros(d)
        scatter = np.eye(d) + (seen - centre).T @ (seen - centre) + (m / kappa) * np.outer(centre, centre)
        v = dof - d + 1
        shape = scatter * (kappa + 1) / (kappa * v)
        off = row - mean
        return math.lgamma((v + d) / 2) - math.lgamma(v / 2) - d / 2 * math.log(v * math.pi) - 0.5 * np.linalg.slogdet(shape)[1] - (v + d) / 2 * math.log1p(off @ np.linalg.solve(shape, off) / v)

    chance, best = np.ones(1), []
    for t in range(n):
        best.append(int(chance.argmax()))
        dens = np.exp([log_density(x[t - r : t], x[t]) for r in range(t + 1)])
        new = np.append((chance * dens).sum() * hazard, chance * dens * (1 - hazard))
        chance = new / new.sum()
    return [*best, 0]


@pytest.mark.parametrize("dims", [1, 3])
def test_run_lengths_equal_plain_posterior(dims):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(0.2, 0.05, (40, dims)), rng.normal(0.8, 0.1, (40, dims))])
    assert detect.run_lengths(x, 0.02).tolist() == _plain_run_lengths(x, 0.02)


def test_bocpd_query_changes(spark, data):
    p = queries._patched(spark, data).toPandas()
    want = []
    for metric, part in p.groupby("metric"):
        wide = part.pivot_table(index="patch", columns="entity", values="value").sort_index()
        x = ((wide - wide.min()) / (wide.max() - wide.min()).replace(0, np.nan)).ffill().fillna(0).to_numpy()
        m = _plain_run_lengths(x, 1 / 50)
        want += [(metric, i) for i in range(1, len(m)) if abs(m[i] - m[i - 1]) > 1]
    assert sorted(tuple(r) for r in queries.bocpd_changepoints(spark, data).collect()) == sorted(want)


def test_spot_query_scores(spark, data):
    w = views.weekly(spark, data).toPandas().sort_values("ts")
    raw = {k: detect.spot_score(part["value"].to_numpy(float), n_init=60) for k, part in w.groupby(["metric", "entity"])}
    total = pd.Series(raw).groupby(level=0).sum()
    for r in queries.spot_scores(spark, data).collect():
        whole = total[r["metric"]]
        assert r["score"] is None or r["score"] == pytest.approx(raw[r["metric"], r["entity"]] / whole if whole else 0, abs=1e-6)


def test_tail_fit_recovers_a_pareto_tail():
    rng = np.random.default_rng(4)
    for gamma, sigma in ((0.3, 2.0), (-0.2, 1.0)):
        u = rng.random(20_000)
        g, s = detect.fit_tail(sigma / gamma * (u**-gamma - 1))
        assert g == pytest.approx(gamma, abs=0.05) and s == pytest.approx(sigma, rel=0.06)


# ------------------------------------------------------------- graphs


def _residual_correlation(x, i, j, given):
    a = np.column_stack([np.ones(len(x)), *(x[:, k] for k in given)])
    r = [x[:, k] - a @ np.linalg.lstsq(a, x[:, k], rcond=None)[0] for k in (i, j)]
    return float(np.corrcoef(r)[0, 1])


def _linear_system(rng, n=4000):
    a = rng.normal(size=n)
    b = 0.9 * a + rng.normal(size=n)
    c = 0.9 * b + rng.normal(size=n)
    d = rng.normal(size=n)
    e = 0.7 * c + 0.7 * d + rng.normal(size=n)
    return np.column_stack([a, b, c, d, e])


def test_partial_correlation_equals_residuals():
    x = _linear_system(np.random.default_rng(5), 300)
    for i, j in itertools.combinations(range(5), 2):
        rest = [k for k in range(5) if k not in (i, j)]
        for size in range(4):
            for given in itertools.combinations(rest, size):
                assert causal.partial_correlation(x, i, j, list(given)) == pytest.approx(_residual_correlation(x, i, j, given), abs=1e-9)
    assert causal.partial_correlation(np.column_stack([x, np.ones(300)]), 0, 5, [1]) == 0.0


def test_pc_skeleton_equals_tests_of_all_subsets():
    """On data without ties to luck an edge stays if and only if no set of the others parts its ends; all orders are tested."""
    x = _linear_system(np.random.default_rng(6))
    adj, apart = causal.pc_kernel(x, 1e-6)
    crit = 4.8916
    for i, j in itertools.combinations(range(5), 2):
        rest = [k for k in range(5) if k not in (i, j)]
        independent = any(math.atanh(abs(_residual_correlation(x, i, j, g))) <= crit / math.sqrt(len(x) - len(g) - 3) for size in range(4) for g in itertools.combinations(rest, size))
        assert adj[i, j] == (not independent)
    d = causal.orient(adj, apart)
    assert d[2, 4] and d[3, 4] and not d[4, 2] and not d[4, 3]


def test_prior_knowledge(spark):
    x = _linear_system(np.random.default_rng(7), 1500)
    s = long_frame(spark, x, "abcde")
    rules = spark.createDataFrame([("known", "a", "b", None), ("tier", "c", None, 1), ("tier", "b", None, 0), ("forbidden", "e", "d", None)], "kind string, src string, dst string, tier int")
    forbidden, tiers, known = causal.prior_knowledge(rules)
    assert (forbidden, tiers, known) == ({("e", "d")}, {"c": 1, "b": 0}, {("a", "b")})
    got = {(r["src"], r["dst"]) for r in causal.pc_edges(s, ["g"], "ts", forbidden=forbidden, tiers=tiers, known=known).collect()}
    assert {("a", "b"), ("b", "c"), ("c", "e"), ("d", "e")} == got
    with pytest.raises(ValueError):
        causal.prior_knowledge(rules.withColumn("kind", F.lit("x")))


def test_partial_strengths(spark):
    x = _linear_system(np.random.default_rng(8), 400)
    s = long_frame(spark, x, ["a", "b", "c", "d", "kpi"])
    edges = spark.createDataFrame([("a", "a", "b"), ("a", "b", "c"), ("a", "c", "kpi"), ("a", "d", "kpi")], "g string, src string, dst string")
    got = {r["entity"]: r["r"] for r in causal.partial_strengths(s, edges, ["g"], "ts", "kpi").collect()}
    parents = {0: [], 1: [0], 2: [1], 3: []}
    for k, name in enumerate("abcd"):
        given = sorted({2, 3, *parents[k]} - {k, 4})
        assert got[name] == pytest.approx(abs(_residual_correlation(x, 4, k, given)), abs=1e-9)
    assert got["kpi"] == 0.0


def test_transitions_follow_their_definition(spark):
    rng = np.random.default_rng(9)
    names = ["a", "b", "c", "kpi"]
    for _ in range(3):
        w = (rng.random((4, 4)) < 0.5) & ~np.eye(4, dtype=bool)
        r = np.append(rng.random(3), 0.0)
        q = np.zeros((4, 4))
        for i in range(4):
            causes = [j for j in range(4) if w[j, i]]
            for j in causes:
                q[i, j] = r[j]
                if not w[i, j]:
                    q[j, i] = 0.01 * r[i]
        for i in range(4):
            q[i, i] = max(0.0, r[i] - max((r[j] for j in range(4) if w[j, i]), default=0.0))
        total = q.sum(1, keepdims=True)
        q = q / np.where(total == 0, 1, total)
        edges = spark.createDataFrame([("g", names[i], names[j]) for i, j in np.argwhere(w)], "g string, src string, dst string")
        got = np.zeros((4, 4))
        for t in causal.transitions(edges, spark.createDataFrame([("g", n, float(v)) for n, v in zip(names, r, strict=True)], "g string, entity string, r double"), ["g"]).collect():
            got[names.index(t["src"]), names.index(t["dst"])] = t["p"]
        assert np.allclose(got, q)


def test_granger_meets_its_optimality_conditions():
    """Causes are found, and every group of lags meets the group lasso's conditions."""
    rng = np.random.default_rng(10)
    x = np.zeros((600, 3))
    for t in range(2, 600):
        x[t, 0] = rng.normal()
        x[t, 1] = 0.8 * x[t - 1, 0] + 0.3 * rng.normal()
        x[t, 2] = 0.8 * x[t - 2, 1] + 0.3 * rng.normal()
    w = causal.granger_kernel(x, 2, 0.05, 2000)
    off = w * ~np.eye(3, dtype=bool)
    assert off[0, 1] > 0.5 and off[1, 2] > 0.5 and off[2, 0] == 0 and off[1, 0] == 0
    assert (causal.granger_kernel(x, 2, 10.0) == 0).all() and causal.granger_kernel(x[:2], 2, 0.1).shape == (3, 3)


def test_regression_scores(spark):
    rng = np.random.default_rng(11)
    x = _linear_system(rng, 200)
    x[150:, 1] += 6.0
    s = long_frame(spark, x, "abcde").withColumn("part", F.when(F.col("ts") < 120, "train").otherwise("test"))
    edges = spark.createDataFrame([("a", "a", "b"), ("a", "b", "c"), ("a", "c", "e"), ("a", "d", "e")], "g string, src string, dst string")
    got = {r["entity"]: r["score"] for r in causal.regression_scores(s, edges, ["g"], "ts").collect()}
    for k, parents in ((0, []), (1, [0]), (2, [1]), (3, []), (4, [2, 3])):
        a = np.column_stack([np.ones(200), *(x[:, p] for p in parents)])
        beta = np.linalg.solve(a[:120].T @ a[:120], a[:120].T @ x[:120, k])
        e = x[:, k] - a @ beta
        assert got["abcde"[k]] == pytest.approx(np.abs((e[120:] - e[:120].mean()) / e[:120].std()).max(), rel=1e-6)


def test_fnode_scores(spark):
    """Counts by hand: chi-squared of the binned values against the part, alone and given each other candidate."""
    rng = np.random.default_rng(12)
    n = 400
    part = np.arange(n) >= 200
    a = rng.normal(size=n) + 2.5 * part
    x = np.column_stack([a, a + 0.1 * rng.normal(size=n), rng.normal(size=n)])
    s = long_frame(spark, x, "abc").withColumn("part", F.when(F.col("ts") < 200, "train").otherwise("test"))
    got = {r["entity"]: r["score"] for r in causal.discretised_fnode_scores(s, ["g"], "ts").collect()}
    bins = {c: np.array([sum(v >= q for q in np.quantile(x[:, k], [0.2, 0.4, 0.6, 0.8])) for v in x[:, k]]) for k, c in enumerate("abc")}

    def chi(c, given):
        total = dof = 0
        for g in sorted(set(bins[given])) if given else [None]:
            rows = [i for i in range(n) if given is None or bins[given][i] == g]
            seen = sorted({bins[c][i] for i in rows})
            parts = [[sum(part[i] == p and bins[c][i] == v for i in rows) for v in seen] for p in (False, True)]
            if len(seen) < 2 or not all(map(sum, parts)):
                continue
            for p in parts:
                for k, count in enumerate(p):
                    want = sum(p) * (parts[0][k] + parts[1][k]) / len(rows)
                    total += (count - want) ** 2 / want
            dof += len(seen) - 1
        return (total - dof) / math.sqrt(2 * dof) if dof else -1.0

    alone = {c: chi(c, None) for c in "abc"}
    candidates = [c for c in "abc" if alone[c] > 0.6744897501960817]
    want = {c: min([alone[c], *(chi(c, o) for o in candidates if o != c)]) for c in candidates}
    assert set(got) <= set(want) and all(got[c] == pytest.approx(want[c], rel=1e-9) for c in got) and max(got, key=got.get) == max(want, key=want.get)


def test_log_pca_equals_svd(spark, data):
    counts = views.logs(spark, data).groupBy("entity", F.expr("ts div 3600").alias("hour"), F.col("message").alias("event")).agg(F.count("*").alias("n")).toPandas()
    got = queries.log_pca(spark, data).toPandas()
    assert len(got) > 0
    for entity, part in counts.groupby("entity"):
        wide = part.pivot_table(index="hour", columns="event", values="n", aggfunc="sum").fillna(0).sort_index()
        x = wide.to_numpy(float) * np.log(len(wide) / (wide.to_numpy() > 0).sum(0))
        x = x - x.mean(0)
        _, s, vt = np.linalg.svd(x, full_matrices=False)
        mine = got[got["entity"] == entity].sort_values("hour")
        if len(s) > 1 and s[0] - s[1] > 1e-6 * s[0]:
            assert np.allclose(np.abs(mine["score"]), np.abs(x @ vt[0]), atol=1e-4)
            assert np.allclose(mine["spe"], ((x - np.outer(x @ vt[0], vt[0])) ** 2).sum(1), atol=1e-4)


def test_quantile_and_online_thresholds(spark):
    rng = np.random.default_rng(13)
    w = np.where(rng.random((8, 8)) < 0.3, rng.random((8, 8)), 0.0)
    e = spark.createDataFrame([("g", str(i), str(j), float(w[i, j]), 8) for i, j in np.argwhere(w > 0)], "g string, src string, dst string, weight double, n int")
    got = {(r["src"], r["dst"]) for r in rank.quantile_edges(e, ["g"], "n").collect()}
    assert got == {(str(i), str(j)) for i, j in np.argwhere(w > np.quantile(w.flatten(), 0.95))}
    flat = sorted(w.flatten(), reverse=True)
    cut = max(0.5, flat[math.ceil(0.3 * 64) - 1])
    assert {(r["src"], r["dst"]) for r in rank.online_threshold(e, ["g"], "n", floor=0.5).collect()} == {(str(i), str(j)) for i, j in np.argwhere(w > cut)}


# ------------------------------------------------------------- times, traces, templates


def test_asof_in_ranges_equals_scan(spark):
    rng = np.random.default_rng(14)
    left = [(i, str(rng.integers(0, 3)), int(rng.integers(0, 1000))) for i in range(300)]
    right = [(str(rng.integers(0, 3)), int(rng.integers(0, 1000)), None if i % 9 == 0 else float(i)) for i in range(60)]
    l, r = spark.createDataFrame(left, "id int, k string, ts long"), spark.createDataFrame(right, "k string, ts long, v double")
    for keys, width in (([], 40), (["k"], 40), (["k"], 7), (["k"], None), ([], 5000)):
        rows = right if keys else [("", t, v) for _, t, v in right]
        got = {x["id"]: x["v"] for x in align.asof_backward(l if keys else l.drop("k"), r if keys else r.drop("k"), keys, "ts", "v", width).collect()}
        for i, k, t in left:
            past = [(s, v) for kk, s, v in rows if s <= t and v is not None and (kk == k or not keys)]
            last = max((s for s, _ in past), default=None)
            assert got[i] == max((v for s, v in past if s == last), default=None)


def test_anomalies_or_peak(spark):
    s = spark.createDataFrame([("a", i, 9.0 if i == 8 else 1.0) for i in range(20)] + [("b", i, float(-abs(i - 12))) for i in range(20)] + [("c", i, 1.0) for i in range(3)], "e string, ts long, value double")
    assert {(r["e"], r["row"]) for r in scorers.anomalies_or_peak(s, ["e"], 5.0).collect()} == {("a", 8), ("b", 12)}


def test_event_depths_end_at_cycles(spark):
    edges = spark.createDataFrame([("1", "root start", "x", "p", 0), ("1", "x", "y start", "q", 1), ("1", "y start", "z", "q", 2), ("1", "other start", "z", "r", 3), ("2", "m start", "n", "p", 0), ("2", "n", "m start", "p", 1)], "trace string, src string, dst string, dst_pod string, o int")
    got = {(r["trace"], r["event"]): (r["depth"], r["pod"]) for r in traces.event_depths(edges, ["o"]).collect()}
    assert got == {("1", "x"): (1, "p"), ("1", "y start"): (1, "q"), ("1", "z"): (2, "q"), ("2", "n"): (1, "p"), ("2", "m start"): (1, "p")}
    best = {r["event"]: (r["depth"], r["pod"]) for r in traces.deepest(traces.event_depths(edges, ["o"])).collect()}
    assert best["z"] == (2, "q")


def test_rank_patterns_keeps_the_deepest_of_an_alarmed_pod(spark):
    scored = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 0.8), ("e", "f", 0.9)], "src string, dst string, score double")
    depths = spark.createDataFrame([("a", 1, "p"), ("b", 3, "p"), ("c", 3, "p")], "event string, depth int, pod string")
    alarms = spark.createDataFrame([("p", "CpuUsageRate", 1), ("p", "Early", 0)], "pod string, metric_type string, position int")
    got = [tuple(r) for r in traces.rank_patterns(scored, depths, alarms, "front").orderBy("rank").collect()]
    assert got == [("b", "c", 1.0, 3, "p", "Early", 1), ("e", "f", 0.9, 1, "front", None, 2)]


def test_alarm_order_decides(spark):
    s = spark.createDataFrame([("p", 1, "NetworkTx", 250.0, 0), ("p", 1, "CpuUsageRate", 90.0, 1), ("q", 1, "CpuUsageRate", 70.0, 0), ("q", 1, "MemoryUsageRate", 81.0, 2)], "pod string, ts long, metric string, value double, position int")
    assert {(r["pod"], r["metric_type"]) for r in traces.first_alarms(s, "hipster").collect()} == {("p", "NetworkTx"), ("q", "MemoryUsageRate")}
    assert {(r["pod"], r["metric_type"]) for r in traces.first_alarms(s, "ts").collect()} == {("p", "CpuUsageRate"), ("q", "MemoryUsageRate")}


def test_miner_settings_state_and_catalogue(spark, tmp_path):
    config = templates.MinerConfig.of({"similarity": 0.5, "max_clusters": 2, "delimiters": ["|"], "mask_prefix": "{", "mask_suffix": "}"})
    with pytest.raises(ValueError):
        templates.MinerConfig.of({"sim": 1})
    text = spark.createDataFrame([("a|b  10.0.0.1 c",)], "m string").select(config.tokenised(F.col("m")).alias("t")).first()["t"]
    assert text.startswith("a b ") and "{" in text and "<" not in text
    miner = templates.TemplateMiner(config)
    assert [miner.add(i, t.split()) for i, t in enumerate(["x one", "y one", "x one", "z one", "y one", "x one"])] == [0, 1, 0, 2, 3, 4]
    lines = spark.createDataFrame([(1, "open file a1"), (2, "open file b2"), (3, "close file x"), (4, ""), (5, "other words here now")], "line_id int, content string")
    mined = templates.mine(lines)
    templates.save_catalogue(templates.catalogue(mined), f"{tmp_path}/state")
    known = templates.load_catalogue(spark, f"{tmp_path}/state")
    again = {r["line_id"]: r["template"] for r in templates.match_only(lines, known).collect()}
    assert again == {r["line_id"]: r["template"] for r in mined.collect()}
    unseen = templates.match_only(spark.createDataFrame([(9, "nothing like any of these")], "line_id int, content string"), known).first()
    assert unseen["template"] is None and unseen["event_id"] is None
    assert {r["line_id"]: r["cluster_id"] for r in templates.numbered(mined).collect()} == {1: 1, 2: 1, 3: 2, 4: 3, 5: 4}
    logs = spark.createDataFrame([('{"log":"open file a1  "}', "adservice-1-2")], "log string, pod string")
    parsed = templates.parse_events(logs, known).first()
    assert parsed["service"] == "adservice" and parsed["template"] == again[1]

class _ScanningMiner(templates.TemplateMiner):
    """Compares a line with every group of its leaf."""

    def match(self, tokens):
        best, best_key = None, (-1.0, -1)
        for g in getattr(self._leaf(tokens, False), "groups", ()):
            template = self.groups[g].template
            key = (sum(a == b for a, b in zip(template, tokens, strict=True) if a != "<*>") / len(tokens), template.count("<*>"))
            if key > best_key:
                best, best_key = g, key
        return best if best is not None and best_key[0] >= self.config.similarity else None


def test_miner_finds_groups_as_a_scan_would():
    rng = np.random.default_rng(5)
    for _ in range(400):
        words = [*"abcdefgh", "x1", "<*>"][: int(rng.integers(2, 11))]
        config = templates.MinerConfig(similarity=float(rng.choice([0, 0.2, 0.4, 0.7, 1])), depth=int(rng.integers(3, 7)), max_children=int(rng.choice([1, 3, 100])), max_clusters=[None, 1, 3][int(rng.integers(3))])
        miner, plain = templates.TemplateMiner(config), _ScanningMiner(config)
        for i in range(40):
            tokens = [str(w) for w in rng.choice(words, int(rng.choice([0, 1, 2, 3, 4, 6])))]
            assert miner.add(i, tokens) == plain.add(i, tokens)
        assert [g.template for g in miner.groups] == [g.template for g in plain.groups]


def test_miner_compares_a_line_with_few_of_many_groups():
    """6,000 lines with words as skewed as a language's: 18 million pairs of 20 tokens, of which few are compared."""
    rng = np.random.default_rng(6)
    lines = [[f"w{int(w)}" for w in 1 / rng.random(20) ** 6] for _ in range(6000)]
    began = time.process_time()
    miner = templates.TemplateMiner()
    for i, tokens in enumerate(lines):
        miner.add(i, tokens)
    assert len(miner.groups) > 4000
    assert time.process_time() - began < 10



def test_miner_as_stream_state(spark, tmp_path):
    texts = ["open file alpha", "open file beta", "close door", "open file gamma", "close window", "close door"]
    for k in range(3):
        spark.createDataFrame([(i, texts[i]) for i in (2 * k, 2 * k + 1)], "line_id long, content string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("line_id long, content string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r["line_id"]: r["template"] for r in online._drain(spark, templates.mine_online(stream), "append").collect()}
    lines = spark.createDataFrame(list(enumerate(texts)), "line_id long, content string")
    assert got == {r["line_id"]: r["template"] for r in templates.mine(lines, running=True).collect()}


# ------------------------------------------------------------- plans and streams


def _planted(spark, n=2000):
    rng = np.random.default_rng(15)
    x = rng.normal(10, 1, (n, 8))
    x[1200:, 3] += 8
    kpi = rng.normal(50, 1, n)
    kpi[1205:] += 8 * 1.5
    obs = spark.createDataFrame([("c", m, f"e{k}", t, float(x[t, k])) for m in ("cpu",) for t in range(n) for k in range(8)], "case_id string, metric string, entity string, ts long, value double")
    return obs, spark.createDataFrame([("c", t, float(v)) for t, v in enumerate(kpi)], "case_id string, ts long, value double")


def test_every_method_ranks_the_planted_fault(spark):
    series, changes = root_cause.prepared(*_planted(spark), 20)
    (change,) = [r["a"] for r in changes.collect()]
    assert abs(change - 60) <= 2
    for method in root_cause.METHODS:
        first = [r["entity"] for r in root_cause.ranking(series, changes, method).orderBy("rank").collect()]
        assert len(first) == 8 if method == "spot" else first[0] == "e3", (method, first)  # 100 pooled rows only initialise the tails


def test_online_detector_through_the_stream(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet").select("event_type", "ts", (F.col("value") / 100).alias("a"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("b")).toPandas()
    want = []
    for kind, part in e.groupby("event_type"):
        d = online.OnlineDetector(window=20, shift=3, stride=4, pool=2)
        rows = part.sort_values("ts")[["a", "b"]].to_numpy(float).tolist()
        want += [(kind, c) for c in d.push(rows)]
    got = [(r["event_type"], r["change"]) for r in queries.stream_online_rca(spark, data).collect()]
    assert sorted(got) == sorted(want)


def test_online_ranking_stops_once_rankings_agree(spark, tmp_path):
    obs, _ = _planted(spark, 1800)
    for k in range(6):
        obs.where((F.col("ts") >= 300 * k) & (F.col("ts") < 300 * k + 300)).drop("case_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("metric string, entity string, ts long, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    r = OnlineRanking(f"{tmp_path}/out", method="baro", start=1250, keep=1500, failure_time=1200, tolerance=200, convergence=Convergence(depth=1, times=1))
    got = r.run(stream).collect()
    by = {b: [x["entity"] for x in sorted(got, key=lambda x: x["rank"]) if x["batch"] == b] for b in {x["batch"] for x in got}}
    assert sorted(by) == [4, 5] and by[4][0] == by[5][0] == "e3" and r.done
    assert {x["early"] for x in got if x["batch"] == 4} == {True} and {x["early"] for x in got if x["batch"] == 5} == {False}
