"""Causal graphs over entities: independence tests, transitions, walks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import frame
from ..functions.numeric import fisher_z, normal_quantile


def tests_order_0(corr: DataFrame, keys: list[str], alpha: float = 1e-6) -> DataFrame:
    """Per pair Fisher's z, the critical value, and whether the edge stays."""
    critical = F.lit(normal_quantile(1 - alpha / 2)) / F.sqrt(F.col("n") - 3)
    return corr.withColumn("z", fisher_z(F.col("r"))).withColumn("critical", critical).withColumn("dependent", F.col("z") > F.col("critical"))


def partial_order_1(corr: DataFrame, keys: list[str]) -> DataFrame:
    """Partial correlation of each pair (a < b) given each third entity c."""
    both = corr.select(*keys, "a", "b", "r", "n").unionByName(corr.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "r", "n"))
    ac = both.select(*keys, "a", F.col("b").alias("c"), F.col("r").alias("ac"))
    bc = both.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"), F.col("r").alias("bc"))
    j = corr.select(*keys, "a", "b", "r", "n").join(ac, [*keys, "a"]).where("c <> b").join(bc, [*keys, "b", "c"])
    return j.withColumn("partial", (F.col("r") - F.col("ac") * F.col("bc")) / F.sqrt(F.greatest((1 - F.col("ac") ** 2) * (1 - F.col("bc") ** 2), F.lit(1e-12))))


def tests_order_1(corr: DataFrame, keys: list[str], alpha: float = 1e-6) -> DataFrame:
    """Pairs (a < b) that stay dependent given each single third entity: a, b, least z."""
    p = partial_order_1(corr, keys).withColumn("z", fisher_z(F.col("partial")))
    g = p.groupBy(*keys, "a", "b").agg(F.min("z").alias("z"), F.first("n").alias("n"))
    return g.withColumn("critical", F.lit(normal_quantile(1 - alpha / 2)) / F.sqrt(F.col("n") - 4)).withColumn("dependent", F.col("z") > F.col("critical"))


def transitions(edges: DataFrame, strength: DataFrame, keys: list[str], rho: float = 0.01) -> DataFrame:
    """Row-stochastic transitions from causal edges(src, dst) and strength(entity, r): |correlation| with the KPI.

    A walker steps back along an edge to its cause with the cause's strength,
    forward with rho times the effect's strength if no edge leads back, and stays
    with what its own exceeds the greatest of its causes' by. Rows of strength 0
    stay 0.
    """
    r = strength.select(*keys, "entity", F.abs("r").alias("r"))
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")).join(r.withColumnRenamed("entity", "dst"), [*keys, "dst"]).select(*keys, "src", "dst", F.col("r").alias("w"))
    reverse = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    forward = edges.join(reverse, [*keys, "src", "dst"], "left_anti").join(r.withColumnRenamed("entity", "dst"), [*keys, "dst"]).select(*keys, "src", "dst", (rho * F.col("r")).alias("w"))
    steps = back.unionByName(forward).groupBy(*keys, "src", "dst").agg(F.max("w").alias("w"))
    top = back.groupBy(*keys, "src").agg(F.max("w").alias("_top"))
    own = r.withColumnRenamed("entity", "src").join(top, [*keys, "src"], "left").select(*keys, "src", F.col("src").alias("dst"), F.greatest(F.lit(0.0), F.col("r") - F.coalesce("_top", F.lit(0.0))).alias("w"))
    all_ = steps.unionByName(own)
    total = F.sum("w").over(Window.partitionBy(*keys, "src"))
    return all_.withColumn("p", F.coalesce(F.col("w") / F.nullif(total, F.lit(0.0)), F.lit(0.0))).where("p > 0").select(*keys, "src", "dst", "p")


def partial_correlation(x: np.ndarray, i: int, j: int, given: list[int]) -> float:
    """Correlation of two columns after both are regressed on others, from the inverse of the correlation matrix; 0 for a constant column."""
    ix = [i, j, *given]
    part = x[:, ix]
    part = part[:, [0, 1] + [k for k in range(2, len(ix)) if part[:, k].std() > 0]]
    if part[:, 0].std() == 0 or part[:, 1].std() == 0:
        return 0.0
    p = np.linalg.pinv(np.corrcoef(part.T), hermitian=True)
    return float(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1])) if p[0, 0] > 0 and p[1, 1] > 0 else 0.0


def partial_strengths(series: DataFrame, edges: DataFrame, keys: list[str], row: str, target: str) -> DataFrame:
    """(keys, entity, r): |partial correlation| of each entity with ``target`` given the parents of both; 0 for the target itself.

    A parent is the source of an edge, both ends of an undirected one. A group's
    pooled series are one small matrix.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return frame({c: [] for c in (*keys, "entity", "r")})
        wide = left.pivot_table(index=row, columns="entity", values="value").sort_index().dropna()
        names = list(wide.columns)
        at, x = {n: i for i, n in enumerate(names)}, wide.to_numpy(float)
        parents: dict[str, set[str]] = {n: set() for n in names}
        for a, b in zip(right["src"], right["dst"], strict=True):
            if a in at and b in at and a != b:
                parents[b].add(a)
        out = []
        for n in names:
            given = sorted((parents.get(target, set()) | parents[n]) - {n, target})
            r = abs(partial_correlation(x, at[target], at[n], [at[g] for g in given])) if n != target and target in at else 0.0
            out.append((*key, n, r))
        return pd.DataFrame(out, columns=[*keys, "entity", "r"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema if f.name in keys)
    return series.groupBy(*keys).cogroup(edges.groupBy(*keys)).applyInPandas(run, f"{schema}, entity string, r double")


def granger_edges(series: DataFrame, keys: list[str], row: str, lag: int = 2, penalty: float = 0.02, rounds: int = 200) -> DataFrame:
    """(keys, src, dst, weight): linear Granger causes by group lasso, one vector autoregression per entity.

    Standardised series are regressed on the ``lag`` values before of all; the
    lags of one entity are one group, whose norm is the edge's weight. Solved by
    block coordinate descent with the groups' proximal step.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=row, columns="entity", values="value").sort_index().dropna()
        names = list(wide.columns)
        weights = granger_kernel(wide.to_numpy(float), lag, penalty, rounds)
        i, j = np.nonzero(weights)
        return frame({**{k: [pdf[k].iloc[0]] * len(i) for k in keys}, "src": [names[k] for k in i], "dst": [names[k] for k in j], "weight": weights[i, j]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema if f.name in keys)
    return series.groupBy(*keys).applyInPandas(run, f"{schema}, src string, dst string, weight double")


def granger_kernel(x: np.ndarray, lag: int, penalty: float, rounds: int = 200) -> np.ndarray:
    """Norms w[i, j] of the lags of column i in the regression of column j; 0 where the penalty shuts them out."""
    n, d = x.shape
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1.0)
    if n <= lag + 1:
        return np.zeros((d, d))
    past = np.stack([z[lag - 1 - k : n - 1 - k] for k in range(lag)], 2)  # row, entity, lag
    rows = len(past)
    step = np.array([max(np.linalg.eigvalsh(past[:, i].T @ past[:, i] / rows)[-1], 1e-12) for i in range(d)])
    out = np.zeros((d, d))
    for j in range(d):
        beta, rest = np.zeros((d, lag)), z[lag:, j].copy()
        for _ in range(rounds):
            moved = 0.0
            for i in range(d):
                target = beta[i] + past[:, i].T @ rest / rows / step[i]
                size = np.linalg.norm(target)
                new = target * max(0.0, 1 - penalty / step[i] / size) if size > 0 else target
                if (new != beta[i]).any():
                    rest -= past[:, i] @ (new - beta[i])
                    moved = max(moved, float(np.abs(new - beta[i]).max()))
                    beta[i] = new
            if moved < 1e-8:
                break
        out[:, j] = np.linalg.norm(beta, axis=1)
    return out


def prior_knowledge(frame_: DataFrame) -> tuple[set[tuple[str, str]], dict[str, int], set[tuple[str, str]]]:
    """(forbidden edges, tiers, known edges) from rows (kind, src, dst, tier), a file written by hand.

    kind is ``forbidden`` or ``known``, with src and dst, or ``tier``, with src and
    its tier: no edge leads from a later tier to an earlier one.
    """
    forbidden, tiers, known = set(), {}, set()
    for r in frame_.toLocalIterator():
        if r["kind"] == "tier":
            tiers[r["src"]] = int(r["tier"])
        elif r["kind"] in ("forbidden", "known"):
            (forbidden if r["kind"] == "forbidden" else known).add((r["src"], r["dst"]))
        else:
            raise ValueError(f"unknown kind {r['kind']}")
    return forbidden, tiers, known


def walk_kernel(q: np.ndarray, start: int, restart: float = 0.05, steps: int = 100) -> np.ndarray:
    """Visits of a walk with restart by power iteration; what a row lacks to 1 restarts."""
    e = np.zeros(len(q))
    e[start] = 1
    p = e.copy()
    for _ in range(steps):
        moved = (1 - restart) * (q.T @ p)
        p = moved + (1 - moved.sum()) * e
    return p


def walk(trans: DataFrame, keys: list[str], start: str, restart: float = 0.05, steps: int = 100) -> DataFrame:
    """(keys, entity, score): visits of a walk from the entity ``start`` in each graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["src"], *pdf["dst"], start})
        at = {n: i for i, n in enumerate(names)}
        q = np.zeros((len(names), len(names)))
        q[pdf["src"].map(at), pdf["dst"].map(at)] = pdf["p"]
        return frame({**{k: [pdf[k].iloc[0]] * len(names) for k in keys}, "entity": names, "score": walk_kernel(q, at[start], restart, steps)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trans.schema if f.name in keys)
    return trans.groupBy(*keys).applyInPandas(run, f"{schema}, entity string, score double")


def pc_kernel(x: np.ndarray, alpha: float = 1e-6, max_order: int | None = None) -> tuple[np.ndarray, dict]:
    """Skeleton (boolean matrix) and separating sets by order-independent PC on Gaussian data.

    Orders rise until no node has enough neighbours, or to ``max_order``.
    Correlations are not disturbed; inverses get a ridge of 1e-9.
    """
    n, d = x.shape
    sd = x.std(0)
    corr = np.corrcoef(x[:, sd > 0].T) if (sd > 0).sum() > 1 else np.eye(int((sd > 0).sum()))
    full = np.eye(d)
    live = np.flatnonzero(sd > 0)
    full[np.ix_(live, live)] = corr
    adj = ~np.eye(d, dtype=bool)
    apart: dict[tuple[int, int], tuple[int, ...]] = {}
    crit = normal_quantile(1 - alpha / 2)
    for order in range(d if max_order is None else max_order + 1):
        if n - order - 3 <= 0 or adj.sum(1).max(initial=0) - 1 < order:
            break
        frozen = adj.copy()
        for i, j in combinations(range(d), 2):
            if not adj[i, j]:
                continue
            for a, b in ((i, j), (j, i)):
                pool = [k for k in np.flatnonzero(frozen[a]) if k != b]
                if order and len(pool) < order:
                    continue
                hit = None
                for given in combinations(pool, order):
                    ix = [i, j, *given]
                    p = np.linalg.inv(full[np.ix_(ix, ix)] + 1e-9 * np.eye(len(ix)))
                    r = min(abs(p[0, 1]) / np.sqrt(p[0, 0] * p[1, 1]), 0.999999)
                    if 0.5 * np.log1p(2 * r / (1 - r)) <= crit / np.sqrt(n - order - 3):
                        hit = given
                        break
                if hit is not None:
                    adj[i, j] = adj[j, i] = False
                    apart[i, j] = tuple(int(k) for k in hit)
                    break
    return adj, apart


def orient(adj: np.ndarray, apart: dict, forbidden: set[tuple[int, int]] = frozenset(), known: set[tuple[int, int]] = frozenset(), tier: dict[int, int] | None = None) -> np.ndarray:
    """Partly directed graph (d[i, j]: i -> j possible) from a skeleton: prior knowledge, v-structures, then Meek's rules 1 to 3 to a fixpoint."""
    d = adj.copy()
    n = len(d)
    for i, j in forbidden:
        if d[j, i]:
            d[i, j] = False
    for i, j in known:
        d[i, j], d[j, i] = True, False
    if tier:
        for i in range(n):
            for j in range(n):
                if d[i, j] and d[j, i] and i in tier and j in tier and tier[i] > tier[j]:
                    d[i, j] = False
    for k in range(n):
        for i, j in combinations(np.flatnonzero(adj[k]).tolist(), 2):
            if not adj[i, j] and k not in apart.get((min(i, j), max(i, j)), ()):
                if d[i, k] and d[j, k]:
                    d[k, i] = d[k, j] = False
    while True:
        before = d.copy()
        one_way = d & ~d.T
        for i in range(n):
            for j in range(n):
                if not (d[i, j] and d[j, i]):
                    continue
                into = np.flatnonzero(one_way[:, i])
                chain = one_way[i] & one_way[:, j]
                spouses = [k for k in range(n) if d[i, k] and d[k, i] and one_way[k, j]]
                if (~adj[into, j]).any() or chain.any() or any(not adj[a, b] for a, b in combinations(spouses, 2)):
                    d[j, i] = False
        if (d == before).all():
            return d


def pc_edges(series: DataFrame, keys: list[str], row: str, alpha: float = 1e-6, max_order: int | None = None, forbidden: set[tuple[str, str]] = frozenset(), tiers: dict[str, int] | None = None, known: set[tuple[str, str]] = frozenset()) -> DataFrame:
    """(keys, src, dst): edges of the PC graph of each group's entities, both ways where undirected, under prior knowledge by name.

    Groups are pooled series, a few hundred rows of a few hundred entities.
    Tests go up to the order that the graph's degrees allow, or to ``max_order``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=row, columns="entity", values="value").sort_index().dropna()
        names = list(wide.columns)
        at = {n: i for i, n in enumerate(names)}
        pairs = lambda some: {(at[a], at[b]) for a, b in some if a in at and b in at}
        d = orient(*pc_kernel(wide.to_numpy(float), alpha, max_order), pairs(forbidden), pairs(known), {at[n]: t for n, t in (tiers or {}).items() if n in at})
        i, j = np.nonzero(d)
        return frame({**{k: [pdf[k].iloc[0]] * len(i) for k in keys}, "src": [names[k] for k in i], "dst": [names[k] for k in j]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema if f.name in keys)
    return series.groupBy(*keys).applyInPandas(run, f"{schema}, src string, dst string")


def break_cycles(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Without the least edge of each cycle found, until there is none."""
    edges = sorted(set(edges))
    while True:
        out: dict[str, list[str]] = {}
        for a, b in edges:
            out.setdefault(a, []).append(b)
        state: dict[str, int] = {}
        cycle: list[tuple[str, str]] | None = None

        def visit(root: str) -> list[tuple[str, str]] | None:
            path, todo = [], [(root, iter(out.get(root, ())))]
            state[root] = 1
            path.append(root)
            while todo:
                node, rest = todo[-1]
                for b in rest:
                    if state.get(b) == 1:
                        ring = path[path.index(b) :] + [b]
                        return list(zip(ring[:-1], ring[1:], strict=True))
                    if b not in state:
                        state[b] = 1
                        path.append(b)
                        todo.append((b, iter(out.get(b, ()))))
                        break
                else:
                    state[node] = 2
                    path.pop()
                    todo.pop()
            return None

        for a in sorted(out):
            if a not in state and (cycle := visit(a)):
                break
        if not cycle:
            return edges
        edges.remove(min(cycle))


def regression_scores(series: DataFrame, edges: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Greatest absolute z of the test rows' residuals, each entity regressed on its parents over the train rows (part)."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return frame({c: [] for c in (*keys, "entity", "score")})
        wide = left.pivot_table(index=row, columns="entity", values="value").sort_index().dropna()
        train = left[left["part"] == "train"][row].unique()
        is_train = wide.index.isin(train)
        kept = break_cycles(list(zip(right["src"], right["dst"], strict=True)))
        rows = []
        for name in wide.columns:
            parents = [a for a, b in kept if b == name and a in wide.columns]
            a = np.column_stack([np.ones(len(wide)), *(wide[p].to_numpy(float) for p in parents)])
            y = wide[name].to_numpy(float)
            beta, *_ = np.linalg.lstsq(a[is_train], y[is_train], rcond=None)
            e = y - a @ beta
            sd = e[is_train].std(ddof=0)
            z = np.abs((e[~is_train] - e[is_train].mean()) / (sd if sd > 1e-12 else 1.0))
            rows.append((*key, name, float(z.max(initial=0.0))))
        return pd.DataFrame(rows, columns=[*keys, "entity", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema if f.name in keys)
    return series.groupBy(*keys).cogroup(edges.groupBy(*keys)).applyInPandas(run, f"{schema}, entity string, score double")


def discretised_fnode_scores(series: DataFrame, keys: list[str], row: str, bins: int = 5, alpha: float = 0.5, top: int = 3) -> DataFrame:
    """Root causes as children of a fault node: entities whose binned values depend on the part (train or test), given no single other entity.

    Conditional dependence is tested with chi-squared statistics; the score is the least normalised statistic.
    """

    def chi(f: np.ndarray, v: np.ndarray, g: np.ndarray | None) -> float:
        total, dof = 0.0, 0
        for s in [None] if g is None else np.unique(g):
            m = np.ones(len(f), bool) if s is None else g == s
            t = np.zeros((2, bins))
            np.add.at(t, (f[m], v[m]), 1)
            t = t[:, t.sum(0) > 0]
            if t.shape[1] < 2 or (t.sum(1) == 0).any():
                continue
            e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
            total += ((t - e) ** 2 / e).sum()
            dof += t.shape[1] - 1
        return (total - dof) / np.sqrt(2 * dof) if dof else -1.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=row, columns="entity", values="value").sort_index().dropna()
        test = set(pdf[pdf["part"] == "test"][row])
        f = np.array([r in test for r in wide.index], int)
        binned = {}
        for c in wide.columns:
            edges = np.quantile(wide[c], np.linspace(0, 1, bins + 1)[1:-1])
            binned[c] = np.searchsorted(edges, wide[c], side="right")
        base = {c: chi(f, v, None) for c, v in binned.items()}
        cut = normal_quantile(1 - alpha / 2)
        cand = [c for c in base if base[c] > cut]
        score = {c: min([base[c], *(chi(f, binned[c], binned[o]) for o in cand if o != c)]) for c in cand}
        best = sorted(score, key=lambda c: (-score[c], c))[:top]
        return frame({**{k: [pdf[k].iloc[0]] * len(best) for k in keys}, "entity": best, "score": [float(score[c]) for c in best]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema if f.name in keys)
    return series.groupBy(*keys).applyInPandas(run, f"{schema}, entity string, score double")
