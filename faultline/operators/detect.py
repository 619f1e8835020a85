"""Sequential detectors as numpy kernels, and their grouped forms."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .frames import frame


def cusum(x: np.ndarray, threshold: float, drift: float = 0.0) -> list[tuple[int, int]]:
    """(alarm, start) indices of cumulative sums of changes, reset at each alarm.

    Each sum takes in a change and the drift step by step, in the order that the
    recurrence states: values of few decimals meet the threshold exactly, and a
    sum rounded otherwise would pass it or not. Where a sum would fall below 0,
    or a value is missing, it is 0 and a change may start.
    """
    out: list[tuple[int, int]] = []
    up = down = 0.0
    up_start = down_start = 0
    values = np.asarray(x, float).tolist()
    for i, (last, v) in enumerate(itertools.pairwise(values), 1):
        up, down = up + v - last - drift, down - (v - last) - drift
        if not up >= 0:
            up, up_start = 0.0, i
        if not down >= 0:
            down, down_start = 0.0, i
        if up > threshold or down > threshold:
            out.append((i, up_start if up > threshold else down_start))
            up = down = 0.0
    return out


def cusum_changes(x: np.ndarray, threshold: float, drift: float = 0.0) -> list[tuple[int, int, int, float]]:
    """(alarm, start, end, amplitude): as :func:`cusum`, with ends from the same sums run backwards.

    A change's end is where a change of the reversed series starts. Alarms of one
    start are one change. Where there are more ends than changes, a change takes
    the first end not before its alarm; where there are fewer, an end takes the
    last change alarmed by then. Of changes that overlap, the earlier gives its
    start and the later its end.
    """
    x = np.asarray(x, float)
    first: dict[int, int] = {}
    for alarm, start in cusum(x, threshold, drift):
        first.setdefault(start, alarm)
    changes = [(alarm, start) for start, alarm in sorted(first.items())]
    ends = sorted(len(x) - 1 - start for _, start in cusum(x[::-1], threshold, drift))
    if len(changes) < len(ends):
        ends = [next((e for e in ends if e >= alarm), ends[0]) for alarm, _ in changes]
    elif len(changes) > len(ends):
        before = [[c for c in changes if c[0] <= e] for e in ends]
        changes = [b[-1] if b else changes[-1] for b in before]
    clash = [e > later[1] for e, later in zip(ends[:-1], changes[1:], strict=True)]
    starts = [c for c, drop in zip(changes, [False, *clash], strict=False) if not drop]
    stops = [e for e, drop in zip(ends, [*clash, False], strict=False) if not drop]
    return [(alarm, start, end, float(x[end] - x[start])) for (alarm, start), end in zip(starts, stops, strict=True)]


def cusum_alarms(series: DataFrame, keys: list[str], threshold: float, drift: float = 0.0, ts: str = "ts", value: str = "value") -> DataFrame:
    """(keys, alarm, start): positions in each series. The reset makes the sum non-associative, so a series is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = cusum(pdf.sort_values(ts)[value].to_numpy(float), threshold, drift)
        return frame({**{k: [pdf[k].iloc[0]] * len(found) for k in keys}, "alarm": [a for a, _ in found], "start": [s for _, s in found]})

    return series.groupBy(*keys).applyInPandas(run, f"{_schema(series, keys)}, alarm long, start long")


def cusum_ends(series: DataFrame, keys: list[str], threshold: float, drift: float = 0.0, ts: str = "ts", value: str = "value") -> DataFrame:
    """(keys, alarm, start, end, amplitude): the changes of each series with where they end and how far they lead."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = cusum_changes(pdf.sort_values(ts)[value].to_numpy(float), threshold, drift)
        cols = list(zip(*found, strict=True)) or [()] * 4
        return frame({**{k: [pdf[k].iloc[0]] * len(found) for k in keys}, **dict(zip(("alarm", "start", "end", "amplitude"), map(list, cols), strict=True))})

    return series.groupBy(*keys).applyInPandas(run, f"{_schema(series, keys)}, alarm long, start long, end long, amplitude double")


def distance_threshold(distances: np.ndarray, beta: float = 1.0, gamma: float = 4.0) -> float:
    """beta * mean + gamma * population deviation."""
    return float(beta * distances.mean() + gamma * distances.std())


class Runs:
    """Predictive Student densities of a multivariate normal of unknown mean and precision, one per run, by when the run began.

    A run that has seen m rows has m + dims + 1 degrees of freedom and weight
    m + 1. Its precision matrix and that matrix's log-determinant follow from the
    ones before by a rank-one update, so a step inverts nothing.
    """

    def __init__(self, rows: int, dims: int) -> None:
        self.dims, self.live = dims, 0
        self.mean = np.zeros((rows + 1, dims))
        self.precision = np.broadcast_to(np.eye(dims), (rows + 1, dims, dims)).copy()
        self.logdet = np.zeros(rows + 1)

    def begin(self) -> None:
        self.live += 1

    def see(self, x: np.ndarray) -> np.ndarray:
        """Densities of a row under the live runs, which then take it in."""
        k, d = self.live, self.dims
        weight = np.arange(k, 0, -1, dtype=float)  # the oldest run first
        freedom = weight + 1.0
        off = x - self.mean[:k]
        pull = np.einsum("kij,kj->ki", self.precision[:k], off)
        quad = np.einsum("ki,ki->k", off, pull)
        ratio = weight / (weight + 1)
        lgamma = np.array([math.lgamma((f + d) / 2) - math.lgamma(f / 2) for f in freedom])
        logp = lgamma + 0.5 * (self.logdet[:k] + d * np.log(ratio / math.pi)) - (freedom + d) / 2 * np.log1p(ratio * quad)
        self.mean[:k] += off / (weight + 1)[:, None]
        shrink = ratio / (1 + ratio * quad)
        self.precision[:k] -= shrink[:, None, None] * pull[:, :, None] * pull[:, None, :]
        self.logdet[:k] -= np.log1p(ratio * quad)
        return np.exp(logp)


def run_lengths(x: np.ndarray, hazard: float = 1 / 50) -> np.ndarray:
    """Likeliest run length before each row and, as the last of n + 1 entries, 0.

    The run-length distribution keeps one column only, so memory is linear in the rows.
    """
    x = np.asarray(x, float).reshape(len(x), -1)
    runs, chance = Runs(len(x), x.shape[1]), np.zeros(len(x) + 1)
    best = np.zeros(len(x) + 1, int)
    chance[0] = 1.0
    for t, row in enumerate(x):
        runs.begin()  # the run of length 0 began at row t
        best[t] = int(chance[: t + 1][::-1].argmax())
        grown = chance[: t + 1] * runs.see(row)
        total = grown.sum()
        if total > 0:
            chance[: t + 1] = grown * (1 - hazard) / total
            chance[t + 1] = hazard
        else:
            chance[: t + 1] = 0.0
            chance[t + 1] = 1.0
    return best


def change_points(x: np.ndarray, hazard: float = 1 / 50, drop_sentinel: bool = False) -> list[int]:
    """Rows at which the likeliest run length jumps by more than 1; the sentinel reports row n as well, if the last run is longer than 1."""
    m = run_lengths(x, hazard)
    m = m[:-1] if drop_sentinel else m
    return [i for i in range(1, len(m)) if abs(m[i] - m[i - 1]) > 1]


def bocpd_changes(series: DataFrame, keys: list[str], ts: str = "ts", entity: str = "entity", value: str = "value", hazard: float = 1 / 50) -> DataFrame:
    """(keys, change): change points of the joint series of each group, scaled to 0..1; groups are pooled beforehand."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=ts, columns=entity, values=value).sort_index()
        low, width = wide.min(), wide.max() - wide.min()
        x = ((wide - low) / width.where(width > 0)).ffill().fillna(0).to_numpy()
        found = change_points(x, hazard)
        return frame({**{k: [pdf[k].iloc[0]] * len(found) for k in keys}, "change": found})

    return series.groupBy(*keys).applyInPandas(run, f"{_schema(series, keys)}, change long")


def fit_tail(excess: np.ndarray) -> tuple[float, float]:
    """(gamma, sigma) of a generalised Pareto tail: the likelier of Grimshaw's roots, the moments' and the exponential fit."""
    mean, var = excess.mean(), excess.var()
    if len(excess) < 2 or mean <= 0:
        return 0.0, max(float(mean) if len(excess) else 1.0, 1e-12)
    top, low = excess.max(), excess.min()

    def likelihood(g: float, s: float) -> float:
        if s <= 0 or (1 + g * excess / s <= 0).any():
            return -np.inf
        return -len(excess) * math.log(s) - (excess.sum() / s if abs(g) < 1e-9 else (1 + 1 / g) * np.log1p(g * excess / s).sum())

    fits = [(0.0, float(mean))]
    if var > 0:
        g = 0.5 * (1 - mean * mean / var)
        fits.append((float(g), float(mean * (1 - g))))
    spans = [np.linspace(-1 / top + 1e-8 / top, -1e-8 / top, 24), np.linspace(1e-8 / mean, max(2 * (mean - low) / (mean * max(low, 1e-12)), 2e-8 / mean), 24)]
    for span in spans:
        f = [(1 + np.log1p(z * excess).mean()) * (1 / (1 + z * excess)).mean() - 1 for z in span]
        for a, b, fa, fb in zip(span[:-1], span[1:], f[:-1], f[1:], strict=True):
            if fa * fb < 0:
                for _ in range(50):
                    m = (a + b) / 2
                    fm = (1 + np.log1p(m * excess).mean()) * (1 / (1 + m * excess)).mean() - 1
                    a, b, fa = (m, b, fm) if fa * fm > 0 else (a, m, fa)
                z = (a + b) / 2
                g = float(np.log1p(z * excess).mean())
                fits.append((g, g / z))
    return max(fits, key=lambda p: likelihood(*p))


class Spot:
    """Streaming peaks over threshold with drift: 1 or -1 for an alert above or below, 2 for a peak, 4 while initialising, else 0."""

    def __init__(self, depth: int = 10, q: float = 1e-4, n_init: int = 100, level: float = 0.95) -> None:
        self.depth, self.q, self.n_init, self.level = depth, q, n_init, level
        self.recent: list[float] = []
        self.start: list[float] = []
        self.n = 0
        self.sides: dict[int, list] = {}
        self.limits = {1: math.nan, -1: math.nan}

    def _limit(self, side: int) -> float:
        first, excess = self.sides[side]
        g, s = fit_tail(np.array(excess)) if excess else (0.0, 1e-12)
        r = self.q * self.n / max(len(excess), 1)
        return first + (s / g * (r ** (-g) - 1) if abs(g) > 1e-9 else -s * math.log(r))

    def step(self, x: float) -> int:
        if len(self.recent) < self.depth:
            self.recent.append(x)
            return 4
        base = sum(self.recent) / self.depth
        y = x - base
        if len(self.start) < self.n_init:
            self.start.append(y)
            self._move(x)
            if len(self.start) == self.n_init:
                a = np.array(self.start)
                self.n = self.n_init
                for side in (1, -1):
                    first = float(np.quantile(side * a, self.level))
                    self.sides[side] = [first, [float(v) for v in side * a[side * a > first] - first]]
                    self.limits[side] = self._limit(side)
            return 4
        for side in (1, -1):
            v = side * y
            if v > self.limits[side]:
                return side
        self.n += 1
        out = 0
        for side in (1, -1):
            v = side * y
            if v > self.sides[side][0]:
                self.sides[side][1].append(v - self.sides[side][0])
                self.limits[side] = self._limit(side)
                out = 2
        self._move(x)
        return out

    def _move(self, x: float) -> None:
        self.recent = [*self.recent[1:], x]

    def bound(self, side: int) -> float:
        return sum(self.recent) / self.depth + side * self.limits[side]


def spot_score(x: np.ndarray, depth: int = 10, q: float = 1e-4, n_init: int = 100, level: float = 0.95) -> float:
    """Sum over alerts of |x - z| / |z|, z the bound that was passed (0: 1e-4)."""
    spot, total = Spot(depth, q, n_init, level), 0.0
    for v in np.asarray(x, float):
        flag = spot.step(float(v))
        if flag in (1, -1):
            z = spot.bound(flag) or 1e-4
            total += abs((v - z) / z)
    return total


def spot_scores(series: DataFrame, keys: list[str], entity: str = "entity", ts: str = "ts", value: str = "value", **params) -> DataFrame:
    """(keys, entity, score): extreme-value scores of each series, as shares of the group's sum."""
    from pyspark.sql import functions as F

    from ..functions.numeric import l1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = spot_score(pdf.sort_values(ts)[value].to_numpy(float), **params)
        return frame({**{k: [pdf[k].iloc[0]] for k in keys}, entity: [pdf[entity].iloc[0]], "score": [s]})

    out = series.groupBy(*keys, entity).applyInPandas(run, f"{_schema(series, keys)}, {entity} string, score double")
    return out.withColumn("score", l1(F.col("score"), *keys))


def principal_scores(counts: DataFrame, keys: list[str], row: str, event: str, n: str) -> DataFrame:
    """(keys, row, score, spe): event counts weighted by TF-IDF and centred; first principal component, and squared distance from it.

    The component's sign makes its largest loading positive.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=row, columns=event, values=n, aggfunc="sum").fillna(0).sort_index()
        x = wide.to_numpy(float)
        x = x * np.log(len(x) / np.maximum((x > 0).sum(0), 1))
        x = x - x.mean(0)
        values, vectors = np.linalg.eigh(x.T @ x / max(len(x), 1))
        v = vectors[:, values.argmax()]
        v = v * np.sign(v[np.abs(v).argmax()] or 1)
        s = x @ v
        return frame({**{k: [pdf[k].iloc[0]] * len(s) for k in keys}, row: wide.index, "score": s, "spe": ((x - np.outer(s, v)) ** 2).sum(1)})

    return counts.groupBy(*keys).applyInPandas(run, f"{_schema(counts, [*keys, row])}, score double, spe double")


def _schema(df: DataFrame, keys: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{k}` {types[k]}" for k in keys)
