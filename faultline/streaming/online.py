"""Structured Streaming: hopping counts, online change detection, alerts, and batch ranking at each trigger."""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import Spot, cusum, distance_threshold
from ..functions.numeric import l1
from ..operators import prep, rank
from ..operators.frames import frame, materialised, shared_folder
from ..operators.rank import average_overlap


def hopping(stream: DataFrame, key: str, ts: str = "ts", width: str = "30 minutes", step: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums per key and hopping window; rows later than ``late`` behind the newest are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, step), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class OnlineDetector:
    """Distances of consecutive windows of one series set, judged by cumulative sums; state is plain data."""

    def __init__(self, window: int = 60, shift: int = 5, stride: int = 15, pool: int = 5, keep: int = 57_600, jump: int = 2) -> None:
        self.window, self.shift, self.stride, self.pool, self.keep, self.jump = window, shift, stride, pool, keep, jump
        self.rows: list[list[float]] = []
        self.seen = self.cursor = 0
        self.distances: list[float] = []

    def distance(self, x: np.ndarray) -> float:
        def moment(part: np.ndarray) -> np.ndarray:
            n = len(part) // self.pool * self.pool
            pooled = part[:n].reshape(-1, self.pool, part.shape[1]).mean(1)
            return pooled.T @ pooled / max(len(pooled), 1)

        a, b = moment(x[: self.window]), moment(x[self.shift : self.shift + self.window])
        with np.errstate(invalid="ignore", divide="ignore"):
            return float(np.nan_to_num(np.sqrt(((np.log1p(a) - np.log1p(b)) ** 2).sum()), nan=0.0, posinf=0.0, neginf=0.0))

    def push(self, rows: list[list[float]]) -> list[int]:
        """Rows in time order; row numbers (since the first) at which a change is detected. After one, history of distances is dropped and the cursor jumps on."""
        self.rows += rows
        self.seen += len(rows)
        out = []
        while self.cursor + self.window + self.shift <= self.seen:
            first = self.seen - len(self.rows)
            at = self.cursor - first
            self.distances.append(self.distance(np.array(self.rows[at : at + self.window + self.shift])))
            found = cusum(np.array(self.distances), distance_threshold(np.array(self.distances))) if len(self.distances) > 3 else []
            if found and found[-1][0] == len(self.distances) - 1:
                out.append(self.cursor + self.window)
                self.distances = []
                self.cursor += self.jump * self.window
            else:
                self.cursor += self.stride
        drop = len(self.rows) - min(len(self.rows), max(self.keep, self.seen - self.cursor))
        self.rows = self.rows[drop:]
        return out

    def dump(self) -> tuple:
        return self.rows, self.seen, self.cursor, self.distances

    def load(self, state: tuple) -> OnlineDetector:
        rows, self.seen, self.cursor, distances = state
        self.rows, self.distances = [list(map(float, r)) for r in rows], list(map(float, distances))
        return self


def detect_online(stream: DataFrame, key: str, values: list[str], ts: str = "ts", **params) -> DataFrame:
    """(key, change, seen): detections per key; rows must reach a key in time order of batches and are sorted within one."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = OnlineDetector(**params)
        if state.exists:
            d.load(state.get)
        pdf = pd.concat(list(parts)).sort_values(ts)
        found = d.push(pdf[values].to_numpy(float).tolist())
        state.update(d.dump())
        yield frame({key: [k[0]] * len(found), "change": found, "seen": [d.seen] * len(found)})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, change long, seen long", "rows array<array<double>>, seen long, cursor long, distances array<double>", "append", GroupStateTimeout.NoTimeout)


def spot_online(stream: DataFrame, key: str, ts: str = "ts", value: str = "value", **params) -> DataFrame:
    """(key, ts, flag): alerts of the streaming extreme-value detector."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spot = Spot(**params)
        if state.exists:
            spot.__dict__ |= json.loads(state.get[0], object_hook=lambda x: {int(a) if a.lstrip("-").isdigit() else a: b for a, b in x.items()})
        pdf = pd.concat(list(parts)).sort_values(ts)
        flags = [spot.step(float(v)) for v in pdf[value]]
        state.update((json.dumps(spot.__dict__),))
        out = pdf.assign(flag=flags)
        yield out[out["flag"].isin((1, -1))][[key, ts, "flag"]]

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, {ts} {types[ts]}, flag int", "state string", "append", GroupStateTimeout.NoTimeout)


class Convergence:
    """Ends online ranking once the first entities agree: average overlap of at least ``least`` in ``times`` rankings in a row."""

    def __init__(self, depth: int = 5, least: float = 0.9, times: int = 3) -> None:
        self.depth, self.least, self.times = depth, least, times
        self.last: list[str] | None = None
        self.run = 0

    def add(self, ranking: list[str]) -> bool:
        agrees = self.last is not None and average_overlap(self.last, ranking, self.depth) >= self.least
        self.run = self.run + 1 if agrees else 0
        self.last = ranking[: self.depth]
        return self.run >= self.times


@dataclasses.dataclass
class OnlineRanking:
    """Ranks entities at each trigger over the history so far, until the rankings agree.

    A batch of ``obs(metric, entity, ts, value)`` joins the history, of which the
    last ``keep`` time units stay; per metric, the times that all entities have
    make shares, which the ``method`` scores after a split at ``share`` of the
    times; an entity's mean over the metrics, as a share of all, ranks it. Each
    ranking is written with its confidence. The first one that reaches
    ``failure_time + tolerance`` is marked early. History and rankings lie in
    ``folder`` by batch, so a batch that is run again replaces its own.
    """

    folder: str
    method: str = "nsigma"
    share: float = 0.6
    keep: int = 57_600
    start: int | None = None
    failure_time: int | None = None
    tolerance: int = 600
    convergence: Convergence = dataclasses.field(default_factory=Convergence)
    done: bool = False
    early: int | None = None

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if self.done:
            return
        batch.select("metric", "entity", "ts", "value").write.mode("overwrite").parquet(f"{self.folder}/history/batch={number}")
        history = spark.read.option("basePath", f"{self.folder}/history").parquet(f"{self.folder}/history").where(F.col("batch") <= number).drop("batch")
        last = history.agg(F.max("ts")).first()[0]
        if last is None or self.start is not None and last < self.start:
            return
        series = materialised(history.where(F.col("ts") > last - self.keep))
        final = rank.ranked(rank.mean_over_metrics(self.scores(series), ["case_id"]), ["case_id"])
        if self.early is None and self.failure_time is not None and last >= self.failure_time + self.tolerance:
            self.early = number
        final = materialised(final)
        out = final.join(F.broadcast(rank.confidence(final)), "case_id", "left").select("entity", "score", "rank", "confidence", F.lit(last).alias("until"), F.lit(self.early == number).alias("early"))
        out.write.mode("overwrite").parquet(f"{self.folder}/ranking/batch={number}")
        top = [r["entity"] for r in final.where(F.col("rank") <= self.convergence.depth).orderBy("rank").collect()]
        self.done = self.convergence.add(top)

    def scores(self, series: DataFrame) -> DataFrame:
        from ..plans.root_cause import METHODS

        keys = ["case_id", "metric"]
        entities = series.groupBy("metric").agg(F.count_distinct("entity").alias("_n"))
        common = series.groupBy("metric", "ts").agg(F.count_distinct("entity").alias("_c")).join(entities, "metric").where("_c = _n").select("metric", "ts")
        s = series.join(common, ["metric", "ts"]).withColumn("case_id", F.lit("online")).withColumn("value", l1(F.col("value"), "metric", "entity"))
        s = materialised(s)
        split = prep.time_index(s, keys).groupBy(*keys).agg(F.floor(F.count("*") * self.share).alias("a"))
        return METHODS[self.method](s, split)

    def run(self, stream: DataFrame) -> DataFrame:
        """Feeds what the stream has, batch by batch, and stops early once the rankings agree; all rankings, by batch."""
        q = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        while not q.awaitTermination(1):
            if self.done:
                q.stop()
        return stream.sparkSession.read.parquet(f"{self.folder}/ranking")


def _drain(spark: SparkSession, out: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is and returns its output table, which lies in the shared folder by batch."""
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out" if mode == "complete" else f"{where}/out/batch={number}")

    q = out.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/out")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def run_hopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hopping(_event_stream(spark, sf_dir), "event_type")
    out = _drain(spark, h, "complete")
    return out.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def run_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _event_stream(spark, sf_dir).select("event_type", "ts", (F.col("value") / 100).alias("a"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("b"))
    return _drain(spark, detect_online(s, "event_type", ["a", "b"], window=20, shift=3, stride=4, pool=2), "append")


def run_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly series that come in five batches; a fault is known half way."""
    from .. import views

    weekly = views.weekly(spark, sf_dir)
    lo, hi = weekly.agg(F.min("ts"), F.max("ts")).first()
    folder = f"{shared_folder(spark)}/online-{uuid.uuid4().hex}"
    for k in range(5):  # one file after another, as they would arrive
        part = weekly.where((F.col("ts") >= lo + (hi - lo + 1) * k // 5) & (F.col("ts") < lo + (hi - lo + 1) * (k + 1) // 5))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(weekly.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    ranking = OnlineRanking(folder, failure_time=lo + (hi - lo + 1) // 2, tolerance=0, convergence=Convergence(times=99))
    return ranking.run(stream).select("batch", "entity", F.round("score", 6).alias("score"), "rank", "early")
