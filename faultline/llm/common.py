"""Shared pieces: reading tables, cutting lineage, hashing words, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial word hash (mod 2**64) and its inverse.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in ``spark.checkpoint.dir``; only a local session that names none gets a temporary one."""
    sc = spark.sparkContext
    where = sc._jsc.sc().getCheckpointDir()
    if where.isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="faultline-checkpoints-")
        sc.setCheckpointDir(named)
        where = sc._jsc.sc().getCheckpointDir()
    return where.get()


def reliable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name with as many underscores before it as set it apart from all of ``columns``, in any case of letters."""
    taken, start = {c.lower() for c in columns}, "_"
    while any(start + n.lower() in taken for n in names):
        start += "_"
    return [start + n for n in names]


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, by doubling."""
    out = np.ones(n, np.uint64)
    have, top = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(top)
        have += take
        top = top * top & 0xFFFFFFFFFFFFFFFF
    return out


class RunHasher:
    """64-bit hashes of byte ranges of one buffer, without a Python loop.

    hash = mix(sum T[b_i] * P**i * P**-start, length), so it does not depend on where the range lies.
    """

    def __init__(self) -> None:
        self._table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
        self._up = self._down = np.ones(0, np.uint64)

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of buf[starts:ends]; ranges are in order and don't overlap; bytes between them are ignored."""
        if len(starts) == 0:
            return np.zeros(0, np.uint64)
        if len(buf) > len(self._up):
            n = max(len(buf), 2 * len(self._up), 1 << 16)
            self._up, self._down = _powers(_P, n), _powers(_P_INV, n)
        terms = self._table[buf] * self._up[: len(buf)]
        gaps = np.empty(2 * len(starts), np.int64)
        gaps[0::2], gaps[1::2] = starts, ends
        if gaps[-1] == len(buf):
            gaps = gaps[:-1]
        if np.array_equal(starts[1:], ends[:-1]):
            sums = np.add.reduceat(terms, starts)
            if ends[-1] < len(buf):
                sums[-1] = terms[starts[-1] : ends[-1]].sum()
        else:
            sums = np.add.reduceat(terms, gaps)[0::2]
        return mix(sums * self._down[starts] + (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def groups(batches) -> Iterator[pa.Table]:
    """Runs of rows with equal first column, of batches sorted by it; small runs come many in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        if held and last > 0 or held and held[-1].column(0)[-1].as_py() != key[0]:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif last > 0:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``(id, component)`` for every id on an edge.

    component is the smallest id reachable. Alternates large-star and small-star
    steps until the edge set no longer changes. The least neighbours have partial
    sums, and each table is checkpointed before a join, so both sides of a join
    are plain shuffles that adaptive execution splits where an id is a hub. Null
    ends and self-loops are ignored.
    """
    e = reliable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.expr("cast(xxhash64(a, b) as decimal(38,0))")).alias("s")).first()
        if now["n"] == 0 or (before is not None and tuple(now) == before):
            break
        before = tuple(now)
        # the larger neighbours of an id go over to its least one
        low = reliable(e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")))
        e = reliable(e.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
        # an id and its smaller neighbours go over to the least of them
        low = reliable(e.groupBy("a").agg(F.min("b").alias("m")))
        e = e.join(low, "a")
        e = reliable(e.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
    nodes = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
