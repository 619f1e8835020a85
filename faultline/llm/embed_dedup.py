"""Near-duplicate embeddings by an inverted file with product quantisation.

Vectors are normalised; at a cosine of 0.95 or more two of them are at most
REACH = sqrt(2 - 2 * 0.95) apart. A coarse k-means cuts space into lists; a
vector's residual to its list's centroid is coded by one byte in each subspace
of SUBSPACE_DIMS components, and the length of what the code leaves out is kept.

A vector probes its own list and every list whose bounding plane lies within a
margin. Both vectors of a pair probe, so a pair is missed only if its difference
crosses the plane between their lists by more than twice the margin. A margin of
half the reach loses nothing. Where the sample spreads over D effective
dimensions, a difference of length REACH has a component of about
REACH / sqrt(D) along a plane's normal, and the margin is PROBE_SIGMAS / 2 of
that if it is less. A coded vector is dropped only if its asymmetric
table-lookup distance exceeds the reach by more than its own coding error, which
loses nothing. What remains is compared by its exact cosine in double precision.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, groups, reliable

COSINE = 0.95
#: Vectors in the training sample at least, those of them that train the codes, rows a list aims at, rows of a list or of its queries in one task.
SAMPLE, CODE_SAMPLE, LIST_ROWS, BLOCK = 20_000, 4096, 512, 2048
#: Lists grow with the rows up to the first, then with the square root of the rows; bytes of all centroids at most.
MANY_LISTS, CENTRE_BYTES = 4096, 1 << 26
#: Components a code stands for, codes per subspace, rounds of k-means; subspaces whose tables are summed before a pair may be dropped.
SUBSPACE_DIMS, CODES, ROUNDS, FIRST = 4, 256, 5, 8
#: Standard deviations of a difference's component along a normal that two vectors' probes reach over together.
PROBE_SIGMAS = 4.0
#: Bounds get this much slack for rounding.
SLACK = 1e-6
#: Distances held at once.
_CELLS = 1 << 21


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        order = np.argsort(near, kind="stable")
        n = np.bincount(near, minlength=k)
        has = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[has], axis=0)
        centres[has] = sums / n[has, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of each row's nearest centre."""
    step = max(1, _CELLS // len(centres))
    own = (centres * centres).sum(1)[None, :]
    return np.concatenate([np.zeros(0, np.int64), *((own - 2 * x[at : at + step] @ centres.T).argmin(1) for at in range(0, len(x), step))])


def list_count(n: int, dim: int) -> int:
    """How many lists n vectors get: a broadcast of CENTRE_BYTES at most."""
    wanted = n // LIST_ROWS if n <= MANY_LISTS * LIST_ROWS else max(MANY_LISTS, int(2 * n**0.5))
    return max(1, min(wanted, CENTRE_BYTES // (8 * dim)))


class Index:
    """Coarse centroids and subspace codebooks, fitted on a bounded sample; every vector is indexed."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float) -> None:
        rng = np.random.default_rng(7)
        self.cosine, self.reach = cosine, float(np.sqrt(max(0.0, 2 - 2 * cosine)))
        dim = sample.shape[1]
        lists = min(list_count(n, dim), len(sample))
        self.coarse = kmeans(sample, lists, ROUNDS if lists <= MANY_LISTS else 2, rng)
        some = sample[rng.choice(len(sample), min(CODE_SAMPLE, len(sample)), replace=False)]
        residual = some - self.coarse[nearest(some, self.coarse)]
        spread = np.linalg.eigvalsh(residual.T @ residual)
        effective = spread.sum() ** 2 / max((spread * spread).sum(), 1e-300)
        self.margin = self.reach / 2 * min(1.0, PROBE_SIGMAS / max(effective, 1e-9) ** 0.5)
        self.cuts = np.linspace(0, dim, max(1, dim // SUBSPACE_DIMS) + 1).round().astype(int)
        self.books = [kmeans(residual[:, a:b], min(CODES, len(residual)), ROUNDS, rng) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and coding error of each vector."""
        residual = x - self.coarse[home]
        codes = np.stack([nearest(residual[:, a:b], book).astype(np.uint8) for a, b, book in self._books()], 1)
        left = residual - np.concatenate([book[codes[:, k]] for k, (_, _, book) in enumerate(self._books())], 1)
        return codes, np.sqrt((left * left).sum(1))

    def _books(self):
        return zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)

    @functools.cached_property
    def _gaps(self) -> np.ndarray | None:
        return np.sqrt(distances(self.coarse, self.coarse)) if len(self.coarse) <= 1024 else None

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home list of each vector, and the other lists that it probes.

        x lies (|x - c_j|^2 - |x - c_i|^2) / (2 |c_i - c_j|) away from the plane
        between its list i and list j, on its own side of it.
        """
        homes, found = [], []
        step = max(1, _CELLS // len(self.coarse))
        for at in range(0, len(x), step):
            d = distances(x[at : at + step], self.coarse)
            home = d.argmin(1)
            gap = self._gaps[home] if self._gaps is not None else np.sqrt(distances(self.coarse[home], self.coarse))
            ok = d - d[np.arange(len(home)), home][:, None] <= 2 * (self.margin + SLACK) * gap + SLACK
            ok[np.arange(len(home)), home] = False
            homes.append(home)
            found += [np.flatnonzero(r).astype(np.int32) for r in ok]
        return np.concatenate(homes), found

    def tables(self, queries: np.ndarray, home: int) -> np.ndarray:
        """Asymmetric distance tables (subspace, query, code) for the residuals of the queries to one list."""
        r = queries - self.coarse[home]
        out = np.full((len(self.books), len(r), max(len(b) for b in self.books)), np.inf, np.float32)
        for k, (a, b, book) in enumerate(self._books()):
            out[k, :, : len(book)] = distances(r[:, a:b], book)
        return out


def _unit(batch_column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch_column.to_pylist()), np.float64).reshape(-1, dim)


def _valid_vectors(batches):
    """(vec_id, key, unit vector as doubles); key is null for what links with nothing: null, zero, or null or non-finite components."""
    for batch in batches:
        ids, units, keys = batch.column(0), [], []
        for v in batch.column(1).to_pylist():
            x = None
            if v and None not in v:
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top
                    x = x / np.sqrt((x * x).sum())
                else:
                    x = None
            units.append(None if x is None else x.tobytes())
            keys.append(None if x is None else len(x))
        yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "dim", "unit"])


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    n_links counts the other rows at a cosine of ``cosine`` or more, component_id
    is the smallest vec_id reachable by links. Null and zero vectors, and those
    with a null or non-finite component, link with nothing; so do vectors of
    different length with each other. Rows of one vector are one node that
    counts as often as it stands; a null vec_id counts as a link of others and
    has a null component. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("e"))
    rows = reliable(slim.mapInArrow(_valid_vectors, "vec_id long, dim int, unit binary").withColumn("key", F.md5("unit")))
    nodes = rows.where("unit is not null").groupBy("dim", "unit").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
    # numbers once the checkpoint is read, so they are the same in every later job
    nodes = reliable(nodes.withColumn("key", F.md5("unit")).withColumn("node", F.monotonically_increasing_id()))
    dims = [r["dim"] for r in nodes.select("dim").distinct().collect()]
    found = [f for dim in dims for f in _links(spark, nodes.where(F.col("dim") == dim), dim, cosine)]
    counts = edges = None
    for i in range(0, len(found), 2):
        counts = found[i] if counts is None else counts.unionByName(found[i])
        edges = found[i + 1] if edges is None else edges.unionByName(found[i + 1])
    if counts is None:
        return slim.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = components(edges)
    labels = nodes.select("node", "key", "rep", "copies").join(linked.select(F.col("id").alias("node"), "component"), "node", "left")
    lowest = labels.where("component is not null").groupBy("component").agg(F.min("rep").alias("lowest"))
    labels = labels.join(lowest, "component", "left").select("node", "key", "copies", F.coalesce("lowest", "rep").alias("lowest"))
    per_node = labels.join(counts.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").select("key", "lowest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    return (
        rows.select("vec_id", "key").join(per_node, "key", "left")
        .select(
            "vec_id",
            F.when(F.col("key").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_links"),
            F.when(F.col("vec_id").isNotNull(), F.coalesce("lowest", "vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


_PLACED = "list int, base boolean, home int, node long, copies long, unit binary, code binary, error double, probes binary"


def _links(spark, nodes: DataFrame, dim: int, cosine: float) -> list[DataFrame]:
    n = nodes.count()
    wanted = max(SAMPLE, 2 * list_count(n, dim))
    share = min(1.0, wanted / max(n, 1))
    mark = F.xxhash64("unit")  # the same sample in every run
    sample = nodes.where(F.pmod(mark, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(mark).limit(wanted).select("unit").toArrow()
    if sample.num_rows == 0:
        sample = nodes.orderBy(mark).limit(1).select("unit").toArrow()
    index = Index(np.frombuffer(b"".join(sample.column(0).to_pylist()), np.float64).reshape(-1, dim), n, cosine)
    shared = spark.sparkContext.broadcast(index)

    def place(batches):
        ix = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _unit(part.column(2), dim)
                home, probes = ix.probes(x)
                codes, error = ix.encode(x, home)
                times = np.fromiter(map(len, probes), np.int64, len(probes))
                # a row as a member of its list, one as a query in it, one per list probed
                take = np.concatenate([np.arange(len(x)), np.arange(len(x)), np.repeat(np.arange(len(x)), times)])
                is_base = np.arange(len(take)) < len(x)
                lists = np.concatenate([home, home, *probes]).astype(np.int32)
                take_arrow, none = pa.array(take), [None] * (len(take) - len(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(lists),
                        pa.array(is_base),
                        pa.array(home[take].astype(np.int32)),
                        part.column(0).take(take_arrow),
                        part.column(1).take(take_arrow),
                        part.column(2).take(take_arrow),
                        pa.array([c.tobytes() for c in codes] + none, pa.binary()),
                        pa.array(np.where(is_base, error[take], 0.0)),
                        pa.array([p.tobytes() for p in probes] + none, pa.binary()),
                    ],
                    names=["list", "base", "home", "node", "copies", "unit", "code", "error", "probes"],
                )

    placed = reliable(nodes.select("node", "copies", "unit").mapInArrow(place, _PLACED))
    sizes = placed.groupBy("list").agg(F.ceil(F.sum(F.col("base").cast("int")) / BLOCK).cast("int").alias("nb"), F.ceil(F.sum((~F.col("base")).cast("int")) / BLOCK).cast("int").alias("nq")).where("nb > 0")
    cut = placed.join(F.broadcast(sizes), "list")  # a row per list: list_count of them at most
    mine = F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("base"), F.col("nb")).otherwise(F.greatest("nq", F.lit(1)))).cast("int")
    cut = cut.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(F.col("base"), F.greatest("nq", F.lit(1))).otherwise(F.col("nb")) - 1)))
    task = F.xxhash64("list", F.when(F.col("base"), F.col("_mine")).otherwise(F.col("_other")), F.when(F.col("base"), F.col("_other")).otherwise(F.col("_mine")))
    cut = cut.select(task.alias("task"), "list", "base", "home", "node", "copies", "unit", "code", "error", "probes")

    def compare(batches):
        ix = shared.value
        for t in groups(batches):
            key, lists = t.column("task").to_numpy(), t.column("list").to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (lists[1:] != lists[:-1]))), len(key))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                yield from _compare(ix, t.slice(a, b - a), dim)

    out = cut.repartition(F.col("task")).sortWithinPartitions("task", "list").mapInArrow(compare, "node long, n long, other long")
    out = reliable(out)
    return [out.select("node", "n"), out.where("other is not null and other <> node").select(F.col("node").alias("a"), F.col("other").alias("b"))]


def _compare(ix: Index, t: pa.Table, dim: int):
    """Links between the queries and the coded vectors of one task.

    A pair of one list counts where the query's node is the lesser. A pair of two
    lists that both vectors find counts in the greater list; one that only one of
    them finds counts where it does.
    """
    base, home = t.column("base").to_numpy(), t.column("home").to_numpy()
    node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
    b, q = np.flatnonzero(base), np.flatnonzero(~base)
    if not len(b) or not len(q):
        return
    unit = _unit(t.column("unit"), dim)
    here = int(t.column("list")[0].as_py())
    members = t.filter(t.column("base"))
    codes = np.frombuffer(b"".join(members.column("code").to_pylist()), np.uint8).reshape(len(b), -1)
    limit = (((ix.reach + SLACK + members.column("error").to_numpy()) ** 2 + SLACK) * 1.0001).astype(np.float32)
    ends, others = [], []
    step = max(1, min(512, (1 << 20) // len(b)))
    for at in range(0, len(q), step):
        some = q[at : at + step]
        tables = ix.tables(unit[some], here)
        rough = np.take(tables[0], codes[:, 0], axis=1)
        for k in range(1, min(FIRST, codes.shape[1])):
            rough += np.take(tables[k], codes[:, k], axis=1)
        i, j = np.nonzero(rough <= limit)
        once = (home[some[i]] != here) | (node[some[i]] < node[b[j]])
        i, j = i[once], j[once]
        rest = rough[i, j]
        for k in range(FIRST, codes.shape[1]):
            rest += tables[k][i, codes[j, k]]
        near = rest <= limit[j]
        i, j = i[near], j[near]
        hit = np.einsum("ij,ij->i", unit[some[i]], unit[b[j]]) >= ix.cosine
        ends.append(some[i[hit]])
        others.append(j[hit])
    i, j = np.concatenate(ends), np.concatenate(others)
    twice = np.flatnonzero(home[i] > here)
    if len(twice):
        probes = [np.frombuffer(p, np.int32) for p in members.column("probes").to_pylist()]
        found = np.fromiter((h in probes[m] for h, m in zip(home[i[twice]].tolist(), j[twice].tolist(), strict=True)), bool, len(twice))
        i, j = np.delete(i, twice[found]), np.delete(j, twice[found])
    if not len(i):
        return
    j = b[j]
    n = (np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))).astype(np.int64)
    has = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(n[has]), pa.nulls(len(has), pa.int64())], names=["node", "n", "other"])
    a, c = _forest(node, i, j)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.zeros(len(a), np.int64)), pa.array(c)], names=["node", "n", "other"])


def _forest(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node it reaches among these links; at most one per node."""
    ids, at = np.unique(node, return_inverse=True)
    a, b = at[a], at[b]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]
