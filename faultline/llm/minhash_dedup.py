"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gives SYMBOLS minima of b = 16 bits. Two
signatures are near if they differ in at most MAX_ERRORS symbols. By pigeonhole
over CHUNKS chunks, near signatures agree in some chunk up to
MAX_ERRORS // CHUNKS = 1 symbol, so each chunk is indexed under every choice of
one symbol left out: all near pairs meet in a bucket. At a similarity of 0.85 a
pair exceeds MAX_ERRORS with probability 1e-5, above it more rarely.

No step emits all pairs of a group. Equal sets are one class. A bucket, cut into
blocks where it is large, yields a spanning forest of its near signatures; the
forest's components are cut into blocks as well, and each pair of blocks yields
a spanning forest of confirmed links on the full sets. A pair that is already
connected needs no comparison, every other pair gets one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunHasher, components, groups, mix, reliable

SYMBOLS, MAX_ERRORS, CHUNKS = 40, 17, 9
#: Rows of a bucket, and documents of a candidate component, in one block.
BUCKET_BLOCK, TEXT_BLOCK = 4096, 1024
#: Documents with candidates that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Characters whose shingles are computed at once, at least; rows of an Arrow batch that are Python objects at once.
SUB_BLOCK, BATCH_ROWS = 1 << 18, 512

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_RNG = np.random.default_rng(85)
_XOR = _RNG.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


class Shingler:
    """Sets of 64-bit shingle hashes of texts."""

    def __init__(self, width: int = 3) -> None:
        self.width, self.hash = width, RunHasher()

    def raw(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles, in order and with repeats, and where each text's start (one more at the end).

        Words are runs of other than ASCII white space, A-Z in lower case. A text
        of fewer words than the width has its whole sequence as one shingle; one
        without words, or a null, has none.
        """
        parts = [(t or "").encode() for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        doc_start = np.cumsum(sizes) - sizes
        buf = _LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
        white = _WHITE[buf]
        edge = np.flatnonzero(np.diff(white, prepend=True))
        starts, ends = edge[0::2], edge[1::2]
        words = self.hash(buf, starts, ends)
        first = np.searchsorted(starts, np.append(doc_start, len(buf)))
        n_words = np.diff(first)
        n_shingles = np.where(n_words >= self.width, n_words - self.width + 1, np.minimum(n_words, 1))
        cuts = np.append(0, np.cumsum(n_shingles))
        at = np.repeat(first[:-1] - cuts[:-1], n_shingles) + np.arange(cuts[-1])
        left = np.repeat(np.minimum(n_words, self.width), n_shingles)
        out = left.astype(np.uint64)
        for k in range(self.width):
            w = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else np.zeros(0, np.uint64)
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(k < left, w, np.uint64(0)))
        return out, cuts

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        all_, cuts = self.raw(texts)
        return [np.unique(all_[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def set_id(distinct: np.ndarray) -> int:
    """63-bit identity of a set, from its distinct hashes in any order."""
    total = mix(distinct ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(distinct))], np.uint64))[0] >> np.uint64(1))


def sub_blocks(texts: list[str | None], least: int = SUB_BLOCK) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= least:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _sign(width: int):
    def run(batches):
        shingle = Shingler(width)
        for batch in (big.slice(i, BATCH_ROWS) for big in batches for i in range(0, big.num_rows, BATCH_ROWS)):
            texts = batch.column(1).to_pylist()
            for a, b in sub_blocks(texts):
                all_, cuts = shingle.raw(texts[a:b])
                sizes, ids = [], []
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    one = np.unique(all_[x:y])
                    sizes.append(len(one))
                    ids.append(set_id(one) if len(one) else None)
                has = np.flatnonzero(np.diff(cuts))
                low = (all_ >> np.uint64(32)).astype(np.uint32)
                signature = np.empty((len(has), SYMBOLS), np.uint16)
                for k in range(SYMBOLS if len(has) else 0):
                    least = np.minimum.reduceat((low ^ _XOR[k]) * _ODD[k], cuts[:-1][has])
                    signature[:, k] = mix(least.astype(np.uint64)) & np.uint64(0xFFFF)
                sigs: list[bytes | None] = [None] * (b - a)
                for i, h in enumerate(has.tolist()):
                    sigs[h] = signature[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sigs, pa.binary())],
                    names=["doc_id", "n_shingles", "cid", "sig"],
                )

    return run


def _chunk_keys(batches):
    """Index keys of signatures: every chunk with every choice of one symbol left out."""
    cuts = np.linspace(0, SYMBOLS, CHUNKS + 1).round().astype(int)
    for batch in batches:
        cid = batch.column(0).to_numpy()
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for drop in range(a, b):
                key = np.full(len(cid), drop, np.uint64)
                for k in range(a, b):
                    if k != drop:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cid)], names=["key", "cid"])


def _spread(n: int, near) -> Iterator[tuple[int, int]]:
    """A spanning forest of n nodes under ``near(i, others) -> bool array``; pairs already connected aren't compared."""
    rest = np.arange(n)
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            hit = near(i, rest)
            found = rest[hit]
            rest = rest[~hit]
            for j in found.tolist():
                yield i, j
            front += found.tolist()


def _near_signatures(batches):
    for t in groups(batches):
        key, cid = t.column(0).to_numpy(), t.column(1).to_numpy()
        sig = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        start = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if key[0] > -(2**63) else 0))
        start[0:1] = 0
        size = np.diff(np.append(start, len(key)))
        pivot = np.repeat(start, size)
        near = (sig != sig[pivot]).sum(1) <= MAX_ERRORS
        a, b = [cid[pivot[near]]], [cid[near]]
        # buckets with rows that aren't near their first row
        far = np.add.reduceat(~near, start)
        for g in np.flatnonzero((far > 0) & (size > 2)).tolist():
            s = sig[start[g] : start[g] + size[g]]
            ids = cid[start[g] : start[g] + size[g]]
            for i, j in _spread(len(s), lambda i, rest, s=s: (s[rest] != s[i]).sum(1) <= MAX_ERRORS):
                a.append(ids[i : i + 1])
                b.append(ids[j : j + 1])
        a, b = np.concatenate(a), np.concatenate(b)
        keep = a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def _confirm(width: int, percent: int):
    def run(batches):
        shingle = Shingler(width)
        for t in groups(batches):
            key = t.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(key, prepend=key[0])), len(key))
            cuts = cuts if cuts[0] == 0 else np.append(0, cuts)
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = t.slice(x, y - x)
                cid = part.column(1).to_pylist()
                sets: dict[int, np.ndarray] = {}
                for c, s in zip(cid, shingle.sets(part.column(2).to_pylist()), strict=True):
                    if c not in sets and len(s) and set_id(s) == c:  # a repeated id may bring another text
                        sets[c] = s
                ids = np.array(list(sets), np.int64)
                if len(ids) < 2:
                    continue
                flat = np.concatenate(list(sets.values()))
                _, flat = np.unique(flat, return_inverse=True)
                size = np.fromiter(map(len, sets.values()), np.int64, len(ids))
                start = np.cumsum(size) - size
                mark = np.zeros(int(flat.max()) + 1, np.int64)

                def near(i, rest, flat=flat, size=size, start=start, mark=mark):
                    rest_ok = (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))
                    out = np.zeros(len(rest), bool)
                    some = rest[rest_ok]
                    if len(some) == 0:
                        return out
                    mine = flat[start[i] : start[i] + size[i]]
                    mark[mine] = 1
                    n = size[some]
                    at = np.repeat(start[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    both = np.add.reduceat(mark[flat[at]], np.cumsum(n) - n)
                    mark[mine] = 0
                    out[rest_ok] = 100 * both >= percent * (n + size[i] - both)
                    return out

                found = list(_spread(len(ids), near))
                if found:
                    f = np.array(found)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[f[:, 0]]), pa.array(ids[f[:, 1]])], names=["a", "b"])

    return run


def _blocked(rows: DataFrame, group: str, n: str, block: int) -> DataFrame:
    """Adds ``task``: rows of one task are one group, or two blocks of a large one (every pair of blocks has a task)."""
    blocks = F.ceil(F.col(n) / block).cast("int")
    mine = F.pmod(F.xxhash64("cid", F.lit(7)), blocks).cast("int")
    cut = rows.withColumn("_nb", blocks).withColumn("_mine", mine)
    one = cut.where("_nb <= 1").withColumn("task", F.xxhash64(group))
    many = (
        cut.where("_nb > 1")
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .withColumn("task", F.xxhash64(group, F.least("_mine", "_other"), F.greatest("_mine", "_other")))
    )
    return one.unionByName(many.select(*one.columns))


def classes(docs: DataFrame, width: int, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents link at a Jaccard similarity of ``percent`` hundredths or more of
    their sets of ``width``-word shingles; component_id is the smallest doc_id
    reachable by links. Empty and null texts link with nothing. A null doc_id
    links with nothing and is its own, null, component, kept. Rows of equal
    doc_id and text are one document twice and stay both. Extra columns are
    ignored; an empty table gives an empty result.
    """
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = reliable(slim.mapInArrow(_sign(width), "doc_id long, n_shingles long, cid long, sig binary"))
    sets = signed.where("cid is not null and doc_id is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    sets = reliable(sets)
    keys = sets.select("cid", "sig").mapInArrow(_chunk_keys, "key long, cid long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = keys.join(shared, "key").join(sets.select("cid", "sig"), "cid")
    tasks = _blocked(buckets, "key", "n", BUCKET_BLOCK).select("task", "cid", "sig")
    near = tasks.repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(_near_signatures, "a long, b long")
    candidates = components(near)
    sizes = candidates.groupBy("component").agg(F.count("*").alias("n"))
    members = reliable(candidates.join(sizes, "component").join(sets.select(F.col("cid").alias("id"), F.col("rep").alias("doc_id")), "id").select("component", "n", F.col("id").alias("cid"), "doc_id"))
    small = members.count() <= BROADCAST_ROWS
    texts = slim.join(F.broadcast(members) if small else members, "doc_id").select("component", "n", "cid", "text")
    tasks = _blocked(texts, "component", "n", TEXT_BLOCK).select("task", "cid", "text")
    links = tasks.repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(_confirm(width, percent), "a long, b long")
    linked = components(links).withColumnRenamed("id", "cid")
    named = sets.select("cid", "rep", "copies").join(linked, "cid", "left")
    lowest = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("lowest"))
    label = named.where("copies > 1 or component is not null").join(lowest, "component", "left").select("cid", F.coalesce("lowest", "rep").alias("lowest"))
    return (
        signed.drop("sig").join(label, "cid", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one of the smallest doc_id, in the same columns.

    Of rows that repeat a kept doc_id one stays; rows of a null doc_id stay.
    """
    found = classes(docs, width, percent)
    gone = found.where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = reliable(left.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    once = left.join(twice, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(left.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
