"""Toxic passages by maximum-scoring segments.

A feature - a word, or the first bytes of one - has log-odds between toxic and
clean labelled documents with an informative Dirichlet prior, shrunk by their
standard error. A token's score is the greatest of its features, less a toll
that makes clean text drift down. A linear-time scan finds all maximal scoring
segments of a document. Segment scores of clean text follow an extreme-value law
(Karlin and Altschul): lambda solves sum p e^(lambda s) = 1, K is fitted; a
document's significant segments add up, and a logistic curve fitted on the
labelled sample turns the sum into a score.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunHasher
from .minhash_dedup import sub_blocks

#: Token buckets, labelled documents per class in the sample at most, prior strength in tokens.
BITS, SAMPLE_DOCS, PRIOR = 20, 10_000, 2_000.0
#: Standard errors by which a token's log-odds are shrunk, what each token costs, the most a feature scores.
SHRINK, TOLL, HIGH = 3.0, 0.12, 8.0
#: Expected number of clean segments as good below which a segment is significant.
SIGNIFICANT = 0.05

#: Lengths in bytes of the beginnings of words that count as features beside the word.
PREFIXES = (2, 3, 4, 5, 6, 7, 8)

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Tokens:
    """Token buckets of texts: runs of ASCII letters, digits and other than ASCII characters, A-Z in lower case."""

    def __init__(self) -> None:
        self.hash = RunHasher()

    def __call__(self, texts: list[str | None]):
        """Feature buckets (a row for words, then one per prefix length, -1 if the word isn't longer) of all tokens, where each text's begin (one more at the end), byte starts, byte ends, byte start of each text."""
        parts = [(t or "").encode() for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        doc = np.cumsum(sizes) - sizes
        buf = _LOWER[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
        edge = np.flatnonzero(np.diff(_WORD[buf], prepend=False))
        starts, ends = edge[0::2], edge[1::2]
        bucket = np.full((1 + len(PREFIXES), len(starts)), -1, np.int64)
        bucket[0] = self.hash(buf, starts, ends) >> np.uint64(64 - BITS)
        for k, length in enumerate(PREFIXES, 1):
            longer = np.flatnonzero(ends - starts > length)
            salted = self.hash(buf, starts[longer], starts[longer] + length) * np.uint64(0x9E3779B97F4A7C15)
            bucket[k, longer] = salted >> np.uint64(64 - BITS)
        return bucket, np.searchsorted(starts, np.append(doc, len(buf))), starts, ends, doc


@dataclasses.dataclass
class Model:
    scores: np.ndarray  # float32 by bucket
    lam: float
    log_k: float
    slope: float
    intercept: float


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end excluded, score), left to right, in linear time.

    Only tokens of positive score start a candidate; totals before and after
    each candidate decide whether it stands alone or swallows those before it.
    """
    at = np.flatnonzero(scores > 0)
    if len(at) == 0:
        return []
    total = np.cumsum(scores, dtype=np.float64)
    stack: list[tuple[float, float, int, int, int]] = []  # before, after, first, end, last candidate with a lower total before
    for i in at.tolist():
        after = float(total[i])
        before, first = after - float(scores[i]), i
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= after:
                stack.append((before, after, first, i + 1, j))
                break
            before, first = stack[j][0], stack[j][2]
            del stack[j:]
            j = len(stack) - 1
    return [(f, e, b - a) for a, b, f, e, _ in stack]


def statistic(found: list[tuple[int, int, float]], n: int, lam: float, log_k: float) -> float:
    """Sum over significant segments of -ln E, or the best segment's if none is; E = K n e^(-lambda s)."""
    if not found or not n:
        return -10.0
    gains = [lam * s - log_k - math.log(n) for _, _, s in found]
    over = [g for g in gains if g >= -math.log(SIGNIFICANT)]
    return min(sum(over), 60.0) if over else max(-10.0, max(gains))


def _count(batches):
    tokens = Tokens()
    for batch in batches:
        texts, labels = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64)
        for a, b in sub_blocks(texts):
            bucket, cuts, *_ = tokens(texts[a:b])
            label = np.repeat(labels[a:b], np.diff(cuts))
            value, n = np.unique((bucket * 2 + label)[bucket >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["value", "n"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the rows of ``labels(doc_id, toxic)`` and the texts of ``docs``.

    The sample is SAMPLE_DOCS documents per class at most, by a hash of the id;
    rows without text or label don't count, and a document labelled both ways
    counts as toxic. Without both classes every score is 0.5 or less.
    """
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 1.0, 0.0, 0.0, -5.0 if 1 not in counts else 0.0)
    share = {k: min(1.0, 0.95 * SAMPLE_DOCS / v) for k, v in counts.items()}
    limit = F.when(F.col("toxic") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    sample = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) < limit)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    got = rows.mapInArrow(_count, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).toArrow()
    y = np.zeros((1 << BITS, 2))
    y.reshape(-1)[got.column("value").to_numpy()] = got.column("n").to_numpy()
    n = y.sum(0) / (1 + len(PREFIXES))
    alpha = (0.5 + PRIOR * y.sum(1, keepdims=True) / y.sum()) * (2 * n / n.sum())  # a feature that neither class has scores 0
    total = alpha.sum(0) / (1 + len(PREFIXES))
    logit = np.log((y + alpha) / np.maximum(n + total - y - alpha, 1.0))
    delta = logit[:, 1] - logit[:, 0]
    error = np.sqrt((1 / (y + alpha)).sum(1))
    shrunk = np.sign(delta) * np.maximum(0, np.abs(delta) - SHRINK * error)
    scores = (np.clip(shrunk, 0, HIGH) - TOLL).astype(np.float32)
    session = docs.sparkSession.sparkContext
    # extreme values of the sample: lambda from the tokens of clean documents, K from their best segments, the curve from all
    first = session.broadcast(Model(scores, 1.0, 0.0, 1.0, 0.0))

    def spread(batches):
        scan = _Scan(first.value)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in sub_blocks(texts):
                value, n = np.unique(np.round(np.concatenate(scan.token_scores(texts[a:b])[0]), 2), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(float)), pa.array(n)], names=["s", "n"])

    seen = rows.where("toxic = 0").mapInArrow(spread, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toArrow()
    p = seen.column("n").to_numpy().astype(float)
    lam = _lambda(seen.column("s").to_numpy(), p / max(p.sum(), 1)) if len(p) else 1.0
    model = Model(scores, lam, 0.0, 1.0, 0.0)

    def per_document(value):
        """A job over the sample that gives ``value(segments, tokens, model)`` and the label of each document."""
        shared = session.broadcast(model)

        def run(batches):
            scan = _Scan(shared.value)
            for batch in batches:
                texts = batch.column(0).to_pylist()
                out = [value(segments(s), len(s), scan.model) for a, b in sub_blocks(texts) for s in scan.token_scores(texts[a:b])[0]]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), batch.column(1)], names=["x", "toxic"])

        return rows.mapInArrow(run, "x double, toxic int")

    tops = per_document(lambda found, n, m: m.lam * max((x for *_, x in found), default=0.0) - math.log(n) if n else None)
    fair = tops.where("toxic = 0 and x is not null").agg(F.avg(F.exp(-F.col("x")))).first()[0]
    model.log_k = round(-math.log(fair), 9) if fair else 0.0
    fit = per_document(lambda found, n, m: statistic(found, n, m.lam, m.log_k)).toArrow().to_pylist()  # two numbers a document of the sample
    fit.sort(key=lambda r: (r["x"], r["toxic"]))
    x = np.array([r["x"] for r in fit])
    t = np.array([r["toxic"] for r in fit], float)
    weight = np.where(t > 0, 1 / share[1], 1 / share[0])
    model.slope, model.intercept = _logistic(x, t, weight)
    return model


def _lambda(scores: np.ndarray, p: np.ndarray) -> float:
    low, high = 1e-6, 1.0
    if (p * scores).sum() >= 0 or scores.max() <= 0:
        return 1.0
    while (p * np.exp(high * scores)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, t: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit with a small ridge, by Newton's method; the slope stays positive."""
    a = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        grad = a.T @ (w * (t - p)) - 1e-2 * beta
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


class _Scan:
    def __init__(self, model: Model) -> None:
        self.model, self.tokens = model, Tokens()

    def token_scores(self, texts: list[str | None]):
        bucket, cuts, starts, ends, doc = self.tokens(texts)
        s = np.where(bucket >= 0, self.model.scores[bucket], -np.float32(TOLL)).max(0) if bucket.size else np.zeros(0, np.float32)
        return [s[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], cuts, starts, ends, doc


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every column of ``docs``, with toxic_score in 0..1 and toxic_passages, an array of (first, last, score, expected).

    Passages are the significant maximal segments, as offsets in code points, the
    end excluded; expected is how many as good a clean text of this length has.
    A null text counts as empty and has the least score; repeated rows stay;
    columns named like the results are replaced; an empty table gives an empty
    result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

    names = [c for c in docs.columns if c not in ("toxic_score", "toxic_passages")]
    slim = docs.select(*(F.col(f"`{c}`") for c in names))
    passage = StructType([StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("score", DoubleType()), StructField("expected", DoubleType())])
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in slim.schema), StructField("toxic_score", DoubleType()), StructField("toxic_passages", ArrayType(passage))])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        scan = _Scan(m)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            scores, passages = [], []
            for a, b in sub_blocks(texts):
                per_doc, cuts, starts, ends, doc = scan.token_scores(texts[a:b])
                for i, s in enumerate(per_doc):
                    found = segments(s)
                    x = statistic(found, len(s), m.lam, m.log_k)
                    scores.append(1 / (1 + math.exp(-(m.slope * x + m.intercept))))
                    good = []
                    for f, e, v in found:
                        expected = math.exp(min(50.0, m.log_k + math.log(len(s)) - m.lam * v))
                        if expected <= SIGNIFICANT:
                            raw = (texts[a + i] or "").encode()
                            at, to = int(starts[cuts[i] + f] - doc[i]), int(ends[cuts[i] + e - 1] - doc[i])
                            first = len(raw[:at].decode())
                            good.append({"first": first, "last": first + len(raw[at:to].decode()), "score": v, "expected": expected})
                    passages.append(good)
            cols = [*batch.columns, pa.array(scores, pa.float64()), pa.array(passages, arrow.field("toxic_passages").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return slim.mapInArrow(run, schema)
