"""Language identification by compression.

Per language, text of labelled documents makes a zstandard raw-content
dictionary. A document is encoded with each, in pieces so that its own text
doesn't stand in for the dictionary, and the language of the smallest encoding
wins. Narrow margins get a second, closer look; what stays narrow is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reliable

#: Bytes of a dictionary; bytes of it from one document at most; bytes of all dictionaries, which share them equally where there are very many languages.
DICT_BYTES, PASSAGE_BYTES, ALL_BYTES = 1 << 16, 500, 1 << 28
#: Languages whose counts are broadcast at most.
BROADCAST_ROWS = 100_000
#: Bytes of a document's pieces; rows of an Arrow batch that are Python objects at once.
PIECE_BYTES, BATCH_ROWS = 1024, 512
#: Relative margins below these get a second look, and are rejected after it.
NARROW, REJECT = 0.02, 0.003
#: Rotations of the text that the second look adds up, for texts of one piece.
ROTATIONS = 8

_KEEP = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def letters(text: str) -> bytes:
    """Lower case, with white space, ASCII digits and ASCII marks as single blanks."""
    return b" ".join(text.lower().encode().translate(_KEEP).split())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary, from a bounded sample of the rows whose text and language are not null.

    Every language that a row names is learned. Its sample is the texts of the
    smallest hashes, each text once, a passage of at most PASSAGE_BYTES from a
    hashed place in each, and DICT_BYTES in all (less where ALL_BYTES are shared
    by more than 4096 languages). One aggregation finds how many rows a language
    has, so only about as many as needed are shuffled.
    """
    rows = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where("t is not null and l is not null and trim(l) <> ''")
    counts = reliable(rows.groupBy("l").count())
    languages = counts.count()
    if not languages:
        return {}
    size = min(DICT_BYTES, max(PASSAGE_BYTES, ALL_BYTES // languages))
    want = 8 * size // PASSAGE_BYTES
    h, room = F.xxhash64("t"), 4 * PASSAGE_BYTES
    sample = (
        rows.join(F.broadcast(counts) if languages <= BROADCAST_ROWS else counts, "l")
        .withColumn("h", h)
        .where(F.pmod("h", F.lit(1 << 30)) < F.least(F.lit(1.0), want / F.col("count")) * (1 << 30))
        .select("l", "h", F.substring("t", F.pmod(F.shiftright("h", 30), F.greatest(F.length("t") - room, F.lit(0)) + 1).cast("int") + 1, F.lit(room)).alias("t"))
        .groupBy("l", "h")
        .agg(F.min("t").alias("t"))
    )
    per: dict[str, list] = {}
    for r in sample.toLocalIterator():
        per.setdefault(r["l"], []).append((r["h"] % (1 << 30), r["h"], letters(r["t"])[:PASSAGE_BYTES]))
    return {lang: b" ".join(p for _, _, p in sorted(parts))[:size] for lang, parts in sorted(per.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = sorted(dictionaries)

        def coder(data: bytes, level: int):
            params = zstandard.ZstdCompressionParameters.from_level(level, source_size=PIECE_BYTES, dict_size=DICT_BYTES, min_match=3, write_content_size=0)
            return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)

        self.fast = [coder(dictionaries[x], 2) for x in self.languages]
        self.close = [coder(dictionaries[x], 12) for x in self.languages]

    def sizes(self, raw: bytes, coders: list) -> np.ndarray:
        pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in coders], float)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin was wide enough. ``und``, 0 and False for null, no letter, or nothing learned."""
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0, False
        raw = letters(text) or text.encode()
        sizes = self.sizes(raw, self.fast)
        if self.margin(sizes) < NARROW:
            if len(raw) <= PIECE_BYTES:
                step = max(1, len(raw) // ROTATIONS)
                turns = [raw[i:] + b" " + raw[:i] for i in range(0, len(raw), step)]
                sizes = np.mean([self.sizes(t, self.close) for t in turns], axis=0)
            else:
                sizes = self.sizes(raw, self.close)
        best = int(sizes.argmin())
        score = float(1 / np.exp2(np.maximum(sizes[best] - sizes, -60)).sum())
        return self.languages[best], score, len(sizes) == 1 or self.margin(sizes) >= REJECT

    @staticmethod
    def margin(sizes: np.ndarray) -> float:
        if len(sizes) < 2:
            return 1.0
        a, b = np.partition(sizes, 1)[:2]
        return float((b - a) / b)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """Every column of ``docs``, with lang_pred, lang_score in 0..1 and lang_accepted.

    The score is the winner's share if a byte saved doubles the odds. Null
    texts and texts without a letter are ``und``, 0, not accepted; a tie after
    the second look goes to the first language by name, not accepted. Columns
    named like the results are replaced; repeated rows stay; an empty table
    gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_accepted")]
    slim = docs.select(*(F.col(f"`{c}`") for c in names))
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in slim.schema), StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_accepted", BooleanType())])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        classify = Classifier(shared.value)
        for batch in (big.slice(i, BATCH_ROWS) for big in batches for i in range(0, big.num_rows, BATCH_ROWS)):
            got = [classify(t) for t in batch.column(text).to_pylist()]
            cols = [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return slim.mapInArrow(run, schema)


def held_out(doc_id: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves this remainder; a null id is in no part."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % parts == part, F.lit(False))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are rejected, in the same columns.

    Rejected are null texts, texts without a letter, and those whose smallest
    encodings of two languages are too close to tell. Repeated rows stay or go
    together; without any labelled row nothing can be told and all go.
    """
    found = identify(docs, learn(docs.where(~held_out("doc_id", 3, 1))))
    return found.where("lang_accepted").select(*docs.columns)
