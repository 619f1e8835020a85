"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations alone.

Each source has a weight schedule over training time; its integral is the
source's demand for words up to a moment. Inverting the cumulative demand at a
document's offset in its source's stream of words gives the moment at which the
document is trained on; sorting by range of moments lays out the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import reliable

#: Words of a document: runs of other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A source is taken at most this often.
MAX_REPEATS = 3
#: Documents of one bucket of the order, about; a source's window never spans more.
BUCKET_ROWS = 4_000


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``number``, the place of each row in this order from 0: ranges of the order are sorted apart, and only their counts are added up in one task."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = "__" + "_".join(["range", *df.columns])  # no column has this name
    parts = reliable(df.repartitionByRange(ranges, *order).withColumn(at, F.spark_partition_id()))
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(at).count().select(at, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("number"))
    inside = F.row_number().over(Window.partitionBy(at).orderBy(*order)) - 1
    return parts.withColumn("_inside", inside).join(F.broadcast(starts), at).select(*df.columns, (F.col("number") + F.col("_inside")).alias("number"))


def targets(sources: DataFrame, total: int) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``sources(source, source_size)``.

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share
    ``total``; a target stops at MAX_REPEATS times its source's size and the
    excess is shared among the others by weight until none is above. The level
    is found by aggregates over the sources' table; only its totals reach the
    driver.
    """
    s = numbered(sources, F.col("source").isNull(), F.col("source")).withColumn("weight", (F.col("number") % 3 + 1).cast("int")).drop("number").withColumn("cap", F.col("source_size") * MAX_REPEATS)
    s = reliable(s)
    level = 0.0
    while total:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        r = s.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("c"), F.sum(F.when(~full, F.col("weight")).otherwise(0)).alias("w")).first()
        higher = (total - r["c"]) / r["w"] if r["w"] else level
        if higher <= level:
            break
        level = higher
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level)))).drop("cap")


def moment(share: Column, slope: Column) -> Column:
    """When a schedule 1 + slope * (t - 1/2), t in 0..1, has met this share of its demand: the inverse of its integral."""
    start = 1 - slope / 2
    return F.when(F.abs(slope) < 1e-9, share).otherwise((F.sqrt(start * start + 2 * slope * share) - start) / slope)


def stream_order(doc_id: Column, text: Column) -> Column:
    """60-bit hash of id and text, from MD5, so that any engine can say it."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", slopes: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, positions, taken, in training order.

    A source's documents are ordered by a hash of id and text, rows of equal
    hash by id, and make a stream of words, repeated up to MAX_REPEATS times.
    The source's demand for words at a moment of training, 0 to 1, is its target
    times the integral of its schedule up to then; inverting it at the middle of
    each copy of a document gives the moment at which that copy is trained on.
    ``positions`` holds the moments before 1, in order; later ones, beyond the
    target, aren't taken, so a source's taken words are within half a document
    of its target. Rows are sorted in ranges of their first position, those
    without any last. ``slopes``, by source and weight, tilts the schedules
    (default: heavier sources later).

    Null and empty texts have size 0 and are taken once, with 0 words, at the
    moment of their place in the stream, or at 1 if that lies beyond the target; null sources are one source. Repeated
    rows count as often as they stand. Other columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    d = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        stream_order(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("h"),
    )
    d = reliable(d)
    n = d.count()
    d = d.withColumn("bucket", F.shiftright("h", 60 - (n // BUCKET_ROWS).bit_length()))  # ranges of the order
    parts = reliable(d.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sources = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    by_source = targets(sources, total)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    parts = parts.join(by_source, parts["source"].eqNullSafe(by_source["source"])).select(parts["source"].alias("s"), F.col("bucket").alias("k"), "before", "source_size", "weight", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(parts, (d["bucket"] == parts["k"]) & d["source"].eqNullSafe(parts["s"]))
    d = d.withColumn("middle", F.col("before") + F.col("offset") + F.col("size") / 2).withColumn("slope", slopes if slopes is not None else (F.col("weight") - 2) * 0.5)

    def trained_at(repeat: int) -> Column:
        share = (F.col("middle") + F.col("source_size") * repeat) / F.col("target")
        return F.when(F.col("target") > 0, F.when(share < 1, moment(share, F.col("slope"))))

    positions = F.when(F.col("size") == 0, F.array(F.coalesce(trained_at(0), F.lit(1.0)))).otherwise(F.filter(F.array(*map(trained_at, range(MAX_REPEATS))), lambda t: t < 1))
    d = d.withColumn("positions", positions).withColumn("taken", (F.size("positions") * F.col("size")).cast("long"))
    first = F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(2.0))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartitionByRange(ranges, first, "h").sortWithinPartitions(first, "h").select("doc_id", "size", "source", "source_size", "target", "positions", "taken", "h")


def laid_out(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The mix itself: the rows of ``docs``, repeated as taken, in range-sorted training order; documents not taken go.

    Of rows of equal doc_id and text, which can't be told apart, each gets the
    positions of the one that has most. Null and empty texts stay once; a null
    doc_id or source is a value like others; an empty table stays empty.
    """
    plan = mix(docs).where("size(positions) > 0").groupBy("doc_id", "h").agg(F.max(F.struct(F.size("positions").alias("n"), "positions")).alias("most"))
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.posexplode("most.positions").alias("_pass", "_position"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("row_id"), stream_order(F.col("doc_id"), F.col("text")).alias("row_hash"))
    out = rows.join(plan, F.col("row_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_h")))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, "_position", "_h").sortWithinPartitions("_position", "_h", "_pass").select("row.*")
