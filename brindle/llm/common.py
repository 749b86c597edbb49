"""What the operators share: staged tables, bounded samples, connected components."""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import remove, shared_folder, staged, staged_at

__all__ = ["WORD", "bounded_sample", "components", "remainder", "shared_folder", "sieved", "single_threaded", "small_batches", "staged"]

#: Words of every contract: runs of anything but space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def remainder(column: str, modulus: int):
    """crc32 of an id as text, modulo; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(df: DataFrame, by: str, rows: int, key: str = "doc_id") -> DataFrame:
    """At most `rows` rows of each value of `by`, those of lowest hash of `key`; rows of equal keys by the hash of all their columns.

    A first pass counts each value, so that the window only sorts about twice the rows asked for, however many there are.
    The counts, a row for each value, are staged: Spark sees their size and broadcasts them if it is under the session's threshold.
    """
    whole = df.select(F.struct(*df.columns).alias("row"), F.col(by).alias("by"), F.col(key).alias("key"))
    counts = staged(whole.groupBy(F.col("by").alias("of")).agg(F.count(F.lit(1)).alias("n")), "sample")
    unit = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = whole.withColumn("u", unit).join(counts, F.col("by") == F.col("of")).where(F.col("u") * F.col("n") <= 2.0 * rows)
    rank = F.row_number().over(Window.partitionBy("by").orderBy("u", "key", F.xxhash64("row")))
    return near.withColumn("r", rank).where(F.col("r") <= rows).select("row.*")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a bigint, b bigint): rows (node, root), root the smallest id reachable.

    Alternating large-star and small-star contraction.  Each round is staged in the shared folder and the one before it deleted; only a
    count and a checksum reach the driver.  Nodes without an edge to another node have no row.  The edges of a giant component all carry its
    root: the joins on it are sort-merge joins of two sides, whose large partitions Spark's adaptive execution splits.
    """
    spark = edges.sparkSession
    e, place = staged_at(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        before = place
        e, place = staged_at(small.distinct(), "edges")
        remove(spark, before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


#: Whole texts in an Arrow batch: ten thousand, Spark's own number, are hundreds of MB where texts are long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the session's Arrow batches to `rows` rows; smaller bounds stay.  Called by operators whose tasks take whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


#: Bits of a sieve: 2 MB, whatever it holds.
SIEVE_BITS = 1 << 24


def sieved(rows: DataFrame, hash_of: str, keys: DataFrame) -> DataFrame:
    """rows with `maybe`: true for every row whose `hash_of` (long) is among the single column of keys, and for a few others.

    The keys are or-ed into a bitmap of SIEVE_BITS bits in Spark, so what is broadcast has a fixed size; what falls through a saturated one costs a
    shuffle and no result.
    """
    slot = lambda c: F.pmod(c, F.lit(SIEVE_BITS)) + 1
    key = slot(F.col(keys.columns[0]))
    maps = keys.select(key.alias("k")).groupBy(F.bitmap_bucket_number("k").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("_bits"))
    at = rows.withColumn("_slot", slot(F.col(hash_of)))
    found = at.join(F.broadcast(maps), F.bitmap_bucket_number("_slot") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST(bitmap_bit_position(_slot) div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, CAST(bitmap_bit_position(_slot) % 8 AS INT)) % 2 = 1")
    return found.withColumn("_byte", F.coalesce(byte, F.lit(0))).withColumn("maybe", bit).drop("_slot", "_bucket", "_bits", "_byte")


@functools.cache
def single_threaded() -> None:
    """Called in tasks: native libraries must not start threads of their own there."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
