"""Archive windows: content dedup, run lengths, offsets and directory deltas.

Input is (tile_id, blob). Blobs are grouped by their SHA-256 beside their
length, so a large blob crosses the network once; ordered windows over all tiles
are cut into ranges of tile ids, whose carries are summed over one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tile ids whose high bits agree are one range of the ordered windows.
RANGE_BITS = 20


def distinct_blobs(tiles: DataFrame) -> DataFrame:
    """(digest, first_id, length): each content with the first tile that has it."""
    rows = tiles.select("tile_id", F.sha2("blob", 256).alias("digest"), F.length("blob").cast("long").alias("length"))
    return rows.groupBy("digest").agg(F.min("tile_id").alias("first_id"), F.min("length").alias("length"))


def running_sum(df: DataFrame, value: str, order: str, name: str, bits: int = RANGE_BITS) -> DataFrame:
    """Add the sum of `value` over all rows before this one by `order`, in two levels: within ranges of the order, and over ranges."""
    df = df.withColumn("_range", F.shiftright(order, bits))
    sums = df.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried"))
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(carried, "_range").withColumn(name, (F.col("_within") + F.col("_carried")).cast("long")).drop("_range", "_within", "_carried")


def with_previous(df: DataFrame, columns: list[str], order: str, bits: int = RANGE_BITS) -> DataFrame:
    """Add `previous`, a struct of these columns of the row before by `order`: within ranges of the order, and for a range's first row by one row per range."""
    value = F.struct(*columns)
    df = df.withColumn("_range", F.shiftright(order, bits))
    last = df.groupBy("_range").agg(F.max_by(value, order).alias("_last"))
    carried = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_carried"))
    rows = df.withColumn("_before", F.lag(value).over(Window.partitionBy("_range").orderBy(order)))
    return rows.join(carried, "_range").withColumn("previous", F.coalesce("_before", "_carried")).drop("_range", "_before", "_carried")


def blob_offsets(tiles: DataFrame) -> DataFrame:
    """(digest, first_id, length, offset): contents laid out by first appearance."""
    return running_sum(distinct_blobs(tiles), "length", "first_id", "offset")


def entries(tiles: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """(tile_id, offset, length, run_length): tiles of one content with ids in a row are one entry.

    A tile begins a run if the tile before it is missing or has other content; the
    number of runs so far names its run.
    """
    placed = tiles.select("tile_id", F.sha2("blob", 256).alias("digest")).join(blob_offsets(tiles), "digest")
    starts = placed.join(placed.select((F.col("tile_id") + 1).alias("tile_id"), F.col("offset").alias("_last")), "tile_id", "left")
    begins = (F.col("_last").isNull() | (F.col("_last") != F.col("offset"))).cast("long")
    numbered = running_sum(starts.select("tile_id", "offset", "length", begins.alias("_begins")), "_begins", "tile_id", "_runs", bits)
    run = (F.col("_runs") + F.col("_begins")).alias("run")
    return numbered.groupBy(run).agg(F.min("tile_id").alias("tile_id"), F.min("offset").alias("offset"), F.min("length").alias("length"), F.count(F.lit(1)).alias("run_length")).drop("run")


def directory_columns(found: DataFrame) -> DataFrame:
    """Entries as a directory stores them: (tile_id, id_delta, run_length, length, stored_offset), 0 where an entry follows its predecessor's bytes."""
    rows = with_previous(found, ["tile_id", "offset", "length"], "tile_id")
    follows = F.col("offset") == F.col("previous.offset") + F.col("previous.length")
    stored = F.when(F.coalesce(follows, F.lit(False)), F.lit(0)).otherwise(F.col("offset") + 1)
    return rows.select("tile_id", (F.col("tile_id") - F.coalesce("previous.tile_id", F.lit(0))).alias("id_delta"), "run_length", "length", stored.cast("long").alias("stored_offset"))


def leaf_of(found: DataFrame, leaf_size: int) -> DataFrame:
    """Entries with the number of the leaf directory they are in."""
    numbered = running_sum(found.withColumn("_one", F.lit(1)), "_one", "tile_id", "_nth")
    return numbered.withColumn("leaf", F.floor(F.col("_nth") / leaf_size).cast("long")).drop("_one", "_nth")


def archive_counts(found: DataFrame) -> DataFrame:
    """One row: addressed tiles, entries, contents and bytes of content."""
    contents = found.groupBy("offset").agg(F.max("length").alias("length"), F.sum("run_length").alias("tiles"), F.count(F.lit(1)).alias("entries"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return contents.agg(total("tiles").alias("addressed"), total("entries").alias("entries"), F.count(F.lit(1)).alias("contents"), total("length").alias("tile_bytes"))
