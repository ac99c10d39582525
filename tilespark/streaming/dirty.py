"""Incremental rebuild: the tiles that a stream of changed nodes makes stale.

An extension: the batch job has no streams. Changes (id, lat, lon, changed_at)
come in with late ones dropped after `delay`; per window each stale tile is
counted once, and its id can be joined to the archive's tiles to build them anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hilbert as H
from ..functions import scalar as S


def stale_tiles(changes: DataFrame, zooms: tuple[int, ...], window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(window, z, tile_id, changes) of a stream or table of changed nodes."""
    z = F.col("z")
    rows = changes.withWatermark("changed_at", delay).withColumn("z", F.explode(F.array(*map(F.lit, zooms))))
    x, y = S.tile_at(S.x_of(F.col("lon")), z), S.tile_at(S.y_of(F.col("lat")), z)
    tiles = rows.select("changed_at", "z", H.tile_id(z, x, y).alias("tile_id"))
    return tiles.groupBy(F.window("changed_at", window).alias("window"), "z", "tile_id").agg(F.count(F.lit(1)).alias("changes"))
