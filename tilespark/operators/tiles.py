"""From classified features to encoded tiles.

A feature row is (source, ordinal, id, layer, type, attributes, min_zoom, rank,
outer, inner), its parts arrays of (lon, lat); source tells ways 0, relations 1
and points 2 apart, and (rank, source, ordinal) is the total drawing order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as S
from ..functions.hilbert import tile_id
from ..schema import POINT, POLYGON, TileSchema
from .kernels import ENCODED_LAYER, layer_encoder, simplify


@dataclass(frozen=True)
class Area:
    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float

    def tile_range(self, z: Column) -> tuple[Column, Column, Column, Column]:
        """First and last tile column and row that the area touches."""
        at = lambda v: S.tile_at(v, z)
        return at(S.x_of(F.lit(self.min_lon))), at(S.y_of(F.lit(self.max_lat))), at(S.x_of(F.lit(self.max_lon))), at(S.y_of(F.lit(self.min_lat)))

    def tiles(self, zooms: DataFrame) -> DataFrame:
        """(z, x, y, tile_id) of every tile that the area touches, from rows (z)."""
        z = F.col("z")
        x0, y0, x1, y1 = self.tile_range(z)
        rows = zooms.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1)))
        return rows.select("z", "x", "y", tile_id(z, F.col("x"), F.col("y")).alias("tile_id"))


def expand_zooms(features: DataFrame, low: int, high: int) -> DataFrame:
    """A row for each zoom of low..high that shows the feature."""
    shown = F.sequence(F.greatest(F.col("min_zoom"), F.lit(low)), F.lit(high))
    return features.where(F.col("min_zoom") <= high).withColumn("z", F.explode(shown))


def world_parts(parts: Column, z: Column, extent: int) -> Column:
    return F.transform(parts, lambda p: F.transform(p, lambda v: G.point(S.world(S.x_of(v["lon"]), z, extent), S.world(S.y_of(v["lat"]), z, extent))))


def tile_candidates(shapes: DataFrame, area: Area, extent: int, buffer: int) -> DataFrame:
    """Add tx, ty of every tile whose buffered square the bounds of `outer` meet, inside the area; the ranges are cut before they are exploded."""
    shapes = S.bound(shapes, "_b", G.bounds(F.col("outer")))
    z = F.col("z")
    x0, y0, x1, y1 = area.tile_range(z)
    low = lambda v, limit: F.greatest(S.tile_of_world(v - buffer, z, extent), limit)
    high = lambda v, limit: F.least(S.tile_of_world(v + buffer, z, extent), limit)
    ranges = shapes.select("*", low(F.col("_b.min_x"), x0).alias("_x0"), low(F.col("_b.min_y"), y0).alias("_y0"), high(F.col("_b.max_x"), x1).alias("_x1"), high(F.col("_b.max_y"), y1).alias("_y1"))
    span = lambda a, z: F.when(F.col(a) <= F.col(z), F.sequence(a, z)).otherwise(F.array().cast("array<bigint>"))
    return ranges.withColumn("tx", F.explode(span("_x0", "_x1"))).withColumn("ty", F.explode(span("_y0", "_y1"))).drop("_b", "_x0", "_y0", "_x1", "_y1")


def prepare(features: DataFrame, schema: TileSchema) -> DataFrame:
    """Lines and areas on the integer grid of their zoom, simplified, without parts that have become too small."""
    z = F.col("z")
    least = F.when(F.col("type") == POLYGON, 3).otherwise(2)
    out = features
    for side in ("outer", "inner"):
        out = S.bound(out, side, F.filter(world_parts(F.col(side), z, schema.extent), lambda p: F.size(p) >= least))
    for side in ("outer", "inner"):
        out = S.bound(out, side, F.filter(simplify(F.col(side), schema.tolerance(z)), lambda p: F.size(p) >= least))
    return out.where(F.size("outer") > 0)


def clip_to_tiles(shapes: DataFrame, extent: int, buffer: int) -> DataFrame:
    """The parts of each (feature, tile): clipped, and rings nested again."""
    low, high = -buffer, extent + buffer
    local = lambda parts: F.transform(parts, lambda p: F.transform(p, lambda v: G.point(v["x"] - F.col("tx") * extent, v["y"] - F.col("ty") * extent)))
    rings = lambda parts: F.filter(F.transform(local(parts), lambda p: G.clip_ring(p, low, high)), lambda p: F.size(p) >= 3)
    lines = F.filter(F.transform(F.flatten(F.transform(local(F.col("outer")), lambda p: G.clip_line(p, low, high))), G.dedupe), lambda p: F.size(p) >= 2)
    polygon = F.col("type") == POLYGON
    cut = S.bound(S.bound(shapes, "_o", F.when(polygon, rings(F.col("outer")))), "_i", F.when(polygon, rings(F.col("inner"))))
    parts = F.when(polygon, F.when(F.size("_o") > 0, G.nest(F.col("_o"), F.col("_i")))).otherwise(lines)
    return S.bound(cut, "parts", parts).where(F.size("parts") > 0).drop("outer", "inner", "_o", "_i")


def bin_points(points: DataFrame, area: Area, schema: TileSchema) -> DataFrame:
    """Points (lon, lat) in the one tile that holds them; there is no buffer."""
    z = F.col("z")
    x, y = S.x_of(F.col("lon")), S.y_of(F.col("lat"))
    x0, y0, x1, y1 = area.tile_range(z)
    rows = expand_zooms(points, schema.min_zoom, schema.max_zoom).withColumn("tx", S.tile_at(x, z)).withColumn("ty", S.tile_at(y, z))
    rows = rows.where(F.col("tx").between(x0, x1) & F.col("ty").between(y0, y1))
    at = G.point(S.project(x, z, F.col("tx"), schema.extent), S.project(y, z, F.col("ty"), schema.extent))
    return rows.withColumn("parts", F.array(F.array(at))).drop("lon", "lat")


TILE_FEATURE = ["z", "tx", "ty", "source", "ordinal", "id", "layer", "type", "attributes", "rank", "parts"]


def bin_features(shapes: DataFrame, points: DataFrame | None, area: Area, schema: TileSchema, buffer: int | None = None) -> DataFrame:
    """A row per feature and tile: TILE_FEATURE and tile_id."""
    buffer = schema.extent // 64 if buffer is None else buffer
    shown = prepare(expand_zooms(shapes, schema.min_zoom, schema.max_zoom), schema)
    out = clip_to_tiles(tile_candidates(shown, area, schema.extent, buffer), schema.extent, buffer).select(*TILE_FEATURE)
    if points is not None:
        out = out.unionByName(bin_points(points, area, schema).select(*TILE_FEATURE))
    return S.bound(out, "tile_id", tile_id(F.col("z"), F.col("tx"), F.col("ty")))


def commands(kind: Column, parts: Column) -> Column:
    return F.when(kind == POINT, G.encode_points(parts)).when(kind == POLYGON, G.encode_lines(parts, True)).otherwise(G.encode_lines(parts, False))


def encode_tiles(binned: DataFrame, extent: int) -> DataFrame:
    """(z, tile_id, features, tile) from binned features.

    Layers are encoded for themselves and joined to a tile in the order of their
    first features, since a tile message is its layer messages one after
    another; so a crowded tile is spread over as many tasks as it has layers.
    """
    rows = binned.select("z", "tile_id", "layer", "rank", "source", "ordinal", "id", "type", "attributes", commands(F.col("type"), F.col("parts")).alias("commands"))
    layers = rows.groupBy("z", "tile_id", "layer").applyInArrow(layer_encoder(extent), ENCODED_LAYER)
    part = F.struct("rank", "source", "ordinal", "message")
    tiles = layers.groupBy("z", "tile_id").agg(F.sum("features").alias("features"), F.sort_array(F.collect_list(part)).alias("p"))
    tile = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["message"]))
    return tiles.select("z", "tile_id", "features", tile.alias("tile")).where(F.length("tile") > 0)
