"""Tile addresses as Hilbert numbers: all tiles of lower zooms come first, then the curve of the zoom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ZOOM = 31


def _shl(a: Column, b: Column) -> Column:
    return F.call_function("shiftleft", a, b.cast("int"))


def _bit(a: Column, i: Column) -> Column:
    return F.call_function("shiftright", a, i.cast("int")).bitwiseAND(F.lit(1).cast("long"))


def zoom_offset(z: Column) -> Column:
    """How many tiles the zooms below z have: (4^z - 1) / 3, without leaving 64 bits."""
    all_tiles = _shl(F.lit(1).cast("long"), 2 * z) - 1
    return F.call_function("div", all_tiles, F.lit(3))


def _levels(z: Column, descending: bool) -> Column:
    steps = F.sequence(z - 1, F.lit(0), F.lit(-1)) if descending else F.sequence(F.lit(0), z - 1, F.lit(1))
    return F.when(z > 0, steps).otherwise(F.array().cast("array<int>"))


def _turn(x: Column, y: Column, rx: Column, ry: Column, last: Column) -> tuple[Column, Column]:
    """Reflect and swap the lower bits of a quadrant (rx, ry) whose side's largest coordinate is `last`."""
    flip = (ry == 0) & (rx == 1)
    a, b = F.when(flip, last - x).otherwise(x), F.when(flip, last - y).otherwise(y)
    return F.when(ry == 0, b).otherwise(a), F.when(ry == 0, a).otherwise(b)


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """The id of tile z/x/y; null outside the grid (`checked_tile_id` raises)."""
    zero = F.struct(F.lit(0).cast("long").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(a: Column, i: Column) -> Column:
        rx, ry = _bit(a["x"], i), _bit(a["y"], i)
        last = _shl(F.lit(1).cast("long"), i) - 1
        low_x, low_y = a["x"].bitwiseAND(last), a["y"].bitwiseAND(last)
        nx, ny = _turn(low_x, low_y, rx, ry, last)
        quadrant = (3 * rx).bitwiseXOR(ry)
        return F.struct((a["d"] + _shl(quadrant, 2 * i)).alias("d"), nx.alias("x"), ny.alias("y"))

    inside = z.between(0, MAX_ZOOM) & (x >= 0) & (y >= 0) & (x < _shl(F.lit(1).cast("long"), z)) & (y < _shl(F.lit(1).cast("long"), z))
    return F.when(inside, zoom_offset(z) + F.aggregate(_levels(z.cast("int"), True), zero, step, lambda a: a["d"]))


def checked_tile_id(z: Column, x: Column, y: Column) -> Column:
    return F.coalesce(tile_id(z, x, y), F.raise_error(F.concat(F.lit("no such tile: "), F.concat_ws("/", z, x, y))).cast("long"))


def zoom_of(id_: Column) -> Column:
    """The zoom of a tile id; null below 0 or beyond the last zoom."""
    bounds = [(4**z - 1) // 3 for z in range(MAX_ZOOM + 2)]
    out = F.when(id_ < 0, F.lit(None).cast("int"))
    for z in range(MAX_ZOOM + 1):
        out = out.when(id_ < bounds[z + 1], F.lit(z))
    return out


def zxy_of(id_: Column) -> Column:
    """A struct (z, x, y) from a tile id; null for ids that no tile has."""
    z = zoom_of(id_)
    zero = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), (id_ - zoom_offset(z)).alias("d"))

    def step(a: Column, i: Column) -> Column:
        two = F.call_function("shiftright", a["d"], (2 * i).cast("int")).bitwiseAND(F.lit(3).cast("long"))
        rx = F.call_function("shiftright", two, F.lit(1)).bitwiseAND(F.lit(1).cast("long"))
        ry = two.bitwiseXOR(rx).bitwiseAND(F.lit(1).cast("long"))
        last = _shl(F.lit(1).cast("long"), i) - 1
        nx, ny = _turn(a["x"], a["y"], rx, ry, last)
        return F.struct((nx + _shl(rx, i)).alias("x"), (ny + _shl(ry, i)).alias("y"), a["d"].alias("d"))

    place = F.aggregate(_levels(z, False), zero, step)
    return F.when(z.isNotNull(), F.struct(z.alias("z"), place["x"].alias("x"), place["y"].alias("y")))
