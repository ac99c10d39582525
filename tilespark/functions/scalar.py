"""Rounding, degrees and Web Mercator as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The latitude at which the Mercator square ends.
MAX_LATITUDE = 85.05112877980659


def round_away(x: Column) -> Column:
    """Nearest integer, halves away from zero; exact where adding a half is not, and inside code generation where round() is not."""
    size = F.abs(x)
    whole = F.floor(size)
    up = whole + (size - whole >= 0.5).cast("long")
    return F.when(x < 0, -up).otherwise(up)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later filters and projections read but never inline: it stands behind a Generate.

    Catalyst pushes filters through projections and merges projections by
    copying expressions; for deep higher-order ones the plan would double at each step.
    """
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def clamp_latitude(lat: Column) -> Column:
    return F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE))


def x_of(lon: Column) -> Column:
    return (lon + 180.0) / 360.0


def y_of(lat: Column) -> Column:
    angle = clamp_latitude(lat) * F.lit(math.pi) / 180.0
    return (1.0 - F.ln(F.tan(angle) + 1.0 / F.cos(angle)) / F.lit(math.pi)) / 2.0


def lon_of(x: Column) -> Column:
    return x * 360.0 - 180.0


def lat_of(y: Column) -> Column:
    return F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * y))) * 180.0 / F.lit(math.pi)


def tiles_across(z: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int"))


def tile_at(unit: Column, z: Column) -> Column:
    """The tile column or row that holds a unit coordinate, inside the grid."""
    n = tiles_across(z)
    return F.least(F.greatest(F.floor(unit * n), F.lit(0)), n - 1)


def tile_edges(z: Column, x: Column, y: Column) -> Column:
    """A struct of a tile's degrees: west, south, east, north."""
    n = tiles_across(z)
    at = lambda f, v: f(v.cast("double") / n)
    return F.struct(at(lon_of, x).alias("west"), at(lat_of, y + 1).alias("south"), at(lon_of, x + 1).alias("east"), at(lat_of, y).alias("north"))


def world(unit: Column, z: Column, extent: int = 4096) -> Column:
    """A unit coordinate on the integer grid of a zoom: 2^z tiles of `extent` steps."""
    return round_away(unit * tiles_across(z) * F.lit(extent))


def project(unit: Column, z: Column, tile: Column, extent: int = 4096) -> Column:
    """Local to a tile, not clamped."""
    return round_away((unit * tiles_across(z) - tile) * F.lit(extent))


def tile_of_world(v: Column, z: Column, extent: int = 4096) -> Column:
    return F.least(F.greatest(F.floor(v / F.lit(extent)), F.lit(0)), tiles_across(z) - 1)


def to_e7(degrees: Column) -> Column:
    """As the node store keeps degrees: steps of 1e-7, by division."""
    return round_away(degrees / F.lit(1e-7))


def from_e7(steps: Column) -> Column:
    return steps * F.lit(1e-7)


def header_e7(degrees: Column) -> Column:
    """As the archive header keeps degrees: by multiplication."""
    return round_away(degrees * F.lit(1e7))


def header_degrees(steps: Column) -> Column:
    return steps / F.lit(1e7)


def parse_number(text: Column) -> Column:
    """A decimal number or null; no type suffixes, no infinities."""
    plain = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(plain, F.trim(text).try_cast("double"))
