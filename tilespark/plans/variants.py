"""What schemas cost: the same extract as an archive of each of several schemas."""

from __future__ import annotations

import time
from dataclasses import dataclass

from ..operators.tiles import Area
from ..schema import DeliverySchema, KeepEverythingSchema, OpenMapTilesSchema, TileSchema
from .build import Extract, build

#: Delivery first, everything last, which is what the others are held against.
VARIANTS: dict[str, TileSchema] = {
    "delivery": DeliverySchema(min_zoom=8),
    "delivery, no names": DeliverySchema(min_zoom=8, names=False),
    "delivery, zooms 12 to 15": DeliverySchema(min_zoom=12),
    "delivery, extent 1024": DeliverySchema(min_zoom=8, extent=1024),
    "openmaptiles": OpenMapTilesSchema(min_zoom=8, max_zoom=15),
    "openmaptiles, no buildings": OpenMapTilesSchema(min_zoom=8, max_zoom=15, buildings=False),
    "everything": KeepEverythingSchema(),
}


@dataclass(frozen=True)
class Cost:
    variant: str
    tiles: int
    features: int
    archive_bytes: int
    #: Of the last variant's bytes; None where those are none.
    share: float | None
    seconds: float


def compare(extract: Extract, area: Area, folder: str, variants: dict[str, TileSchema] | None = None) -> list[Cost]:
    """Build each variant once, into `folder`, and tell what it cost."""
    found = []
    for k, (name, schema) in enumerate((variants or VARIANTS).items()):
        began = time.perf_counter()
        report = build(extract, f"{folder}/{k}.pmtiles", schema, area)
        found.append((name, report, time.perf_counter() - began))
    most = found[-1][1].archive_bytes
    return [Cost(name, r.tiles, r.features, r.archive_bytes, r.archive_bytes / most if most else None, seconds) for name, r, seconds in found]
