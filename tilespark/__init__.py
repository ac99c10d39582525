"""Vector-tile analytics on Spark: classification, tiling, encoding and archives as DataFrame operations."""

from .operators.tiles import Area
from .plans.build import Extract, Report, build, build_from_pbf
from .schema import DeliverySchema, KeepEverythingSchema, Layer, OpenMapTilesSchema, TileSchema
from .sources.osm_pbf import read as read_osm
from .sources.osm_pbf import read_bounds
from .sources.pmtiles import ArchiveWriter, Compression, FormatError, Header, TileType, read_archive, tile_bytes, write_archive

__all__ = [
    "ArchiveWriter", "Area", "Compression", "DeliverySchema", "Extract", "FormatError", "Header", "KeepEverythingSchema", "Layer", "OpenMapTilesSchema",
    "Report", "TileSchema", "TileType", "build", "build_from_pbf", "read_archive", "read_bounds", "read_osm", "tile_bytes", "write_archive",
]

__version__ = "0.1.0"
