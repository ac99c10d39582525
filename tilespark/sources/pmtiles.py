"""PMTiles version 3: header, directories, and whole archives on the driver.

Directories have one row per run of equal tiles, so they are small beside the
tiles. Contents are streamed to the file partition by partition and never
collected at once.
"""

from __future__ import annotations

import gzip as _gzip
import json
import struct
from collections.abc import Callable
from dataclasses import astuple, dataclass, fields
from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hilbert import MAX_ZOOM
from ..operators import archive
from ..operators.kernels import gzip, gzipped, varint
from ..storage import stored
from .files import open_for

# ---- fixed values of the format ----
MAGIC = b"PMTiles\x03"
HEADER_BYTES = 127
#: Bytes that the root directory may take beside the header.
ROOT_BYTES = 16384 - HEADER_BYTES
LEAF_SIZE, LEAF_GROWTH = 4096, 1.2


class Compression(IntEnum):
    UNKNOWN = 0
    NONE = 1
    GZIP = 2
    BROTLI = 3
    ZSTD = 4


class TileType(IntEnum):
    UNKNOWN = 0
    MVT = 1
    PNG = 2
    JPEG = 3
    WEBP = 4
    AVIF = 5


# ---- end of fixed values ----


class FormatError(ValueError):
    """The bytes are not what the format asks for."""


@dataclass(frozen=True)
class Header:
    """Fields in the order of the file; degrees are kept in steps of 1e-7."""

    root_offset: int = HEADER_BYTES
    root_length: int = 0
    metadata_offset: int = 0
    metadata_length: int = 0
    leaf_offset: int = 0
    leaf_length: int = 0
    data_offset: int = 0
    data_length: int = 0
    addressed: int = 0
    entries: int = 0
    contents: int = 0
    clustered: bool = True
    internal_compression: int = Compression.GZIP
    tile_compression: int = Compression.GZIP
    tile_type: int = TileType.MVT
    min_zoom: int = 0
    max_zoom: int = 0
    min_lon: float = -180.0
    min_lat: float = -85.0
    max_lon: float = 180.0
    max_lat: float = 85.0
    center_zoom: int = 0
    center_lon: float = 0.0
    center_lat: float = 0.0

    _LAYOUT = struct.Struct("<8s11Q6B4iB2i")

    def to_bytes(self) -> bytes:
        return self._LAYOUT.pack(MAGIC, *(_steps(v) if isinstance(v, float) else int(v) for v in astuple(self)))

    @classmethod
    def from_bytes(cls, data: bytes) -> Header:
        if len(data) < HEADER_BYTES:
            raise FormatError("an archive's header has 127 bytes")
        magic, *values = cls._LAYOUT.unpack(data[:HEADER_BYTES])
        if magic[:7] != MAGIC[:7]:
            raise FormatError("not a PMTiles archive")
        if magic[7] != 3:
            raise FormatError(f"version {magic[7]} of the format is not read here")
        named = dict(zip((f.name for f in fields(cls)), values))
        for name, kind in (("internal_compression", Compression), ("tile_compression", Compression), ("tile_type", TileType)):
            named[name] = kind(named[name]) if named[name] in {*kind} else kind.UNKNOWN
        named |= {k: v / 1e7 for k, v in named.items() if k.endswith(("_lon", "_lat"))}
        return cls(**named | {"clustered": bool(named["clustered"])})


def _steps(degrees: float) -> int:
    x = abs(degrees * 1e7)
    whole = int(x)
    return (whole + (x - whole >= 0.5)) * (1 if degrees >= 0 else -1)


Entry = tuple[int, int, int, int]  # tile_id, offset, length, run_length; a run of 0 points to a leaf


def write_directory(entries: list[Entry]) -> bytes:
    """Columns one after another: id deltas, runs, lengths, offsets."""
    ids = [e[0] for e in entries]
    ends = [None, *(e[1] + e[2] for e in entries)]
    columns = [
        [b - a for a, b in zip([0, *ids], ids)],
        [e[3] for e in entries],
        [e[2] for e in entries],
        [0 if e[1] == end else e[1] + 1 for e, end in zip(entries, ends)],
    ]
    return b"".join(map(varint, [len(entries), *(v for c in columns for v in c)]))


def read_directory(data: bytes) -> list[Entry]:
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            if at >= len(data):
                raise FormatError("the directory ends within a number")
            if shift > 63:
                raise FormatError("a number has more than 64 bits")
            byte = data[at]
            at += 1
            out |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return out

    n = number()
    if n >= 1 << 63:
        raise FormatError("a directory has no negative number of entries")
    if n > len(data):
        raise FormatError("the directory is shorter than its number of entries")
    deltas, runs, lengths, stored = ([number() for _ in range(n)] for _ in range(4))
    out: list[Entry] = []
    tile = 0
    for delta, run, length, offset in zip(deltas, runs, lengths, stored):
        tile += delta
        if offset == 0 and not out:
            raise FormatError("the first entry has nothing to follow")
        out.append((tile, out[-1][1] + out[-1][2] if offset == 0 else offset - 1, length, run))
    return out


def compress(data: bytes, how: Compression) -> bytes:
    if how == Compression.NONE:
        return data
    if how == Compression.GZIP:
        return gzipped(data)
    raise ValueError(f"{how.name.lower()} is not written here")


def decompress(data: bytes, how: Compression) -> bytes:
    if how == Compression.NONE:
        return data
    if how == Compression.GZIP:
        return _gzip.decompress(data)
    raise ValueError(f"{how.name.lower()} is not read here")


def build_directories(entries: list[Entry], how: Compression = Compression.GZIP) -> tuple[bytes, bytes]:
    """Root and leaves: one directory if it fits, else leaves that grow until their root fits."""
    root = compress(write_directory(entries), how)
    size = LEAF_SIZE
    leaves = b""
    while len(root) > ROOT_BYTES:
        parts, pointers, at = [], [], 0
        for i in range(0, len(entries), size):
            leaf = compress(write_directory(entries[i : i + size]), how)
            pointers.append((entries[i][0], at, len(leaf), 0))
            parts.append(leaf)
            at += len(leaf)
        root, leaves = compress(write_directory(pointers), how), b"".join(parts)
        size = -int(-size * LEAF_GROWTH // 1)
    return root, leaves


def zoom_of(tile_id: int) -> int:
    if tile_id < 0:
        raise ValueError("tile ids are not negative")
    for z in range(MAX_ZOOM + 1):
        if tile_id < (4 ** (z + 1) - 1) // 3:
            return z
    raise ValueError("the tile id is beyond the last zoom")


def _head(entries: list[Entry], counts: dict[str, int], metadata: dict, bounds: tuple[float, float, float, float], center_zoom: int | None, internal: Compression, compression: Compression, tile_type: TileType) -> tuple[Header, bytes]:
    """An archive's header, and all that stands before its tiles. The centre's zoom is moved into the range that was written."""
    root, leaves = build_directories(entries, internal)
    described = compress(json.dumps(metadata, ensure_ascii=False, separators=(",", ":")).encode(), internal)
    low, high = [zoom_of(e) for e in (entries[0][0], entries[-1][0] + entries[-1][3] - 1)] if entries else [0, 0]
    center = min(max(low if center_zoom is None else center_zoom, low), high)
    metadata_at = HEADER_BYTES + len(root)
    leaves_at = metadata_at + len(described)
    data_at = leaves_at + len(leaves)
    west, south, east, north = (float(v) for v in bounds)
    header = Header(HEADER_BYTES, len(root), metadata_at, len(described), leaves_at, len(leaves), data_at, counts["tile_bytes"], counts["addressed"], counts["entries"], counts["contents"], True, internal, compression, tile_type, low, high, west, south, east, north, center, (west + east) / 2, (south + north) / 2)
    return header, header.to_bytes() + root + described + leaves


def hilbert_id(z: int, x: int, y: int) -> int:
    """The tile's id: the tiles of all lower zooms, then its place on the zoom's Hilbert curve."""
    if not 0 <= z <= MAX_ZOOM or not (0 <= x < 1 << z and 0 <= y < 1 << z):
        raise ValueError(f"no such tile: {z}/{x}/{y}")
    out = (4**z - 1) // 3
    for bit in reversed(range(z)):
        side = 1 << bit
        right, lower = bool(x & side), bool(y & side)
        out += ((3 if right else 0) ^ (1 if lower else 0)) * side * side
        if not lower:
            if right:
                x, y = ~x, ~y
            x, y = y, x
    return out


class ArchiveWriter:
    """Tiles one at a time, in rising order of id, into an archive's bytes: for what fits the driver. `write_archive` is for tables of tiles."""

    def __init__(self, metadata: dict, bounds: tuple[float, float, float, float] = (-180.0, -85.0, 180.0, 85.0), center_zoom: int | None = None, internal: Compression = Compression.GZIP, compression: Compression = Compression.GZIP, tile_type: TileType = TileType.MVT):
        self._options = (metadata, bounds, center_zoom, internal, compression, tile_type)
        self._compression = compression
        self._last = -1
        self._places: dict[bytes, int] = {}
        self._entries: list[Entry] = []
        self.addressed = self.data_length = 0

    @property
    def entries(self) -> int:
        return len(self._entries)

    @property
    def contents(self) -> int:
        return len(self._places)

    def add(self, tile_id: int, tile: bytes) -> None:
        """Compress a tile and add it; an empty one is left out."""
        if tile:
            self.add_encoded(tile_id, compress(tile, self._compression))

    def add_zxy(self, z: int, x: int, y: int, tile: bytes) -> None:
        self.add(hilbert_id(z, x, y), tile)

    def add_encoded(self, tile_id: int, blob: bytes) -> None:
        """Add a tile that is compressed already."""
        if not blob:
            return
        if tile_id <= self._last:
            raise FormatError(f"tile ids must rise: {tile_id} came after {self._last}")
        zoom_of(tile_id)
        if blob not in self._places:
            self._places[blob] = self.data_length
            self.data_length += len(blob)
        at = self._places[blob]
        first, offset, length, run = self._entries[-1] if self._entries else (-1, -1, 0, 0)
        if offset == at and first + run == tile_id:
            self._entries[-1] = (first, offset, length, run + 1)
        else:
            self._entries.append((tile_id, at, len(blob), 1))
        self._last = tile_id
        self.addressed += 1

    def build(self) -> bytes:
        counts = {"tile_bytes": self.data_length, "addressed": self.addressed, "entries": self.entries, "contents": self.contents}
        return _head(self._entries, counts, *self._options)[1] + b"".join(self._places)


def write_archive(tiles: DataFrame, path: str, metadata: dict, bounds: tuple[float, float, float, float] = (-180.0, -85.0, 180.0, 85.0), internal: Compression = Compression.GZIP, compression: Compression = Compression.GZIP, compressed: bool = False, tile_type: TileType = TileType.MVT, center_zoom: int | None = None, on_zoom: Callable[[int], None] | None = None) -> Header:
    """Write (tile_id, tile) as one file; `compressed` tiles are taken as they are. Empty tiles are left out, repeated ids are an error. `on_zoom` hears the zoom of each content before it is written."""
    blob = F.col("tile") if compressed or compression == Compression.NONE else gzip(F.col("tile"))
    if not compressed and compression not in (Compression.NONE, Compression.GZIP):
        raise ValueError(f"{compression.name.lower()} is not written here")
    kept = stored(tiles.where(F.length("tile") > 0).select("tile_id", blob.alias("blob")), "blobs")
    twice = kept.groupBy("tile_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"tile {twice[0]['tile_id']} is given more than once")
    found = archive.entries(kept)
    entries = sorted(tuple(r) for r in found.select("tile_id", "offset", "length", "run_length").collect())  # the directory itself
    n = archive.archive_counts(found).first()
    header, head = _head(entries, n.asDict(), metadata, bounds, center_zoom, internal, compression, tile_type)
    first = archive.distinct_blobs(kept).select(F.col("first_id").alias("tile_id"))
    with open_for(path, writing=True) as f:
        f.write(head)
        for row in kept.join(first, "tile_id", "left_semi").orderBy("tile_id").select("tile_id", "blob").toLocalIterator(prefetchPartitions=True):
            if on_zoom:
                on_zoom(zoom_of(row["tile_id"]))
            f.write(row["blob"])
    return header


def read_archive(data: bytes) -> tuple[Header, dict, list[Entry]]:
    """Header, metadata and all entries of an archive's bytes, leaves followed."""
    header = Header.from_bytes(data)
    how = Compression(header.internal_compression)
    cut = lambda at, n: data[at : at + n]
    entries: list[Entry] = []
    for e in read_directory(decompress(cut(header.root_offset, header.root_length), how)):
        entries += [e] if e[3] else read_directory(decompress(cut(header.leaf_offset + e[1], e[2]), how))
    return header, json.loads(decompress(cut(header.metadata_offset, header.metadata_length), how)), entries


def tile_bytes(data: bytes, tile_id: int) -> bytes | None:
    """One tile of an archive's bytes, decompressed."""
    header, _, entries = read_archive(data)
    for first, offset, length, run in entries:
        if first <= tile_id < first + run:
            return decompress(data[header.data_offset + offset : header.data_offset + offset + length], Compression(header.tile_compression))
    return None
