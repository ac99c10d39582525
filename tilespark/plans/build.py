"""From an extract to an archive: the whole job as one DataFrame plan and a driver-side file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as J
from ..operators.tiles import Area, bin_features, encode_tiles
from ..schema import TileSchema
from ..sources import osm_pbf, pmtiles
from ..storage import stored


@dataclass(frozen=True)
class Extract:
    """nodes (id, lat, lon, tags, ordinal), ways (id, node_ids, tags, ordinal), relations (id, members, tags, ordinal)."""

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame


@dataclass(frozen=True)
class Report:
    kept_ways: int
    referenced_nodes: int
    resolved_nodes: int
    tiles: int
    features: int
    min_zoom: int
    max_zoom: int
    archive_bytes: int


@dataclass(frozen=True)
class Sources:
    """What an extract holds for a schema: features in node-id space, the distinct node ids that kept ways and members of kept relations refer to, and the nodes that are referred to or drawn."""

    features: DataFrame
    wanted: DataFrame
    nodes: DataFrame


def read_sources(extract: Extract, schema: TileSchema, say: Callable[[str], None] = lambda stage: None) -> Sources:
    """Each stage is a stored table, and is said when it begins; nodes are scanned once."""
    say("reading relations")
    kept = stored(J.kept_relations(extract.relations, schema), "relations")
    say("reading ways")
    ways = stored(J.classify_ways(extract.ways, schema), "ways")
    members = stored(J.member_ways(extract.ways, kept).select("id", "node_ids", "ordinal"), "members")
    say("assembling areas")
    none = F.array().cast("array<array<bigint>>")
    features = ways.select(F.lit(0).alias("source"), "ordinal", "id", F.array("node_ids").alias("outer"), none.alias("inner"), *J.CLASSES)
    areas = J.assemble_relations(kept, members)
    features = stored(features.unionByName(areas.select(F.lit(1).alias("source"), "ordinal", "id", "outer", "inner", *J.CLASSES)), "features")
    say("reading nodes")
    ids = ways.select(F.explode("node_ids").alias("node_id")).union(members.select(F.explode("node_ids").alias("node_id")))
    wanted = stored(J.referenced_nodes(ids), "wanted")
    return Sources(features, wanted, stored(J.needed_nodes(J.classify_nodes(extract.nodes, schema), wanted), "nodes"))


def node_counts(sources: Sources) -> tuple[int, int]:
    """Node ids that are referred to, and those of them that the extract has."""
    return sources.wanted.count(), sources.nodes.where("wanted").select("id").distinct().count()


def tile_features(sources: Sources, schema: TileSchema, area: Area, buffer: int | None = None) -> DataFrame:
    """The binned features."""
    shapes = J.resolve(sources.features, J.last_written(sources.nodes.where("wanted")))
    points = sources.nodes.where("_c is not null").select(F.lit(2).alias("source"), "ordinal", "id", "lon", "lat", "_c.*") if schema.reads_nodes else None
    return bin_features(shapes, points, area, schema, buffer)


def metadata(schema: TileSchema, area: Area) -> dict:
    return {
        "name": schema.name,
        "format": "pbf",
        "type": "overlay",
        "minzoom": schema.min_zoom,
        "maxzoom": schema.max_zoom,
        "bounds": f"{area.min_lon},{area.min_lat},{area.max_lon},{area.max_lat}",
        "vector_layers": [x.metadata() for x in schema.layers],
    }


def build(extract: Extract, output: str, schema: TileSchema, area: Area, buffer: int | None = None, on_progress: Callable[[str], None] | None = None) -> Report:
    """Write the archive of an extract; with the report of what went into it. Stages are said when they begin, `zoom N` when its tiles are written."""
    say = on_progress or (lambda stage: None)
    sources = read_sources(extract, schema, say)
    say("building tiles")
    tiles = stored(encode_tiles(tile_features(sources, schema, area, buffer), schema.extent), "tiles")
    zooms = iter(range(schema.min_zoom, schema.max_zoom + 1))
    ahead = next(zooms, None)

    def reach(zoom: int) -> None:
        nonlocal ahead
        while ahead is not None and ahead <= zoom:
            say(f"zoom {ahead}")
            ahead = next(zooms, None)

    bounds = (area.min_lon, area.min_lat, area.max_lon, area.max_lat)
    header = pmtiles.write_archive(tiles.select("tile_id", "tile"), output, metadata(schema, area), bounds, center_zoom=(schema.min_zoom + schema.max_zoom) // 2, on_zoom=reach)
    reach(schema.max_zoom)
    t = tiles.agg(F.count(F.lit(1)).alias("tiles"), F.coalesce(F.sum("features"), F.lit(0)).alias("features")).first()
    return Report(sources.features.count(), *node_counts(sources), t["tiles"], t["features"], schema.min_zoom, schema.max_zoom, header.data_offset + header.data_length)


def build_from_pbf(spark: SparkSession, path: str, output: str, schema: TileSchema, area: Area | None = None, **options) -> Report:
    """Without an area the file's own bounds are taken; a file without them needs one."""
    if area is None:
        bounds = osm_pbf.read_bounds(path)
        if bounds is None:
            raise ValueError("the extract's header has no bounds, so an area must be given")
        area = Area(*bounds)
    read = lambda entity, tags=True: osm_pbf.read(spark, path, entity, tags)
    return build(Extract(read("nodes", schema.reads_nodes), read("ways"), read("relations")), output, schema, area, **options)
