"""Joins that turn an extract's rows into features with coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bound, from_e7, to_e7
from ..schema import CLASSIFIED, POLYGON, TileSchema
from .kernels import rings_of

CLASSES = ["layer", "type", "attributes", "min_zoom", "rank"]


def _classify(rows: DataFrame, found: Column | None) -> DataFrame:
    """rows with _c where the schema draws them; no rows if it draws nothing of the kind."""
    if found is None:
        return rows.where(F.lit(False)).withColumn("_c", F.lit(None).cast(CLASSIFIED))
    return bound(rows, "_c", found).where("_c is not null")


def classify_ways(ways: DataFrame, schema: TileSchema) -> DataFrame:
    """(id, ordinal, node_ids, class columns) of the ways that the schema draws. Areas lose their repeated last node."""
    rows = _classify(ways, schema.way(F.col("node_ids"), F.col("tags")))
    n = F.size("node_ids")
    ring = (F.col("_c.type") == POLYGON) & (n > 1) & (F.element_at("node_ids", 1) == F.element_at("node_ids", -1))
    node_ids = F.when(ring, F.slice("node_ids", F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.col("node_ids"))
    return rows.select("id", "ordinal", node_ids.alias("node_ids"), "_c.*")


def kept_relations(relations: DataFrame, schema: TileSchema) -> DataFrame:
    """(id, ordinal, members, class columns) of the relations that the schema draws and that have a way among their members."""
    rows = _classify(relations, schema.relation(F.col("tags")["type"] == "multipolygon", F.col("tags")))
    return rows.where(F.exists("members", lambda m: m["type"] == "way")).select("id", "ordinal", "members", "_c.*")


def classify_nodes(nodes: DataFrame, schema: TileSchema) -> DataFrame:
    """nodes (id, lat, lon, ordinal) with _c, null where the schema draws nothing."""
    found = schema.node(F.col("tags")) if schema.reads_nodes else None
    shown = F.lit(None).cast(CLASSIFIED) if found is None else F.when(F.size("tags") > 0, found)
    return nodes.select("id", "lat", "lon", "ordinal", shown.alias("_c"))


def way_members(relations: DataFrame) -> DataFrame:
    """(id, place, ref, role) of the members that are ways, in order; with ordinal where relations have it."""
    keys = ["id", *(c for c in ("ordinal",) if c in relations.columns)]
    ways = F.filter("members", lambda m: m["type"] == "way")
    return relations.select(*keys, F.posexplode(ways).alias("place", "m")).select(*keys, "place", "m.ref", "m.role")


def member_ways(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """The ways that some relation refers to: a left-semi join, so nothing is repeated."""
    return ways.join(way_members(relations).select(F.col("ref").alias("id")), "id", "left_semi")


def assemble_relations(kept: DataFrame, ways: DataFrame) -> DataFrame:
    """(id, ordinal, outer, inner, class columns) of the kept relations whose outer rings close. Any role but inner is outer; of a way that is written more than once the last counts."""
    last = ways.groupBy(F.col("id").alias("ref")).agg(F.max_by("node_ids", "ordinal").alias("node_ids"))
    members = way_members(kept).join(last, "ref").where(F.size("node_ids") >= 2)
    side = lambda inner: F.transform(F.filter(F.sort_array("found"), lambda m: m["inner"] == F.lit(inner)), lambda m: m["node_ids"])
    found = members.groupBy("id", "ordinal").agg(F.collect_list(F.struct("place", F.coalesce(F.col("role") == "inner", F.lit(False)).alias("inner"), "node_ids")).alias("found"))
    rings = found.select("id", "ordinal", rings_of(side(False)).alias("outer"), rings_of(side(True)).alias("inner")).where(F.size("outer") > 0)
    return rings.join(kept.select("id", "ordinal", *CLASSES), ["id", "ordinal"])


def last_written(nodes: DataFrame) -> DataFrame:
    """One row per node id; of repeated ids the last in scan order (ordinal) stays."""
    best = F.max_by(F.struct("lat", "lon"), F.col("ordinal")).alias("v")
    return nodes.groupBy("id").agg(best).select("id", "v.lat", "v.lon")


def referenced_nodes(parts: DataFrame) -> DataFrame:
    return parts.select("node_id").distinct()


def needed_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """nodes (id, _c, ...) with `wanted`: whether it is one of the distinct node_ids; without those that are neither wanted nor drawn."""
    marked = nodes.join(wanted.select(F.col("node_id").alias("id"), F.lit(True).alias("wanted")), "id", "left")
    return marked.withColumn("wanted", F.coalesce("wanted", F.lit(False))).where(F.col("wanted") | F.col("_c").isNotNull())


def resolve(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replace outer and inner (arrays of arrays of node ids) by arrays of arrays of (lon, lat).

    One equi-join on the node id; the places of parts and vertices travel along
    and put them in order again. What is found is dealt out by feature once, and
    grouped by part and by feature where it is. Nodes that are missing leave no
    vertex. Coordinates pass through steps of 1e-7 degrees, as stored nodes do.
    """
    key = ["source", "ordinal"]
    side = lambda name, inner: F.transform(name, lambda p, i: F.struct(F.lit(inner).alias("inner"), i.alias("part"), p.alias("ids")))
    parts = features.select(*key, F.explode(F.concat(side("outer", False), side("inner", True))).alias("p")).select(*key, "p.*")
    vertices = parts.select(*key, "inner", "part", F.posexplode("ids").alias("place", "node_id"))
    coordinates = nodes.select(F.col("id").alias("node_id"), from_e7(to_e7(F.col("lon"))).alias("lon"), from_e7(to_e7(F.col("lat"))).alias("lat"))
    found = vertices.join(coordinates, "node_id").repartition(*key)
    line = F.transform(F.sort_array(F.collect_list(F.struct("place", "lon", "lat"))), lambda v: F.struct(v["lon"], v["lat"]))
    lines = found.groupBy(*key, "inner", "part").agg(line.alias("line"))
    shapes = lines.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("inner", "part", "line"))).alias("lines"))
    pick = lambda inner: F.transform(F.filter("lines", lambda x: x["inner"] == F.lit(inner)), lambda x: x["line"])
    shapes = shapes.select(*key, pick(False).alias("outer"), pick(True).alias("inner"))
    rest = [c for c in features.columns if c not in ("outer", "inner")]
    return features.drop("outer", "inner").join(shapes, key).select(*rest, "outer", "inner")
