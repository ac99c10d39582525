"""The map side's operators as queries over the star-schema tables, each with DuckDB SQL that says the same in other words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import geometry as G
from .functions import hilbert as H
from .functions import scalar as S
from .operators import archive as A
from .operators import features as J
from .operators import kernels as K
from .operators import tiles as T
from .schema import DeliverySchema, KeepEverythingSchema, OpenMapTilesSchema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
ZOOMS = (10, 13, 15)
AREA = T.Area(*X.AREA)
EXTENT, BUFFER = 4096, 64


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- SQL text that several statements share ----
def q_x(lon: str) -> str:
    return f"(({lon} + 180.0::DOUBLE) / 360.0::DOUBLE)"


def q_y(lat: str) -> str:
    angle = f"(least(greatest({lat}, -85.05112877980659::DOUBLE), 85.05112877980659::DOUBLE) * pi() / 180.0::DOUBLE)"
    return f"((1.0::DOUBLE - ln(tan({angle}) + 1.0::DOUBLE / cos({angle})) / pi()) / 2.0::DOUBLE)"


def q_n(z: str) -> str:
    return f"(1::BIGINT << CAST({z} AS INTEGER))"


def q_world(unit: str, z: str) -> str:
    return f"CAST(round({unit} * {q_n(z)} * {EXTENT}) AS BIGINT)"


def q_tile(unit: str, z: str) -> str:
    return f"least(greatest(CAST(floor({unit} * {q_n(z)}) AS BIGINT), 0), {q_n(z)} - 1)"


def q_tile_of_world(v: str, z: str) -> str:
    return f"least(greatest(CAST(floor({v} / {EXTENT}.0) AS BIGINT), 0), {q_n(z)} - 1)"


def q_hilbert(source: str) -> str:
    """CTEs hs, hilbert(z, x, y, tile_id) for the distinct z, x, y of a table."""
    return f"""hs(z, x, y, i, cx, cy, d) AS (
  SELECT z, x, y, z - 1, x, y, 0::BIGINT FROM (SELECT DISTINCT CAST(z AS INTEGER) AS z, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM {source})
  UNION ALL
  SELECT z, x, y, i - 1, CASE WHEN ry = 0 THEN fy ELSE lx END, CASE WHEN ry = 0 THEN fx ELSE ly END, d + (xor(3 * rx, ry) << (2 * i)) FROM (
    SELECT *, CASE WHEN rx = 1 THEN low - lx ELSE lx END AS fx, CASE WHEN rx = 1 THEN low - ly ELSE ly END AS fy FROM (
      SELECT *, cx & low AS lx, cy & low AS ly FROM (SELECT *, (cx >> i) & 1 AS rx, (cy >> i) & 1 AS ry, (1::BIGINT << i) - 1 AS low FROM hs WHERE i >= 0)))
), hilbert AS (SELECT z, x, y, CAST(((1::HUGEINT << (2 * z)) - 1) // 3 AS BIGINT) + d AS tile_id FROM hs WHERE i < 0)"""


Q_ZOOMS = f"(VALUES {', '.join(f'({z})' for z in ZOOMS)}) AS zs(z)"


def zooms(df: DataFrame) -> DataFrame:
    return df.withColumn("z", F.explode(F.array(*map(F.lit, ZOOMS))))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return X.frame(spark, sf, "fx_nodes")


def unit(df: DataFrame) -> DataFrame:
    return df.withColumn("ux", S.x_of(F.col("lon"))).withColumn("uy", S.y_of(F.col("lat")))


# ---- flagship ----
@query(f"""{X.text('fx_nodes').replace('WITH ', 'WITH RECURSIVE ', 1)}, placed AS (
  SELECT z, way_id, {q_tile(q_x('n.lon'), 'z')} AS x, {q_tile(q_y('n.lat'), 'z')} AS y,
         {q_world(q_x('n.lon'), 'z')} AS wx, {q_world(q_y('n.lat'), 'z')} AS wy
  FROM fx_nodes n JOIN fx_vertices v USING (id), {Q_ZOOMS}
), {q_hilbert('placed')}
SELECT p.z, tile_id, count(DISTINCT way_id) AS ways, count(*) AS vertices, CAST(sum(wx) AS BIGINT) AS sum_x, CAST(sum(wy) AS BIGINT) AS sum_y
FROM placed p JOIN hilbert h ON p.z = h.z AND p.x = h.x AND p.y = h.y GROUP BY ALL""")
def flagship_tile_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Trajectories on the map: per zoom and tile the ways and vertices in it. One partial aggregate, one shuffle; the address is computed per tile."""
    rows = unit(X.frame(spark, sf, "fx_vertices").select("way_id", S.from_e7(F.col("lon_e7")).alias("lon"), S.from_e7(F.col("lat_e7")).alias("lat")))
    z = F.col("z")
    rows = zooms(rows).select("z", "way_id", S.tile_at(F.col("ux"), z).alias("x"), S.tile_at(F.col("uy"), z).alias("y"), S.world(F.col("ux"), z).alias("wx"), S.world(F.col("uy"), z).alias("wy"))
    per_way = rows.groupBy("z", "x", "y", "way_id").agg(F.count(F.lit(1)).alias("vertices"), F.sum("wx").alias("sum_x"), F.sum("wy").alias("sum_y"))
    per = per_way.groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("ways"), F.sum("vertices").alias("vertices"), F.sum("sum_x").alias("sum_x"), F.sum("sum_y").alias("sum_y"))
    return per.select("z", H.tile_id(z, F.col("x"), F.col("y")).alias("tile_id"), "ways", "vertices", "sum_x", "sum_y")


# ---- projection ----
@query(f"{X.text('fx_nodes')} SELECT id, {q_x('lon')} AS ux, {q_y('lat')} AS uy FROM fx_nodes")
def mercator_xy(spark: SparkSession, sf: str) -> DataFrame:
    return unit(nodes(spark, sf)).select("id", "ux", "uy")


@query(f"""{X.text('fx_nodes')}
SELECT id, round(({q_x('lon')}) * 360.0 - 180.0, 9) AS lon, round(atan((exp(pi() * (1 - 2 * {q_y('lat')})) - exp(-pi() * (1 - 2 * {q_y('lat')}))) / 2) * 180.0 / pi(), 9) AS lat FROM fx_nodes""")
def mercator_inverse(spark: SparkSession, sf: str) -> DataFrame:
    u = unit(nodes(spark, sf))
    return u.select("id", F.round(S.lon_of(F.col("ux")), 9).alias("lon"), F.round(S.lat_of(F.col("uy")), 9).alias("lat"))


@query("SELECT CAST(c_custkey AS BIGINT) AS id, least(greatest(c_acctbal / 50.0, -85.05112877980659::DOUBLE), 85.05112877980659::DOUBLE) AS lat FROM customer")
def clamp_latitude(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), S.clamp_latitude(F.col("c_acctbal") / 50.0).alias("lat"))


@query(f"{X.text('fx_nodes')} SELECT id, z, {q_tile(q_x('lon'), 'z')} AS x, {q_tile(q_y('lat'), 'z')} AS y, round({q_x('lon')} * {q_n('z')}, 6) AS fx FROM fx_nodes, {Q_ZOOMS}")
def tile_at(spark: SparkSession, sf: str) -> DataFrame:
    z = F.col("z")
    u = zooms(unit(nodes(spark, sf)))
    return u.select("id", "z", S.tile_at(F.col("ux"), z).alias("x"), S.tile_at(F.col("uy"), z).alias("y"), F.round(F.col("ux") * S.tiles_across(z), 6).alias("fx"))


@query(f"""{X.text('fx_nodes')}, t AS (SELECT DISTINCT z, {q_tile(q_x('lon'), 'z')} AS x, {q_tile(q_y('lat'), 'z')} AS y FROM fx_nodes, {Q_ZOOMS}),
e AS (SELECT *, pi() * (1 - 2 * (y::DOUBLE / {q_n('z')})) AS n, pi() * (1 - 2 * ((y + 1)::DOUBLE / {q_n('z')})) AS s FROM t)
SELECT z, x, y, round(x::DOUBLE / {q_n('z')} * 360 - 180, 9) AS west, round((x + 1)::DOUBLE / {q_n('z')} * 360 - 180, 9) AS east,
       round(atan((exp(s) - exp(-s)) / 2) * 180 / pi(), 9) AS south, round(atan((exp(n) - exp(-n)) / 2) * 180 / pi(), 9) AS north FROM e""")
def tile_bounds(spark: SparkSession, sf: str) -> DataFrame:
    z = F.col("z")
    u = zooms(unit(nodes(spark, sf))).select("z", S.tile_at(F.col("ux"), z).alias("x"), S.tile_at(F.col("uy"), z).alias("y")).distinct()
    edges = u.withColumn("b", S.tile_edges(z, F.col("x"), F.col("y")))
    return edges.select("z", "x", "y", *(F.round(f"b.{e}", 9).alias(e) for e in ("west", "east", "south", "north")))


_A = X.AREA


@query(f"""WITH RECURSIVE zr AS (SELECT z, {q_tile(q_x(f'({_A[0]})::DOUBLE'), 'z')} AS x0, {q_tile(q_x(f'({_A[2]})::DOUBLE'), 'z')} AS x1,
  {q_tile(q_y(f'({_A[3]})::DOUBLE'), 'z')} AS y0, {q_tile(q_y(f'({_A[1]})::DOUBLE'), 'z')} AS y1 FROM {Q_ZOOMS}),
t AS (SELECT z, x, unnest(generate_series(y0, y1)) AS y FROM (SELECT *, unnest(generate_series(x0, x1)) AS x FROM zr)), {q_hilbert('t')}
SELECT z, x, y, tile_id FROM hilbert""")
def coverage_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return AREA.tiles(zooms(spark.range(1)).select("z")).orderBy("tile_id")


@query(f"""{X.text('fx_nodes')}, w AS (SELECT id, z, {q_world(q_x('lon'), 'z')} AS wx, {q_world(q_y('lat'), 'z')} AS wy, {q_tile(q_x('lon'), 'z')} AS tx,
  CAST(round(({q_x('lon')} * {q_n('z')} - {q_tile(q_x('lon'), 'z')}) * {EXTENT}) AS BIGINT) AS px FROM fx_nodes, {Q_ZOOMS})
SELECT id, z, wx, wy, wx - tx * {EXTENT} AS local_x, px FROM w""")
def world_local(spark: SparkSession, sf: str) -> DataFrame:
    z = F.col("z")
    tx = S.tile_at(F.col("ux"), z)
    u = zooms(unit(nodes(spark, sf))).withColumn("tx", tx)
    return u.select("id", "z", S.world(F.col("ux"), z).alias("wx"), S.world(F.col("uy"), z).alias("wy"), (S.world(F.col("ux"), z) - F.col("tx") * EXTENT).alias("local_x"), S.project(F.col("ux"), z, F.col("tx")).alias("px"))


@query(f"""{X.text('fx_vertices', 'fx_nodes')}, w AS (SELECT way_id, z, {q_world(q_x('n.lon'), 'z')} AS wx, {q_world(q_y('n.lat'), 'z')} AS wy FROM fx_vertices v JOIN fx_nodes n USING (id), {Q_ZOOMS}),
b AS (SELECT way_id, z, min(wx) AS min_x, min(wy) AS min_y, max(wx) AS max_x, max(wy) AS max_y FROM w GROUP BY ALL)
SELECT *, {q_tile_of_world(f'(min_x - {BUFFER})', 'z')} AS tx0, {q_tile_of_world(f'(min_y - {BUFFER})', 'z')} AS ty0, {q_tile_of_world(f'(max_x + {BUFFER})', 'z')} AS tx1, {q_tile_of_world(f'(max_y + {BUFFER})', 'z')} AS ty1 FROM b""")
def tile_range(spark: SparkSession, sf: str) -> DataFrame:
    z = F.col("z")
    u = zooms(unit(X.frame(spark, sf, "fx_vertices").select("way_id", S.from_e7(F.col("lon_e7")).alias("lon"), S.from_e7(F.col("lat_e7")).alias("lat"))))
    w = u.select("way_id", "z", S.world(F.col("ux"), z).alias("wx"), S.world(F.col("uy"), z).alias("wy"))
    b = w.groupBy("way_id", "z").agg(F.min("wx").alias("min_x"), F.min("wy").alias("min_y"), F.max("wx").alias("max_x"), F.max("wy").alias("max_y"))
    tile = lambda c, k: S.tile_of_world(F.col(c) + k, z)
    return b.select("*", tile("min_x", -BUFFER).alias("tx0"), tile("min_y", -BUFFER).alias("ty0"), tile("max_x", BUFFER).alias("tx1"), tile("max_y", BUFFER).alias("ty1"))


@query(f"""{X.text('fx_nodes')} SELECT id, lon, CAST(round(lon / 1e-7) AS BIGINT) AS stored, CAST(round(lon / 1e-7) AS BIGINT) * 1e-7 AS read, CAST(round(lon * 1e7) AS BIGINT) AS in_header, CAST(round(lon * 1e7) AS BIGINT) / 1e7 AS from_header FROM fx_nodes""")
def e7_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    stored, head = S.to_e7(F.col("lon")), S.header_e7(F.col("lon"))
    return n.select("id", "lon", stored.alias("stored"), S.from_e7(stored).alias("read"), head.alias("in_header"), S.header_degrees(head).alias("from_header"))


@query("SELECT l_orderkey, count(*) AS n, CAST(sum(round((l_extendedprice - 50000) / 64)) AS BIGINT) AS s FROM lineitem GROUP BY 1")
def round_half_away(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(S.round_away((F.col("l_extendedprice") - 50000) / 64)).alias("s"))


# ---- tile addresses ----
_Q_GRID = "SELECT CAST(c_custkey % 32 AS INTEGER) AS z, (c_custkey * 2654435761) % (1::BIGINT << CAST(c_custkey % 32 AS INTEGER)) AS x, (c_custkey * 40503) % (1::BIGINT << CAST(c_custkey % 32 AS INTEGER)) AS y FROM customer"


def grid(spark: SparkSession, sf: str) -> DataFrame:
    z = (F.col("c_custkey") % 32).cast("int")
    n = S.tiles_across(z)
    return spark.read.parquet(f"{sf}/customer.parquet").select(z.alias("z"), ((F.col("c_custkey") * 2654435761) % n).alias("x"), ((F.col("c_custkey") * 40503) % n).alias("y"))


@query(f"WITH RECURSIVE g AS ({_Q_GRID}), {q_hilbert('g')} SELECT g.z, g.x, g.y, tile_id FROM g JOIN hilbert h ON g.z = h.z AND g.x = h.x AND g.y = h.y")
def hilbert_encode(spark: SparkSession, sf: str) -> DataFrame:
    return grid(spark, sf).withColumn("tile_id", H.tile_id(F.col("z"), F.col("x"), F.col("y")))


@query(f"WITH RECURSIVE g AS ({_Q_GRID}), {q_hilbert('g')} SELECT tile_id, z, x, y FROM hilbert")
def hilbert_decode(spark: SparkSession, sf: str) -> DataFrame:
    ids = grid(spark, sf).select(H.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("tile_id")).distinct()
    return ids.withColumn("p", H.zxy_of(F.col("tile_id"))).select("tile_id", "p.z", "p.x", "p.y")


@query("SELECT CAST(z AS INTEGER) AS z, CAST(((1::HUGEINT << (2 * CAST(z AS INTEGER))) - 1) // 3 AS BIGINT) AS first_id FROM range(32) AS r(z)")
def zoom_offset(spark: SparkSession, sf: str) -> DataFrame:
    z = F.col("id").cast("int")
    return spark.range(32).select(z.alias("z"), H.zoom_offset(z).alias("first_id"))


# ---- classification ----
def class_columns(c: Column) -> list[Column]:
    text = F.array_join(F.transform(c["attributes"], lambda a: F.concat(a["key"], F.lit("="), F.coalesce(a["s"], a["i"].cast("string")))), ";")
    return [c["layer"].alias("layer"), c["type"].cast("long").alias("type"), text.alias("attributes"), c["min_zoom"].cast("long").alias("min_zoom"), c["rank"].cast("long").alias("rank")]


def classified(df: DataFrame, c: Column) -> DataFrame:
    rows = S.bound(df, "c", c).where("c is not null")
    return rows.select("id", *class_columns(F.col("c")))


def q_values(table: dict, *parts: int) -> str:
    rows = ", ".join("(" + ", ".join([f"'{k}'", *(repr(v[p]) if isinstance(v, tuple) else repr(v) for p in parts)]) + ")" for k, v in table.items())
    return f"(VALUES {rows})"


from .schema import DELIVERY_RANKS, DELIVERY_ROADS, OMT_PLACES, OMT_ROADS  # noqa: E402


@query(f"""{X.text('fx_ways')} SELECT w.id, 'road' AS layer, 2::BIGINT AS type, 'class=' || r.class || CASE WHEN w.name <> '' THEN ';name=' || w.name ELSE '' END AS attributes,
CAST(greatest(r.zoom, 6) AS BIGINT) AS min_zoom, CAST(k.rank AS BIGINT) AS rank
FROM fx_ways w JOIN {q_values(DELIVERY_ROADS, 0, 1)} r(highway, class, zoom) ON w.highway = r.highway JOIN {q_values(DELIVERY_RANKS, 0)} k(class, rank) ON k.class = r.class WHERE w.n >= 2""")
def classify_delivery_roads(spark: SparkSession, sf: str) -> DataFrame:
    return classified(X.way_table(spark, sf), DeliverySchema().way(F.col("node_ids"), F.col("tags"))).where("layer = 'road'")


@query(f"{X.text('fx_rings')} SELECT id, 'water' AS layer, 3::BIGINT AS type, 'class=water' AS attributes, 6::BIGINT AS min_zoom, 0::BIGINT AS rank FROM fx_rings WHERE nature IN ('water', 'bay', 'strait')")
def classify_delivery_water(spark: SparkSession, sf: str) -> DataFrame:
    return classified(X.ring_table(spark, sf), DeliverySchema().way(F.col("node_ids"), F.col("tags")))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    t = X.tags(place="place", name="name", highway="highway", crossing="crossing", crossing__signals="crossing_signals", railway="railway")
    return X.frame(spark, sf, "fx_tagged").select("id", "lon", "lat", t.alias("tags"))


@query(f"""{X.text('fx_tagged')}, c AS (SELECT id, CASE WHEN railway IN ('level_crossing', 'crossing') THEN 'level_crossing'
  WHEN highway = 'crossing' AND (crossing = 'traffic_signals' OR crossing_signals = 'yes') THEN 'traffic_signals'
  WHEN highway IN ('traffic_signals', 'stop', 'give_way') THEN highway END AS class FROM fx_tagged)
SELECT id, 'signal' AS layer, 1::BIGINT AS type, 'class=' || class AS attributes, 14::BIGINT AS min_zoom, 0::BIGINT AS rank FROM c WHERE class IS NOT NULL""")
def classify_delivery_signals(spark: SparkSession, sf: str) -> DataFrame:
    return classified(tagged(spark, sf), DeliverySchema().node(F.col("tags")))


@query(f"{X.text('fx_relations')} SELECT id, 'water' AS layer, 3::BIGINT AS type, 'class=water' AS attributes, 6::BIGINT AS min_zoom, 0::BIGINT AS rank FROM fx_relations WHERE type = 'multipolygon' AND nature IN ('water', 'bay', 'strait')")
def classify_delivery_relations(spark: SparkSession, sf: str) -> DataFrame:
    return classified(X.relation_table(spark, sf), DeliverySchema().relation(F.col("tags")["type"] == "multipolygon", F.col("tags")))


_Q_BRUNNEL = "CASE WHEN bridge <> 'no' THEN 'bridge' WHEN tunnel <> 'no' THEN 'tunnel' WHEN ford <> 'no' THEN 'ford' END"


@query(f"""{X.text('fx_ways')}, b AS (SELECT *, CASE WHEN ends_with(highway, '_link') THEN left(highway, length(highway) - 5) ELSE highway END AS base, {_Q_BRUNNEL} AS brunnel FROM fx_ways WHERE n >= 2)
SELECT b.id, 'transportation' AS layer, 2::BIGINT AS type, 'class=' || r.class || CASE WHEN base <> r.class THEN ';subclass=' || base ELSE '' END || coalesce(';brunnel=' || brunnel, '') || CASE WHEN oneway = 'yes' THEN ';oneway=1' ELSE '' END AS attributes,
CAST(greatest(r.zoom, 4) AS BIGINT) AS min_zoom, 0::BIGINT AS rank FROM b JOIN {q_values(OMT_ROADS, 0, 1)} r(highway, class, zoom) ON b.base = r.highway""")
def classify_omt_roads(spark: SparkSession, sf: str) -> DataFrame:
    return classified(X.way_table(spark, sf), OpenMapTilesSchema().way(F.col("node_ids"), F.col("tags"))).where("layer = 'transportation'")


@query(f"{X.text('fx_ways')} SELECT id, {_Q_BRUNNEL} AS brunnel FROM fx_ways")
def classify_omt_brunnel(spark: SparkSession, sf: str) -> DataFrame:
    return X.way_table(spark, sf).select("id", OpenMapTilesSchema.brunnel(F.col("tags")).alias("brunnel"))


@query(f"""{X.text('fx_rings')} SELECT id, CASE WHEN is_water THEN 'water' ELSE 'building' END AS layer, CAST(CASE WHEN is_water THEN 0 ELSE 13 END AS BIGINT) AS min_zoom
FROM (SELECT *, coalesce(nature IN ('water', 'bay', 'strait', 'lagoon'), false) OR coalesce(landuse = 'reservoir', false) OR water IS NOT NULL AS is_water FROM fx_rings) WHERE is_water OR building IS NOT NULL""")
def classify_omt_areas(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.bound(X.ring_table(spark, sf), "c", OpenMapTilesSchema().way(F.col("node_ids"), F.col("tags"))).where("c.type = 3")
    return rows.select("id", "c.layer", F.col("c.min_zoom").cast("long").alias("min_zoom"))


@query(f"""{X.text('fx_rings')}, p AS (SELECT id, CASE WHEN regexp_matches(height, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN try_cast(trim(height) AS DOUBLE) END AS h, try_cast(levels AS DOUBLE) AS l FROM fx_rings)
SELECT id, coalesce(h, l * 3.66::DOUBLE) AS render_height FROM p""")
def classify_omt_height(spark: SparkSession, sf: str) -> DataFrame:
    return X.ring_table(spark, sf).select("id", OpenMapTilesSchema.height(F.col("tags")).alias("render_height"))


@query(f"""{X.text('fx_rings')} SELECT id, 'waterway' AS layer, 2::BIGINT AS type, 'class=' || waterway || ';name=' || name AS attributes, CAST(CASE WHEN waterway = 'river' THEN 9 ELSE 12 END AS BIGINT) AS min_zoom, 0::BIGINT AS rank
FROM fx_rings WHERE waterway IN ('stream', 'river', 'canal', 'drain', 'ditch') AND building IS NULL AND water IS NULL AND NOT coalesce(landuse = 'reservoir', false) AND NOT coalesce(nature IN ('water', 'bay', 'strait', 'lagoon'), false)""")
def classify_omt_waterways(spark: SparkSession, sf: str) -> DataFrame:
    return classified(X.ring_table(spark, sf), OpenMapTilesSchema().way(F.col("node_ids"), F.col("tags"))).where("layer = 'waterway'")


@query(f"""{X.text('fx_tagged')} SELECT t.id, 'place' AS layer, 1::BIGINT AS type, 'class=' || t.place || ';name=' || t.name || ';rank=' || CAST(p.rank AS VARCHAR) AS attributes, CAST(p.zoom AS BIGINT) AS min_zoom, CAST(p.rank AS BIGINT) AS rank
FROM fx_tagged t JOIN {q_values(OMT_PLACES, 0, 1)} p(place, rank, zoom) ON t.place = p.place WHERE t.name <> ''""")
def classify_omt_places(spark: SparkSession, sf: str) -> DataFrame:
    return classified(tagged(spark, sf), OpenMapTilesSchema().node(F.col("tags")))


@query(f"{X.text('fx_relations')} SELECT id, 'water' AS layer, 3::BIGINT AS type, 'class=lake' AS attributes, 0::BIGINT AS min_zoom, 0::BIGINT AS rank FROM fx_relations WHERE type = 'multipolygon' AND (nature IN ('water', 'bay', 'strait', 'lagoon') OR water IS NOT NULL)")
def classify_omt_relations(spark: SparkSession, sf: str) -> DataFrame:
    return classified(X.relation_table(spark, sf), OpenMapTilesSchema().relation(F.col("tags")["type"] == "multipolygon", F.col("tags")))


_KEYS = ("highway", "name", "bridge", "tunnel", "ford", "oneway", "nature", "waterway")


@query(f"""{X.text('fx_ways')}, t AS ({' UNION ALL '.join(f"SELECT id, '{'natural' if k == 'nature' else k}' AS key, {k} AS value FROM fx_ways WHERE highway IS NOT NULL AND n >= 2" for k in _KEYS)})
SELECT id, key, value FROM t WHERE value IS NOT NULL""")
def classify_keep_everything(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.bound(X.way_table(spark, sf), "c", KeepEverythingSchema().way(F.col("node_ids"), F.col("tags"))).where("c is not null")
    return rows.select("id", F.explode("c.attributes").alias("a")).select("id", "a.key", F.col("a.s").alias("value"))


# ---- filters ----
@query(f"""{X.text('fx_ways')} SELECT w.id, CAST(z AS INTEGER) AS z FROM fx_ways w JOIN {q_values(DELIVERY_ROADS, 1)} r(highway, zoom) ON w.highway = r.highway, range(6, 16) AS zs(z) WHERE w.n >= 2 AND z >= r.zoom""")
def zoom_expand(spark: SparkSession, sf: str) -> DataFrame:
    return T.expand_zooms(J.classify_ways(X.way_table(spark, sf), DeliverySchema()), 6, 15).select("id", "z")


_Q_RANGE = f"{q_tile(q_x('lon'), 'z')} AS x, {q_tile(q_y('lat'), 'z')} AS y, {q_tile(q_x('(-70.68)::DOUBLE'), 'z')} AS x0, {q_tile(q_x('(-70.66)::DOUBLE'), 'z')} AS x1, {q_tile(q_y('(-33.47)::DOUBLE'), 'z')} AS y0, {q_tile(q_y('(-33.49)::DOUBLE'), 'z')} AS y1"


@query(f"{X.text('fx_nodes')} SELECT id, z FROM (SELECT id, z, {_Q_RANGE} FROM fx_nodes, {Q_ZOOMS}) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def area_filter(spark: SparkSession, sf: str) -> DataFrame:
    z = F.col("z")
    x0, y0, x1, y1 = T.Area(-70.68, -33.49, -70.66, -33.47).tile_range(z)
    u = zooms(unit(nodes(spark, sf)))
    return u.where(S.tile_at(F.col("ux"), z).between(x0, x1) & S.tile_at(F.col("uy"), z).between(y0, y1)).select("id", "z")


@query(f"{X.text('fx_vertices')} SELECT way_id AS id, count(*) AS n FROM fx_vertices GROUP BY way_id HAVING count(*) >= 3")
def min_vertex_filter(spark: SparkSession, sf: str) -> DataFrame:
    return X.way_table(spark, sf).where(F.size("node_ids") >= 3).select("id", F.size("node_ids").cast("long").alias("n"))


@query("SELECT CAST(z AS INTEGER) AS z, CAST(CASE WHEN z >= 15 THEN 2 ELSE 4 END AS INTEGER) AS delivery, CAST(CASE WHEN z >= 14 THEN 2 ELSE 4 END AS INTEGER) AS omt, CAST(4096 // 64 AS INTEGER) AS buffer FROM range(16) AS r(z)")
def tolerances(spark: SparkSession, sf: str) -> DataFrame:
    z = F.col("id").cast("int")
    return spark.range(16).select(z.alias("z"), DeliverySchema().tolerance(z).alias("delivery"), OpenMapTilesSchema().tolerance(z).alias("omt"), F.lit(EXTENT // 64).alias("buffer"))


# ---- joins, sets, aggregates ----
@query(f"{X.text('fx_members', 'fx_rings')} SELECT id FROM fx_rings WHERE id IN (SELECT ref FROM fx_members WHERE type = 'way')")
def member_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return J.member_ways(X.ring_table(spark, sf), X.relation_table(spark, sf)).select("id")


@query(f"{X.text('fx_members', 'fx_rings')} SELECT CAST(m.id AS BIGINT) AS id, dense_rank() OVER (PARTITION BY m.id ORDER BY place) AS nth, m.ref, m.role FROM fx_members m JOIN fx_rings r ON m.ref = r.id WHERE type = 'way'")
def member_geometry_join(spark: SparkSession, sf: str) -> DataFrame:
    found = J.way_members(X.relation_table(spark, sf)).join(X.ring_table(spark, sf).select(F.col("id").alias("ref")), "ref")
    return found.select("id", F.dense_rank().over(Window.partitionBy("id").orderBy("place")).cast("long").alias("nth"), "ref", "role")


_Q_KNOWN = "id % 17 <> 0"


@query(f"{X.text('fx_vertices')} SELECT way_id AS id, row_number() OVER (PARTITION BY way_id ORDER BY pos) - 1 AS nth, lon_e7, lat_e7 FROM fx_vertices WHERE {_Q_KNOWN}")
def node_resolve_ordered(spark: SparkSession, sf: str) -> DataFrame:
    ways = X.way_table(spark, sf).select(F.lit(0).alias("source"), "ordinal", "id", F.array("node_ids").alias("outer"), F.array().cast("array<array<bigint>>").alias("inner"))
    found = J.resolve(ways, nodes(spark, sf).where(_Q_KNOWN))
    line = found.select("id", F.posexplode(F.col("outer")[0]).alias("nth", "v"))
    return line.select("id", F.col("nth").cast("long").alias("nth"), S.to_e7(F.col("v.lon")).alias("lon_e7"), S.to_e7(F.col("v.lat")).alias("lat_e7"))


@query(f"{X.text('fx_vertices')} SELECT count(DISTINCT id) AS referenced, count(DISTINCT id) FILTER (WHERE {_Q_KNOWN}) AS resolved, 16 * count(DISTINCT id) AS node_bytes FROM fx_vertices")
def unresolved_nodes(spark: SparkSession, sf: str) -> DataFrame:
    wanted = J.referenced_nodes(X.way_table(spark, sf).select(F.explode("node_ids").alias("node_id")))
    known = nodes(spark, sf).where(_Q_KNOWN).select(F.col("id").alias("node_id"), F.lit(1).alias("here"))
    both = wanted.join(known, "node_id", "left")
    return both.agg(F.count(F.lit(1)).alias("referenced"), F.count("here").alias("resolved"), (16 * F.count(F.lit(1))).alias("node_bytes"))


@query(f"{X.text('fx_vertices')} SELECT DISTINCT id AS node_id FROM fx_vertices")
def distinct_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return J.referenced_nodes(X.way_table(spark, sf).select(F.explode("node_ids").alias("node_id")))


@query("""SELECT id, max_by(lat, ordinal) AS lat, max_by(lon, ordinal) AS lon FROM (SELECT l_orderkey AS id, l_quantity AS lat, l_tax AS lon, l_partkey * 1000000000 + l_suppkey * 10000 + CAST(l_extendedprice AS BIGINT) % 10000 AS ordinal FROM lineitem
QUALIFY row_number() OVER (PARTITION BY id, ordinal ORDER BY lat DESC, lon DESC) = 1) GROUP BY id""")
def last_node_wins(spark: SparkSession, sf: str) -> DataFrame:
    ordinal = F.col("l_partkey") * 1000000000 + F.col("l_suppkey") * 10000 + S.round_away(F.col("l_extendedprice")) % 10000
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("lat"), F.col("l_tax").alias("lon"), ordinal.alias("ordinal"))
    best = rows.groupBy("id", "ordinal").agg(F.max(F.struct("lat", "lon")).alias("v")).select("id", "ordinal", "v.*")
    return J.last_written(best)


@query(f"{X.text('fx_ways', 'fx_rings')} SELECT 0::BIGINT AS source, id FROM fx_ways UNION ALL SELECT 1::BIGINT, id FROM fx_rings")
def feature_union(spark: SparkSession, sf: str) -> DataFrame:
    a, b = X.way_table(spark, sf).select(F.lit(0).cast("long").alias("source"), "id"), X.ring_table(spark, sf).select(F.lit(1).cast("long").alias("source"), "id")
    return a.unionByName(b)


#: Ways that relations refer to which the delivery schema keeps.
_Q_KEPT_MEMBERS = "SELECT m.ref FROM fx_members m JOIN fx_relations r ON m.id = r.id WHERE m.type = 'way' AND r.type = 'multipolygon' AND r.nature IN ('water', 'bay', 'strait')"


@query(f"""{X.text('fx_vertices', 'fx_rings', 'fx_members', 'fx_relations')} SELECT id AS node_id FROM fx_vertices UNION SELECT r.id * 4 + k FROM fx_rings r, range(4) AS ks(k) WHERE r.id IN ({_Q_KEPT_MEMBERS})""")
def node_id_union(spark: SparkSession, sf: str) -> DataFrame:
    own = X.way_table(spark, sf).select(F.explode("node_ids").alias("node_id"))
    members = J.member_ways(X.ring_table(spark, sf), J.kept_relations(X.relation_table(spark, sf), DeliverySchema())).select(F.explode("node_ids").alias("node_id"))
    return J.referenced_nodes(own.union(members))


def q_ring(zoom: int = 14) -> str:
    """CTE ring(id, k, x, y): the squares local to the tile of their middle."""
    wx = lambda c: q_world(q_x(f"({c} * 1e-7)"), str(zoom))
    wy = lambda c: q_world(q_y(f"({c} * 1e-7)"), str(zoom))
    return f"""ring AS (SELECT c.id, c.k, {wx('c.lon_e7')} - CAST(floor({wx('r.lon_e7')} / {EXTENT}.0) AS BIGINT) * {EXTENT} AS x,
  {wy('c.lat_e7')} - CAST(floor({wy('r.lat_e7')} / {EXTENT}.0) AS BIGINT) * {EXTENT} AS y FROM fx_corners c JOIN fx_rings r ON c.id = r.id WHERE c.k < 4)"""


@query(f"{X.text('fx_rings', 'fx_corners')}, {q_ring()} SELECT id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM ring GROUP BY id")
def feature_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return X.ring_points(spark, sf).select("id", G.bounds(F.array("ring")).alias("b")).select("id", "b.*")


@query(f"""{X.text('fx_vertices', 'fx_nodes')}, w AS (SELECT way_id, z, {q_world(q_x('n.lon'), 'z')} AS wx, {q_world(q_y('n.lat'), 'z')} AS wy FROM fx_vertices v JOIN fx_nodes n USING (id), {Q_ZOOMS}),
m AS (SELECT way_id AS id, z, min(wx) AS ax, min(wy) AS ay, max(wx) AS bx, max(wy) AS by_ FROM w GROUP BY ALL),
b AS (SELECT id, z, {q_tile_of_world(f'(ax - {BUFFER})', 'z')} AS tx0, {q_tile_of_world(f'(ay - {BUFFER})', 'z')} AS ty0, {q_tile_of_world(f'(bx + {BUFFER})', 'z')} AS tx1, {q_tile_of_world(f'(by_ + {BUFFER})', 'z')} AS ty1 FROM m),
a AS (SELECT *, {q_tile(q_x(f'({_A[0]})::DOUBLE'), 'z')} AS x0, {q_tile(q_x(f'({_A[2]})::DOUBLE'), 'z')} AS x1, {q_tile(q_y(f'({_A[3]})::DOUBLE'), 'z')} AS y0, {q_tile(q_y(f'({_A[1]})::DOUBLE'), 'z')} AS y1 FROM b),
t AS (SELECT *, unnest(generate_series(greatest(tx0, x0), least(tx1, x1))) AS tx FROM a)
SELECT id, z, tx, unnest(generate_series(greatest(ty0, y0), least(ty1, y1))) AS ty FROM t""")
def tile_candidates(spark: SparkSession, sf: str) -> DataFrame:
    z = F.col("z")
    u = zooms(unit(X.frame(spark, sf, "fx_vertices").select("way_id", S.from_e7(F.col("lon_e7")).alias("lon"), S.from_e7(F.col("lat_e7")).alias("lat"))))
    line = u.select("way_id", "z", G.point(S.world(F.col("ux"), z), S.world(F.col("uy"), z)).alias("p")).groupBy(F.col("way_id").alias("id"), "z").agg(F.array(F.collect_list("p")).alias("outer"))
    return T.tile_candidates(line, AREA, EXTENT, BUFFER).select("id", "z", "tx", "ty")


# ---- geometry ----
def lines(spark: SparkSession, sf: str, step: int = 0) -> DataFrame:
    """Trajectories on the grid of zoom 13, local to a tile in the middle of the area: id, line; `step` rounds to make points repeat."""
    rows = unit(X.frame(spark, sf, "fx_vertices").select("way_id", "pos", S.from_e7(F.col("lon_e7")).alias("lon"), S.from_e7(F.col("lat_e7")).alias("lat")))
    z = F.lit(13)
    x, y = S.world(F.col("ux"), z) - LINE_X * EXTENT, S.world(F.col("uy"), z) - LINE_Y * EXTENT
    if step:
        x, y = F.floor(x / step) * step, F.floor(y / step) * step
    at = rows.select(F.col("way_id").alias("id"), "pos", G.point(x, y).alias("p"))
    return at.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda v: v["p"]).alias("line"))


#: The tile at zoom 13 that holds -70.675, -33.48.
LINE_X, LINE_Y = 2487, 4905


def q_line(step: int = 0) -> str:
    """CTE line(id, k, x, y)."""
    x, y = f"{q_world(q_x('(lon_e7 * 1e-7)'), '13')} - {LINE_X * EXTENT}", f"{q_world(q_y('(lat_e7 * 1e-7)'), '13')} - {LINE_Y * EXTENT}"
    if step:
        x, y = (f"CAST(floor(({v}) / {step}.0) AS BIGINT) * {step}" for v in (x, y))
    return f"line AS (SELECT way_id AS id, row_number() OVER (PARTITION BY way_id ORDER BY pos) - 1 AS k, {x} AS x, {y} AS y FROM fx_vertices)"


def points_out(df: DataFrame, name: str) -> DataFrame:
    return df.select("id", F.posexplode(name).alias("k", "p")).select("id", F.col("k").cast("long").alias("k"), "p.x", "p.y")


@query(f"""{X.text('fx_vertices')}, {q_line(2048)}, d AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM line WINDOW w AS (PARTITION BY id ORDER BY k))
SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS k, x, y FROM d WHERE px IS NULL OR px <> x OR py <> y""")
def dedupe_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return points_out(lines(spark, sf, 2048).select("id", G.dedupe(F.col("line")).alias("line")), "line")


_Q_NEXT = "coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny"
_Q_AREA = f"area AS (SELECT id, CAST(sum(x * ny - nx * y) AS BIGINT) AS doubled_area FROM (SELECT *, {_Q_NEXT} FROM ring WINDOW w AS (PARTITION BY id ORDER BY k)) GROUP BY id)"


@query(f"{X.text('fx_rings', 'fx_corners')}, {q_ring()}, {_Q_AREA} SELECT id, doubled_area FROM area")
def ring_area(spark: SparkSession, sf: str) -> DataFrame:
    return X.ring_points(spark, sf).select("id", G.doubled_area(F.col("ring")).alias("doubled_area"))


@query(f"{X.text('fx_rings', 'fx_corners')}, {q_ring()}, {_Q_AREA} SELECT r.id, CASE WHEN (doubled_area > 0) = (r.id % 2 = 0) THEN k ELSE 3 - k END AS k, x, y FROM ring r JOIN area a ON r.id = a.id")
def ring_orient(spark: SparkSession, sf: str) -> DataFrame:
    ring = F.when(F.col("id") % 2 == 0, G.orient(F.col("ring"), True)).otherwise(G.orient(F.col("ring"), False))
    return points_out(X.ring_points(spark, sf).select("id", ring.alias("ring")), "ring")


@query(f"""{X.text('fx_rings', 'fx_corners')}, {q_ring()}, spot AS (SELECT id, (id * 37) % 4096 AS px, (id * 101) % 4096 AS py FROM fx_rings),
e AS (SELECT r.*, px, py, coalesce(lag(r.x) OVER w, last_value(r.x) OVER (PARTITION BY r.id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS qx,
  coalesce(lag(r.y) OVER w, last_value(r.y) OVER (PARTITION BY r.id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS qy FROM ring r JOIN spot ON r.id = spot.id WINDOW w AS (PARTITION BY r.id ORDER BY k))
SELECT id, count(*) FILTER (WHERE (y > py) <> (qy > py) AND px < x + (py - y)::DOUBLE / nullif(qy - y, 0) * (qx - x)) % 2 = 1 AS inside FROM e GROUP BY id""")
def point_in_ring(spark: SparkSession, sf: str) -> DataFrame:
    at = G.point((F.col("id") * 37) % 4096, (F.col("id") * 101) % 4096)
    return X.ring_points(spark, sf).select("id", G.contains(F.col("ring"), at).alias("inside"))


_SIZES = (3000, 1000, 2000, 1000)


@query(f"""WITH s AS (SELECT * FROM (VALUES {', '.join(f'({i}, {v})' for i, v in enumerate(_SIZES))}) t(nth, half)),
c AS (SELECT c_custkey AS id, (c_custkey * 53) % 8000 - 4000 AS px, (c_custkey * 97) % 8000 - 4000 AS py FROM customer)
SELECT id, coalesce(first(nth ORDER BY half, nth) FILTER (WHERE px >= -half AND px < half AND py >= -half AND py < half), -1)::BIGINT AS owner FROM c, s GROUP BY id""")
def ring_owner(spark: SparkSession, sf: str) -> DataFrame:
    square = lambda h: F.array(*(G.point(F.lit(x), F.lit(y)) for x, y in ((-h, -h), (h, -h), (h, h), (-h, h))))
    at = G.point((F.col("c_custkey") * 53) % 8000 - 4000, (F.col("c_custkey") * 97) % 8000 - 4000)
    owner = G.owner_of(F.array(*map(square, _SIZES)), F.array(at, at, at))
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), owner.cast("long").alias("owner"))


def _q_clip_ring() -> str:
    steps, name = [], "ring"
    for i, (axis, at, keep) in enumerate((("x", -BUFFER, ">="), ("x", EXTENT + BUFFER, "<="), ("y", -BUFFER, ">="), ("y", EXTENT + BUFFER, "<="))):
        other = "y" if axis == "x" else "x"
        met = f"CAST(round(q{other} + ({other} - q{other})::DOUBLE * ({at} - q{axis}) / nullif({axis} - q{axis}, 0)) AS BIGINT)"
        cx, cy = (f"{at}::BIGINT", met) if axis == "x" else (met, f"{at}::BIGINT")
        last = lambda c: f"coalesce(lag({c}) OVER w, last_value({c}) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS q{c}"
        steps.append(f"e{i} AS (SELECT *, {last('x')}, {last('y')} FROM {name} WINDOW w AS (PARTITION BY id ORDER BY k))")
        crossing = f"SELECT id, k * 2 AS k, {cx} AS x, {cy} AS y FROM e{i} WHERE ({axis} {keep} {at}) <> (q{axis} {keep} {at})"
        steps.append(f"s{i} AS ({crossing} UNION ALL SELECT id, k * 2 + 1, x, y FROM e{i} WHERE {axis} {keep} {at})")
        name = f"s{i}"
    steps.append(f"o AS (SELECT id, x, y, row_number() OVER w AS k, count(*) OVER (PARTITION BY id) AS n, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM {name} WINDOW w AS (PARTITION BY id ORDER BY k))")
    steps.append("u AS (SELECT id, k - 1 AS k, x, y FROM o WHERE n >= 3 AND NOT (k = n AND x = fx AND y = fy))")
    return ", ".join(steps)


@query(f"{X.text('fx_rings', 'fx_corners')}, {q_ring()}, {_q_clip_ring()} SELECT id, k, x, y FROM u QUALIFY count(*) OVER (PARTITION BY id) >= 3")
def clip_ring(spark: SparkSession, sf: str) -> DataFrame:
    rings = S.bound(X.ring_points(spark, sf), "ring", G.clip_ring(F.col("ring"), -BUFFER, EXTENT + BUFFER))
    return points_out(rings, "ring")


_LO, _HI = -BUFFER, EXTENT + BUFFER
#: Cohen-Sutherland as a recursion: while an end is outside, it moves to the edge that it is beyond.
_Q_SEGMENTS = f"""seg AS (SELECT id, k, x, y, lead(x) OVER w AS tx, lead(y) OVER w AS ty FROM line WINDOW w AS (PARTITION BY id ORDER BY k)),
cs(id, k, step, x0, y0, x1, y1, gone) AS (
  SELECT id, k, 0, x::DOUBLE, y::DOUBLE, tx::DOUBLE, ty::DOUBLE, false FROM seg WHERE tx IS NOT NULL
  UNION ALL
  SELECT id, k, step + 1, CASE WHEN o0 AND NOT missed THEN nx ELSE x0 END, CASE WHEN o0 AND NOT missed THEN ny ELSE y0 END, CASE WHEN NOT o0 AND NOT missed THEN nx ELSE x1 END, CASE WHEN NOT o0 AND NOT missed THEN ny ELSE y1 END, missed
  FROM (SELECT *, CASE WHEN sy > {_HI} THEN x0 + (x1 - x0) * ({_HI} - y0) / nullif(y1 - y0, 0) WHEN sy < {_LO} THEN x0 + (x1 - x0) * ({_LO} - y0) / nullif(y1 - y0, 0) WHEN sx > {_HI} THEN {_HI} ELSE {_LO} END AS nx,
    CASE WHEN sy > {_HI} THEN {_HI} WHEN sy < {_LO} THEN {_LO} WHEN sx > {_HI} THEN y0 + (y1 - y0) * ({_HI} - x0) / nullif(x1 - x0, 0) ELSE y0 + (y1 - y0) * ({_LO} - x0) / nullif(x1 - x0, 0) END AS ny
    FROM (SELECT *, CASE WHEN o0 THEN x0 ELSE x1 END AS sx, CASE WHEN o0 THEN y0 ELSE y1 END AS sy,
      (x0 < {_LO} AND x1 < {_LO}) OR (x0 > {_HI} AND x1 > {_HI}) OR (y0 < {_LO} AND y1 < {_LO}) OR (y0 > {_HI} AND y1 > {_HI}) AS missed
      FROM (SELECT *, x0 < {_LO} OR x0 > {_HI} OR y0 < {_LO} OR y0 > {_HI} AS o0, x1 < {_LO} OR x1 > {_HI} OR y1 < {_LO} OR y1 > {_HI} AS o1 FROM cs WHERE NOT gone AND step < 5))
    WHERE o0 OR o1)
), cut AS (SELECT id, k, CAST(round(x0) AS BIGINT) AS ax, CAST(round(y0) AS BIGINT) AS ay, CAST(round(x1) AS BIGINT) AS bx, CAST(round(y1) AS BIGINT) AS by_ FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY step DESC) AS r FROM cs) WHERE r = 1 AND NOT gone)"""


@query(f"{X.text('fx_vertices').replace('WITH ', 'WITH RECURSIVE ', 1)}, {q_line()}, {_Q_SEGMENTS} SELECT * FROM cut")
def clip_segment(spark: SparkSession, sf: str) -> DataFrame:
    pairs = lines(spark, sf).select("id", F.posexplode("line").alias("k", "p"), "line").withColumn("q", F.get("line", F.col("k") + 1)).where("q is not null")
    cut = S.bound(pairs.select("id", "k", "p", "q"), "c", G.clip_segment(F.col("p"), F.col("q"), _LO, _HI)).where("c is not null")
    return cut.select("id", F.col("k").cast("long").alias("k"), F.col("c.a.x").alias("ax"), F.col("c.a.y").alias("ay"), F.col("c.b.x").alias("bx"), F.col("c.b.y").alias("by_"))


@query(f"""{X.text('fx_vertices').replace('WITH ', 'WITH RECURSIVE ', 1)}, {q_line()}, {_Q_SEGMENTS},
j AS (SELECT c.*, lag(c.k) OVER w AS pk, lag(bx) OVER w AS pbx, lag(by_) OVER w AS pby, s.x AS sx, s.y AS sy FROM cut c JOIN seg s ON c.id = s.id AND c.k = s.k WINDOW w AS (PARTITION BY c.id ORDER BY c.k)),
f AS (SELECT *, CASE WHEN pk = k - 1 AND pbx = sx AND pby = sy AND ax = pbx AND ay = pby THEN 0 ELSE 1 END AS fresh FROM j),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY k) - 1 AS run FROM f),
v AS (SELECT id, run, k * 2 AS o, ax AS x, ay AS y FROM g WHERE fresh = 1 UNION ALL SELECT id, run, k * 2 + 1, bx, by_ FROM g)
SELECT id, CAST(run AS BIGINT) AS run, row_number() OVER (PARTITION BY id, run ORDER BY o) - 1 AS k, x, y FROM v""")
def clip_line(spark: SparkSession, sf: str) -> DataFrame:
    cut = S.bound(lines(spark, sf), "runs", G.clip_line(F.col("line"), _LO, _HI))
    runs = cut.select("id", F.posexplode("runs").alias("run", "r")).select("id", "run", F.posexplode("r").alias("k", "p"))
    return runs.select("id", F.col("run").cast("long").alias("run"), F.col("k").cast("long").alias("k"), "p.x", "p.y")


@query()
def rdp_simplify(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only: no SQL engine here recurses over windows; tests hold it against a plain recursion."""
    kept = S.bound(lines(spark, sf), "kept", K.simplify(F.array("line"), F.lit(1000))[0])
    return points_out(kept, "kept")


@query(f"""{X.text('fx_rings')} SELECT id, k, id * 4 + CASE WHEN id % 2 = 0 THEN k ELSE (4 - k) % 4 END AS node_id FROM fx_rings, range(4) AS ks(k) WHERE id % 5 <> 0""")
def ring_assemble(spark: SparkSession, sf: str) -> DataFrame:
    """Each square in two fragments, the second reversed for even ids, the whole walked backwards for odd ones; every fifth lacks one."""
    i = F.col("id") * 4
    even = F.array(F.array(i, i + 1, i + 2), F.array(i, i + 3, i + 2))
    odd = F.array(F.array(i, i + 3), F.array(i + 3, i + 2, i + 1, i))
    parts = F.when(F.col("id") % 5 == 0, F.array(F.array(i, i + 1, i + 2))).when(F.col("id") % 2 == 0, even).otherwise(odd)
    rings = X.frame(spark, sf, "fx_rings").select("id", K.rings_of(parts).alias("rings")).select("id", F.explode("rings").alias("ring"))
    return rings.select("id", F.posexplode("ring").alias("k", "node_id")).select("id", F.col("k").cast("long").alias("k"), "node_id")


@query("""WITH c AS (SELECT c_custkey AS id, 1000 + c_custkey % 500 AS h FROM customer), p AS (
SELECT id, part, k, CASE WHEN part = 0 THEN (CASE WHEN k IN (0, 3) THEN -h ELSE h END) ELSE (CASE WHEN k IN (0, 1) THEN -100 ELSE 100 END) END AS x,
  CASE WHEN part = 0 THEN (CASE WHEN k IN (0, 1) THEN -h ELSE h END) ELSE (CASE WHEN k IN (0, 3) THEN -100 ELSE 100 END) END AS y FROM c, range(2) AS ps(part), range(4) AS ks(k)
WHERE part = 0 OR id % 3 <> 0) SELECT id, part, k, x::BIGINT AS x, y::BIGINT AS y FROM p""")
def ring_nest(spark: SparkSession, sf: str) -> DataFrame:
    """A square with a hole wound as the square is; for every third the hole lies outside and goes."""
    h = (1000 + F.col("id") % 500).cast("long")
    square = lambda r, d: F.array(*(G.point(x * r + d, y * r) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))))
    # Turned so that reversing it starts at the same corner.
    inner = F.array(*(G.point(F.lit(x * 100) + F.when(F.col("id") % 3 == 0, 9000).otherwise(0), F.lit(y * 100)) for x, y in ((1, -1), (1, 1), (-1, 1), (-1, -1))))
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"))
    nested = S.bound(rows, "parts", G.nest(F.array(square(h, F.lit(0))), F.array(inner)))
    parts = nested.select("id", F.posexplode("parts").alias("part", "r")).select("id", F.col("part").cast("long").alias("part"), F.posexplode("r").alias("k", "p"))
    return parts.select("id", "part", F.col("k").cast("long").alias("k"), "p.x", "p.y")


# ---- command integers ----
@query(f"""{X.text('fx_vertices')}, {q_line()}, d AS (SELECT id, k, x - coalesce(lag(x) OVER w, 0) AS dx, y - coalesce(lag(y) OVER w, 0) AS dy FROM line WINDOW w AS (PARTITION BY id ORDER BY k))
SELECT id, k, CASE WHEN dx < 0 THEN -2 * dx - 1 ELSE 2 * dx END AS zx, CASE WHEN dy < 0 THEN -2 * dy - 1 ELSE 2 * dy END AS zy FROM d""")
def zigzag_delta(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy("k")
    p = points_out(lines(spark, sf), "line")
    return p.select("id", "k", G.zigzag(F.col("x") - F.lag("x", 1, 0).over(w)).alias("zx"), G.zigzag(F.col("y") - F.lag("y", 1, 0).over(w)).alias("zy"))


def commands_out(df: DataFrame, commands: Column) -> DataFrame:
    out = S.bound(df, "c", commands)
    return out.select("id", F.posexplode("c").alias("place", "v")).select("id", F.col("place").cast("long").alias("place"), F.col("v").alias("command"))


def _q_zz(v: str) -> str:
    return f"CASE WHEN {v} < 0 THEN -2 * ({v}) - 1 ELSE 2 * ({v}) END"


_Q_DELTAS = "d AS (SELECT id, k, n, x - coalesce(lag(x) OVER w, 0) AS dx, y - coalesce(lag(y) OVER w, 0) AS dy FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM {0}) WINDOW w AS (PARTITION BY id ORDER BY k))"


@query(f"""{X.text('fx_vertices')}, {q_line()}, {_Q_DELTAS.format('line')}, c AS (
SELECT id, 0::BIGINT AS place, 9::BIGINT AS command FROM d WHERE k = 0 UNION ALL SELECT id, 3, (n - 1) * 8 + 2 FROM d WHERE k = 0
UNION ALL SELECT id, CASE WHEN k = 0 THEN 1 ELSE 2 + 2 * k END, {_q_zz('dx')} FROM d UNION ALL SELECT id, CASE WHEN k = 0 THEN 2 ELSE 3 + 2 * k END, {_q_zz('dy')} FROM d)
SELECT id, place, command FROM c""")
def mvt_commands_line(spark: SparkSession, sf: str) -> DataFrame:
    return commands_out(lines(spark, sf), G.encode_lines(F.array("line"), False))


@query(f"""{X.text('fx_vertices')}, {q_line()}, {_Q_DELTAS.format('line')}, c AS (SELECT id, 0::BIGINT AS place, n * 8 + 1 AS command FROM d WHERE k = 0
UNION ALL SELECT id, 1 + 2 * k, {_q_zz('dx')} FROM d UNION ALL SELECT id, 2 + 2 * k, {_q_zz('dy')} FROM d) SELECT id, place, command FROM c""")
def mvt_commands_point(spark: SparkSession, sf: str) -> DataFrame:
    return commands_out(lines(spark, sf), G.encode_points(F.array("line")))


@query(f"""{X.text('fx_rings', 'fx_corners')}, {q_ring()}, {_Q_DELTAS.format('ring')}, c AS (
SELECT id, 0::BIGINT AS place, 9::BIGINT AS command FROM d WHERE k = 0 UNION ALL SELECT id, 3, (n - 1) * 8 + 2 FROM d WHERE k = 0 UNION ALL SELECT id, 10, 15 FROM d WHERE k = 0
UNION ALL SELECT id, CASE WHEN k = 0 THEN 1 ELSE 2 + 2 * k END, {_q_zz('dx')} FROM d UNION ALL SELECT id, CASE WHEN k = 0 THEN 2 ELSE 3 + 2 * k END, {_q_zz('dy')} FROM d) SELECT id, place, command FROM c""")
def mvt_commands_polygon(spark: SparkSession, sf: str) -> DataFrame:
    """The rings repeat their first point, which is dropped."""
    return commands_out(X.ring_points(spark, sf), G.encode_lines(F.array(F.concat("ring", F.slice("ring", 1, 1))), True))


# ---- binning and layers ----
def point_rows(spark: SparkSession, sf: str) -> DataFrame:
    return S.bound(tagged(spark, sf), "c", OpenMapTilesSchema().node(F.col("tags"))).where("c is not null").select(F.lit(2).alias("source"), F.col("id").alias("ordinal"), "id", "lon", "lat", "c.*")


@query(f"""{X.text('fx_tagged').replace('WITH ', 'WITH RECURSIVE ', 1)}, s AS (SELECT t.id, t.lon, t.lat, z FROM fx_tagged t JOIN {q_values(OMT_PLACES, 0, 1)} p(place, rank, zoom) ON t.place = p.place, range(4, 15) AS zs(z) WHERE t.name <> '' AND z >= p.zoom),
b AS (SELECT id, CAST(z AS INTEGER) AS z, {q_tile(q_x('lon'), 'z')} AS x, {q_tile(q_y('lat'), 'z')} AS y, {q_x('lon')} AS ux, {q_y('lat')} AS uy, {q_tile(q_x(f'({_A[0]})::DOUBLE'), 'z')} AS x0, {q_tile(q_x(f'({_A[2]})::DOUBLE'), 'z')} AS x1, {q_tile(q_y(f'({_A[3]})::DOUBLE'), 'z')} AS y0, {q_tile(q_y(f'({_A[1]})::DOUBLE'), 'z')} AS y1 FROM s),
k AS (SELECT * FROM b WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), {q_hilbert('k')}
SELECT k.id, k.z, tile_id, CAST(round((ux * {q_n('k.z')} - k.x) * {EXTENT}) AS BIGINT) AS px, CAST(round((uy * {q_n('k.z')} - k.y) * {EXTENT}) AS BIGINT) AS py FROM k JOIN hilbert h ON k.z = h.z AND k.x = h.x AND k.y = h.y""")
def bin_points(spark: SparkSession, sf: str) -> DataFrame:
    z, p = F.col("z"), F.col("parts")[0][0]
    rows = T.bin_points(point_rows(spark, sf), AREA, OpenMapTilesSchema())
    return rows.select("id", "z", H.tile_id(z, F.col("tx"), F.col("ty")).alias("tile_id"), p["x"].alias("px"), p["y"].alias("py"))


def resolved(spark: SparkSession, sf: str, polygons: bool) -> DataFrame:
    """Classified trajectories or rings with coordinates."""
    schema = OpenMapTilesSchema() if polygons else DeliverySchema()
    table = X.ring_table(spark, sf) if polygons else X.way_table(spark, sf)
    ways = J.classify_ways(table, schema).select(F.lit(0).alias("source"), F.col("id").alias("ordinal"), "id", F.array("node_ids").alias("outer"), F.array().cast("array<array<bigint>>").alias("inner"), *J.CLASSES)
    corners = X.frame(spark, sf, "fx_corners").where("k < 4").select((F.col("id") * 4 + F.col("k")).alias("id"), S.from_e7(F.col("lon_e7")).alias("lon"), S.from_e7(F.col("lat_e7")).alias("lat"))
    return J.resolve(ways.where(F.col("type") == (3 if polygons else 2)), corners if polygons else nodes(spark, sf))


def binned(spark: SparkSession, sf: str, polygons: bool) -> DataFrame:
    schema = OpenMapTilesSchema(min_zoom=12) if polygons else DeliverySchema(min_zoom=11, max_zoom=13)
    return T.bin_features(resolved(spark, sf, polygons), None, AREA, schema)


@query()
def bin_lines(spark: SparkSession, sf: str) -> DataFrame:
    return binned(spark, sf, False).select("z", "tile_id", "id", "layer", F.size("parts").cast("long").alias("runs"), F.size(F.flatten("parts")).cast("long").alias("vertices"))


@query()
def bin_polygons(spark: SparkSession, sf: str) -> DataFrame:
    area = F.aggregate("parts", F.lit(0).cast("long"), lambda a, r: a + G.doubled_area(r))
    return binned(spark, sf, True).select("z", "tile_id", "id", "layer", F.size("parts").cast("long").alias("rings"), area.alias("doubled_area"))


@query(f"""{X.text('fx_tagged')}, f AS (SELECT s_nationkey AS tile, 'place' AS layer, p.rank, t.id FROM fx_tagged t JOIN supplier ON s_suppkey = t.id JOIN {q_values(OMT_PLACES, 0, 1)} p(place, rank, zoom) ON t.place = p.place WHERE t.name <> ''
UNION ALL SELECT s_nationkey, 'signal', 0, t.id FROM fx_tagged t JOIN supplier ON s_suppkey = t.id WHERE railway IN ('level_crossing', 'crossing') OR (railway IS DISTINCT FROM 'level_crossing' AND highway = 'crossing' AND (crossing = 'traffic_signals' OR crossing_signals = 'yes')) OR highway IN ('traffic_signals', 'stop', 'give_way')),
o AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY rank, id, layer) AS drawn FROM f)
SELECT CAST(tile AS BIGINT) AS tile, layer, dense_rank() OVER (PARTITION BY tile ORDER BY first_drawn) AS nth_layer, row_number() OVER (PARTITION BY tile, layer ORDER BY drawn) AS nth, id
FROM (SELECT *, min(drawn) OVER (PARTITION BY tile, layer) AS first_drawn FROM o)""")
def layer_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Features of a tile (here a nation) in drawing order, layers in the order of their first features."""
    rows = tagged(spark, sf)
    one = lambda c: S.bound(rows, "c", c).where("c is not null").select("id", "c.layer", "c.rank")
    both = one(OpenMapTilesSchema().node(F.col("tags"))).unionByName(one(DeliverySchema().node(F.col("tags"))))
    tile = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("tile"))
    per_tile, per_layer = Window.partitionBy("tile"), Window.partitionBy("tile", "layer")
    drawn = both.join(tile, "id").withColumn("drawn", F.row_number().over(per_tile.orderBy("rank", "id", "layer")))
    first = drawn.withColumn("first", F.min("drawn").over(per_layer))
    return first.select("tile", "layer", F.dense_rank().over(per_tile.orderBy("first")).cast("long").alias("nth_layer"), F.row_number().over(per_layer.orderBy("drawn")).cast("long").alias("nth"), "id")


@query("""WITH a AS (SELECT o_custkey AS tile, o_orderkey AS id, 0 AS nth, 'status' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_custkey, o_orderkey, 1, 'priority', CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END FROM orders),
k AS (SELECT tile, key AS text, min(id * 2 + nth) AS first FROM a WHERE value IS NOT NULL GROUP BY ALL), v AS (SELECT tile, value AS text, min(id * 2 + nth) AS first FROM a WHERE value IS NOT NULL GROUP BY ALL)
SELECT tile, 'key' AS part, text, row_number() OVER (PARTITION BY tile ORDER BY first) - 1 AS index FROM k UNION ALL SELECT tile, 'value', text, row_number() OVER (PARTITION BY tile ORDER BY first) - 1 FROM v""")
def attribute_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and values of a tile's layer in the order in which they are first seen; nulls are not."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    priority = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    rows = o.select(F.col("o_custkey").alias("tile"), F.col("o_orderkey").alias("id"), F.posexplode(F.array(F.struct(F.lit("status").alias("key"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("key"), priority.alias("value")))).alias("at", "a"))
    seen = rows.where("a.value is not null").select("tile", (F.col("id") * 2 + F.col("at")).alias("first"), F.explode(F.array(F.struct(F.lit("key").alias("part"), F.col("a.key").alias("text")), F.struct(F.lit("value").alias("part"), F.col("a.value").alias("text")))).alias("e")).select("tile", "first", "e.*")
    firsts = seen.groupBy("tile", "part", "text").agg(F.min("first").alias("first"))
    nth = F.row_number().over(Window.partitionBy("tile", "part").orderBy("first")) - 1
    return firsts.select("tile", "part", "text", nth.cast("long").alias("index"))


# ---- archive windows ----
def blobs(spark: SparkSession, sf: str) -> DataFrame:
    return X.frame(spark, sf, "fx_blobs").select("tile_id", F.col("payload").cast("binary").alias("blob"))


_Q_BLOBS = f"""{X.text('fx_blobs')}, o AS (SELECT payload, min(tile_id) AS first_id, CAST(min(length(payload)) AS BIGINT) AS length FROM fx_blobs GROUP BY payload),
off AS (SELECT *, CAST(coalesce(sum(length) OVER (ORDER BY first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM o)"""
_Q_ENTRIES = f"""{_Q_BLOBS}, p AS (SELECT b.tile_id, f.* FROM fx_blobs b JOIN off f ON b.payload = f.payload),
g AS (SELECT *, CASE WHEN lag(tile_id) OVER w = tile_id - 1 AND lag("offset") OVER w = "offset" THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (ORDER BY tile_id)),
r AS (SELECT *, sum(fresh) OVER (ORDER BY tile_id) AS run FROM g),
entries AS (SELECT min(tile_id) AS tile_id, min("offset") AS "offset", min(length) AS length, count(*) AS run_length FROM r GROUP BY run)"""


@query(f"{_Q_BLOBS} SELECT first_id, length FROM o")
def tile_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return A.distinct_blobs(blobs(spark, sf)).select("first_id", "length")


@query(f'{_Q_BLOBS} SELECT first_id, length, "offset" FROM off')
def tile_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return A.blob_offsets(blobs(spark, sf)).select("first_id", "length", "offset")


@query(f'{_Q_ENTRIES} SELECT tile_id, "offset", length, run_length FROM entries')
def tile_rle(spark: SparkSession, sf: str) -> DataFrame:
    return A.entries(blobs(spark, sf), bits=6)


@query(f"""{_Q_ENTRIES} SELECT tile_id, tile_id - coalesce(lag(tile_id) OVER w, 0) AS id_delta, run_length, length, CASE WHEN "offset" = lag("offset") OVER w + lag(length) OVER w THEN 0 ELSE "offset" + 1 END AS stored_offset FROM entries WINDOW w AS (ORDER BY tile_id)""")
def dir_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return A.directory_columns(A.entries(blobs(spark, sf)))


@query(f'{_Q_ENTRIES} SELECT tile_id, (row_number() OVER (ORDER BY tile_id) - 1) // 16 AS leaf FROM entries')
def leaf_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return A.leaf_of(A.entries(blobs(spark, sf)), 16).select("tile_id", "leaf")


@query(f"{_Q_ENTRIES} SELECT CAST(sum(run_length) AS BIGINT) AS addressed, count(*) AS entries, (SELECT count(*) FROM off) AS contents, (SELECT CAST(sum(length) AS BIGINT) FROM off) AS tile_bytes FROM entries")
def archive_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.archive_counts(A.entries(blobs(spark, sf)))


@query(f"{X.text('fx_blobs')} SELECT coalesce(min(z), 0) AS min_zoom, coalesce(max(z), 0) AS max_zoom FROM (SELECT (SELECT max(z) FROM range(32) AS zs(z) WHERE ((1::HUGEINT << (2 * CAST(z AS INTEGER))) - 1) // 3 <= tile_id) AS z FROM fx_blobs)")
def zoom_written_range(spark: SparkSession, sf: str) -> DataFrame:
    z = H.zoom_of(F.col("tile_id")).cast("long")
    return blobs(spark, sf).agg(F.coalesce(F.min(z), F.lit(0)).alias("min_zoom"), F.coalesce(F.max(z), F.lit(0)).alias("max_zoom"))


# ---- whole jobs ----
@query()
def mvt_encode(spark: SparkSession, sf: str) -> DataFrame:
    tiles = T.encode_tiles(binned(spark, sf, False), EXTENT)
    return tiles.select("z", "tile_id", "features", F.length("tile").cast("long").alias("bytes"), F.sha2("tile", 256).alias("sha256"))


@query(f"{X.text('fx_blobs')} SELECT tile_id, '1F8B08' AS magic, CAST(length(payload) AS BIGINT) AS bytes_before FROM fx_blobs")
def gzip_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """What the compressed tiles say of themselves: their first bytes, and the length before, from their last four."""
    packed = blobs(spark, sf).select("tile_id", K.gzip(F.col("blob")).alias("g"))
    last = F.reverse(F.sequence(F.lit(0), F.lit(3)))
    before = F.conv(F.array_join(F.transform(last, lambda i: F.hex(F.substring(F.col("g"), F.length("g") - 3 + i, F.lit(1)))), ""), 16, 10)
    return packed.select("tile_id", F.hex(F.substring("g", 1, 3)).alias("magic"), before.cast("long").alias("bytes_before"))


_Q_WANTED = f"wanted AS (SELECT r.id * 4 + k AS node_id FROM fx_rings r, range(4) AS ks(k) WHERE r.nature IN ('water', 'bay', 'strait') OR r.id IN ({_Q_KEPT_MEMBERS}))"


@query(f"""{X.text('fx_rings', 'fx_members', 'fx_relations')}, {_Q_WANTED} SELECT
(SELECT count(*) FROM fx_rings WHERE nature IN ('water', 'bay', 'strait')) AS kept_ways,
(SELECT count(*) FROM wanted) AS referenced_nodes, (SELECT count(*) FROM wanted WHERE node_id % 17 <> 0) AS resolved_nodes""")
def build_report(spark: SparkSession, sf: str) -> DataFrame:
    """The builder's own counts, of rings and relations where each seventeenth node is missing."""
    from .plans.build import Extract, node_counts, read_sources

    at = X.frame(spark, sf, "fx_corners").where("k < 4").select((F.col("id") * 4 + F.col("k")).alias("id"), S.from_e7(F.col("lat_e7")).alias("lat"), S.from_e7(F.col("lon_e7")).alias("lon"))
    tags = F.create_map().cast("map<string,string>").alias("tags")
    sources = read_sources(Extract(at.where("id % 17 <> 0").select("id", "lat", "lon", tags, F.col("id").alias("ordinal")), X.ring_table(spark, sf), X.relation_table(spark, sf)), DeliverySchema())
    referenced, resolved = node_counts(sources)
    return spark.createDataFrame([(sources.features.where("source = 0").count(), referenced, resolved)], "kept_ways long, referenced_nodes long, resolved_nodes long")


def _q_metadata() -> str:
    import json

    from .plans.build import metadata

    return json.dumps(metadata(DeliverySchema(), AREA), ensure_ascii=False, separators=(",", ":"))


@query("""SELECT 'delivery' AS name, 6::BIGINT AS minzoom, 15::BIGINT AS maxzoom, '-70.7,-33.5,-70.65,-33.46' AS bounds, 'road,water,signal' AS layers""")
def metadata_json(spark: SparkSession, sf: str) -> DataFrame:
    text = spark.range(1).select(F.lit(_q_metadata()).alias("m"))
    field = lambda name: F.get_json_object("m", f"$.{name}")
    layers = F.array_join(F.from_json(field("vector_layers"), "array<struct<id string>>")["id"], ",")
    return text.select(field("name").alias("name"), field("minzoom").cast("long").alias("minzoom"), field("maxzoom").cast("long").alias("maxzoom"), field("bounds").alias("bounds"), layers.alias("layers"))


@query(f'{_Q_ENTRIES} SELECT tile_id, "offset", length, run_length FROM entries')
def pmtiles_archive(spark: SparkSession, sf: str) -> DataFrame:
    """An archive of the payloads as they are, written and read back: its directory."""
    from .sources import pmtiles
    from .sources.files import open_for
    from .storage import scratch_path

    path = scratch_path(spark, "payloads") + ".pmtiles"
    pmtiles.write_archive(blobs(spark, sf).withColumnRenamed("blob", "tile"), path, {"name": "payloads"}, compression=pmtiles.Compression.NONE)
    with open_for(path) as f:
        _, _, entries = pmtiles.read_archive(f.read())
    return spark.createDataFrame(entries, "tile_id bigint, offset bigint, length bigint, run_length bigint")
