"""Features derived from the star-schema tables, by integer arithmetic that any SQL engine repeats.

The statements are plain SQL over named tables, so that the same text can run
on Spark (`frame`) and elsewhere (`text`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import DELIVERY_ROADS, OMT_PLACES

AREA = (-70.7, -33.5, -70.65, -33.46)

ROADS = [*DELIVERY_ROADS, "proposed", "corridor", None]
PLACES = [*OMT_PLACES, "farm", None]


def _pick(expr: str, values: list) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {expr} % {len(values)} {cases} END"


STATEMENTS = {
    # A trajectory per user: a way whose nodes are the user's events in order.
    "fx_vertices": """
SELECT event_id AS id, user_id AS way_id, pos,
       -707000000 + (user_id * 7919 + pos * 10007) % 500000 AS lon_e7,
       -335000000 + (user_id * 104729 + pos * pos * 613) % 400000 AS lat_e7
FROM (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos FROM events) AS e""",
    "fx_nodes": "SELECT id, lon_e7, lat_e7, lon_e7 * 1e-7 AS lon, lat_e7 * 1e-7 AS lat FROM fx_vertices",
    "fx_ways": f"""
SELECT id, n, closed, {_pick("id", ROADS)} AS highway,
       CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Street ', CAST(id AS VARCHAR(20))) END AS name,
       CASE id % 7 WHEN 1 THEN 'yes' WHEN 2 THEN 'no' END AS bridge, CASE id % 5 WHEN 1 THEN 'yes' WHEN 2 THEN 'no' END AS tunnel,
       CASE id % 3 WHEN 1 THEN 'yes' END AS ford, CASE id % 2 WHEN 1 THEN 'yes' ELSE 'no' END AS oneway,
       CASE id % 6 WHEN 0 THEN 'water' WHEN 1 THEN 'wood' END AS nature, CASE id % 11 WHEN 0 THEN 'river' WHEN 1 THEN 'ditch' WHEN 2 THEN 'weir' END AS waterway
FROM (SELECT way_id AS id, count(*) AS n, false AS closed FROM fx_vertices GROUP BY way_id) AS w""",
    # A square per customer: a closed way of five node ids, its tags by turns.
    "fx_rings": """
SELECT c_custkey AS id, -707000000 + (c_custkey * 7919) % 500000 AS lon_e7, -335000000 + (c_custkey * 104729) % 400000 AS lat_e7, 500 + (c_custkey % 50) * 400 AS half_e7,
       CASE c_custkey % 6 WHEN 0 THEN 'water' WHEN 1 THEN 'wood' WHEN 2 THEN 'lagoon' END AS nature,
       CASE c_custkey % 8 WHEN 3 THEN 'reservoir' END AS landuse, CASE c_custkey % 9 WHEN 4 THEN 'pond' END AS water,
       CASE c_custkey % 2 WHEN 1 THEN 'yes' END AS building,
       CASE c_custkey % 7 WHEN 0 THEN '12.5' WHEN 1 THEN '12f' WHEN 2 THEN 'inf' WHEN 3 THEN ' 7 ' WHEN 4 THEN 'tall' END AS height,
       CASE c_custkey % 4 WHEN 0 THEN '3' WHEN 1 THEN 'x' END AS levels,
       CASE c_custkey % 5 WHEN 2 THEN 'stream' WHEN 3 THEN 'river' END AS waterway, concat('Ring ', CAST(c_custkey AS VARCHAR(20))) AS name
FROM customer""",
    "fx_corners": """
SELECT r.id, k.k, r.lon_e7 + CASE WHEN k.k IN (0, 3, 4) THEN -r.half_e7 ELSE r.half_e7 END AS lon_e7, r.lat_e7 + CASE WHEN k.k IN (0, 1, 4) THEN -r.half_e7 ELSE r.half_e7 END AS lat_e7
FROM fx_rings AS r CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS k(k)""",
    "fx_tagged": f"""
SELECT s_suppkey AS id, -70.7 + (s_suppkey % 97) * 0.0005 AS lon, -33.5 + (s_suppkey % 79) * 0.0005 AS lat,
       {_pick("s_suppkey", PLACES)} AS place, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE s_name END AS name,
       CASE s_suppkey % 6 WHEN 0 THEN 'crossing' WHEN 1 THEN 'stop' WHEN 2 THEN 'give_way' WHEN 3 THEN 'traffic_signals' WHEN 4 THEN 'bus_stop' END AS highway,
       CASE s_suppkey % 5 WHEN 0 THEN 'traffic_signals' WHEN 1 THEN 'zebra' END AS crossing, CASE s_suppkey % 4 WHEN 0 THEN 'yes' END AS crossing_signals,
       CASE s_suppkey % 10 WHEN 7 THEN 'level_crossing' WHEN 8 THEN 'crossing' WHEN 9 THEN 'station' END AS railway
FROM supplier""",
    # Relations of customers' rings: a nation is a relation, its customers' rings are members; some refer to ways that are missing.
    "fx_members": """
SELECT c_nationkey AS id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS place,
       CASE WHEN c_custkey % 13 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS ref,
       CASE c_custkey % 3 WHEN 0 THEN 'inner' WHEN 1 THEN 'outer' ELSE '' END AS role,
       CASE c_custkey % 10 WHEN 9 THEN 'node' ELSE 'way' END AS type
FROM customer""",
    "fx_relations": """
SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 7 = 3 THEN 'route' ELSE 'multipolygon' END AS type,
       CASE n_nationkey % 4 WHEN 0 THEN 'water' WHEN 1 THEN 'bay' WHEN 2 THEN 'lagoon' ELSE 'wood' END AS nature, CASE WHEN n_nationkey % 5 = 4 THEN 'pond' END AS water
FROM nation""",
    # Payloads of few kinds under ids in a row, with gaps.
    "fx_blobs": """
SELECT c_custkey + CAST(floor(c_custkey / 10) AS BIGINT) AS tile_id, concat(c_mktsegment, CAST(CAST(floor(c_custkey / 7) AS BIGINT) % 3 AS VARCHAR(9))) AS payload
FROM customer WHERE c_custkey % 11 <> 5""",
}
USES = {
    "fx_nodes": ["fx_vertices"],
    "fx_ways": ["fx_vertices"],
    "fx_corners": ["fx_rings"],
}


def text(*names: str) -> str:
    """WITH clauses that define the named fixtures and what they read."""
    wanted: list[str] = []
    for name in names:
        wanted += [x for x in (*USES.get(name, []), name) if x not in wanted]
    return "WITH " + ", ".join(f"{n} AS ({STATEMENTS[n]})" for n in wanted)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame; nothing is registered in the session's catalog."""
    statement = STATEMENTS[name]
    sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "customer", "supplier", "nation") if f"FROM {t}" in statement}
    sources |= {t: frame(spark, sf_dir, t) for t in USES.get(name, [])}
    for t in sources:
        statement = statement.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(statement, **sources)


def tags(**columns: str):
    """A map column from columns that hold tags; nulls are left out."""
    from itertools import chain

    pairs = chain.from_iterable((F.lit(k.replace("__", ":")), F.col(v)) for k, v in columns.items())
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def way_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories as ways: id, node_ids, tags, ordinal."""
    ids = frame(spark, sf_dir, "fx_vertices").groupBy(F.col("way_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda v: v["id"]).alias("node_ids"))
    own = frame(spark, sf_dir, "fx_ways")
    t = tags(highway="highway", name="name", bridge="bridge", tunnel="tunnel", ford="ford", oneway="oneway", natural="nature", waterway="waterway")
    return own.select("id", t.alias("tags"), F.col("id").alias("ordinal")).join(ids, "id").select("id", "node_ids", "tags", "ordinal")


def ring_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares as closed ways: id, node_ids, tags, ordinal."""
    t = tags(natural="nature", landuse="landuse", water="water", building="building", height="height", building__levels="levels", waterway="waterway", name="name")
    ids = F.transform(F.array(*map(F.lit, (0, 1, 2, 3, 0))), lambda k: F.col("id") * 4 + k)
    return frame(spark, sf_dir, "fx_rings").select("id", ids.alias("node_ids"), t.alias("tags"), F.col("id").alias("ordinal"))


def relation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = frame(spark, sf_dir, "fx_members").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "type", "ref", "role"))), lambda m: F.struct(m["type"], m["ref"], m["role"])).alias("members"))
    own = frame(spark, sf_dir, "fx_relations").select("id", tags(type="type", natural="nature", water="water").alias("tags"), F.col("id").alias("ordinal"))
    return own.join(members.withColumn("id", F.col("id").cast("long")), "id").select("id", "members", "tags", "ordinal")


def ring_points(spark: SparkSession, sf_dir: str, extent: int = 4096, zoom: int = 14) -> DataFrame:
    """Squares on the integer grid of a zoom, local to the tile of their middle: id, ring array<struct<x, y>> of four points."""
    from .functions import geometry as G
    from .functions import scalar as S

    z = F.lit(zoom)
    world = lambda c, of: S.world(of(c * 1e-7), z, extent)
    at = frame(spark, sf_dir, "fx_corners").where("k < 4").select("id", "k", world(F.col("lon_e7"), S.x_of).alias("x"), world(F.col("lat_e7"), S.y_of).alias("y"))
    mid = frame(spark, sf_dir, "fx_rings").select("id", F.floor(world(F.col("lon_e7"), S.x_of) / extent).alias("tx"), F.floor(world(F.col("lat_e7"), S.y_of) / extent).alias("ty"))
    local = at.join(mid, "id").select("id", "k", G.point(F.col("x") - F.col("tx") * extent, F.col("y") - F.col("ty") * extent).alias("p"))
    return local.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda v: v["p"]).alias("ring"))
