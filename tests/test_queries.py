import collections
import math

import pytest
from compare import same
from pyspark.sql import functions as F
from test_kernels import fields, slow_rdp

import __spark_entry__ as entry
from tilespark import fixtures as X
from tilespark import queries as own
from tilespark.operators import tiles as T
from tilespark.schema import DeliverySchema, OpenMapTilesSchema

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    same(spark, own.QUERIES[name], own.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert not own.QUERIES[name](spark, SF).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


# ---- brute force for what SQL does not express ----
def whole(v):
    """Rounded, halves away from zero."""
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def on_grid(lon_e7, lat_e7, z):
    """Whole units of a zoom's grid, counted from its north-western corner."""
    lon, lat = lon_e7 * 1e-7, lat_e7 * 1e-7
    y = 0.5 - math.log((1 + math.sin(math.radians(lat))) / (1 - math.sin(math.radians(lat)))) / (4 * math.pi)
    return whole((lon / 360 + 0.5) * 4096 * 2**z), whole(y * 4096 * 2**z)


def without_repeats(points):
    return [p for i, p in enumerate(points) if i == 0 or p != points[i - 1]]


def cut_ring(ring, low, high):
    """Sutherland and Hodgman's way, one edge after another; crossings are rounded."""
    for axis, limit, keeps in ((0, low, lambda v: v >= low), (0, high, lambda v: v <= high), (1, low, lambda v: v >= low), (1, high, lambda v: v <= high)):
        out = []
        for a, b in zip([ring[-1], *ring[:-1]] if ring else [], ring):
            if keeps(a[axis]) != keeps(b[axis]):
                t = (limit - a[axis]) / (b[axis] - a[axis])
                other = whole(a[1 - axis] + t * (b[1 - axis] - a[1 - axis]))
                out.append((limit, other) if axis == 0 else (other, limit))
            if keeps(b[axis]):
                out.append(b)
        ring = out
    return without_repeats(ring)


def doubled(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]]))


def cut_segment(a, b, low, high):
    """The part inside the square, by the parameters where it enters and leaves; None without any."""
    first, last = 0.0, 1.0
    for axis in (0, 1):
        d = b[axis] - a[axis]
        for limit, side in ((low, -1), (high, 1)):
            gap = side * (limit - a[axis])
            if d == 0:
                if gap < 0:
                    return None
            elif side * d > 0:
                last = min(last, gap / (side * d))
            else:
                first = max(first, gap / (side * d))
    if first > last:
        return None
    at = lambda t: (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
    return at(first), at(last)


def trajectories(spark):
    found = collections.defaultdict(list)
    for r in X.frame(spark, SF, "fx_vertices").orderBy("way_id", "pos").collect():
        found[r.way_id].append((r.lon_e7, r.lat_e7))
    return found


def area_tiles(z):
    box = own.AREA
    (x0, y0), (x1, y1) = on_grid(round(box.min_lon * 1e7), round(box.max_lat * 1e7), z), on_grid(round(box.max_lon * 1e7), round(box.min_lat * 1e7), z)
    return range(x0 // 4096, x1 // 4096 + 1), range(y0 // 4096, y1 // 4096 + 1)


def test_simplified_lines_against_recursion(spark):
    found = collections.defaultdict(list)
    for r in own.QUERIES["rdp_simplify"](spark, SF).orderBy("id", "k").collect():
        found[r.id].append((r.x, r.y))
    lines = {i: [(x - own.LINE_X * 4096, y - own.LINE_Y * 4096) for x, y in (on_grid(*p, 13) for p in points)] for i, points in trajectories(spark).items()}
    assert len(found) > 5 and all(found[i] == without_repeats(slow_rdp(line, 1000)) for i, line in lines.items() if len(line) > 1)


def test_binned_lines_against_brute_force(spark):
    """Every tile of every line; lengths inside the buffered squares agree but for rounding."""
    schema, classes = DeliverySchema(min_zoom=11, max_zoom=13), {}
    ways = own.J.classify_ways(X.way_table(spark, SF), schema).where("type = 2").collect()
    shapes = trajectories(spark)
    found = {(r.z, r.tx, r.ty, r.id): r.parts for r in own.binned(spark, SF, False).collect()}
    length = lambda runs: sum(math.dist(a, b) for run in runs for a, b in zip(run, run[1:]))
    expected = {}
    for way in ways:
        for z in range(max(11, way.min_zoom), 14):
            line = without_repeats(slow_rdp([on_grid(*p, z) for p in shapes[way.id]], 2 if z == 13 else 4))
            columns, rows = area_tiles(z)
            for tx in columns:
                for ty in rows:
                    local = [(x - tx * 4096, y - ty * 4096) for x, y in line]
                    cuts = [c for c in (cut_segment(a, b, -64, 4160) for a, b in zip(local, local[1:])) if c]
                    inside = sum(math.dist(*c) for c in cuts)
                    if inside > 4:
                        expected[z, tx, ty, way.id] = (inside, 2 * len(cuts))
    assert len(expected) > 20
    for key, (inside, most) in expected.items():
        assert abs(length([[(v.x, v.y) for v in run] for run in found[key]]) - inside) <= most + 2
    # What brute force left out touches a square by a corner.
    assert all(length([[(v.x, v.y) for v in run] for run in found[key]]) <= 16 for key in set(found) - set(expected))


def test_binned_areas_against_brute_force(spark):
    """Squares, simplified and cut: the same tiles and the same areas to the unit."""
    schema = OpenMapTilesSchema(min_zoom=12)
    corners = collections.defaultdict(list)
    for r in X.frame(spark, SF, "fx_corners").where("k < 4").orderBy("id", "k").collect():
        corners[r.id].append((r.lon_e7, r.lat_e7))
    expected = {}
    for ring in own.J.classify_ways(X.ring_table(spark, SF), schema).where("type = 3").collect():
        for z in range(max(12, ring.min_zoom), 15):
            shape = without_repeats(slow_rdp([on_grid(*p, z) for p in corners[ring.id]], 2 if z == 14 else 4))
            if len(shape) < 3:
                continue
            columns, rows = area_tiles(z)
            for tx in columns:
                for ty in rows:
                    cut = cut_ring([(x - tx * 4096, y - ty * 4096) for x, y in shape], -64, 4160)
                    if len(cut) >= 3 and doubled(cut):
                        expected[z, tx, ty, ring.id] = abs(doubled(cut))
    found = {(r.z, r.tx, r.ty, r.id): abs(doubled([(v.x, v.y) for v in r.parts[0]])) for r in own.binned(spark, SF, True).collect()}
    assert len(expected) > 100 and {k: v for k, v in found.items() if v} == expected


def test_encoded_tiles_read_back(spark):
    """An independent reader finds every binned feature with its drawing commands."""
    binned = own.binned(spark, SF, False)
    expected = collections.defaultdict(dict)
    for r in binned.collect():
        path, x, y = [], 0, 0
        for run in r.parts:
            for k, v in enumerate(run):
                if k < 2:
                    path.append(1 << 3 | 1 if k == 0 else (len(run) - 1) << 3 | 2)
                path += [(d << 1) ^ (d >> 63) for d in (v.x - x, v.y - y)]
                x, y = v.x, v.y
        expected[r.tile_id, r.layer][r.id] = path
    found = collections.defaultdict(dict)

    def numbers(data):
        # Packed: one varint after another.
        out, n, shift = [], 0, 0
        for b in data:
            n, shift = n | (b & 127) << shift, shift + 7
            if b < 128:
                out, n, shift = [*out, n], 0, 0
        return out

    for row in T.encode_tiles(binned, 4096).collect():
        for number, layer in fields(row.tile):
            parts = fields(layer)
            assert number == 3
            for k, feature in parts:
                if k == 2:
                    own_fields = dict(fields(feature))
                    found[row.tile_id, dict(parts)[1].decode()][own_fields[1]] = numbers(own_fields[4])
    assert found == expected and len(found) > 5
