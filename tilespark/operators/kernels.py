"""State machines that Catalyst has no expression for, as Arrow functions: simplification, ring assembly, encoding."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.geometry import dedupe


def kept_by_rdp(xs: np.ndarray, ys: np.ndarray, tolerance: int) -> np.ndarray:
    """Indices that Ramer-Douglas-Peucker keeps: farther than the tolerance from their section's segment, the first of the farthest."""
    n = len(xs)
    if tolerance <= 0 or n < 3:
        return np.arange(n)
    x, y = xs.astype(np.float64), ys.astype(np.float64)
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    sections = [(0, n - 1)]
    while sections:
        a, b = sections.pop()
        if b - a < 2:
            continue
        px, py = x[a + 1 : b], y[a + 1 : b]
        dx, dy = x[b] - x[a], y[b] - y[a]
        length = dx * dx + dy * dy
        t = np.clip(((px - x[a]) * dx + (py - y[a]) * dy) / length, 0, 1) if length else np.zeros(b - a - 1)
        gap = (px - (x[a] + t * dx)) ** 2 + (py - (y[a] + t * dy)) ** 2
        far = int(gap.argmax())
        if gap[far] > tolerance * tolerance:
            middle = a + 1 + far
            keep[middle] = True
            sections += [(a, middle), (middle, b)]
    return np.flatnonzero(keep)


@arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _rdp(xs: pa.Array, ys: pa.Array, tolerance: pa.Array) -> pa.Array:
    rows = [
        None if px is None else [kept_by_rdp(np.array(a, np.int64), np.array(b, np.int64), t or 0).tolist() for a, b in zip(px, py)]
        for px, py, t in zip(xs.to_pylist(), ys.to_pylist(), tolerance.to_pylist())
    ]
    return pa.array(rows, pa.list_(pa.list_(pa.int32())))


def simplify(parts: Column, tolerance: Column) -> Column:
    """Each part simplified, then without repeated neighbours."""
    axis = lambda c: F.transform(parts, lambda p: F.transform(p, lambda v: v[c]))
    kept = _rdp(axis("x"), axis("y"), tolerance.cast("int"))
    return F.transform(kept, lambda k, i: dedupe(F.transform(k, lambda j: F.get(F.get(parts, i), j))))


def assemble_rings(fragments: list[list[int]]) -> list[list[int]]:
    """Closed rings, not repeating their first node, from fragments that meet at their ends.

    Fragments are taken in order; the open end is continued by the first unused
    fragment that has it as an end. A chain that does not close uses its
    fragments up.
    """
    at_end: dict[int, list[int]] = defaultdict(list)
    free = [len(f) >= 2 for f in fragments]
    for k, f in enumerate(fragments):
        if free[k]:
            for node in (f[0], f[-1]):
                at_end[node].append(k)
    rings = []
    for k, f in enumerate(fragments):
        if not free[k]:
            continue
        free[k] = False
        chain = list(f)
        while chain[0] != chain[-1]:
            follower = next((j for j in at_end[chain[-1]] if free[j]), None)
            if follower is None:
                break
            free[follower] = False
            piece = fragments[follower]
            chain += (piece if piece[0] == chain[-1] else piece[::-1])[1:]
        if chain[0] == chain[-1] and len(chain) >= 4:
            rings.append(chain[:-1])
    return rings


@arrow_udf(T.ArrayType(T.ArrayType(T.LongType())))
def rings_of(fragments: pa.Array) -> pa.Array:
    return pa.array([None if f is None else assemble_rings(f) for f in fragments.to_pylist()], pa.list_(pa.list_(pa.int64())))


# ---- protocol buffers ----


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def tag(number: int, wire: int) -> bytes:
    if number < 1:
        raise ValueError(f"no such field: {number}")
    return varint(number << 3 | wire)


def uint_field(number: int, n: int) -> bytes:
    return tag(number, 0) + varint(n)


def sint_field(number: int, n: int) -> bytes:
    return uint_field(number, (n << 1) ^ (n >> 63))


def bool_field(number: int, b: bool) -> bytes:
    return uint_field(number, int(b))


def double_field(number: int, v: float) -> bytes:
    return tag(number, 1) + struct.pack("<d", v)


def float_field(number: int, v: float) -> bytes:
    return tag(number, 5) + struct.pack("<f", v)


def bytes_field(number: int, data: bytes) -> bytes:
    return tag(number, 2) + varint(len(data)) + data


def text_field(number: int, text: str) -> bytes:
    return bytes_field(number, text.encode())


def packed_field(number: int, values: list[int]) -> bytes:
    return bytes_field(number, b"".join(map(varint, values))) if values else b""


def packed_sint_field(number: int, values: list[int]) -> bytes:
    return packed_field(number, [(v << 1) ^ (v >> 63) for v in values])


#: Field numbers of the vector tile format (fixed values).
LAYER = {"name": 1, "features": 2, "keys": 3, "values": 4, "extent": 5, "version": 15}
FEATURE = {"id": 1, "tags": 2, "type": 3, "geometry": 4}
VALUE = {"string": 1, "double": 3, "int": 4, "bool": 7}
TILE_LAYERS = 3


def encode_value(kind: str, value) -> bytes:
    if kind not in VALUE:
        raise ValueError(f"no tile value has the kind {kind}")
    write = {"string": text_field, "double": double_field, "int": uint_field, "bool": bool_field}[kind]
    return write(VALUE[kind], value)


def encode_layer(name: str, extent: int, features: list[dict]) -> bytes:
    """A layer message; features: id, type, geometry (command integers), attributes [(key, kind, value)]. Empty without geometry."""
    if extent < 1:
        raise ValueError("a layer's extent is at least 1")
    keys: dict[str, int] = {}
    values: dict[tuple, int] = {}
    body = []
    for f in features:
        if not f["geometry"]:
            continue
        tags = []
        for key, kind, value in f["attributes"]:
            if value is not None:
                tags += [keys.setdefault(key, len(keys)), values.setdefault((kind, value), len(values))]
        message = (uint_field(FEATURE["id"], f["id"]) if f["id"] is not None else b"") + packed_field(FEATURE["tags"], tags)
        body.append(bytes_field(LAYER["features"], message + uint_field(FEATURE["type"], f["type"]) + packed_field(FEATURE["geometry"], f["geometry"])))
    if not body:
        return b""
    head = [text_field(LAYER["name"], name)]
    tail = [text_field(LAYER["keys"], k) for k in keys] + [bytes_field(LAYER["values"], encode_value(*v)) for v in values]
    return bytes_field(TILE_LAYERS, b"".join([*head, *body, *tail, uint_field(LAYER["extent"], extent), uint_field(LAYER["version"], 2)]))


def layer_encoder(extent: int):
    """For groupBy(z, tile_id, layer).applyInArrow: rows in drawing order (sort_key) become one layer message."""

    def encode(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("rank", "ascending"), ("source", "ascending"), ("ordinal", "ascending")]).to_pylist()
        slot = {"string": "s", "int": "i", "double": "d", "bool": "b"}
        features = [{"id": r["id"], "type": r["type"], "geometry": r["commands"], "attributes": [(a["key"], a["kind"], a[slot[a["kind"]]]) for a in r["attributes"]]} for r in rows]
        first = rows[0]
        return pa.table({
            "z": pa.array([first["z"]], pa.int32()), "tile_id": pa.array([first["tile_id"]], pa.int64()), "layer": [first["layer"]],
            "rank": pa.array([first["rank"]], pa.int32()), "source": pa.array([first["source"]], pa.int32()), "ordinal": pa.array([first["ordinal"]], pa.int64()),
            "features": pa.array([len(rows)], pa.int64()), "message": pa.array([encode_layer(first["layer"], extent, features)], pa.binary()),
        })

    return encode


ENCODED_LAYER = "z int, tile_id bigint, layer string, rank int, source int, ordinal bigint, features bigint, message binary"


def gzipped(data: bytes, level: int = 9) -> bytes:
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(data) + packer.flush()


@arrow_udf(T.BinaryType())
def gzip(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else gzipped(x) for x in data.to_pylist()], pa.binary())
