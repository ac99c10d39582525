import gzip
import random
import struct

import numpy as np
import pytest

from tilespark.operators import kernels as K
from tilespark.sources import pmtiles as P


def slow_rdp(points, tolerance):
    def gap(p, a, b):
        dx, dy = float(b[0] - a[0]), float(b[1] - a[1])
        if dx == 0 and dy == 0:
            return float(p[0] - a[0]) ** 2 + float(p[1] - a[1]) ** 2
        t = min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return (p[0] - (a[0] + t * dx)) ** 2 + (p[1] - (a[1] + t * dy)) ** 2

    if tolerance <= 0 or len(points) < 3:
        return points
    gaps = [gap(p, points[0], points[-1]) for p in points[1:-1]]
    far = max(gaps)
    if far <= tolerance**2:
        return [points[0], points[-1]]
    k = gaps.index(far) + 1
    return slow_rdp(points[: k + 1], tolerance)[:-1] + slow_rdp(points[k:], tolerance)


def test_rdp_against_recursion():
    rng = random.Random(4)
    for _ in range(300):
        points = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(0, 30))]
        xs, ys = (np.array([p[i] for p in points], np.int64) for i in (0, 1))
        tolerance = rng.choice([0, 1, 3, 10])
        assert [points[i] for i in K.kept_by_rdp(xs, ys, tolerance)] == slow_rdp(points, tolerance)


@pytest.mark.parametrize(
    "fragments, rings",
    [
        ([[1, 2, 3, 1]], [[1, 2, 3]]),
        ([[1, 2, 3], [3, 4, 1]], [[1, 2, 3, 4]]),
        ([[3, 4, 1], [1, 2, 3]], [[3, 4, 1, 2]]),
        ([[1, 2, 3], [1, 4, 3]], [[1, 2, 3, 4]]),
        ([[1, 2, 3]], []),
        ([[1, 2, 1]], []),
        ([[5]], []),
        ([], []),
        ([[1, 2], [11, 12], [2, 3], [12, 13], [3, 1], [13, 11]], [[1, 2, 3], [11, 12, 13]]),
        ([[1, 2, 3], [3, 4], [5, 6, 7, 5]], [[5, 6, 7]]),
    ],
)
def test_rings(fragments, rings):
    assert K.assemble_rings(fragments) == rings


def test_wire_format():
    assert [K.varint(n) for n in (0, 1, 127, 300)] == [b"\0", b"\1", b"\x7f", b"\xac\2"]
    assert len(K.varint(-1)) == 10
    assert [K.sint_field(1, n)[1:] for n in (0, -1, 1, -2)] == [b"\0", b"\1", b"\2", b"\3"]
    assert K.double_field(3, 1.5) == b"\x19" + struct.pack("<d", 1.5)
    assert K.packed_field(2, []) == b""
    with pytest.raises(ValueError):
        K.tag(0, 0)


def fields(data):
    """An independent reader: (number, value) pairs."""
    out, at = [], 0

    def number():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = number()
        if key & 7 == 0:
            out.append((key >> 3, number()))
        else:
            size = number() if key & 7 == 2 else 8
            out.append((key >> 3, data[at : at + size]))
            at += size
    return out


def test_layer_keeps_dictionaries_and_drops_what_collapsed():
    features = [
        {"id": 7, "type": 2, "geometry": [9, 0, 0, 10, 2, 2], "attributes": [("class", "string", "road"), ("n", "int", 1), ("gone", "string", None)]},
        {"id": 8, "type": 2, "geometry": [], "attributes": [("never", "string", "x")]},
        {"id": 9, "type": 2, "geometry": [9, 4, 4, 10, 2, 2], "attributes": [("class", "string", "road"), ("n", "double", 1.0), ("b", "bool", True)]},
    ]
    ((number, layer),) = fields(K.encode_layer("roads", 4096, features))
    assert number == 3
    found = fields(layer)
    assert [v for k, v in found if k == 3] == [b"class", b"n", b"b"]
    assert [dict(fields(v)) for k, v in found if k == 4] == [{1: b"road"}, {4: 1}, {3: struct.pack("<d", 1.0)}, {7: 1}]
    assert [dict(fields(v))[1] for k, v in found if k == 2] == [7, 9]
    assert dict(found)[15] == 2 and dict(found)[5] == 4096
    assert K.encode_layer("none", 4096, features[1:2]) == b""
    for bad in (lambda: K.encode_layer("x", 0, []), lambda: K.encode_value("date", 1)):
        with pytest.raises(ValueError):
            bad()


def test_gzip():
    assert gzip.decompress(K.gzipped(b"x" * 1000)) == b"x" * 1000


def test_header_and_directory():
    header = P.Header(root_length=5, addressed=9, min_zoom=2, max_zoom=4, min_lon=-70.7, min_lat=-33.5, max_lon=-70.65, max_lat=-33.46, center_zoom=3, center_lon=-70.6, center_lat=-33.5)
    data = header.to_bytes()
    assert len(data) == 127 and data[:7] == b"PMTiles" and P.Header.from_bytes(data) == header
    for bad in (data[:100], b"x" * 127, data[:7] + b"\2" + data[8:]):
        with pytest.raises(P.FormatError):
            P.Header.from_bytes(bad)
    entries = [(0, 0, 10, 1), (5, 10, 20, 50), (60, 0, 10, 1), (61, 30, 1, 1)]
    assert P.read_directory(P.write_directory(entries)) == entries
    for bad in (b"", b"\1", b"\xff" * 12, b"\1\0\1\1\0"):
        with pytest.raises(P.FormatError):
            P.read_directory(bad)


def test_leaves_appear_when_the_root_is_too_large():
    rng = random.Random(1)
    entries, at = [], 0
    for i in range(6000):
        n = rng.randint(1, 1 << 20)
        entries.append((i * 3, at, n, 1))
        at += n + rng.randint(0, 5)
    root, leaves = P.build_directories(entries, P.Compression.NONE)
    assert len(root) <= P.ROOT_BYTES and leaves
    found = [e for p in P.read_directory(root) for e in P.read_directory(leaves[p[1] : p[1] + p[2]])]
    assert found == entries
