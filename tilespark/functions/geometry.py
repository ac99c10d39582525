"""Geometry on arrays of points (x, y: 64-bit integers) as higher-order Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import let, round_away

POINT = "struct<x:bigint,y:bigint>"
NO_POINTS = f"array<{POINT}>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))


def empty() -> Column:
    return F.array().cast(NO_POINTS)


def _before(points: Column, i: Column) -> Column:
    """The point before the i-th in a ring."""
    n = F.size(points)
    return F.get(points, F.pmod(i - 1 + n, n))


def dedupe(points: Column) -> Column:
    """Without points that equal the one before them."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def doubled_area(ring: Column) -> Column:
    """Twice the signed area; the last point joins the first."""
    terms = F.transform(ring, lambda p, i: _before(ring, i)["x"] * p["y"] - p["x"] * _before(ring, i)["y"])
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: a + t)


def orient(ring: Column, exterior: bool) -> Column:
    """Exterior rings wind to a positive area, holes do not; fewer than three points stay as they are."""
    wound = (doubled_area(ring) > 0) == F.lit(exterior)
    return F.when((F.size(ring) < 3) | wound, ring).otherwise(F.reverse(ring))


def contains(ring: Column, at: Column) -> Column:
    """Whether a point is inside by the even-odd rule."""

    def crossed(p: Column, i: Column) -> Column:
        q = _before(ring, i)
        spans = (p["y"] > at["y"]) != (q["y"] > at["y"])
        part = (at["y"] - p["y"]).cast("double") / F.when(spans, q["y"] - p["y"]).cast("double")
        return F.coalesce(spans & (at["x"] < p["x"] + part * (q["x"] - p["x"])), F.lit(False))

    return F.size(F.filter(F.transform(ring, crossed), lambda c: c)) % 2 == 1


def bounds(parts: Column) -> Column:
    """(min_x, min_y, max_x, max_y) over all points of all parts."""
    flat = F.flatten(parts)
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def _cross(a: Column, b: Column, axis: str, at: int) -> Column:
    """Where the segment a-b meets axis = at; asked for only where it does, null where the ends agree."""
    other = "y" if axis == "x" else "x"
    span = F.nullif(b[axis] - a[axis], F.lit(0)).cast("double")
    met = round_away(a[other] + (b[other] - a[other]).cast("double") * (F.lit(at) - a[axis]) / span)
    return point(F.lit(at), met) if axis == "x" else point(met, F.lit(at))


def _clip_edge(ring: Column, axis: str, at: int, keep_above: bool) -> Column:
    inside = (lambda p: p[axis] >= at) if keep_above else (lambda p: p[axis] <= at)

    def pieces(p: Column, i: Column) -> Column:
        q = _before(ring, i)
        crossing = F.array(_cross(q, p, axis, at))
        now, then = inside(p), inside(q)
        return F.when(now & then, F.array(p)).when(now, F.concat(crossing, F.array(p))).when(then, crossing).otherwise(empty())

    return F.flatten(F.transform(ring, pieces))


def clip_ring(ring: Column, low: int, high: int) -> Column:
    """The ring inside the square low..high, edge by edge, rounded at every crossing; empty below three points."""

    def ended(r: Column) -> Column:
        n = F.size(r)
        closed = (n >= 3) & (F.get(r, F.lit(0)) == F.get(r, n - 1))
        short = F.when(closed, F.slice(r, 1, F.greatest(n - 1, F.lit(1)))).otherwise(r)
        return let(short, lambda s: F.when(F.size(s) < 3, empty()).otherwise(s))

    # Each pass is bound before the next reads it twice.
    passes = [("x", low, True), ("x", high, False), ("y", low, True), ("y", high, False)]

    def run(r: Column, k: int) -> Column:
        return ended(r) if k == 4 else let(_clip_edge(r, *passes[k]), lambda s: run(s, k + 1))

    return F.when(F.size(ring) < 3, empty()).otherwise(let(ring, lambda r: run(r, 0)))


def clip_segment(a: Column, b: Column, low: int, high: int) -> Column:
    """A struct (a, b) of the part inside the square, rounded at the end, or null."""
    lo, hi = F.lit(float(low)), F.lit(float(high))
    start = F.struct(*(p[c].cast("double").alias(f"{c}{k}") for k, p in enumerate((a, b)) for c in "xy"), F.lit(False).alias("gone"))

    def step(s: Column, _: Column) -> Column:
        x0, y0, x1, y1 = (s[c] for c in ("x0", "y0", "x1", "y1"))
        beyond = lambda side: [f(v) for v in side for f in ((lambda v: v < lo), (lambda v: v > hi))]
        l0, r0, b0, t0 = beyond((x0, y0))
        l1, r1, b1, t1 = beyond((x1, y1))
        gone = s["gone"] | (l0 & l1) | (r0 & r1) | (b0 & b1) | (t0 & t1)
        out0, out1 = l0 | r0 | b0 | t0, l1 | r1 | b1 | t1
        top, bottom, right = (F.when(out0, p).otherwise(q) for p, q in ((t0, t1), (b0, b1), (r0, r1)))
        flat, level = F.nullif(y1 - y0, F.lit(0.0)), F.nullif(x1 - x0, F.lit(0.0))
        edge_y = F.when(top, hi).otherwise(lo)
        edge_x = F.when(right, hi).otherwise(lo)
        by_row = top | bottom
        x = F.when(by_row, x0 + (x1 - x0) * (edge_y - y0) / flat).otherwise(edge_x)
        y = F.when(by_row, edge_y).otherwise(y0 + (y1 - y0) * (edge_x - x0) / level)
        idle = gone | ~(out0 | out1)
        pick = lambda mine, moved, old: F.when(~idle & mine, moved).otherwise(old)
        return F.struct(pick(out0, x, x0).alias("x0"), pick(out0, y, y0).alias("y0"), pick(~out0, x, x1).alias("x1"), pick(~out0, y, y1).alias("y1"), gone.alias("gone"))

    # Each end is cut twice at most; the fifth step only sees whether both are inside.
    ended = F.aggregate(F.sequence(F.lit(1), F.lit(5)), start, step)
    ends = lambda s: F.struct(point(round_away(s["x0"]), round_away(s["y0"])).alias("a"), point(round_away(s["x1"]), round_away(s["y1"])).alias("b"))
    return let(ended, lambda s: F.when(~s["gone"], ends(s)))


def clip_line(line: Column, low: int, high: int) -> Column:
    """The runs of a line inside the square, an array of arrays."""
    segments = F.transform(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), lambda p, i: F.struct(clip_segment(p, F.get(line, i + 1), low, high).alias("cut"), F.get(line, i + 1).alias("to")))

    def goes_on(cuts: Column, i: Column) -> Column:
        """Whether segment i continues the one before it: that one was not cut at its end."""
        before = F.get(cuts, i - 1)
        return (i > 0) & before["cut"].isNotNull() & (before["cut"]["b"] == before["to"]) & (before["cut"]["b"] == F.get(cuts, i)["cut"]["a"])

    def begins(cuts: Column) -> Column:
        places = F.transform(cuts, lambda c, i: F.when(c["cut"].isNotNull() & ~F.coalesce(goes_on(cuts, i), F.lit(False)), i))
        return F.filter(places, lambda i: i.isNotNull())

    def run(cuts: Column, first: Column, after: Column) -> Column:
        own = F.filter(F.slice(cuts, first + 1, after - first), lambda c: c["cut"].isNotNull())
        return F.concat(F.array(F.get(cuts, first)["cut"]["a"]), F.transform(own, lambda c: c["cut"]["b"]))

    runs = lambda cuts, starts: F.transform(starts, lambda first, k: run(cuts, first, F.coalesce(F.get(starts, k + 1), F.size(cuts))))
    return let(segments, lambda cuts: let(begins(cuts), lambda starts: runs(cuts, starts)))


def owner_of(outers: Column, hole: Column) -> Column:
    """The place, from 0, of the smallest ring that holds the hole's first point, the first among equals; or -1."""
    first = F.get(hole, F.lit(0))
    found = F.filter(F.transform(outers, lambda r, i: F.struct(F.abs(doubled_area(r)).alias("area"), i.alias("at"), contains(r, first).alias("holds"))), lambda c: c["holds"])
    return F.coalesce(F.array_min(found)["at"], F.lit(-1))


def nest(outers: Column, inners: Column) -> Column:
    """Outer rings wound outwards, each followed by its own holes; holes that no ring holds are dropped."""

    def parts(rings: Column) -> Column:
        holes = F.transform(F.filter(inners, lambda h: F.size(h) >= 3), lambda h: F.struct(owner_of(rings, h).alias("at"), orient(h, False).alias("ring")))
        return let(holes, lambda hs: F.flatten(F.transform(rings, lambda r, i: F.concat(F.array(r), F.transform(F.filter(hs, lambda h: h["at"] == i), lambda h: h["ring"])))))

    return let(F.transform(outers, lambda r: orient(r, True)), parts)


def zigzag(v: Column) -> Column:
    return F.call_function("shiftleft", v, F.lit(1)).bitwiseXOR(F.call_function("shiftright", v, F.lit(63)))


#: Command numbers of the vector tile format (fixed values).
MOVE_TO, LINE_TO, CLOSE_PATH = 1, 2, 7
#: The largest parameter that the format holds.
MAX_PARAMETER = (1 << 31) - 1


def command(kind: int, count: Column) -> Column:
    return count.cast("long") * 8 + kind


def parameter(v: Column) -> Column:
    """A delta in zig-zag form; raises beyond what the format holds."""
    return F.when(F.abs(v) <= MAX_PARAMETER, zigzag(v)).otherwise(F.raise_error(F.lit("a geometry delta leaves 32 bits")).cast("long"))


def _deltas(points: Column, cursor: Column) -> Column:
    """Zig-zag deltas x, y of the points, from the cursor on."""
    return F.flatten(F.transform(points, lambda p, i: F.array(parameter(p["x"] - F.when(i == 0, cursor["x"]).otherwise(F.get(points, i - 1)["x"])), parameter(p["y"] - F.when(i == 0, cursor["y"]).otherwise(F.get(points, i - 1)["y"])))))


def _origin() -> Column:
    return point(F.lit(0), F.lit(0))


def encode_points(parts: Column) -> Column:
    flat = F.flatten(parts)
    return F.when(F.size(flat) > 0, F.concat(F.array(command(MOVE_TO, F.size(flat))), _deltas(flat, _origin()))).otherwise(F.array().cast("array<bigint>"))


def encode_lines(parts: Column, close: bool) -> Column:
    """Command integers of lines or rings; degenerate parts are skipped and do not move the cursor."""
    least = 3 if close else 2

    def ended(p: Column) -> Column:
        n = F.size(p)
        return F.when((n > 1) & (F.get(p, F.lit(0)) == F.get(p, n - 1)), F.slice(p, 1, F.greatest(n - 1, F.lit(1)))).otherwise(p) if close else p

    drawn = F.filter(F.transform(parts, ended), lambda p: F.size(p) >= least)

    def encoded(all_parts: Column, p: Column, i: Column) -> Column:
        n = F.size(p)
        before = F.get(all_parts, i - 1)
        cursor = F.when(i == 0, _origin()).otherwise(F.get(before, F.size(before) - 1))
        pieces = [F.array(command(MOVE_TO, F.lit(1))), _deltas(F.slice(p, 1, 1), cursor), F.array(command(LINE_TO, n - 1)), _deltas(F.slice(p, 2, F.greatest(n - 1, F.lit(1))), F.get(p, F.lit(0)))]
        if close:
            pieces.append(F.array(command(CLOSE_PATH, F.lit(1))))
        return F.concat(*pieces)

    return let(drawn, lambda all_parts: F.flatten(F.transform(all_parts, lambda p, i: encoded(all_parts, p, i))))
