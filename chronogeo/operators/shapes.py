"""Shapes of single features: smoothing, simplifying, detailing, label points, dots. Kernels run on Arrow batches."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogeo.functions.noise import simplex
from chronogeo.operators import edges
from chronogeo.operators.overlay import GEOM, inside, ring_area, union
from chronogeo.session import by_keys, durable_table

CUTOFF = 85.0
_SCALE = 180 / (math.degrees(math.asinh(math.tan(math.radians(CUTOFF)))) + 90 - CUTOFF)


def per_geometry(coords: Column, f: Callable[[list], list | None]) -> Column:
    """A geometry kernel on [part][ring][point] lists; null stays null."""

    def udf(rows: pa.Array) -> pa.Array:
        return pa.array([None if g is None else f(g) for g in rows.to_pylist()], rows.type)

    return F.arrow_udf(udf, GEOM)(coords)


def _map_y(lat: float) -> float:
    return math.degrees(math.asinh(math.tan(math.radians(max(-CUTOFF, min(CUTOFF, lat)))))) * _SCALE


def _map_lat(y: float) -> float:
    return math.degrees(math.atan(math.sinh(math.radians(y / _SCALE))))


def centripetal_midpoint(p0, p1, p2, p3) -> tuple[float, float]:
    """Point halfway between p1 and p2 on the centripetal Catmull-Rom curve through four points (Barry and Goldman's pyramid)."""
    t = [0.0]
    for a, b in ((p0, p1), (p1, p2), (p2, p3)):
        t.append(t[-1] + math.dist(a, b) ** 0.5)
    at = (t[1] + t[2]) / 2

    def mix(a, b, s, e):
        if e == s:
            return a
        return tuple((x * (e - at) + y * (at - s)) / (e - s) for x, y in zip(a, b))

    a1, a2, a3 = mix(p0, p1, t[0], t[1]), mix(p1, p2, t[1], t[2]), mix(p2, p3, t[2], t[3])
    return mix(mix(a1, a2, t[0], t[2]), mix(a2, a3, t[1], t[3]), t[1], t[2])


def _between(p0: np.ndarray, p1: np.ndarray, p2: np.ndarray, p3: np.ndarray) -> np.ndarray:
    """centripetal_midpoint() of many; points are rows."""
    t0 = np.zeros(len(p0))
    t1 = t0 + np.sqrt(np.hypot(*(p1 - p0).T))
    t2 = t1 + np.sqrt(np.hypot(*(p2 - p1).T))
    t3 = t2 + np.sqrt(np.hypot(*(p3 - p2).T))
    at = (t1 + t2) / 2

    def mix(a, b, s, e):
        gap = np.where(e == s, 1.0, e - s)
        return np.where((e == s)[:, None], a, (a * (e - at)[:, None] + b * (at - s)[:, None]) / gap[:, None])

    a1, a2, a3 = mix(p0, p1, t0, t1), mix(p1, p2, t1, t2), mix(p2, p3, t2, t3)
    return mix(mix(a1, a2, t0, t2), mix(a2, a3, t1, t3), t1, t2)


def smoothed(lines: list[list], passes: int = 3, low: float = 0.1, high: float = 175.0) -> list[list]:
    """Curve points on both sides of each bend between the two angles, up to so many times, in map space; all lines together."""
    size = np.array([len(line) for line in lines], int)
    pts = np.array([p[:2] for line in lines for p in line], float).reshape(-1, 2)
    of = np.repeat(np.arange(len(lines)), size)
    pts[:, 1] = np.degrees(np.arcsinh(np.tan(np.radians(np.clip(pts[:, 1], -CUTOFF, CUTOFF))))) * _SCALE
    for _ in range(passes):
        n = len(pts)
        inner = np.flatnonzero((of[1:-1] == of[:-2]) & (of[1:-1] == of[2:])) + 1 if n > 2 else np.zeros(0, int)
        on, back = pts[inner + 1] - pts[inner], pts[inner - 1] - pts[inner]
        turn = np.degrees(np.arctan2(on[:, 1], on[:, 0]) - np.arctan2(back[:, 1], back[:, 0])) % 360
        turn = np.minimum(turn, 360 - turn)
        bends = inner[(low < turn) & (turn < high)]
        cut = np.zeros(n, bool)
        cut[bends - 1] = cut[bends] = True
        at = np.flatnonzero(cut)
        if not len(at):
            break
        p, q = pts[at], pts[at + 1]
        first = (at == 0) | (of[at - 1] != of[at])
        last = (at + 2 >= n) | (of[np.minimum(at + 2, n - 1)] != of[at])
        before = np.where(first[:, None], 2 * p - q, pts[at - 1])
        after = np.where(last[:, None], 2 * q - p, pts[np.minimum(at + 2, n - 1)])
        mid = _between(before, p, q, after)
        real = ~np.isnan(mid).any(axis=1)
        pts, of = np.insert(pts, at[real] + 1, mid[real], axis=0), np.insert(of, at[real] + 1, of[at[real]])
    pts[:, 1] = np.degrees(np.arctan(np.sinh(np.radians(pts[:, 1] / _SCALE))))
    ends = np.searchsorted(of, np.arange(len(lines) + 1)).tolist()
    every = pts.tolist()
    return [every[a:b] for a, b in zip(ends, ends[1:])]


def smooth_line(line: list, passes: int = 3, low: float = 0.1, high: float = 175.0) -> list:
    return smoothed([line], passes, low, high)[0]


def smooth_lines(layer: DataFrame) -> DataFrame:
    """Lines smoothed unless no_smooth is true; one row per line."""
    layer = layer.withColumn("coords", F.explode("coords")).withColumn("coords", F.array("coords"))

    def udf(rows: pa.Array) -> pa.Array:
        from chronogeo.operators.overlay import some_rows
        from chronogeo.operators.shapes import smoothed

        out = []
        for (shapes,) in some_rows(rows):
            done = iter(smoothed([r for g in shapes for part in g or () for r in part]))
            out += [None if g is None else [[next(done) for _ in part] for part in g] for g in shapes]
        return pa.array(out, rows.type)

    smooth = F.arrow_udf(udf, GEOM)(F.col("coords"))
    return layer.withColumn("coords", F.when(F.coalesce(F.col("no_smooth"), F.lit(False)), F.col("coords")).otherwise(smooth))


def cut_corners(ring: list, rounds: int, offset: float = 0.3, max_angle: float = 180.0) -> list:
    """Chaikin's corner cutting of a closed ring, for corners up to an angle."""
    for _ in range(rounds):
        pts, out = ring[:-1], []
        n = len(pts)
        if n < 3:
            break
        for i in range(n):
            a, b, c = pts[i - 1], pts[i], pts[(i + 1) % n]
            turn = abs(math.degrees(math.atan2(c[1] - b[1], c[0] - b[0]) - math.atan2(a[1] - b[1], a[0] - b[0]))) % 360
            if min(turn, 360 - turn) <= max_angle:
                out += [[b[0] + (a[0] - b[0]) * offset, b[1] + (a[1] - b[1]) * offset], [b[0] + (c[0] - b[0]) * offset, b[1] + (c[1] - b[1]) * offset]]
            else:
                out.append(list(b))
        ring = [*out, out[0]]
    return ring


def buffered(coords: Column, distance: Column | float, steps: int = 5, lines: bool = False) -> Column:
    """Geometries grown by a distance, or shrunk by a negative one."""

    def udf(rows: pa.Array, by: pa.Array) -> pa.Array:
        from chronogeo.operators.overlay import buffers, some_rows

        return pa.array([g for shapes, distances in some_rows(rows, by) for g in buffers([g or [] for g in shapes], distances, steps, lines)], rows.type)

    return F.when(coords.isNotNull(), F.arrow_udf(udf, GEOM)(coords, distance if isinstance(distance, Column) else F.lit(float(distance))))


def rounded(coords: Column, rounds: int, max_angle: float) -> Column:
    return per_geometry(coords, lambda g: [[cut_corners(r, rounds, 0.3, max_angle) for r in part] for part in g])


def detailed_edges(a: np.ndarray, b: np.ndarray, longest: float, strength: float = 0.2) -> list[np.ndarray]:
    """Points of edges from a to b, both included: midpoints moved sideways by noise, in so many rounds of halving as bring an edge's length to the longest.

    The noise depends on both ends alike, so an edge and its reverse get the same points.
    """
    length = np.hypot(*(b - a).T)
    rounds = np.where(length > longest, np.ceil(np.log2(np.maximum(length, longest) / longest)), 0).astype(int)
    out: list[np.ndarray] = [np.zeros((0, 2))] * len(a)
    for n in np.unique(rounds).tolist():
        own = np.flatnonzero(rounds == n)
        pts = np.stack([a[own], b[own]], axis=1)
        for _ in range(n):
            p, q = pts[:, :-1], pts[:, 1:]
            back = ((q[..., 0] < p[..., 0]) | ((q[..., 0] == p[..., 0]) & (q[..., 1] < p[..., 1])))[..., None]
            way = np.where(back, p - q, q - p)
            shift = simplex(p[..., 0] + q[..., 0], p[..., 1] + q[..., 1])[..., None].astype(float) * strength
            mid = (p + q) / 2 + np.stack([-way[..., 1], way[..., 0]], axis=-1) * shift
            more = np.empty((len(own), 2 * pts.shape[1] - 1, 2))
            more[:, ::2], more[:, 1::2] = pts, mid
            pts = more
        for k, line in zip(own.tolist(), pts):
            out[k] = line
    return out


def _plain_edge(a, b) -> bool:
    return max(abs(a[1]), abs(b[1])) > 88 or (abs(a[0]) == 180 and a[0] == b[0])


def add_fractal_detail(layer: DataFrame, longest: float = 0.2) -> DataFrame:
    """Edges longer than the limit on the map get fractal detail, but for edges near the poles, along 180 degrees, or found twice in the layer."""
    rows = durable_table(layer.withColumn("_uid", F.monotonically_increasing_id()))
    rings = rows.select("_uid", F.posexplode(F.flatten("coords")).alias("ring", "r")).filter(F.size("r") > 1)
    side = lambda i: F.struct(*[F.element_at("r", i + k)[c].alias(f"{n}{k + 1}") for k in (0, 1) for c, n in enumerate("xy")])
    sides = rings.select("_uid", "ring", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("r") - 1), side)).alias("seq", "s"))
    sides = edges.normalised(sides.select("_uid", "ring", "seq", "s.*"), 7, wrap=True)
    twice = sides.groupBy(*edges.EDGE).count().filter("count > 1").drop("count")
    shared = sides.join(twice, list(edges.EDGE)).groupBy("_uid").agg(F.collect_list(F.struct("ring", "seq")).alias("_shared"))  # of one feature

    def udf(shapes: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for g, found in zip(shapes.to_pylist(), known.to_pylist()):
            if g is None:
                out.append(None)
                continue
            plain, ring, parts = {(s["ring"], s["seq"]) for s in found or ()}, -1, []
            for part in g:
                parts.append([])
                for r in part:
                    ring += 1
                    own = [seq for seq, (a, b) in enumerate(zip(r, r[1:])) if (ring, seq) not in plain and not _plain_edge(a, b)]
                    flat = np.array([[p[0], _map_y(p[1])] for p in r])
                    more = dict(zip(own, detailed_edges(flat[own], flat[[seq + 1 for seq in own]], longest))) if own else {}
                    line = [list(p) for p in r[:1]]
                    for seq, b in enumerate(r[1:]):
                        line += [[x, _map_lat(y)] for x, y in more[seq][1:-1].tolist()] if seq in more else []
                        line.append(list(b))
                    parts[-1].append(line)
            out.append(parts)
        return pa.array(out, shapes.type)

    detailed = rows.join(shared, "_uid", "left").withColumn("coords", F.arrow_udf(udf, GEOM)("coords", "_shared"))
    return detailed.select(*layer.columns)


def inner_points(shapes: list[list], rounds: int = 6) -> list[tuple[float, float] | None]:
    """For each geometry a point far from the outline of its largest part: grid search around the best of each round.

    Outlines of as many sides are searched together, so many at a time as fit a processor's cache.
    """
    out: list[tuple[float, float] | None] = [None] * len(shapes)
    alike: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, parts in enumerate(shapes):
        if parts:
            rings = max(parts, key=lambda p: abs(ring_area(p[0])))
            seg = np.vstack([np.column_stack([np.asarray(r)[:-1, :2], np.asarray(r)[1:, :2]]) for r in rings])
            alike.setdefault(len(seg), []).append((k, seg))
    xs, ys = (v.ravel() for v in np.meshgrid(np.linspace(-1, 1, 17), np.linspace(-1, 1, 17)))
    for n, own in alike.items():
        step = max(1, (1 << 16) // (n * len(xs)))
        for at in range(0, len(own), step):
            seg = np.stack([s for _, s in own[at : at + step]])
            x1, y1, x2, y2 = (seg[:, None, :, c] for c in range(4))
            dx, dy = x2 - x1, y2 - y1
            long = np.maximum(dx * dx + dy * dy, 1e-300)
            lo, hi = seg[:, :, :2].min(axis=1), seg[:, :, :2].max(axis=1)
            centre, reach, best, row = (lo + hi) / 2, (hi - lo) / 2, np.full(len(seg), -math.inf), np.arange(len(seg))
            for _ in range(rounds):
                px, py = (centre[:, c, None] + v * reach[:, c, None] for c, v in ((0, xs), (1, ys)))
                gx, gy = px[:, :, None] - x1, py[:, :, None] - y1
                t = np.clip((gx * dx + gy * dy) / long, 0, 1)
                far = np.hypot(gx - t * dx, gy - t * dy).min(axis=2)
                above = (y1 > py[:, :, None]) != (y2 > py[:, :, None])
                with np.errstate(divide="ignore", invalid="ignore"):
                    within = (above & (px[:, :, None] < x1 + gy / dy * dx)).sum(axis=2) % 2 == 1
                far = np.where(within, far, -far)
                k = far.argmax(axis=1)
                better = far[row, k] > best
                best = np.where(better, far[row, k], best)
                centre = np.where(better[:, None], np.column_stack([px[row, k], py[row, k]]), centre)
                reach = reach / 4
            for (k, _), place, far in zip(own[at : at + step], centre.tolist(), best.tolist()):
                out[k] = (place[0], place[1]) if far > -math.inf else None
    return out


def inner_point(parts: list, rounds: int = 6) -> tuple[float, float] | None:
    return inner_points([parts], rounds)[0]


def oriented_box(parts: list) -> tuple[float, float, float]:
    """width, height and angle (degrees clockwise from north of the long side) of the least rectangle around a geometry."""
    pts = sorted({(p[0], p[1]) for rings in parts for ring in rings for p in ring})
    half = lambda ps: [q for q in _hull(ps)]
    hull = half(pts) + half(pts[::-1])
    best = None
    for a, b in zip(hull, hull[1:] + hull[:1]):
        if a == b:
            continue
        t = math.atan2(b[1] - a[1], b[0] - a[0])
        c, s = math.cos(t), math.sin(t)
        u, v = [p[0] * c + p[1] * s for p in hull], [p[1] * c - p[0] * s for p in hull]
        w, h = max(u) - min(u), max(v) - min(v)
        if best is None or w * h < best[0] - 1e-12:
            long = t if w >= h else t + math.pi / 2
            best = (w * h, min(w, h), max(w, h), (90 - math.degrees(long)) % 180)
    return (0.0, 0.0, 0.0) if best is None else best[1:]


def _hull(pts: list) -> list:
    out = []
    for p in pts:
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
            out.pop()
        out.append(p)
    return out[:-1]


LABEL_POINT = "struct<lng:double,lat:double,width:double,height:double,box_angle:double>"


def label_point(coords: Column) -> Column:
    """Inner point and oriented box of a geometry."""

    def udf(rows: pa.Array) -> pa.Array:
        out = []
        shapes = rows.to_pylist()
        for g, p in zip(shapes, inner_points(shapes)):
            w, h, a = oriented_box(g) if g else (None, None, None)
            out.append(None if p is None else {"lng": p[0], "lat": p[1], "width": w, "height": h, "box_angle": a})
        return pa.array(out, pa.struct([(n, pa.float64()) for n in ("lng", "lat", "width", "height", "box_angle")]))

    return F.arrow_udf(udf, LABEL_POINT)(coords)


def dots(parts: list, n: int, key: str) -> list[list[float]]:
    """n points spread over a polygon: a low-discrepancy sequence over its box, kept where inside; the same for the same key."""
    seg = np.vstack([np.column_stack([np.asarray(r)[:-1, :2], np.asarray(r)[1:, :2]]) for rings in parts for r in rings])
    lo, hi = seg[:, :2].min(axis=0), seg[:, :2].max(axis=0)
    start = int.from_bytes(hashlib.sha256(key.encode()).digest()[:4], "big") / 2**32
    out: list[list[float]] = []
    at, step, most = 0, max(64, min(4 * n, 4096)), 4096 * 64
    while at < most:
        i = np.arange(at, min(at + step, most))
        at, step = at + len(i), 4096
        p = np.column_stack([(start + i * 0.7548776662466927) % 1, (start + i * 0.5698402909980532) % 1]) * (hi - lo) + lo
        out += p[inside(p, seg)].tolist()
        if len(out) >= n:
            break
    return out[:n]


def _cut_ring(ring: list, axis: int, bound: float, below: bool) -> list:
    """The part of a closed ring on one side of a line along an axis."""
    out = []
    keep = lambda p: p[axis] <= bound if below else p[axis] >= bound
    for a, b in zip(ring, ring[1:]):
        if keep(a) != keep(b):
            t = (bound - a[axis]) / (b[axis] - a[axis])
            p = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
            p[axis] = bound
            out.append(p)
        if keep(b):
            out.append(list(b))
    return [out[-1], *out] if len(out) > 2 else []


def _cut_stretch(line: list, w: float, s: float, e: float, n: float) -> list[list]:
    """Stretches of a line within a box."""
    out, current = [], []
    for a, b in zip(line, line[1:]):
        low, high = 0.0, 1.0
        for axis, least, most in ((0, w, e), (1, s, n)):
            d = b[axis] - a[axis]
            if d == 0:
                if not least <= a[axis] <= most:
                    low, high = 1.0, 0.0
                continue
            t = sorted(((least - a[axis]) / d, (most - a[axis]) / d))
            low, high = max(low, t[0]), min(high, t[1])
        if low >= high:
            if len(current) > 1:
                out.append(current)
            current = []
            continue
        p, q = ([a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])] for t in (low, high))
        if low > 0 or not current:
            if len(current) > 1:
                out.append(current)
            current = [list(a) if low == 0 else p]
        current.append(list(b) if high == 1 else q)
    return [*out, current] if len(current) > 1 else out


def box_part(g: list, kind: str, w: float, s: float, e: float, n: float) -> list:
    """What of a geometry lies in a box."""
    if kind.endswith("Point"):
        return [[kept] for part in g for ring in part if (kept := [p for p in ring if w <= p[0] <= e and s <= p[1] <= n])]
    if kind.endswith("LineString"):
        return [[x] for part in g for ring in part for x in _cut_stretch(ring, w, s, e, n)]
    out = []
    for part in g:
        rings = []
        for ring in part:
            for axis, bound, below in ((0, w, False), (0, e, True), (1, s, False), (1, n, True)):
                ring = _cut_ring(ring, axis, bound, below) if ring else ring
            rings.append(ring)
        if rings and rings[0]:
            out.append([r for r in rings if r])
    return out


def box_parts(shapes: pa.Array, boxes: np.ndarray) -> pa.Array | None:
    """box_part() of many polygons (none null), each with its box (west, south, east, north): all rings are cut together. None if points aren't all pairs."""
    parts = shapes.values
    rings = parts.values
    points = rings.values
    of_shape, of_part, of_ring, of_point = (x.offsets.to_numpy() for x in (shapes, parts, rings, points))
    if (np.diff(of_point) != 2).any() or points.values.null_count:
        return None
    pts = np.asarray(points.values.to_numpy(zero_copy_only=False), float)[of_point[0] : of_point[-1]].reshape(-1, 2)
    part_ring = np.repeat(np.arange(len(parts)), np.diff(of_part))
    shape_part = np.repeat(np.arange(len(shapes)), np.diff(of_shape))
    ring_box, of = boxes[shape_part[part_ring]], np.repeat(np.arange(len(rings)), np.diff(of_ring))
    size = np.diff(of_ring)
    for axis, side, below in ((0, 0, False), (0, 2, True), (1, 1, False), (1, 3, True)):
        bound = ring_box[of, side]
        keep = pts[:, axis] <= bound if below else pts[:, axis] >= bound
        a = np.flatnonzero(of[1:] == of[:-1])
        kept, cross = keep[a + 1], keep[a] != keep[a + 1]
        start = np.cumsum(cross.astype(int) + kept) - cross - kept
        out, home = np.empty((int((cross.astype(int) + kept).sum()), 2)), np.repeat(of[a], cross.astype(int) + kept)
        p, q = pts[a[cross]], pts[a[cross] + 1]
        met = p + ((bound[a[cross]] - p[:, axis]) / (q[:, axis] - p[:, axis]))[:, None] * (q - p)
        met[:, axis] = bound[a[cross]]
        out[start[cross]], out[(start + cross)[kept]] = met, pts[a[kept] + 1]
        size = np.bincount(home, minlength=len(rings))
        real = size[home] > 2
        out, home, size = out[real], home[real], np.where(size > 2, size, 0)
        ends = np.cumsum(size[size > 0])
        pts, of = np.insert(out, ends - size[size > 0], out[ends - 1], axis=0), np.insert(home, ends - size[size > 0], home[ends - 1])
        size = np.where(size > 0, size + 1, 0)
    first = np.zeros(len(parts), bool)
    some = np.diff(of_part) > 0
    first[some] = size[(of_part[:-1] - of_part[0])[some]] > 0
    stays = (size > 0) & first[part_ring]
    up = lambda counts: np.append(0, np.cumsum(counts)).astype(np.int32)
    flat = pts[stays[of]]
    out = pa.ListArray.from_arrays(up(np.full(len(flat), 2)), pa.array(flat.ravel()))
    out = pa.ListArray.from_arrays(up(size[stays]), out)
    out = pa.ListArray.from_arrays(up(np.bincount(part_ring[stays], minlength=len(parts))[first]), out)
    return pa.ListArray.from_arrays(up(np.bincount(shape_part[first], minlength=len(shapes))), out)


def clipped_to_box(coords: Column, kind: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """Geometries cut by a box of their own row; empty where nothing lies in it."""

    def udf(*columns: pa.Array) -> pa.Array:
        from chronogeo.operators.shapes import box_part, box_parts

        shapes, kinds, *sides = columns
        told = [g and not (k or "").endswith(("Point", "LineString")) for g, k in zip(shapes.is_valid().to_pylist(), kinds.to_pylist())]
        some = np.flatnonzero(told)
        cut = box_parts(shapes.take(pa.array(some)), np.column_stack([x.to_numpy(zero_copy_only=False) for x in sides])[some]) if len(some) else None
        if cut is None:
            rows = zip(*(c.to_pylist() for c in columns))
            return pa.array([None if g is None else box_part(g, k or "", *b) for g, k, *b in rows], shapes.type)
        rest = [k for k, polygon in enumerate(told) if not polygon]
        others = zip(*(c.take(pa.array(rest, pa.int64())).to_pylist() for c in columns))
        more = pa.array([None if g is None else box_part(g, k or "", *b) for g, k, *b in others], shapes.type)
        order = np.argsort(np.concatenate([some, np.array(rest, int)]), kind="stable")
        return pa.concat_arrays([cut.cast(shapes.type), more]).take(pa.array(order))

    return F.arrow_udf(udf, GEOM)(coords, kind, w, s, e, n)


def _crosses(ring: list) -> bool:
    """Whether two sides of a closed ring that are no neighbours meet."""
    p = np.asarray(ring, float)
    a, b, n = p[:-1], p[1:], len(p) - 1
    side = lambda o, d, q: np.sign((d[..., 0] - o[..., 0]) * (q[..., 1] - o[..., 1]) - (d[..., 1] - o[..., 1]) * (q[..., 0] - o[..., 0]))
    for i in range(n - 2):
        js = np.arange(i + 2, n - (i == 0))
        o, d, u, v = a[i], b[i], a[js], b[js]
        meet = (side(o, d, u) * side(o, d, v) < 0) & (side(u, v, o) * side(u, v, d) < 0)
        if meet.any():
            return True
    return False


def crosses_itself(coords: Column) -> Column:
    """Whether a ring of a geometry crosses itself."""

    def udf(rows: pa.Array) -> pa.Array:
        from chronogeo.operators.shapes import _crosses

        return pa.array([g is not None and any(_crosses(r) for part in g for r in part if len(r) > 4) for g in rows.to_pylist()], pa.bool_())

    return F.arrow_udf(udf, "boolean")(coords)


def _midpoint(a: tuple, b: tuple) -> tuple[float, float]:
    turn, p, q = math.radians(b[0] - a[0]), math.radians(a[1]), math.radians(b[1])
    x, y = math.cos(q) * math.cos(turn), math.cos(q) * math.sin(turn)
    return a[0] + math.degrees(math.atan2(y, math.cos(p) + x)), math.degrees(math.atan2(math.sin(p) + math.sin(q), math.hypot(math.cos(p) + x, y)))


def great_circle(a: tuple, b: tuple, depth: int = 16) -> list[tuple]:
    """Points between two places, halved until each half turns by less than two degrees on the map."""
    m = _midpoint(a, b)
    at = lambda p: (p[0], math.degrees(math.asinh(math.tan(math.radians(max(-89.9, min(89.9, p[1])))))))
    (ax, ay), (mx, my), (bx, by) = at(a), at(m), at(b)
    angle = abs(math.degrees(math.atan2(by - my, bx - mx) - math.atan2(ay - my, ax - mx))) % 360
    if depth == 0 or 178 <= angle <= 182:
        return []
    return [*great_circle(a, m, depth - 1), m, *great_circle(m, b, depth - 1)]


def measured_lines(line: Column) -> Column:
    """A line (array of points) with great circle points between its own."""

    def udf(rows: pa.Array) -> pa.Array:
        from chronogeo.operators.shapes import great_circle

        out = []
        for r in rows.to_pylist():
            points = [tuple(p) for p in r or []]
            out.append(None if r is None else [list(p) for a, b in zip(points, points[1:]) for p in (a, *great_circle(a, b))] + [list(p) for p in points[-1:]])
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    return F.arrow_udf(udf, "array<array<double>>")(line)


def dot_points(coords: Column, n: Column, key: Column) -> Column:
    def udf(gs: pa.Array, ns: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.array([dots(g, m, k) if g and m else [] for g, m, k in zip(gs.to_pylist(), ns.to_pylist(), keys.to_pylist())], pa.list_(pa.list_(pa.float64())))

    return F.arrow_udf(udf, "array<array<double>>")(coords, n, key)


def pebbles(coords: Column, area: Column, key: Column) -> Column:
    """Small ellipses, one per 250 units of area, of seeded size and turn."""

    def udf(gs: pa.Array, areas: pa.Array, keys: pa.Array) -> pa.Array:
        out = []
        for g, a, k in zip(gs.to_pylist(), areas.to_pylist(), keys.to_pylist()):
            if not g:
                out.append(g)
                continue
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big"))
            rows = []
            for x, y in dots(g, max(1, int(a / 250)), k):
                h, turn = rng.uniform(0.0001, 0.0002) / 2, math.radians(rng.uniform(1, 360))
                ring = []
                for t in np.linspace(0, 2 * math.pi, 13):
                    u, v = 0.00005 * math.cos(t), h * math.sin(t)
                    ring.append([x + u * math.cos(turn) - v * math.sin(turn), y + u * math.sin(turn) + v * math.cos(turn)])
                ring[-1] = ring[0]
                rows.append([ring])
            out.append(rows)
        return pa.array(out, gs.type)

    return F.arrow_udf(udf, GEOM)(coords, area, key)


def tapered(line: list, widths: list[float], steps: int = 5) -> list:
    """Pieces with round ends for each segment of a line with a width at each vertex (in degrees)."""
    parts = []
    for (a, b), (u, v) in zip(zip(line, line[1:]), zip(widths, widths[1:])):
        d = math.dist(a[:2], b[:2])
        if not d:
            continue
        t = math.atan2(b[1] - a[1], b[0] - a[0])
        arc = [math.pi / 2 + math.pi * i / (2 * steps) for i in range(2 * steps + 1)]
        ring = [(a[0] + u * math.cos(t + s), a[1] + u * math.sin(t + s)) for s in arc] + [(b[0] + v * math.cos(t + math.pi + s), b[1] + v * math.sin(t + math.pi + s)) for s in arc]
        parts.append([[[*ring, ring[0]]]])
    return parts


def ribbon(line: list, widths: list[float], steps: int = 5) -> list:
    """Outline of a line with a width at each vertex (in degrees): the union of tapered pieces with round ends."""
    return union(tapered(line, widths, steps))


def ribbons(points: DataFrame, key: list[str]) -> DataFrame:
    """key, coords: outlines of chains; points: key, seq, lng, lat, half_width (degrees)."""
    chains = by_keys(points, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "lng", "lat", "half_width"))).alias("chain"))

    def udf(rows: pa.Array) -> pa.Array:
        from chronogeo.operators.overlay import some_rows, unions
        from chronogeo.operators.shapes import tapered

        found = []
        for (some,) in some_rows(rows):
            pieces = [tapered([(p["lng"], p["lat"]) for p in c], [p["half_width"] for p in c]) for c in some]
            # One piece alone is its own union: two half rounds and what lies between.
            done = iter(unions([p for p in pieces if len(p) > 1]))
            found += [next(done) if len(p) > 1 else p[0] if p else [] for p in pieces]
        return pa.array(found, pa.list_(pa.list_(pa.list_(pa.list_(pa.float64())))))

    return chains.select(*key, F.arrow_udf(udf, GEOM)("chain").alias("coords"))
