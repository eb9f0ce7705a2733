"""Planar overlay: clip, erase, mosaic, dissolve, clean, buffer.

The kernel splits all segments where they meet, tells for each piece which
polygons lie left and right of it, and keeps for a wanted combination the
pieces with it on one side only; these chain to rings. All operators are one
call with another wanted combination. A group (the columns ``by``: a slice,
say) is one call; ``tiled`` cuts features by a grid, so that a large layer is
many groups, and dissolving by key joins the pieces again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogeo.session import by_keys, durable_table, spread

PRECISION = 8
#: Groups of so many points together are noded in one call.
MOST_POINTS = 50_000
GREATEST_TILE, LEAST_TILE = 64.0, 2.0**-10
TILE = ["tile_x", "tile_y"]
Ring = list[tuple[float, float]]
Polygon = list[Ring]
GEOM = "array<array<array<array<double>>>>"


def _segments(polygons: list[list[Polygon]]) -> tuple[np.ndarray, np.ndarray]:
    """The sides of polygons, each with the number of its polygon."""
    rings, owner = [], []
    for k, parts in enumerate(polygons):
        for part in parts:
            rings += part
            owner += [k] * len(part)
    points = np.array([(p[0], p[1]) for ring in rings for p in ring], float).reshape(-1, 2)
    if not len(points):
        return np.zeros((0, 4)), np.zeros(0, int)
    points = np.round(points, PRECISION)
    n = np.array([len(ring) for ring in rings])
    after = np.arange(1, len(points) + 1)
    ends = np.cumsum(n)[n > 0]
    after[ends - 1] = ends - n[n > 0]  # back to the beginning of the ring
    seg = np.column_stack([points, points[after]])
    real = (seg[:, :2] != seg[:, 2:]).any(axis=1)
    return seg[real], np.repeat(np.array(owner, int), n)[real]


def _spans(low: np.ndarray, high: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i, j with low[i] <= j < high[i], some at a time."""
    n = np.maximum(high - low, 0)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        past = int(ends[at - 1]) if at else 0
        to = max(int(np.searchsorted(ends, past + most, "right")), at + 1)
        own = n[at:to]
        i = np.repeat(np.arange(at, to), own)
        yield i, np.arange(len(i)) - np.repeat(ends[at:to] - own - past, own) + low[i]
        at = to


def _rank(group: np.ndarray, value: np.ndarray, of: np.ndarray, at: np.ndarray, right: bool) -> np.ndarray:
    """searchsorted() of values within groups; group, value are sorted, by group first."""
    low, high = np.searchsorted(group, of, "left"), np.searchsorted(group, of, "right")
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        mid = np.minimum((low + high) // 2, max(len(value) - 1, 0))
        is_open = low < high
        up = is_open & ((value[mid] <= at) if right else (value[mid] < at))
        low, high = np.where(up, mid + 1, low), np.where(is_open & ~up, mid, high)
    return low


def _long_axis(low: np.ndarray, high: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """For each group whether it is higher than wide."""
    size = []
    for c in (0, 1):
        least, most = np.full(groups, np.inf), np.full(groups, -np.inf)
        np.minimum.at(least, group, low[:, c])
        np.maximum.at(most, group, high[:, c])
        size.append(most - least)
    return size[1] > size[0]


def _noded(seg: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pieces of all segments, split where they meet others of their group, smaller end first, and their groups; and which piece every split part is, with its segment."""
    lo, hi = np.minimum(seg[:, :2], seg[:, 2:]), np.maximum(seg[:, :2], seg[:, 2:])
    high = _long_axis(lo, hi, group, int(group.max(initial=-1)) + 1)[group]
    begin, end = np.where(high, lo[:, 1], lo[:, 0]), np.where(high, hi[:, 1], hi[:, 0])
    order = np.lexsort((begin, group))
    eps = 10.0**-PRECISION
    until = _rank(group[order], begin[order], group[order], end[order] + eps, True)
    at, share = [np.arange(len(seg)), np.arange(len(seg))], [np.zeros(len(seg)), np.ones(len(seg))]
    across_low, across_high = (np.where(high, v[:, 0], v[:, 1])[order] for v in (lo, hi))
    for a, b in _spans(np.arange(1, len(seg) + 1), until):
        near = (across_low[b] <= across_high[a] + eps) & (across_high[b] >= across_low[a] - eps)
        i, j = order[a[near]], order[b[near]]
        r, s, gap = seg[i, 2:] - seg[i, :2], seg[j, 2:] - seg[j, :2], seg[j, :2] - seg[i, :2]
        det = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
        long = np.hypot(r[:, 0], r[:, 1])
        skew = np.abs(det) > 1e-12 * long * np.hypot(s[:, 0], s[:, 1])
        off = gap[:, 0] * r[:, 1] - gap[:, 1] * r[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (gap[:, 0] * s[:, 1] - gap[:, 1] * s[:, 0]) / det, off / det
        hit = skew & (t >= -1e-12) & (t <= 1 + 1e-12) & (u >= -1e-12) & (u <= 1 + 1e-12)
        at += [i[hit], j[hit]]
        share += [t[hit], u[hit]]
        along = ~skew & (np.abs(off) <= eps * long)
        i, j, r, s, gap = i[along], j[along], r[along], s[along], gap[along]
        rr, ss = (r * r).sum(axis=1), (s * s).sum(axis=1)
        for of, t in ((i, (gap * r).sum(axis=1) / rr), (i, ((gap + s) * r).sum(axis=1) / rr), (j, -(gap * s).sum(axis=1) / ss), (j, ((r - gap) * s).sum(axis=1) / ss)):
            on = (t > 0) & (t < 1)
            at.append(of[on])
            share.append(t[on])
    of, t = np.concatenate(at), np.clip(np.concatenate(share), 0, 1)
    order = np.lexsort((t, of))
    of, t = of[order], t[order]
    new = np.append(True, (of[1:] != of[:-1]) | (t[1:] != t[:-1]))
    of, t = of[new], t[new]
    points = np.round(seg[of, :2] + t[:, None] * (seg[of, 2:] - seg[of, :2]), PRECISION)
    points[t == 0], points[t == 1] = seg[of[t == 0], :2], seg[of[t == 1], 2:]
    follows = of[1:] == of[:-1]
    pieces, owner = np.column_stack([points[:-1], points[1:]])[follows] + 0.0, of[:-1][follows]
    real = (pieces[:, :2] != pieces[:, 2:]).any(axis=1)
    pieces, owner = pieces[real], owner[real]
    swap = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    pieces[swap] = pieces[swap][:, [2, 3, 0, 1]]
    order = np.lexsort((*pieces.T[::-1], group[owner]))
    pieces, owner = pieces[order], owner[order]
    new = np.append(True, (pieces[1:] != pieces[:-1]).any(axis=1) | (group[owner[1:]] != group[owner[:-1]]))[: len(pieces)]
    return pieces[new], group[owner[new]], np.cumsum(new) - 1, owner


def _covers(polygons: list[list[Polygon]], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of polygons, noded within groups (ascending), and their groups; and what covers them: piece, polygon, whether on the left, whether on the right.

    Whether a polygon covers the upper side of a flat piece, or the right side of a steep one, is told by the polygon's own
    pieces that a ray from the middle of the piece crosses; the piece itself isn't one of them, so that no rounding can put
    it on either side of itself. Only polygons whose box holds the middle are asked, and of these the pieces near the ray.
    """
    seg, owner = _segments(polygons)
    if not len(seg):
        return np.zeros((0, 4)), np.zeros(0, int), *(np.zeros(0, t) for t in (int, int, bool, bool))
    pieces, at, which, part = _noded(seg, group[owner])
    count = len(polygons)
    key, times = np.unique(owner[part] * len(pieces) + which, return_counts=True)
    key = key[times % 2 == 1]  # by polygon, then piece
    own, of = key % len(pieces), key // len(pieces)
    middle = (pieces[:, :2] + pieces[:, 2:]) / 2
    low, high = np.full((count, 2), np.inf), np.full((count, 2), -np.inf)
    np.minimum.at(low, of, np.minimum(pieces[own, :2], pieces[own, 2:]))
    np.maximum.at(high, of, np.maximum(pieces[own, :2], pieces[own, 2:]))
    real = np.flatnonzero(low[:, 0] <= high[:, 0])
    upright = _long_axis(low[real], high[real], group[real], int(group.max()) + 1)
    axis = upright[group[real]].astype(int)
    begin, reach = low[real, axis], np.zeros(len(upright))
    np.maximum.at(reach, group[real], high[real, axis] - begin)
    order = np.lexsort((begin, group[real]))
    place = middle[np.arange(len(pieces)), upright[at].astype(int)]
    sorted_group, sorted_begin = group[real][order], begin[order]
    found = [_rank(sorted_group, sorted_begin, at, place - reach[at] - 1e-7, False), _rank(sorted_group, sorted_begin, at, place + 1e-7, True)]
    p, k = [], []
    across = middle[np.arange(len(pieces)), 1 - upright[at].astype(int)]
    across_low, across_high = (v[real, 1 - axis][order] for v in (low, high))
    end = high[real, axis][order]
    for i, j in _spans(*found):
        near = (across_low[j] <= across[i] + 1e-7) & (across_high[j] >= across[i] - 1e-7) & (end[j] >= place[i] - 1e-7)
        p.append(i[near])
        k.append(real[order[j[near]]])
    p, k = np.concatenate(p), np.concatenate(k)
    d = pieces[:, 2:] - pieces[:, :2]
    flat = np.abs(d[:, 0]) >= np.abs(d[:, 1])
    beyond = np.zeros(len(p), bool)
    for some, x1, y1, x2, y2 in ((np.flatnonzero(~flat[p]), 0, 1, 2, 3), (np.flatnonzero(flat[p]), 1, 0, 3, 2)):
        b_low, b_high = np.minimum(pieces[own, y1], pieces[own, y2]), np.maximum(pieces[own, y1], pieces[own, y2])
        reach = np.zeros(count)
        np.maximum.at(reach, of, b_high - b_low)
        order = np.lexsort((b_low, of))
        a, b = middle[p[some], x1], middle[p[some], y1]
        mine = k[some]
        first, last = _rank(of[order], b_low[order], mine, b - reach[mine] - 1e-9, False), _rank(of[order], b_low[order], mine, b, True)
        crossed = np.zeros(len(some), int)
        for i, j in _spans(first, last):
            e = own[order[j]]
            a1, b1, a2, b2 = (pieces[e, c] for c in (x1, y1, x2, y2))
            with np.errstate(divide="ignore", invalid="ignore"):
                where = a1 + (b[i] - b1) / (b2 - b1) * (a2 - a1)
            hit = ((b1 > b[i]) != (b2 > b[i])) & (where > a[i]) & (e != p[some[i]])
            crossed += np.bincount(i[hit], minlength=len(some))
        beyond[some] = crossed % 2 == 1
    mine = k * len(pieces) + p
    spot = np.minimum(np.searchsorted(key, mine), max(len(key) - 1, 0))
    before = beyond ^ (key[spot] == mine if len(key) else False)
    # The side of the ray: above a flat piece, which leads east, is its left; east of a steep one is its right, if it leads north.
    is_left = (flat | (d[:, 1] < 0))[p]
    left, right = np.where(is_left, beyond, before), np.where(is_left, before, beyond)
    some = left | right
    return pieces, at, p[some], k[some], left[some], right[some]


def regions(groups: list[list[tuple[int, list[Polygon]]]], wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[list[Polygon]]:
    """For each group of polygons, each of kind 0 or 1, the area for which wanted (whether any of kind 0 covers it, any of kind 1) holds.

    All groups are one call: most groups are small, and one by one their cost is that of the calls.
    """
    out: list[list[Polygon]] = [[] for _ in groups]
    at = 0
    while at < len(groups):
        to, n = at, 0
        while to < len(groups) and (to == at or n < MOST_POINTS):
            n += sum(len(ring) for _, parts in groups[to] for part in parts for ring in part)
            to += 1
        some = groups[at:to]
        polygons = [parts for members in some for _, parts in members]
        kind = np.array([c for members in some for c, _ in members], int)
        group = np.repeat(np.arange(len(some)), [len(members) for members in some])
        pieces, of, p, k, left, right = _covers(polygons, group)
        sides = []
        for side in (left, right):
            has = np.zeros((2, len(pieces)), bool)
            has[kind[k[side]], p[side]] = True
            sides.append(wanted(has[0], has[1]))
        forth, back = sides[0] & ~sides[1], sides[1] & ~sides[0]
        edges = np.vstack([pieces[forth], pieces[back][:, [2, 3, 0, 1]]])
        home = np.concatenate([of[forth], of[back]])
        order = np.argsort(home, kind="stable")
        edges, home = edges[order], home[order]
        bounds = np.searchsorted(home, np.arange(len(some) + 1)).tolist()
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if a < b:
                out[at + i] = _polygons(_rings(edges[a:b]))
        at = to
    return out


def inside(points: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Even-odd test of points against the segments of one polygon."""
    out = np.zeros(len(points), bool)
    for at in range(0, len(points), 2048):
        p = points[at : at + 2048]
        x1, y1, x2, y2 = (c[None, :] for c in seg.T)
        above = (y1 > p[:, 1:]) != (y2 > p[:, 1:])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = x1 + (p[:, 1:] - y1) / (y2 - y1) * (x2 - x1)
        out[at : at + 2048] = (above & (p[:, :1] < x)).sum(axis=1) % 2 == 1
    return out


class Arrangement:
    """Pieces of a set of polygons, and which polygons lie left and right of each."""

    def __init__(self, polygons: list[list[Polygon]]):
        self.n = len(polygons)
        self.pieces, _, *self.covers = _covers(polygons, np.zeros(self.n, int))

    def _side(self, side: int) -> np.ndarray:
        out = np.zeros((len(self.pieces), self.n), bool)
        p, k = self.covers[:2]
        out[p[self.covers[side]], k[self.covers[side]]] = True
        return out

    @property
    def left(self) -> np.ndarray:
        return self._side(2)

    @property
    def right(self) -> np.ndarray:
        return self._side(3)

    def region(self, wanted: Callable[[np.ndarray], np.ndarray]) -> list[Polygon]:
        """Polygons of the area whose covering rows satisfy wanted (rows of booleans -> booleans)."""
        l, r = wanted(self.left), wanted(self.right)
        a = self.pieces[l & ~r]
        b = self.pieces[r & ~l][:, [2, 3, 0, 1]]
        return _polygons(_rings(np.vstack([a, b])))

    def cells(self) -> list[tuple[tuple[int, ...], list[Polygon]]]:
        """The mosaic: each combination of covering polygons that occurs, and its area."""
        p, k, left, right = self.covers
        sides: list[list[tuple[int, ...]]] = []
        for side in (left, right):
            own: list[list[int]] = [[] for _ in range(len(self.pieces))]
            for i, j in zip(p[side].tolist(), k[side].tolist()):
                own[i].append(j)
            sides.append([tuple(sorted(x)) for x in own])
        around: dict[tuple[int, ...], list] = {}
        for piece, l, r in zip(self.pieces, *sides):
            if l != r:
                around.setdefault(l, []).append(piece)
                around.setdefault(r, []).append(piece[[2, 3, 0, 1]])
        return [(cover, _polygons(_rings(np.array(around[cover])))) for cover in sorted(c for c in around if c)]


def _rings(edges: np.ndarray) -> list[Ring]:
    """Chains of directed edges with the area on their left; at a crossing the sharpest left turn is taken."""
    after: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for x1, y1, x2, y2 in edges.tolist():
        after.setdefault((x1, y1), []).append((x2, y2))
    out = []
    while after:
        start = next(iter(after))
        ring, at, came = [start], start, None
        while True:
            options = after[at]
            if came is None or len(options) == 1:
                k = 0
            else:
                back = math.atan2(came[1] - at[1], came[0] - at[0])
                k = min(range(len(options)), key=lambda i: (back - math.atan2(options[i][1] - at[1], options[i][0] - at[0])) % (2 * math.pi) or 2 * math.pi)
            following = options.pop(k)
            if not options:
                del after[at]
            came, at = at, following
            ring.append(at)
            if at == start or at not in after:
                break
        if ring[-1] != start:  # pieces that round to one another may leave a gap
            ring.append(start)
        if len(ring) > 3:
            out.append(ring)
    return out


def ring_area(ring: Ring) -> float:
    p = np.asarray(ring)
    return float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2)


def area(parts: list[Polygon]) -> float:
    return sum(abs(ring_area(rings[0])) - sum(abs(ring_area(h)) for h in rings[1:]) for rings in parts)


def _polygons(rings: list[Ring]) -> list[Polygon]:
    """Outer rings (counter-clockwise) with the holes that lie in them."""
    areas = [ring_area(r) for r in rings]
    outer = [[rings[k]] for k in sorted((k for k, a in enumerate(areas) if a > 0), key=areas.__getitem__)]
    holes = [r for r, a in zip(rings, areas) if a < 0]
    if not holes:
        return outer
    boxes = np.array([_box([p]) for p in outer]).reshape(-1, 4)
    for hole in holes:
        x, y = (hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2
        near = np.flatnonzero((boxes[:, 0] <= x) & (boxes[:, 2] >= x) & (boxes[:, 1] <= y) & (boxes[:, 3] >= y))
        home = next((outer[k] for k in near.tolist() if inside(np.array([[x, y]]), np.column_stack([np.asarray(outer[k][0])[:-1], np.asarray(outer[k][0])[1:]]))[0]), None)
        if home is not None:
            home.append(hole)
    return outer


def _box(parts: list[Polygon]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for rings in parts for p in rings[0]], [p[1] for rings in parts for p in rings[0]]
    return min(xs), min(ys), max(xs), max(ys)


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a & b


def _only(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a & ~b


def _any(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a | b


def intersection(a: list[Polygon], b: list[Polygon]) -> list[Polygon]:
    return regions([[(0, a), (1, b)]], _both)[0]


def difference(a: list[Polygon], b: list[Polygon]) -> list[Polygon]:
    return regions([[(0, a), (1, b)]], _only)[0]


def unions(groups: list[list[list[Polygon]]]) -> list[list[Polygon]]:
    return regions([[(0, parts) for parts in polygons] for polygons in groups], _any)


def union(polygons: list[list[Polygon]]) -> list[Polygon]:
    return unions([polygons])[0]


def capsule(p: tuple[float, float], q: tuple[float, float], r: float, steps: int) -> Polygon:
    """All within r of a segment, with round ends."""
    a = math.atan2(q[1] - p[1], q[0] - p[0])
    arc = [math.pi / 2 + math.pi * i / (2 * steps) for i in range(2 * steps + 1)]
    ring = [(p[0] + r * math.cos(a + t), p[1] + r * math.sin(a + t)) for t in arc] + [(q[0] + r * math.cos(a + math.pi + t), q[1] + r * math.sin(a + math.pi + t)) for t in arc]
    return [[*ring, ring[0]]]


def _straight(ring: Ring) -> Ring:
    """A ring or line without the points on which it goes straight on: what is near a segment doesn't depend on its division."""
    out = [tuple(p[:2]) for p in ring[:1]]
    for p in ring[1:]:
        q = tuple(p[:2])
        if len(out) > 1:
            (ax, ay), (bx, by) = out[-2], out[-1]
            if (bx - ax) * (q[1] - by) == (by - ay) * (q[0] - bx) and (bx - ax) * (q[0] - bx) + (by - ay) * (q[1] - by) > 0:
                out.pop()
        out.append(q)
    return out


def buffers(shapes: list[list[Polygon]], distances: list[float], steps: int = 5, lines: bool = False) -> list[list[Polygon]]:
    """Polygons (or lines) grown by distances of their own, or shrunk by negative ones; round joins."""
    out: list[list[Polygon]] = list(shapes)
    grown, shrunk = {}, {}
    for k, (parts, distance) in enumerate(zip(shapes, distances)):
        turns = [_straight(ring) for rings in parts for ring in rings]
        edges = [[capsule(p, q, abs(distance), steps)] for ring in turns for p, q in zip(ring, ring[1:]) if p != q]
        if not edges or not distance:
            out[k] = [] if lines else parts
        elif distance > 0:
            grown[k] = [(0, g) for g in (edges if lines else [parts, *edges])]
        else:
            shrunk[k] = [(0, parts), *[(1, g) for g in edges]]
    for groups, wanted in ((grown, _any), (shrunk, _only)):
        for k, g in zip(groups, regions(list(groups.values()), wanted)):
            out[k] = g
    return out


def buffer(parts: list[Polygon], distance: float, steps: int = 5, lines: bool = False) -> list[Polygon]:
    """A geometry grown by a distance, or shrunk by a negative one."""
    return buffers([parts], [distance], steps, lines)[0]


def some_rows(*columns: pa.Array, most: int = 1 << 21) -> Iterator[list[list]]:
    """Rows of Arrow columns as lists, so many at a time as take about so many bytes."""
    step = max(1, len(columns[0]) * most // max(sum(c.nbytes for c in columns), 1))
    for at in range(0, len(columns[0]), step):
        yield [c.slice(at, step).to_pylist() for c in columns]


def dissolve(layer: DataFrame, keys: list[str]) -> DataFrame:
    """keys, coords: the union of the polygons (column coords) of each key."""

    def udf(groups: pa.Array) -> pa.Array:
        from chronogeo.operators.overlay import some_rows, unions

        return pa.array([g for (rows,) in some_rows(groups) for g in unions(rows)], groups.type.value_type)

    return by_keys(layer.select(*keys, "coords"), keys).groupBy(*keys).agg(F.collect_list("coords").alias("coords")).withColumn("coords", F.arrow_udf(udf, GEOM)("coords"))


def dissolve_fields(layer: DataFrame, keys: list[str], copy: tuple[str, ...] = (), total: tuple[str, ...] = (), order: str = "fid", most: int = 20_000) -> DataFrame:
    """dissolve() with fields of the first row of each key (by order) and sums of others; keys may be null. Keys with more than so many vertices are cut into tiles."""
    one = [F.min_by(c, order).alias(c) for c in copy] + [F.sum(c).alias(c) for c in total]
    fields = layer.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"), *one)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    whole = dissolve_tiled(layer, keys, tile_size([layer], keys, most))
    return whole.join(fields, same).select(*keys, *copy, *total, "coords")


def cleaned(coords, least: float):
    """Geometries without overlaps of their own parts, parts smaller than an area, and holes smaller than it."""

    def udf(shapes: pa.Array) -> pa.Array:
        from chronogeo.operators.overlay import ring_area, some_rows, unions

        out = []
        for (rows,) in some_rows(shapes):
            found = unions([[[part] for part in g or ()] for g in rows])
            big = [[[r for i, r in enumerate(part) if i == 0 or abs(ring_area(r)) >= least] for part in whole if abs(ring_area(part[0])) >= least] for whole in found]
            out += [None if g is None else x for g, x in zip(rows, big)]
        return pa.array(out, shapes.type)

    return F.arrow_udf(udf, GEOM)(coords)


def dissolve_tiled(layer: DataFrame, keys: list[str], size: float | None) -> DataFrame:
    """dissolve(), within tiles of a size first: then only parts that reach the border of a tile meet in one task."""
    if size is None:
        return dissolve(layer, keys)
    at = lambda k: F.transform(F.col("_part")[0], lambda p: p[k])
    within = [(F.array_min(at(k)) > F.col(tile) * size + 1e-7) & (F.array_max(at(k)) < (F.col(tile) + 1) * size - 1e-7) for k, tile in enumerate(TILE)]
    inner = within[0] & within[1]
    pieces = dissolve(tiled(layer.select(*keys, "coords"), size), [*keys, *TILE]).select(*keys, *TILE, F.explode("coords").alias("_part"))
    pieces = durable_table(pieces.select(*keys, F.array("_part").alias("coords"), inner.alias("_inner")))
    met = dissolve(pieces.filter("NOT _inner"), keys)
    every = pieces.filter("_inner").drop("_inner").unionByName(met)
    return every.groupBy(*keys).agg(F.flatten(F.collect_list("coords")).alias("coords"))  # of one feature


def met(layer: DataFrame, mask: DataFrame, by: list[str]) -> DataFrame:
    """_rows (the layer's rows of a group, as structs) and _mask (the geometries of the mask's rows of that group; empty without any).

    Both come in one shuffle: a join of groups would deal them anew, and put small ones, whose kernel costs much, into few tasks.
    """
    rows = layer.select(*by, F.struct(*[F.col(f"`{c}`") for c in layer.columns]).alias("_row"), F.lit(None).cast(mask.schema["coords"].dataType).alias("_shape"))
    shapes = mask.select(*by, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col("coords").alias("_shape"))
    groups = by_keys(rows.unionByName(shapes), by).groupBy(*by).agg(F.collect_list("_row").alias("_rows"), F.collect_list("_shape").alias("_mask"))
    return groups.filter(F.size("_rows") > 0).select("_rows", "_mask")


def with_shapes(layer: DataFrame, groups: DataFrame, cut: Column) -> DataFrame:
    """The layer's rows out of the groups of met(), each with its own of the geometries in cut; those with none are dropped."""
    pairs = groups.select("_rows", cut.alias("_cut")).select(F.explode(F.arrays_zip("_rows", "_cut")).alias("_r")).filter(F.size("_r._cut") > 0)
    return pairs.select(*[F.col("_r._cut").alias(c) if c == "coords" else F.col(f"_r._rows.`{c}`").alias(c) for c in layer.columns])


def _cut_by(shapes: list, cover: list[Polygon], erase: bool) -> list[list[tuple[int, list[Polygon]]]]:
    """For each geometry the polygons of a call of regions(): itself, and what of the cover comes near."""
    boxes = np.array([_box([part]) for part in cover]).reshape(-1, 4)
    out = []
    for g in shapes:
        near = []
        if g:
            x1, y1, x2, y2 = _box(g)
            near = [(1, [cover[k]]) for k in np.flatnonzero((boxes[:, 0] <= x2) & (boxes[:, 2] >= x1) & (boxes[:, 1] <= y2) & (boxes[:, 3] >= y1))]
        out.append([(0, g), *near] if g and (near or erase) else [])
    return out


def _against(layer: DataFrame, mask: DataFrame, by: list[str], erase: bool) -> DataFrame:
    def udf(shapes: pa.Array, masks: pa.Array) -> pa.Array:
        from chronogeo.operators.overlay import _both, _cut_by, _only, regions, some_rows, unions

        out = []
        for own, others in some_rows(shapes, masks):
            groups = [_cut_by(g, cover, erase) for g, cover in zip(own, unions([x or [] for x in others]))]
            # What nothing of the mask comes near stays as it is.
            alone = [members[0][1] if len(members) == 1 else None for of in groups for members in of]
            done = regions([[] if len(members) == 1 else members for of in groups for members in of], _only if erase else _both)
            cut = iter([a if a is not None else g for a, g in zip(alone, done)])
            out += [[next(cut) for _ in of] for of in groups]
        return pa.array(out, shapes.type)

    groups = met(layer, mask, by)
    return with_shapes(layer, groups, F.arrow_udf(udf, f"array<{GEOM}>")(F.col("_rows.coords"), F.col("_mask")))


def clip(layer: DataFrame, mask: DataFrame, by: list[str]) -> DataFrame:
    """Features' parts inside the mask of the same group (slice, tile); properties stay."""
    return _against(layer, mask, by, erase=False)


def erase(layer: DataFrame, mask: DataFrame, by: list[str]) -> DataFrame:
    """Features' parts outside the mask of the same group."""
    return _against(layer, mask, by, erase=True)


def mosaic(layer: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """by, covers (orders of the covering features, lowest first), coords: the planar partition of each group."""
    cell = f"array<struct<covers:array<bigint>,coords:{GEOM}>>"
    kind = pa.list_(pa.struct([("covers", pa.list_(pa.int64())), ("coords", pa.list_(pa.list_(pa.list_(pa.list_(pa.float64())))))]))

    def udf(orders: pa.Array, shapes: pa.Array) -> pa.Array:
        from chronogeo.operators.overlay import Arrangement, some_rows

        out = [[{"covers": [n[k] for k in cover], "coords": region} for cover, region in Arrangement(g).cells()] for numbers, own in some_rows(orders, shapes) for n, g in zip(numbers, own)]
        return pa.array(out, kind)

    rows = layer.select(*by, F.struct(F.col(order).cast("bigint").alias("ord"), "coords").alias("_f"))
    rows = by_keys(rows, by).groupBy(*by).agg(F.array_sort(F.collect_list("_f")).alias("_f"))
    return rows.select(*by, F.arrow_udf(udf, cell)(F.col("_f.ord"), F.col("_f.coords")).alias("_c")).select(*by, F.inline("_c"))


def tile_size(layers: list[DataFrame], by: list[str], most: int) -> float | None:
    """None if no group of the layers together has more than so many vertices, else the greatest tile size at which no tile has.

    Where features pile up so that even ``LEAST_TILE`` doesn't part them, that size is given.
    """
    pts = reduce(DataFrame.unionByName, [x.select(*by, F.explode(F.flatten(F.flatten("coords"))).alias("p")) for x in layers])
    pts = pts.select(*by, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))

    def crowd(*cells) -> int:
        return pts.groupBy(*by, *cells).count().agg(F.max("count")).first()[0] or 0

    if crowd() <= most:
        return None
    size = GREATEST_TILE
    while size > LEAST_TILE and crowd(F.floor(F.col("x") / size), F.floor(F.col("y") / size)) > most:
        size /= 2
    return size


def tiled(layer: DataFrame, size: float) -> DataFrame:
    """Features cut by square tiles of a size, with tile_x, tile_y: more grouping columns for the operators above."""
    pts = F.flatten(F.flatten("coords"))
    cell = lambda f, k: F.floor(f(F.transform(pts, lambda p: p[k])) / size).cast("int")
    dealt = layer.withColumn("tile_x", F.explode(F.sequence(cell(F.array_min, 0), cell(F.array_max, 0)))).withColumn("tile_y", F.explode(F.sequence(cell(F.array_min, 1), cell(F.array_max, 1))))

    def udf(shapes: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
        from chronogeo.operators.overlay import _both, _box, regions, some_rows

        out = []
        for own, columns, lines in some_rows(shapes, xs, ys):
            groups, whole = [], {}
            for k, (g, x, y) in enumerate(zip(own, columns, lines)):
                a, b = x * size, y * size
                x1, y1, x2, y2 = _box(g)
                if a <= x1 and x2 <= a + size and b <= y1 and y2 <= b + size:
                    whole[k] = g
                groups.append([] if k in whole else [(0, g), (1, [[[(a, b), (a + size, b), (a + size, b + size), (a, b + size), (a, b)]]])])
            out += [whole.get(k, g) for k, g in enumerate(regions(groups, _both))]
        return pa.array(out, shapes.type)

    # Not to be repeated: else Spark would test what is left of a feature before rows are spread, and cut it again after.
    cut = F.arrow_udf(udf, GEOM).asNondeterministic()("coords", "tile_x", "tile_y")
    return spread(dealt).withColumn("coords", cut).filter(F.size("coords") > 0)


def exploded(layer: DataFrame) -> DataFrame:
    """One row per polygon of a feature."""
    return layer.withColumn("coords", F.explode("coords")).withColumn("coords", F.array("coords"))


def boundaries(layer: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """by, keep, x1, y1, x2, y2: each feature's outline in pieces that neighbours of the same group share exactly."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        from chronogeo.operators.overlay import Arrangement

        pdf = pdf[pdf["coords"].notna()]
        net = Arrangement([[[[tuple(p) for p in ring] for ring in part] for part in g] for g in pdf["coords"]])
        piece, feature = np.nonzero(net.left != net.right)
        out = pdf[[*by, *keep]].iloc[feature].reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(net.pieces[piece], columns=["x1", "y1", "x2", "y2"])], axis=1)

    head = ", ".join(f"`{k}` {layer.schema[k].dataType.simpleString()}" for k in [*by, *keep])
    return layer.select(*by, *keep, "coords").groupBy(*by).applyInPandas(run, f"{head}, x1 double, y1 double, x2 double, y2 double")
