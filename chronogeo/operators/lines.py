"""Line geometries: edges as lines, chains of edges, lines cut by polygons."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronogeo.operators.overlay import GEOM, TILE, met, tiled, with_shapes
from chronogeo.session import by_keys, by_size, durable_table

#: Shares of a segment that differ by less are the same place.
SAME = 1e-12


def polygon_edges(layer: DataFrame, keep: list[str]) -> DataFrame:
    """keep, x1, y1, x2, y2: the sides of all rings of a layer (column coords)."""
    rings = layer.select(*keep, F.explode(F.flatten("coords")).alias("r"))
    sides = F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.struct(F.element_at("r", i)[0].alias("x1"), F.element_at("r", i)[1].alias("y1"), F.element_at("r", i + 1)[0].alias("x2"), F.element_at("r", i + 1)[1].alias("y2")))
    return rings.filter(F.size("r") > 1).select(*keep, F.inline(sides))


def as_lines(edges: DataFrame) -> DataFrame:
    """Edges with the geometry of a line of two points each."""
    p = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    return edges.withColumn("coords", F.array(F.array(F.array(p("x1", "y1"), p("x2", "y2"))))).drop("x1", "y1", "x2", "y2")


def chains(lines: list[list[tuple[float, float]]], joints: set[tuple[float, float]] | None = None) -> list[list[tuple[float, float]]]:
    """Lines joined where exactly two of them end (and, if joints are given, only there); rings are not joined."""
    ends: dict[tuple, list[int]] = {}
    for k, line in enumerate(lines):
        for p in {line[0], line[-1]}:
            ends.setdefault(p, []).append(k)
    used = [line[0] == line[-1] for line in lines]
    out = [line for line, ring in zip(lines, used) if ring]

    def follow(line: list) -> list:
        while line[0] != line[-1] and (joints is None or line[-1] in joints):
            near = ends[line[-1]]
            if len(near) != 2:
                break
            k = next((k for k in near if not used[k]), None)
            if k is None:
                break
            used[k] = True
            part = lines[k] if lines[k][0] == line[-1] else lines[k][::-1]
            line = line + list(part[1:])
        return line

    for k, line in enumerate(lines):
        if not used[k]:
            used[k] = True
            out.append(follow(follow(list(line))[::-1])[::-1])
    return out


def merge_lines(layer: DataFrame, keys: list[str]) -> DataFrame:
    """keys, coords: the lines of each key, joined end to end."""

    def udf(groups: pa.Array) -> pa.Array:
        from chronogeo.operators.lines import chains
        from chronogeo.operators.overlay import some_rows

        every = ([[tuple(p) for p in ring] for g in shapes for part in g for ring in part if len(ring) > 1] for (rows,) in some_rows(groups) for shapes in rows)
        return pa.array([[[c] for c in chains(lines)] for lines in every], groups.type.value_type)

    return by_keys(layer.select(*keys, "coords"), keys).groupBy(*keys).agg(F.collect_list("coords").alias("coords")).withColumn("coords", F.arrow_udf(udf, GEOM)("coords"))


def merge_lines_tiled(layer: DataFrame, keys: list[str], size: float, most: int) -> DataFrame:
    """keys, coords: the lines of each key, joined end to end, one row for each.

    Where exactly two lines of a key end is counted first. Lines are joined there within tiles; those without a further
    joint are done, and the others go on to greater tiles, until a key has no more than so many vertices left.
    """
    point = lambda p: F.struct((p[0] + F.lit(0.0)).alias("x"), (p[1] + F.lit(0.0)).alias("y"))
    rows = layer.select(*keys, F.explode(F.flatten("coords")).alias("line")).filter(F.size("line") > 1).withColumn("_uid", F.monotonically_increasing_id())
    rows = durable_table(rows.withColumn("a", point(F.element_at("line", 1))).withColumn("b", point(F.element_at("line", -1))))
    n = rows.agg(F.sum(F.size("line"))).first()[0] or 0
    ends = rows.select("_uid", *keys, F.posexplode(F.array_distinct(F.array("a", "b"))).alias("end", "p"))
    joint = F.count(F.lit(1)).over(Window.partitionBy(*keys, "p")) == 2
    ends = by_size(ends, [*keys, "p"], n).withColumn("joint", joint)
    # A ring has one end, which is no joint.
    known = by_size(ends.select("_uid", "end", "joint"), ["_uid"], n).groupBy("_uid").agg(*[(F.max((F.col("end") == k) & F.col("joint")) & (F.max("end") > 0)).alias(f"{c}_open") for k, c in enumerate("ab")])
    state = by_size(rows, ["_uid"], n).join(known, "_uid").select(*keys, F.array(F.array("line")).alias("coords"), "a_open", "b_open")
    chain = pa.list_(pa.struct([("coords", pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))), ("a_open", pa.bool_()), ("b_open", pa.bool_())]))

    def udf(groups: pa.Array) -> pa.Array:
        from chronogeo.operators.lines import chains
        from chronogeo.operators.overlay import some_rows

        out = []
        for (rows,) in some_rows(groups):
            for own in rows:
                lines = [[tuple(p) for p in s["coords"][0][0]] for s in own]
                joints = {p for line, s in zip(lines, own) for p, is_open in ((line[0], s["a_open"]), (line[-1], s["b_open"])) if is_open}
                out.append([{"coords": [[c]], "a_open": c[0] != c[-1] and c[0] in joints, "b_open": c[0] != c[-1] and c[-1] in joints} for c in chains(lines, joints)])
        return pa.array(out, chain)

    left, done, first = durable_table(state), [], F.col("coords")[0][0][0]
    while True:
        done.append(left.filter("NOT (a_open OR b_open)"))
        left = left.filter("a_open OR b_open")
        rest = left.groupBy(*keys).agg(F.sum(F.size(F.col("coords")[0][0])).alias("n")).agg(F.max("n")).first()[0] or 0
        if not rest:
            break
        whole = rest <= most or size > 360
        tile = [] if whole else [F.floor(first[i] / size).alias(name) for i, name in enumerate(TILE)]
        near = by_size(left.select("*", *tile), [*keys, *(TILE if tile else [])], n).groupBy(*keys, *(TILE if tile else [])).agg(F.collect_list(F.struct("coords", "a_open", "b_open")).alias("_s"))
        left = durable_table(near.select(*keys, F.inline(F.arrow_udf(udf, f"array<struct<coords:{GEOM},a_open:boolean,b_open:boolean>>")("_s"))))
        size *= 4
        if whole:
            done.append(left)
            break
    return reduce(DataFrame.unionByName, done).select(*keys, "coords")


def _covered(point: np.ndarray, seg: np.ndarray, owner: np.ndarray) -> bool:
    """Whether a point is inside of any of the polygons, which may overlap."""
    near = (seg[:, 1] > point[1]) != (seg[:, 3] > point[1])
    s = seg[near]
    x = s[:, 0] + (point[1] - s[:, 1]) / (s[:, 3] - s[:, 1]) * (s[:, 2] - s[:, 0])
    return bool((np.bincount(owner[near][point[0] < x]) % 2 == 1).any())


def stretches(a: list, b: list, seg: np.ndarray, owner: np.ndarray, erase: bool = False, begin: float = 0.0, end: float = 1.0) -> list[tuple[float, float]]:
    """Shares of the way from a to b (between begin and end) that lie inside (or outside) polygons given by their sides and their numbers."""
    if not len(seg):
        return [(begin, end)] if erase and begin < end else []
    p, r = np.array(a[:2], float), np.array(b[:2], float) - np.array(a[:2], float)
    s = seg[:, 2:] - seg[:, :2]
    det = r[0] * s[:, 1] - r[1] * s[:, 0]
    gap = seg[:, :2] - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[:, 0] * s[:, 1] - gap[:, 1] * s[:, 0]) / det
        u = (gap[:, 0] * r[1] - gap[:, 1] * r[0]) / det
    cuts = np.unique(np.concatenate([[begin, end], t[(np.abs(det) > 1e-15) & (t > begin + SAME) & (t < end - SAME) & (u >= 0) & (u <= 1)]]))
    return [(lo, hi) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if _covered(p + r * (lo + hi) / 2, seg, owner) != erase]


def in_tile(a: list, b: list, x: float, y: float, size: float) -> tuple[float, float] | None:
    """The share of the way from a to b in a tile, which holds its left and lower sides."""
    lo, hi = 0.0, 1.0
    for p, q, low in ((a[0], b[0], x), (a[1], b[1], y)):
        if p == q:
            if not low <= p < low + size:
                return None
        else:
            near, far = sorted(((low - p) / (q - p), (low + size - p) / (q - p)))
            lo, hi = max(lo, near), min(hi, far)
    return (lo, hi) if hi - lo > SAME else None


def pieces_of(line: list, shares: dict[int, list[tuple[float, float]]]) -> list[list[list[float]]]:
    """The pieces of a line that are given as shares of its segments."""
    out: list[list[list[float]]] = []
    for k, (a, b) in enumerate(zip(line, line[1:])):
        whole: list[list[float]] = []
        for lo, hi in sorted(shares.get(k, ())):
            if whole and lo <= whole[-1][1] + SAME:
                whole[-1][1] = max(whole[-1][1], hi)
            else:
                whole.append([lo, hi])
        for lo, hi in whole:
            x, y = ([float(a[i]) if t == 0 else float(b[i]) if t == 1 else a[i] + (b[i] - a[i]) * t for i in (0, 1)] for t in (lo, hi))
            if out and out[-1][-1] == x:
                out[-1].append(y)
            else:
                out.append([x, y])
    return out


def cut_line(line: list, seg: np.ndarray, owner: np.ndarray, erase: bool = False) -> list[list[list[float]]]:
    """The stretches of a line inside (or outside) polygons given by their sides and their numbers."""
    return pieces_of(line, {k: stretches(a, b, seg, owner, erase) for k, (a, b) in enumerate(zip(line, line[1:]))})


def near_lines(seg: np.ndarray, owner: np.ndarray) -> Callable[[list], tuple[np.ndarray, np.ndarray]]:
    """Gives for a line the sides, and their numbers, of the polygons whose boxes meet its own: no other covers any of it."""
    count = int(owner.max(initial=-1)) + 1
    low, high = np.full((count, 2), np.inf), np.full((count, 2), -np.inf)
    np.minimum.at(low, owner, np.minimum(seg[:, :2], seg[:, 2:]))
    np.maximum.at(high, owner, np.maximum(seg[:, :2], seg[:, 2:]))

    def near(line: list) -> tuple[np.ndarray, np.ndarray]:
        xs, ys = [p[0] for p in line], [p[1] for p in line]
        met = (low[:, 0] <= max(xs)) & (high[:, 0] >= min(xs)) & (low[:, 1] <= max(ys)) & (high[:, 1] >= min(ys)) if line else np.zeros(count, bool)
        some = np.flatnonzero(met[owner])
        return seg[some], owner[some]

    return near


def clip_lines(layer: DataFrame, mask: DataFrame, by: list[str], erase: bool = False) -> DataFrame:
    """Lines' stretches inside (or outside) the mask polygons of the same group; properties stay."""

    def udf(shapes: pa.Array, masks: pa.Array) -> pa.Array:
        from chronogeo.operators.lines import cut_line, near_lines
        from chronogeo.operators.overlay import _segments, some_rows

        out = []
        for own, others in some_rows(shapes, masks):
            for lines, mask in zip(own, others):
                seg, owner = _segments(mask or [])
                near = near_lines(seg, owner)
                out.append([[[piece] for part in g for ring in part for piece in cut_line(ring, *near(ring), erase)] if (erase or len(seg)) and g is not None else [] for g in lines])
        return pa.array(out, shapes.type)

    return with_shapes(layer, met(layer, mask, by), F.arrow_udf(udf, f"array<{GEOM}>")(F.col("_rows.coords"), F.col("_mask")))


def clip_lines_tiled(layer: DataFrame, mask: DataFrame, by: list[str], size: float, erase: bool = False) -> DataFrame:
    """clip_lines(), segment by segment within tiles; a feature's stretches are put together again by its number."""
    rows = durable_table(layer.withColumn("_uid", F.monotonically_increasing_id()))
    rings = rows.select(*by, "_uid", F.posexplode(F.flatten("coords")).alias("ring", "r")).filter(F.size("r") > 1)
    side = lambda i: F.struct(*[F.element_at("r", i + k)[c].alias(f"{n}{k + 1}") for k in (0, 1) for c, n in enumerate("xy")])
    sides = rings.select(*by, "_uid", "ring", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("r") - 1), side)).alias("seq", "s")).select(*by, "_uid", "ring", "seq", "s.*")
    cells = lambda c: F.explode(F.sequence(*[F.floor(f(f"{c}1", f"{c}2") / size).cast("int") for f in (F.least, F.greatest)]))
    sides = sides.withColumn(TILE[0], cells("x")).withColumn(TILE[1], cells("y"))
    masks = tiled(mask.select(*by, "coords"), size).select(*[F.col(c).alias(f"m_{c}") for c in (*by, *TILE)], "coords")

    def run(left, right):
        import pandas as pd

        from chronogeo.operators.lines import in_tile, stretches
        from chronogeo.operators.overlay import _segments

        seg, owner = _segments([[[[tuple(p) for p in ring] for ring in part] for part in g] for g in right["coords"]])
        out = []
        for uid, ring, seq, x1, y1, x2, y2, i, j in left[["_uid", "ring", "seq", "x1", "y1", "x2", "y2", *TILE]].itertuples(index=False) if erase or len(seg) else ():
            share = in_tile((x1, y1), (x2, y2), i * size, j * size, size)
            if share:
                out += [(uid, ring, seq, lo, hi) for lo, hi in stretches((x1, y1), (x2, y2), seg, owner, erase, *share)]
        return pd.DataFrame(out, columns=["_uid", "ring", "seq", "lo", "hi"])

    shares = sides.groupBy(*by, *TILE).cogroup(masks.groupBy(*[f"m_{c}" for c in (*by, *TILE)])).applyInPandas(run, "_uid bigint, ring int, seq int, lo double, hi double")
    shares = shares.groupBy("_uid").agg(F.collect_list(F.struct("ring", "seq", "lo", "hi")).alias("_shares"))  # of one feature

    def together(shapes, kept):
        import pyarrow as pa

        from chronogeo.operators.lines import pieces_of

        out = []
        for g, own in zip(shapes.to_pylist(), kept.to_pylist()):
            rings = [ring for part in g for ring in part]
            of: list[dict] = [{} for _ in rings]
            for s in own:
                of[s["ring"]].setdefault(s["seq"], []).append((s["lo"], s["hi"]))
            out.append([[piece] for ring, shares in zip(rings, of) for piece in pieces_of(ring, shares)])
        return pa.array(out, shapes.type)

    return rows.join(shares, "_uid").withColumn("coords", F.arrow_udf(together, GEOM)("coords", "_shares")).select(*layer.columns)
