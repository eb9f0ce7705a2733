"""The style filter language: JSON-like expressions compiled to columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class StyleError(ValueError):
    pass


class Style:
    """Compiler for a set of property columns, a zoom and global values.

    properties: name -> column. A property that isn't there is absent: ``has``
    is false and ``get`` is null. Comparisons with null are false, as absent.
    """

    def __init__(self, properties: dict[str, Column], zoom: Column | float | None = None, state: dict[str, Any] | None = None):
        self.properties, self.state = properties, state or {}
        self.zoom = zoom if isinstance(zoom, Column) or zoom is None else F.lit(float(zoom))

    def compile(self, e: Any) -> Column:
        if not isinstance(e, list):
            return F.lit(e)
        if not e or not isinstance(e[0], str):
            raise StyleError(f"no operator in {e!r}")
        name, *args = e
        method = getattr(self, "_" + {"==": "eq", "!=": "ne", "!": "not", "<": "lt", "<=": "le", ">": "gt", ">=": "ge", "+": "add", "-": "sub", "*": "mul", "^": "pow", "global-state": "global_state"}.get(name, name), None)
        if method is None:
            raise StyleError(f"unknown operator {name!r}")
        return method(*args)

    def _two(self, a, b):
        return self.compile(a), self.compile(b)

    def _eq(self, a, b):
        x, y = self._two(a, b)
        return x.eqNullSafe(y)

    def _ne(self, a, b):
        return ~self._eq(a, b)

    def _ordered(self, a, b, f):
        return F.coalesce(f(*self._two(a, b)), F.lit(False))

    def _lt(self, a, b):
        return self._ordered(a, b, lambda x, y: x < y)

    def _le(self, a, b):
        return self._ordered(a, b, lambda x, y: x <= y)

    def _gt(self, a, b):
        return self._ordered(a, b, lambda x, y: x > y)

    def _ge(self, a, b):
        return self._ordered(a, b, lambda x, y: x >= y)

    def _not(self, a):
        return ~self._boolean(a)

    def _all(self, *args):
        out = F.lit(True)
        for a in args:
            out = out & self._boolean(a)
        return out

    def _any(self, *args):
        out = F.lit(False)
        for a in args:
            out = out | self._boolean(a)
        return out

    def _has(self, name):
        return self.properties[name].isNotNull() if name in self.properties else F.lit(False)

    def _get(self, name):
        return self.properties.get(name, F.lit(None))

    def _zoom(self):
        if self.zoom is None:
            raise StyleError("no zoom given")
        return self.zoom

    def _global_state(self, name):
        return F.lit(self.state.get(name))

    def _number(self, a, *defaults):
        return F.coalesce(*[self.compile(x).try_cast("double") for x in (a, *defaults)])

    def _boolean(self, a, *defaults):
        return F.coalesce(*[self.compile(x).try_cast("boolean") for x in (a, *defaults)], F.lit(False))

    def _add(self, *args):
        out = self.compile(args[0])
        for a in args[1:]:
            out = out + self.compile(a)
        return out

    def _sub(self, a, b):
        x, y = self._two(a, b)
        return x - y

    def _mul(self, a, b):
        x, y = self._two(a, b)
        return x * y

    def _pow(self, a, b):
        x, y = self._two(a, b)
        return F.pow(x, y)

    def _min(self, *args):
        return F.least(*[self.compile(a) for a in args])

    def _case(self, *args):
        out = self.compile(args[-1])
        for condition, value in reversed(list(zip(args[:-1:2], args[1::2]))):
            out = F.when(self._boolean(condition), self.compile(value)).otherwise(out)
        return out

    def _interpolate(self, kind, over, *stops):
        """Between stops (position, value), linear or exponential; the end values hold outside."""
        x, base = self.compile(over), 1.0 if kind[0] == "linear" else float(kind[1])
        pairs = list(zip(stops[::2], stops[1::2]))
        out = self.compile(pairs[-1][1]).cast("double")
        for (x0, v0), (x1, v1) in reversed(list(zip(pairs, pairs[1:]))):
            t = (x - x0) / (x1 - x0) if base == 1.0 else (F.pow(F.lit(base), x - x0) - 1) / (base ** (x1 - x0) - 1)
            a, b = self.compile(v0).cast("double"), self.compile(v1).cast("double")
            out = F.when(x < x1, a + (b - a) * t).otherwise(out)
        return F.when(x <= pairs[0][0], self.compile(pairs[0][1]).cast("double")).otherwise(out)


# Border types in the order in which their layers are drawn.
BORDER_ORDER = (3, 2, 1, 4, 5)


def border_layer(border_type: Column) -> Column:
    """Place of a border's layer, from 0; null for other types."""
    return F.nullif(F.array_position(F.array(*[F.lit(t) for t in BORDER_ORDER]), border_type), F.lit(0)) - 1


def nation_label_shows(in_subregion: Column, zoom: Column) -> Column:
    """Labels of nations in a subregion show above zoom 4."""
    return ~F.coalesce(in_subregion, F.lit(False)) | (zoom > 4)


def location_label_shows(label: Column, pregroup_minzoom: Column, zoom: Column) -> Column:
    """Labels of locations show from five zooms after their own least zoom."""
    return label.isNotNull() & (zoom >= F.coalesce(pregroup_minzoom, F.lit(0)) + 5)


def clickable(fid: Column) -> Column:
    return fid.isNotNull()


def layer_zooms(profile: DataFrame, max_zoom: int) -> DataFrame:
    """layer, minzoom, maxzoom of style layers, from a property profile: only where no feature is without, and the bound cuts something."""
    bound = lambda key, value, none: F.max(F.when((F.col("key") == key) & (F.col("nulls") == 0) & (F.col(value) != none), F.col(value))).cast("int")
    return profile.groupBy("layer").agg(bound("tile_minzoom", "min_number", 0).alias("minzoom"), bound("tile_maxzoom", "max_number", max_zoom).alias("maxzoom"))


def listed(layer: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label is in a list (column label)."""
    return layer.join(labels.select(F.col(label)).distinct(), label, "left_semi")


def zoom_window(zoom: Column | float, minzoom: Column, maxzoom: Column) -> Column:
    """Whether a feature shows at a zoom: minzoom inclusive, maxzoom inclusive, either may be absent."""
    z = zoom if isinstance(zoom, Column) else F.lit(zoom)
    return (minzoom.isNull() | (z >= minzoom)) & (maxzoom.isNull() | (z <= maxzoom))


def time_window(index: int, start: Column, end: Column) -> Column:
    """Whether a feature lives in a slice: start inclusive, end exclusive, either may be absent."""
    return (start.isNull() | (start <= index)) & (end.isNull() | (end > index))
