"""Colours as columns: hex texts, alpha compositing, layer colours, HSLuv lightness."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RGBA = "struct<r:int,g:int,b:int,a:int>"

# Layer colours (red, green, blue, alpha), and the colour under all layers.
LAYER_COLORS = {
    "land": (248, 241, 225, 255),
    "continents": (248, 241, 225, 255),
    "ice": (255, 255, 255, 191),
    "districts": (212, 204, 185, 255),
    "deserts": (255, 247, 190, 255),
    "swamp": (183, 197, 188, 255),
    "swamps": (183, 197, 188, 255),
    "mountains": (222, 212, 184, 255),
    "hills": (235, 227, 205, 255),
    "forests": (187, 226, 198, 255),
    "rivers": (138, 180, 248, 255),
    "shallow-waters": (138, 180, 248, 255),
    "waters": (138, 180, 248, 255),
    "buildings": (119, 136, 153, 255),
    "roads": (185, 157, 92, 255),
}
NO_COLOR_LAYERS = ("specials", "generic")
BASE = (110, 160, 245)
BUILDING_COLORS = {"fortification": (105, 105, 105, 255), "bridge": (169, 169, 169, 255)}


def rgba(r, g, b, a=255) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(r).cast("int").alias("r"), lit(g).cast("int").alias("g"), lit(b).cast("int").alias("b"), lit(a).cast("int").alias("a"))


def hex_text(c: Column) -> Column:
    """#rrggbb or #rrggbbaa; full alpha is left out, and pairs of equal digits are written once."""
    pair = lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))
    full = F.concat(pair(c["r"]), pair(c["g"]), pair(c["b"]), F.when(c["a"] == 255, F.lit("")).otherwise(pair(c["a"])))
    short = F.regexp_replace(full, "(.)\\1", "$1")
    return F.concat(F.lit("#"), F.when(full.rlike("^(?:(.)\\1)+$") & (F.length(short) * 2 == F.length(full)), short).otherwise(full))


def parse_hex(text: Column) -> Column:
    """rgba of #rgb, #rgba, #rrggbb or #rrggbbaa; null for other texts."""
    digits = F.substring(text, 2, 8)
    full = F.when(F.length(digits) <= 4, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    part = lambda i: F.conv(F.substring(full, 2 * i + 1, 2), 16, 10).cast("int")
    alpha = F.when(F.length(full) == 8, part(3)).otherwise(255)
    return F.when(text.rlike("^#(?:[0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"), rgba(part(0), part(1), part(2), alpha))


def composite(stack: Column) -> Column:
    """Source-over of an array of rgba, bottom first, in whole numbers; an opaque colour hides what is below."""

    def over(c: Column, n: Column) -> Column:
        mixed = lambda k: F.when(n["a"] == 255, n[k]).otherwise(F.floor((n[k] * n["a"] + c[k] * (255 - n["a"])) / 255).cast("int"))
        return F.struct(mixed("r").alias("r"), mixed("g").alias("g"), mixed("b").alias("b"), F.lit(255).alias("a"))

    return F.aggregate(stack, rgba(*BASE), over)


def building_color(kind: Column) -> Column:
    out = hex_text(rgba(*LAYER_COLORS["buildings"]))
    for name, c in BUILDING_COLORS.items():
        out = F.when(kind == name, hex_text(rgba(*c))).otherwise(out)
    return out


def layer_color(layer: Column) -> Column:
    """Colour of a layer; null for layers without one; an unknown layer is an error."""
    out = F.raise_error(F.concat(F.lit("no colour for layer "), layer)).cast(RGBA)
    for name in NO_COLOR_LAYERS:
        out = F.when(layer == name, F.lit(None).cast(RGBA)).otherwise(out)
    for name, c in LAYER_COLORS.items():
        out = F.when(layer == name, rgba(*c)).otherwise(out)
    return out


# Matrices and constants of sRGB and CIE L*u*v* (D65), as published.
_TO_XYZ = ((0.41239079926595, 0.35758433938387, 0.18048078840183), (0.21263900587151, 0.71516867876775, 0.072192315360733), (0.019330818715591, 0.11919477979462, 0.95053215224966))
_TO_RGB = ((3.240969941904521, -1.537383177570093, -0.498610760293), (-0.96924363628087, 1.87596750150772, 0.041555057407175), (0.055630079696993, -0.20397695888897, 1.056971514242878))
_REF_U, _REF_V, _KAPPA, _EPSILON = 0.19783000664283, 0.46831999493879, 903.2962962, 0.0088564516


def _max_chroma(lightness: float, hue: float) -> float:
    """Largest chroma in gamut: distance along the hue to the nearest of six bounding lines."""
    sub = ((lightness + 16) / 116) ** 3
    sub = sub if sub > _EPSILON else lightness / _KAPPA
    best = math.inf
    for m1, m2, m3 in _TO_RGB:
        for t in (0, 1):
            bottom = (632260 * m3 - 126452 * m2) * sub + 126452 * t
            slope = (284517 * m1 - 94839 * m3) * sub / bottom
            cut = ((838422 * m3 + 769860 * m2 + 731718 * m1) * lightness * sub - 769860 * t * lightness) / bottom
            length = cut / (math.sin(hue) - slope * math.cos(hue))
            if length >= 0:
                best = min(best, length)
    return best


def to_hsluv(r: int, g: int, b: int) -> tuple[float, float, float]:
    linear = [((c / 255 + 0.055) / 1.055) ** 2.4 if c / 255 > 0.04045 else c / 255 / 12.92 for c in (r, g, b)]
    x, y, z = (sum(m * c for m, c in zip(row, linear)) for row in _TO_XYZ)
    lightness = y * _KAPPA if y <= _EPSILON else 116 * y ** (1 / 3) - 16
    total = x + 15 * y + 3 * z
    if lightness < 1e-8 or lightness > 99.9999999 or not total:
        return 0.0, 0.0, max(0.0, min(100.0, lightness))
    u, v = 13 * lightness * (4 * x / total - _REF_U), 13 * lightness * (9 * y / total - _REF_V)
    hue = math.atan2(v, u)
    return math.degrees(hue) % 360, math.hypot(u, v) / _max_chroma(lightness, hue) * 100, lightness


def from_hsluv(hue: float, saturation: float, lightness: float) -> tuple[int, int, int]:
    if lightness <= 1e-8:
        return 0, 0, 0
    if lightness >= 99.9999999:
        return 255, 255, 255
    a = math.radians(hue)
    chroma = _max_chroma(lightness, a) * saturation / 100
    u = math.cos(a) * chroma / (13 * lightness) + _REF_U
    v = math.sin(a) * chroma / (13 * lightness) + _REF_V
    y = lightness / _KAPPA if lightness <= 8 else ((lightness + 16) / 116) ** 3
    x = -(9 * y * u) / ((u - 4) * v - u * v)
    z = (9 * y - 15 * v * y - v * x) / (3 * v)
    linear = [sum(m * c for m, c in zip(row, (x, y, z))) for row in _TO_RGB]
    return tuple(max(0, min(255, round(255 * (12.92 * c if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055)))) for c in linear)


def with_lightness(text: Column, lightness: float | None = None, add: float = 0.0) -> Column:
    """Hex colour with its HSLuv lightness set to, or raised by, a share of 1; alpha is lost."""

    def udf(texts: pa.Array) -> pa.Array:
        from chronogeo.functions.colors import from_hsluv, to_hsluv

        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            d = t[1:]
            d = "".join(c + c for c in d) if len(d) <= 4 else d
            h, s, l = to_hsluv(*(int(d[i : i + 2], 16) for i in (0, 2, 4)))
            l = lightness * 100 if lightness is not None else l + add * 100
            x = "".join("%02x" % c for c in from_hsluv(h, s, max(0.0, min(100.0, l))))
            out.append("#" + (x[::2] if x[::2] == x[1::2] else x))
        return pa.array(out, pa.string())

    return F.arrow_udf(udf, "string")(text)
