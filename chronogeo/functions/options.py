"""Options in the fragment of an URL, and places written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_options(fragment: Column, defaults: dict[str, str]) -> dict[str, Column]:
    """Values by name: those of ``#a=1&b=2``, else the defaults; a later value of a name wins."""
    pairs = F.split(F.regexp_replace(F.coalesce(fragment, F.lit("")), "^#", ""), "&")
    text = lambda v: F.try_url_decode(F.replace(v, F.lit("+"), F.lit(" ")))
    named = lambda k: F.filter(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)) == k)
    value = lambda k: text(F.regexp_replace(F.try_element_at(named(k), F.lit(-1)), "^[^=]*=?", ""))
    return {k: F.coalesce(value(k), F.lit(d)) for k, d in defaults.items()}


def write_options(values: dict[str, Column], defaults: dict[str, str]) -> Column:
    """The fragment of some values: those equal to their defaults are left out."""
    parts = [F.when(~v.eqNullSafe(F.lit(defaults.get(k))), F.concat(F.lit(f"{k}="), F.coalesce(v, F.lit("")))) for k, v in values.items()]
    return F.concat(F.lit("#"), F.concat_ws("&", *parts))


def fly_to(text: Column) -> Column:
    """zoom, lat, lng of ``zoom/lat/lng``; null if there are not three numbers."""
    parts = F.split(text, "/")
    number = lambda i: F.get(parts, i).try_cast("double")
    good = (F.size(parts) == 3) & number(0).isNotNull() & number(1).isNotNull() & number(2).isNotNull()
    return F.when(good, F.struct(number(0).alias("zoom"), number(1).alias("lat"), number(2).alias("lng")))


def bbox_numbers(text: Column) -> Column:
    """Array of the two or four numbers of ``n,n[,n,n]``; null else."""
    numbers = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    return F.when(F.size(numbers).isin(2, 4) & ~F.exists(numbers, lambda n: n.isNull()), numbers)
