"""Colours of style values: parsing, luminance, contrast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A few colour names.
NAMES = {"black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "gray": "#808080", "grey": "#808080", "silver": "#c0c0c0", "yellow": "#ffff00"}


def color(value: Column) -> Column:
    """struct(r, g, b, a), or null if it isn't a colour."""
    v = F.lower(F.trim(value))
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    v = F.coalesce(F.try_element_at(names, v), v)
    v = F.regexp_replace(v, "^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    inside = F.split(F.regexp_extract(v, r"rgba?\(([^)]+)\)", 1), ",")
    number = lambda i: F.try_element_at(inside, F.lit(i)).try_cast("double")
    hexa = lambda i: F.conv(F.substring(v, i, 2), 16, 10).cast("double")
    shape = "struct<r:double,g:double,b:double,a:double>"
    pack = lambda r, g, b, a: F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a")).cast(shape)
    return (
        F.when(v == "transparent", pack(*[F.lit(0.0)] * 4))
        .when(v.rlike("^#[0-9a-f]{6}$"), pack(hexa(2), hexa(4), hexa(6), F.lit(1.0)))
        .when(number(3).isNotNull(), pack(number(1), number(2), number(3), F.coalesce(number(4), F.lit(1.0))))
    )


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of 0..255 channels."""

    def part(c: Column) -> Column:
        v = c / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return part(r) * 0.2126 + part(g) * 0.7152 + part(b) * 0.0722


def contrast(one: Column, other: Column) -> Column:
    """Contrast ratio of two luminances."""
    return (F.greatest(one, other) + 0.05) / (F.least(one, other) + 0.05)
