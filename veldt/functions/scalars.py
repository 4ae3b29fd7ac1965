"""Column functions used by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def floor_shares(shares: list[Column], floor: float) -> list[Column]:
    """Shares not below ``floor``, scaled back to a sum of one."""
    up = [F.greatest(s, F.lit(floor)) for s in shares]
    return [u / total(up) for u in up]


def clr(parts: list[Column]) -> list[Column]:
    """Centred log-ratio: log minus the mean log."""
    mean = total([F.ln(p) for p in parts]) / len(parts)
    return [F.ln(p) - mean for p in parts]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def normal_name(c: Column, drop: tuple[str, ...] = (), keep: str = "a-zа-я0-9") -> Column:
    """Lower case, ё as е, words of ``drop`` out, anything but ``keep`` a space, single spaces."""
    out = F.translate(F.lower(c), "ё", "е")
    if drop:
        out = F.regexp_replace(out, r"(?U)\b(" + "|".join(drop) + r")\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, f"[^{keep}]", " "), " +", " "))


def safe_double(c: Column) -> Column:
    """Number, or null where the text is none."""
    return c.try_cast("double")


def code8(c: Column) -> Column:
    """The part before a dot, zero-filled to ten digits, first eight."""
    return F.substring(F.lpad(F.split(c.cast("string"), r"\.")[0], 10, "0"), 1, 8)
