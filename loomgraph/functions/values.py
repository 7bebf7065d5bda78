"""Canonical strings and numbers of property values, and comparison by them.

The graph languages compare loosely: equality is equality of the printed form, order is numeric where both sides read as
numbers.  A value is therefore a pair of columns, its printed form and the number that it reads as (null if none).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(text: Column, scale: int) -> Column:
    return F.rtrim(text.cast(f"decimal(38,{scale})").cast("string"), F.lit("0"))


def printed(c: Column, kind: str, signed: bool = False) -> Column:
    """The printed form of a typed column: 40.0 prints as 40, and exponents only beyond 1e21 and below 1e-6.

    The languages compare by it, so -0.0 prints as 0; ``signed`` keeps its sign.
    """
    if kind in ("float", "double") or kind.startswith("decimal"):
        x = c.cast("double")
        text = x.cast("string")
        size = F.abs(x)
        return (
            F.when(F.isnan(x), "NaN")
            .when(F.lit(signed) & (text == "-0.0"), "-0")
            .when((x == F.floor(x)) & (size < 1e18), x.cast("decimal(38,0)").cast("string"))
            .when((size >= 1e7) & (size < 1e18), _plain(text, 12))
            .when((size < 1e-3) & (size >= 1e-6), _plain(text, 24))
            .otherwise(text)
        )
    return c.cast("string")


def number(c: Column, kind: str = "string") -> Column:
    """The number that a value reads as; booleans are 1 and 0, blank strings 0, other strings null."""
    if kind == "boolean":
        return c.cast("int").cast("double")
    if kind == "string":
        t = F.trim(c)
        return F.when(t == "", 0.0).when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    if kind.startswith(("timestamp", "date", "array", "map", "struct", "binary")):
        return F.lit(None).cast("double")
    return c.cast("double")


def ordered(op: str, ls: Column, ln: Column, rs: Column, rn: Column) -> Column:
    """``= != < <= > >=`` of two values."""
    if op in ("=", "!=", "<>"):
        return ls == rs if op == "=" else ls != rs
    f = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    return F.when(ln.isNotNull() & rn.isNotNull() & (ls != "") & (rs != ""), f(ln, rn)).otherwise(f(ls, rs))


def sort_keys(s: Column, n: Column, descending: bool = False) -> list[Column]:
    """A total order: numbers before other strings, unbound as 0, then the printed form."""
    n = F.when(s.isNull(), 0.0).otherwise(n)
    keys = [n.isNull().cast("int"), n, F.coalesce(s, F.lit(""))]
    return [k.desc() if descending else k.asc() for k in keys]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, over their common length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    a, b = (F.transform(F.slice(x, F.lit(1), n), lambda v: v.cast("double")) for x in (a, b))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((n > 0) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))
