"""Column expressions: keyed random numbers and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_uniform(*key) -> Column:
    """A number in [0, 1) that depends on the key alone (columns or values): the same on every run, in any order of evaluation."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(*key: str) -> str:
    """keyed_uniform in the dialect of the checks; each part is an SQL expression."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def between(u: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + u * F.lit(float(high) - float(low))


def bind(value: Column, body) -> Column:
    """body(value) with value worked out once; inside a lambda, a plain column may be worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def doubles(xs: Column) -> Column:
    return F.transform(xs, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    """a over the larger of its length and eps."""
    return bind(F.greatest(norm(a), F.lit(eps)), lambda n: F.transform(a, lambda x: x / n))


def log_softmax(x: Column, temperature: float = 1.0) -> Column:
    """Log of the softmax of x / temperature; the largest value is taken off before exp."""
    t = F.lit(float(temperature))

    def shifted(s: Column) -> Column:
        return bind(F.log(F.aggregate(s, F.lit(0.0), lambda a, v: a + F.exp(v))), lambda rest: F.transform(s, lambda v: v - rest))

    return bind(bind(F.array_max(x), lambda top: F.transform(x, lambda v: (v - top) / t)), shifted)


def softmax(x: Column, temperature: float = 1.0) -> Column:
    return F.transform(log_softmax(x, temperature), F.exp)
