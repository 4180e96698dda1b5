"""Scalar and aggregate functions of the query language, as builders of Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sub(s, start, n=None):
    return F.substring(s, start + 1, n if n is not None else F.length(s))


def _finite(x: Column) -> Column:
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def _range(a, b, step=None):
    step = F.lit(1) if step is None else step
    a, b, step = a.cast("long"), b.cast("long"), step.cast("long")
    return F.when(((step > 0) & (a <= b)) | ((step < 0) & (a >= b)), F.sequence(a, b, step)).when(a.isNotNull() & b.isNotNull() & step.isNotNull(), F.array().cast("array<bigint>"))


def _tail(x):
    return F.when(F.size(x) > 0, F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))).when(x.isNotNull(), x)


def _distance(a, b):
    geo = lambda p, k: p.getField(k)
    return F.sqrt(F.pow(geo(a, "x") - geo(b, "x"), 2) + F.pow(geo(a, "y") - geo(b, "y"), 2))


SCALARS: dict[str, Callable[..., Column]] = {
    "tolower": F.lower, "lower": F.lower, "toupper": F.upper, "upper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim,
    "substring": _sub, "replace": lambda s, a, b: F.replace(s, a, b), "split": lambda s, d: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E"))),
    "reverse": F.reverse, "concat": F.concat, "string.concat": F.concat, "char_length": F.length, "character_length": F.length, "left": lambda s, n: F.left(s, n), "right": lambda s, n: F.right(s, n),
    "tostring": lambda x: x.cast("string"), "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "sqrt": lambda x: F.sqrt(x), "exp": F.exp,
    "log": F.log, "log10": F.log10, "power": F.pow, "pow": F.pow, "sign": lambda x: F.signum(x).cast("long"), "rand": lambda: F.rand(), "round": lambda x, places=None, *_: F.round(x.cast("double")) if places is None else F.round(x.cast("double"), places.cast("int")),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "pi": F.pi, "e": F.e, "cot": F.cot, "degrees": F.degrees, "radians": F.radians,
    "tointeger": lambda x: _finite(x).try_cast("long"), "tofloat": _finite, "toboolean": lambda x: F.when(F.lower(F.trim(x.cast("string"))) == "true", True).when(F.lower(F.trim(x.cast("string"))) == "false", False),
    "head": lambda x: F.get(x, F.lit(0)), "last": lambda x: F.try_element_at(x, F.lit(-1)), "tail": _tail, "range": _range, "coalesce": F.coalesce, "isempty": lambda x: F.size(x) == 0,
    "timestamp": lambda: F.unix_millis(F.current_timestamp()),
    "datetime.fromepoch": lambda s, ns=None: F.timestamp_seconds(s) if ns is None else F.timestamp_micros(s.cast("long") * 10**6 + F.call_function("div", ns.cast("long"), F.lit(1000).cast("long"))), "datetime.fromepochmillis": F.timestamp_millis, "distance": _distance,
}

#: Accessors of temporal values.
TEMPORAL: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "ordinalDay": F.dayofyear, "dayOfWeek": lambda d: F.weekday(d) + 1, "weekDay": lambda d: F.weekday(d) + 1,
    "weekYear": lambda d: F.extract(F.lit("YEAROFWEEK"), d), "dayOfQuarter": lambda d: F.datediff(d, F.date_trunc("quarter", d)) + 1, "millisecond": lambda d: F.pmod(F.unix_millis(d.cast("timestamp")), F.lit(1000)), "microsecond": lambda d: F.pmod(F.unix_micros(d.cast("timestamp")), F.lit(10**6)),
    "hour": F.hour, "minute": F.minute, "second": F.second, "epochSeconds": F.unix_seconds, "epochMillis": F.unix_millis,
}

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "percentiledisc", "percentilecont", "stdev", "stdevp"}


def aggregate(name: str, distinct: bool, args: list[Column]) -> Column:
    x = args[0] if args else F.lit(1)
    if name == "count":
        return F.count_distinct(x) if distinct else F.count(x)
    if name == "sum":
        return F.coalesce(F.sum_distinct(x) if distinct else F.sum(x), F.lit(0))
    if name == "avg":
        return F.avg(x) if not distinct else F.sum_distinct(x) / F.count_distinct(x)
    if name == "collect":
        return F.array_sort(F.collect_set(x)) if distinct else F.collect_list(x)
    if name in ("percentiledisc", "percentilecont"):
        return F.call_function("percentile", x, args[1]) if name == "percentilecont" else F.get(F.sort_array(F.collect_list(x)), F.greatest(F.ceil(args[1] * F.count(x)) - 1, F.lit(0)).cast("int"))
    return {"min": F.min, "max": F.max, "stdev": F.stddev_samp, "stdevp": F.stddev_pop}[name](x)
