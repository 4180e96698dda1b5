"""Dates, times and durations: constructors, truncation, differences and arithmetic, as builders of Columns.

date is a DATE, datetime a TIMESTAMP, localdatetime a TIMESTAMP_NTZ; time and localtime are structs of hour, minute, second and nanosecond, which order as
times do; a duration is a struct of months, days, seconds and nanos, which never turn into each other. Precision is microseconds, years are 1 to 9999.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DURATION = ("months", "days", "seconds", "nanos")
CLOCK = ("hour", "minute", "second", "nanosecond")
#: Average seconds of a month, as fractions of months are worth: a fixed value.
MONTH = 2_629_746
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def duration(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and tuple(kind.names) == DURATION


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once and not written out wherever it is read."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _long(c) -> Column:
    return c.cast("long")


def _whole(x: Column) -> Column:
    """Towards zero."""
    return _long(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))


def make_duration(months, days, seconds, nanos) -> Column:
    """Seconds and nanos get the same sign."""
    return let(_long(seconds) * F.lit(10**9) + _long(nanos), lambda t: F.struct(_long(months).alias("months"), _long(days).alias("days"), F.call_function("div", t, F.lit(10**9).cast("long")).alias("seconds"), (t % F.lit(10**9)).alias("nanos")))


def duration_part(d: Column, name: str) -> Column:
    return let(d, lambda v: _duration_part(v, name))


def _duration_part(d: Column, name: str) -> Column:
    m, s, n = d.getField("months"), d.getField("seconds"), d.getField("nanos")
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    own = {
        "years": div(m, 12), "quarters": div(m, 3), "monthsOfYear": m % 12, "monthsOfQuarter": m % 3, "weeks": div(d.getField("days"), 7), "daysOfWeek": d.getField("days") % 7, "hours": div(s, 3600), "minutes": div(s, 60),
        "minutesOfHour": div(s, 60) % 60, "secondsOfMinute": s % 60, "milliseconds": s * 1000 + div(n, 10**6), "microseconds": s * 10**6 + div(n, 1000), "nanoseconds": s * 10**9 + n, "millisecondsOfSecond": div(n, 10**6),
        "microsecondsOfSecond": div(n, 1000), "nanosecondsOfSecond": n,
    }
    return own.get(name, F.lit(None))


def _field(m: Column, kind: T.DataType, name: str, none) -> Column:
    return F.coalesce(m.getField(name), none if isinstance(none, Column) else F.lit(none)) if name in kind.names else none if isinstance(none, Column) else F.lit(none)


def _date_of(m: Column, kind: T.StructType) -> Column:
    """From year with month and day, week and dayOfWeek, ordinalDay, or quarter and dayOfQuarter; or a date to change."""
    names = set(kind.names)
    base = next((m.getField(n).cast("date") for n in ("date", "datetime", "localdatetime") if n in names), None)
    year = _field(m, kind, "year", F.year(base) if base is not None else None).cast("int")
    if "week" in names:
        first = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date")
        return F.date_add(first, ((m.getField("week") - 1) * 7 + _field(m, kind, "dayOfWeek", 1) - 1).cast("int"))
    if "ordinalDay" in names:
        return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (m.getField("ordinalDay") - 1).cast("int"))
    if "quarter" in names:
        return F.date_add(F.make_date(year, (m.getField("quarter") * 3 - 2).cast("int"), F.lit(1)), (_field(m, kind, "dayOfQuarter", 1) - 1).cast("int"))
    part = lambda n, f: _field(m, kind, n, f(base) if base is not None else 1).cast("int")
    return F.make_date(year, part("month", F.month), part("day", F.dayofmonth))


def _clock_of(m: Column, kind: T.StructType) -> list[Column]:
    base = next((m.getField(n) for n in ("time", "localtime") if n in kind.names), None)
    h, i, s = (_long(_field(m, kind, n, base.getField(n) if base is not None else 0)) for n in CLOCK[:3])
    n = _field(m, kind, "millisecond", 0) * 10**6 + _field(m, kind, "microsecond", 0) * 1000 + _field(m, kind, "nanosecond", base.getField("nanosecond") if base is not None else 0)
    return [h, i, s, _long(n)]


def date(x: Column | None = None, *, kinds) -> Column:
    if x is None:
        return F.current_date()
    if isinstance(kinds[0], T.StructType):
        return _date_of(x, kinds[0])
    return x.cast("date") if isinstance(kinds[0], TIMES) else F.try_to_date(x) if hasattr(F, "try_to_date") else x.try_cast("date")


def _stamp(kind: str) -> Callable:
    def make(x: Column | None = None, *, kinds) -> Column:
        if x is None:
            return F.current_timestamp().cast(kind)
        if isinstance(kinds[0], T.StructType):
            h, i, s, n = _clock_of(x, kinds[0])
            seconds = F.unix_seconds(_date_of(x, kinds[0]).cast("timestamp_ntz").cast("timestamp")) + h * 3600 + i * 60 + s
            return (F.timestamp_micros(seconds * 10**6 + F.call_function("div", n, F.lit(1000).cast("long")))).cast(kind)
        return x.cast(kind) if isinstance(kinds[0], TIMES) else x.try_cast(kind)

    return make


def clock(x: Column | None = None, *, kinds) -> Column:
    if x is None:
        x, kinds = F.current_timestamp(), [T.TimestampType()]
    return let(x, lambda v: _clock(v, kinds))


def _clock(x: Column, kinds) -> Column:
    if isinstance(kinds[0], T.StructType):
        got = _clock_of(x, kinds[0])
    elif isinstance(kinds[0], TIMES):
        t = x.cast("timestamp")
        got = [F.hour(t), F.minute(t), F.second(t), F.pmod(F.unix_micros(t), F.lit(10**6)) * 1000]
    else:
        part = lambda k: F.regexp_extract(x, r"^(\d\d):?(\d\d)?:?(\d\d)?(?:\.(\d{1,9}))?", k)
        got = [F.coalesce(part(k).try_cast("long"), F.lit(0)) for k in (1, 2, 3)] + [F.rpad(F.when(part(4) == "", "0").otherwise(part(4)), 9, "0")]
    return F.when(x.isNotNull(), F.struct(*(_long(c).alias(n) for c, n in zip(got, CLOCK))))


def make_any_duration(x: Column, *, kinds) -> Column:
    return let(x, lambda v: _any_duration(v, kinds))


def _any_duration(x: Column, kinds) -> Column:
    if isinstance(kinds[0], T.StructType):
        f = lambda n: _field(x, kinds[0], n, 0).cast("double")
    else:
        def f(n):
            mark = {"years": "Y", "months": "M", "weeks": "W", "days": "D", "hours": "H", "minutes": "M", "seconds": "S"}.get(n)
            if mark is None:
                return F.lit(0.0)
            side = F.regexp_extract(x, "^([^T]*)", 1) if n in ("years", "months", "weeks", "days") else F.regexp_extract(x, "T(.*)$", 1)
            return F.coalesce(F.regexp_extract(side, rf"(-?\d+(?:\.\d+)?){mark}", 1).try_cast("double"), F.lit(0.0))
    months, seconds = f("years") * 12 + f("quarters") * 3 + f("months"), f("hours") * 3600 + f("minutes") * 60 + f("seconds")
    nanos = f("milliseconds") * 10**6 + f("microseconds") * 1000 + f("nanoseconds")
    return F.when(x.isNotNull(), _cascade(months, f("weeks") * 7 + f("days"), seconds, nanos))


def _cascade(months: Column, days: Column, seconds: Column, nanos: Column) -> Column:
    """A duration of parts that may have fractions, which go on to the next smaller part."""
    def of(p):
        days = p.days + (p.months - _whole(p.months)) * (MONTH / 86400)
        return let(F.struct(days.alias("days"), p.seconds.alias("seconds"), p.nanos.alias("nanos")), lambda q: _rest(_whole(p.months), q))

    return let(F.struct(*(c.alias(n) for c, n in zip((months, days, seconds, nanos), DURATION))), of)


def _rest(months: Column, q: Column) -> Column:
    def of(s):
        return make_duration(months, _whole(q.days), _whole(s), _whole(F.round(q.nanos + (s - _whole(s)) * 10**9)))

    return let(q.seconds + (q.days - _whole(q.days)) * 86400, of)


def _truncate(kind: str) -> Callable:
    def cut(unit: Column, x: Column | None = None, *_, kinds) -> Column:
        t, unit = (x if x is not None else F.current_timestamp()).cast("timestamp"), F.lower(unit)
        year = lambda k: F.make_date((F.floor(F.year(t) / k) * k).cast("int"), F.lit(1), F.lit(1)).cast("timestamp")
        iso = F.date_trunc("week", F.make_date(F.extract(F.lit("YEAROFWEEK"), t).cast("int"), F.lit(1), F.lit(4)).cast("timestamp"))
        out = F.when(unit == "millennium", year(1000)).when(unit == "century", year(100)).when(unit == "decade", year(10)).when(unit == "weekyear", iso)
        return out.otherwise(F.call_function("date_trunc", unit, t)).cast(kind)

    return cut


def between(a: Column, b: Column, *, kinds) -> Column:
    """Whole months, then whole days, then the rest, all towards zero."""
    a, b = a.cast("timestamp"), b.cast("timestamp")
    of = lambda t: F.struct(F.dayofmonth(t), F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t)))
    day = F.lit(86_400_000_000).cast("long")

    def whole(p):
        m = F.year(p.b) * 12 + F.month(p.b) - F.year(p.a) * 12 - F.month(p.a)
        return F.when((p.b >= p.a) & (of(p.b) < of(p.a)), m - 1).when((p.b < p.a) & (of(p.b) > of(p.a)), m + 1).otherwise(m)

    def rest(p, m):
        gap = F.unix_micros(p.b) - F.unix_micros(p.a + F.make_interval(F.lit(0), m.cast("int")))
        return let(gap, lambda r: make_duration(m, F.call_function("div", r, day), F.call_function("div", r % day, F.lit(10**6).cast("long")), (r % F.lit(10**6)) * 1000))

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(a.alias("a"), b.alias("b")), lambda p: let(whole(p), lambda m: rest(p, m))))


def _in(unit: str) -> Callable:
    def make(a: Column, b: Column, *, kinds) -> Column:
        zero, gap = F.lit(0), F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
        if unit == "months":
            return make_duration(between(a, b, kinds=kinds).getField("months"), zero, zero, zero)
        if unit == "days":
            return make_duration(zero, F.call_function("div", gap, F.lit(86_400_000_000).cast("long")), zero, zero)
        return make_duration(zero, zero, F.call_function("div", gap, F.lit(10**6).cast("long")), (gap % F.lit(10**6)) * 1000)

    return make


def temporal_arithmetic(op: str, a: Column, ka: T.DataType, b: Column, kb: T.DataType) -> Column | None:
    """Of times and durations; None where neither side is a duration."""
    if not duration(ka) and not duration(kb):
        return None
    part = lambda d: [d.getField(n) for n in DURATION]
    if duration(ka) and duration(kb) and op in "+-":
        return let(F.struct(a.alias("a"), b.alias("b")), lambda p: make_duration(*(x + y if op == "+" else x - y for x, y in zip(part(p.a), part(p.b)))))
    if op in "*/" and (duration(ka) and isinstance(kb, T.NumericType) or duration(kb) and op == "*"):
        d, n = (a, b.cast("double")) if duration(ka) else (b, a.cast("double"))
        return let(d, lambda d: _cascade(*(x * n if op == "*" else x / n for x in part(d))))
    t, k, d = (a, ka, b) if duration(kb) else (b, kb, a)
    if not isinstance(k, TIMES) or op not in "+-" or (op == "-" and duration(ka)):
        return None

    def move(d: Column) -> Column:
        months, days, seconds, nanos = (x if op == "+" else -x for x in part(d))
        if isinstance(k, T.DateType):
            return F.date_add(F.add_months(t, months.cast("int")), (days + F.call_function("div", seconds, F.lit(86400).cast("long"))).cast("int"))
        gap = (seconds + nanos / 10**9).cast("decimal(18,6)")
        return t + F.make_interval(F.lit(0), months.cast("int"), F.lit(0), days.cast("int"), F.lit(0), F.lit(0), gap)

    return let(d, move)


#: Functions that need their arguments' types.
TYPED: dict[str, Callable[..., Column]] = {
    "date": date, "datetime": _stamp("timestamp"), "localdatetime": _stamp("timestamp_ntz"), "time": clock, "localtime": clock, "duration": make_any_duration,
    "duration.between": between, "duration.inmonths": _in("months"), "duration.indays": _in("days"), "duration.inseconds": _in("seconds"),
    "date.truncate": _truncate("date"), "datetime.truncate": _truncate("timestamp"), "localdatetime.truncate": _truncate("timestamp_ntz"),
    "time.truncate": lambda u, x, *_, kinds: _clock_cut(u, x), "localtime.truncate": lambda u, x, *_, kinds: _clock_cut(u, x),
}
TYPED |= {f"{n}.{now}": (lambda *_, kinds, f=TYPED[n]: f(kinds=[])) for n in ("date", "datetime", "localdatetime", "time", "localtime") for now in ("transaction", "statement", "realtime")}


def _clock_cut(unit: Column, x: Column) -> Column:
    unit = F.lower(unit)
    keep = lambda *units: unit.isin(*units)
    h = F.when(keep("day"), 0).otherwise(x.getField("hour"))
    i = F.when(keep("day", "hour"), 0).otherwise(x.getField("minute"))
    s = F.when(keep("day", "hour", "minute"), 0).otherwise(x.getField("second"))
    n = x.getField("nanosecond")
    n = F.when(keep("millisecond"), n - n % 10**6).when(keep("microsecond"), n - n % 1000).otherwise(F.lit(0).cast("long"))
    return F.struct(*(_long(c).alias(k) for c, k in zip((h, i, s, n), CLOCK)))
