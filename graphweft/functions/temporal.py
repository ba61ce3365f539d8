"""Dates, times, date-times and durations as Spark columns.

Local date-times are Spark's, in microseconds. A zoned one is a struct of microseconds in UTC, the offset in seconds and the zone's name, if it
has one; times of day are structs of nanoseconds (in UTC, with the offset, if zoned), so that all of them compare by their first field. A
duration is a struct of months, days, seconds and nanoseconds, since its parts don't convert into each other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphweft.errors import QueryError

PARTS = ("months", "days", "seconds", "nanos")
#: Days of an average month, seconds of a day.
MONTH_DAYS, DAY = 365.2425 / 12, 86400
UNITS = {"year": "year", "quarter": "quarter", "month": "month", "week": "week", "day": "day", "hour": "hour", "minute": "minute", "second": "second", "millisecond": "millisecond", "microsecond": "microsecond"}
#: A time of day as text: hour, minute, second, fraction, offset, zone.
CLOCK = r"^(\d{2})(?::?(\d{2}))?(?::?(\d{2}))?(?:[.,](\d{1,9}))?(Z|[+-]\d{2}(?::?\d{2})?(?::?\d{2})?)?(?:\[([^\]]+)\])?$"
OFFSET = r"^([+-])(\d{2}):?(\d{2})?:?(\d{2})?$"
ZONED = ("datetime", "time")
KINDS = ("date", "localdatetime", "datetime", "localtime", "time")
SPANS = {"millennium": 1000, "century": 100, "decade": 10}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def named(**parts) -> Column:
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def make_duration(months, days, seconds, nanos=0) -> Column:
    """Parts as columns or numbers; null if one of them is."""
    parts = [F.lit(p) if not isinstance(p, Column) else p for p in (months, days, seconds, nanos)]
    made = F.struct(*(p.cast("bigint").alias(n) for p, n in zip(parts, PARTS)))
    return let(made, lambda d: F.when(d["months"].isNotNull() & d["days"].isNotNull() & d["seconds"].isNotNull() & d["nanos"].isNotNull(), d))


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def _from_micros(m: Column) -> Column:
    return F.timestamp_micros(m.cast("bigint")).cast("timestamp_ntz")


def _div(c: Column, n: int) -> Column:
    return F.call_function("div", c, F.lit(n).cast("bigint"))


def zone_text(offset: Column) -> Column:
    size = F.abs(offset)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(F.when(offset < 0, "-").otherwise("+"), two(_div(size, 3600)), F.lit(":"), two(_div(size, 60) % 60), F.when(size % 60 != 0, F.concat(F.lit(":"), two(size % 60))).otherwise(""))
    return F.when(offset == 0, "Z").otherwise(text)


def _offset(text: Column) -> Column:
    """Seconds of Z or +hh:mm text; null for other text."""
    part = lambda k: F.coalesce(F.regexp_extract(text, OFFSET, k).try_cast("int"), F.lit(0))
    size = part(2) * 3600 + part(3) * 60 + part(4)
    return F.when(text.isin("Z", "z"), 0).when(text.rlike(OFFSET), F.when(F.regexp_extract(text, OFFSET, 1) == "-", -size).otherwise(size)).cast("int")


def make_datetime(local: Column, offset: Column, zone: Column) -> Column:
    """From microseconds as the clock shows them; a named zone knows its offset itself."""

    def made(p):
        by_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(p["local"]), F.coalesce(p["zone"], F.lit("UTC"))))
        utc = F.when(p["zone"].isNotNull(), by_zone).otherwise(p["local"] - p["offset"].cast("bigint") * 1_000_000)
        return F.when(utc.isNotNull(), F.struct(utc.alias("utc"), _div(p["local"] - utc, 1_000_000).cast("int").alias("offset"), p["zone"].alias("zone")))

    return let(named(local=local.cast("bigint"), offset=offset.cast("int"), zone=zone.cast("string")), made)


def make_time(nanos: Column, offset: Column) -> Column:
    return F.when(nanos.isNotNull() & offset.isNotNull(), F.struct((nanos - offset.cast("bigint") * 1_000_000_000).cast("bigint").alias("utc"), offset.cast("int").alias("offset")))


def make_localtime(nanos: Column) -> Column:
    return F.when(nanos.isNotNull(), F.struct(nanos.cast("bigint").alias("nanos")))


def local(value) -> Column:
    """Microseconds as the clock shows them, from 1970 on; a time of day is on its first day."""
    x, t = value
    if t == "datetime":
        return x["utc"] + x["offset"].cast("bigint") * 1_000_000
    if t in ("time", "localtime"):
        return _div(nanos_of_day(value), 1000)
    return _micros(x.cast("timestamp_ntz"))


def nanos_of_day(value) -> Column:
    x, t = value
    if t == "localtime":
        return x["nanos"]
    if t == "time":
        return x["utc"] + x["offset"].cast("bigint") * 1_000_000_000
    return F.pmod(local(value), F.lit(DAY * 1_000_000).cast("bigint")) * 1000


def clock_text(nanos: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")

    def text(n):
        rest = n % 1_000_000_000
        frac = F.when(rest != 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(rest.cast("string"), 9, "0"), "0+$", ""))).otherwise("")
        second = _div(n, 1_000_000_000) % 60
        tail = F.when((second != 0) | (rest != 0), F.concat(F.lit(":"), two(second), frac)).otherwise("")
        return F.concat(two(_div(n, 3_600_000_000_000)), F.lit(":"), two(_div(n, 60_000_000_000) % 60), tail)

    return let(nanos, text)


def text(value) -> Column:
    x, t = value
    if t == "duration":
        return duration_text(x)
    if t == "localtime":
        return clock_text(x["nanos"])
    if t == "time":
        return F.concat(clock_text(nanos_of_day(value)), zone_text(x["offset"]))
    day = F.concat(_from_micros(local(value)).cast("date").cast("string"), F.lit("T"), clock_text(nanos_of_day(value)))
    if t == "localdatetime":
        return day
    return F.concat(day, zone_text(x["offset"]), F.when(x["zone"].isNotNull(), F.concat(F.lit("["), x["zone"], F.lit("]"))).otherwise(""))


def shift(value, d: Column, sign: int) -> tuple[Column, str]:
    """A date or date-time moved by a duration: months first (held to the month's end), then days, then time."""
    t = value[1]
    if t == "date":
        moved = lambda p: F.date_add(F.add_months(p["x"], (sign * p["d"]["months"]).cast("int")), (sign * (p["d"]["days"] + F.call_function("div", p["d"]["seconds"], F.lit(DAY).cast("bigint")))).cast("int"))
        return let(named(x=value[0], d=d), moved), "date"

    def moved_time(p):
        x, by = p["x"], p["d"]
        day = F.date_add(F.add_months(x.cast("date"), (sign * by["months"]).cast("int")), (sign * by["days"]).cast("int"))
        rest = _micros(x) - _micros(x.cast("date").cast("timestamp_ntz"))
        return _from_micros(_micros(day.cast("timestamp_ntz")) + rest + sign * (by["seconds"] * 1_000_000 + F.call_function("div", by["nanos"], F.lit(1000).cast("bigint"))))

    if t in ("time", "localtime"):
        by = lambda p: F.pmod(p["n"] + sign * (p["d"]["seconds"] * 1_000_000_000 + p["d"]["nanos"]), F.lit(DAY * 1_000_000_000).cast("bigint"))
        moved = let(named(n=nanos_of_day(value), d=d), by)
        return (make_localtime(moved), t) if t == "localtime" else (make_time(moved, value[0]["offset"]), t)
    if t == "datetime":
        at, _ = shift((_from_micros(local(value)), "localdatetime"), d, sign)
        return make_datetime(_micros(at), value[0]["offset"], value[0]["zone"]), t
    return let(named(x=value[0], d=d), moved_time), "localdatetime"


def arithmetic(op: str, a, b) -> tuple[Column, str]:
    (x, s), (y, t) = a, b
    if s == t == "duration" and op in "+-":
        k = 1 if op == "+" else -1
        return let(named(x=x, y=y), lambda p: make_duration(*(p["x"][n] + k * p["y"][n] for n in PARTS))), "duration"
    if s in KINDS and t == "duration" and op in "+-":
        return shift(a, y, 1 if op == "+" else -1)
    if s == "duration" and t in KINDS and op == "+":
        return shift(b, x, 1)
    if op in "*/" and {s, t} <= {"duration", "int", "float"}:
        d, n = (x, y) if s == "duration" else (y, x)
        return let(named(d=d, n=n), lambda p: _fractions(*(p["d"][k].cast("double") * p["n"] if op == "*" else p["d"][k].cast("double") / p["n"] for k in PARTS))), "duration"
    return F.lit(None).cast("timestamp_ntz"), "localdatetime"


def _fractions(months, days, seconds, nanos=None) -> Column:
    """Whole parts, with fractions of a month passed on to days and of a day to seconds."""
    whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("bigint")
    given = named(m=months, d=days, s=seconds, n=nanos if nanos is not None else F.lit(0.0))
    by_day = lambda p: named(m=whole(p["m"]), d=p["d"] + (p["m"] - whole(p["m"])) * MONTH_DAYS, s=p["s"], n=p["n"])
    by_second = lambda p: named(m=p["m"], d=whole(p["d"]), s=p["s"] + (p["d"] - whole(p["d"])) * DAY, n=p["n"])
    made = lambda p: make_duration(p["m"], p["d"], whole(p["s"]), F.round((p["s"] - whole(p["s"])) * 1e9) + p["n"])
    return let(let(let(given, by_day), by_second), made)


def parse_duration(s: Column) -> Column:
    """ISO text PnYnMnWnDTnHnMnS, fractions and signs allowed; other text is null."""
    got = lambda unit, time: F.coalesce(F.regexp_extract(F.regexp_extract(s, "^P([^T]*)" if not time else "T(.*)$", 1), f"(-?[0-9]+(?:[.][0-9]+)?){unit}", 1).try_cast("double"), F.lit(0.0))
    ok = s.rlike("^P(?=.)(-?[0-9.]+[YMWD])*(T(-?[0-9.]+[HMS])+)?$")
    made = _fractions(got("Y", False) * 12 + got("M", False), got("W", False) * 7 + got("D", False), got("H", True) * 3600 + got("M", True) * 60 + got("S", True))
    return F.when(ok, made)


def duration_text(d: Column) -> Column:
    return let(d, _duration_text)


def _duration_text(d: Column) -> Column:
    part = lambda n, unit: F.when(n != 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    div = lambda a, n: F.call_function("div", a, F.lit(n).cast("bigint"))
    months, seconds = d["months"], d["seconds"]
    frac = F.when(d["nanos"] != 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(F.abs(d["nanos"]).cast("string"), 9, "0"), "0+$", ""))).otherwise("")
    last = seconds % 60
    clock = F.concat(part(div(seconds, 3600), "H"), part(div(seconds % 3600, 60), "M"), F.when((last != 0) | (d["nanos"] != 0), F.concat(last.cast("string"), frac, F.lit("S"))).otherwise(""))
    text = F.concat(F.lit("P"), part(div(months, 12), "Y"), part(months % 12, "M"), part(d["days"], "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
    return F.when(d.isNull(), None).when(text == "P", "PT0S").otherwise(text)


def _fields(args, names) -> dict:
    x, t = args[0]
    have = {k for k, _ in t[1]}
    return {n: x[n] for n in names if n in have}


def _date_of(args) -> Column:
    x, t = args[0]
    if t == "str":
        week = F.regexp_extract(x, "^([0-9]{4})-?W([0-9]{2})-?([1-7])?$", 0) != ""
        part = lambda k: F.regexp_extract(x, "^([0-9]{4})-?W([0-9]{2})-?([1-7])?$", k).try_cast("int")
        return F.when(week, _week(part(1), part(2), F.coalesce(part(3), F.lit(1)))).when(x.rlike("^[0-9]{8}$"), F.try_to_date(x, "yyyyMMdd")).when(x.rlike("^[0-9]{4}-?[0-9]{3}$"), F.date_add(F.make_date(F.left(x, F.lit(4)).try_cast("int"), F.lit(1), F.lit(1)), F.right(x, F.lit(3)).try_cast("int") - 1)).otherwise(x.try_cast("date"))
    if t in ("date", "localdatetime", "datetime"):
        return _from_micros(local(args[0])).cast("date")
    if t == "null":
        return F.lit(None).cast("date")
    args = _with_base(args)
    x, t = args[0]
    f = _fields(args, ("year", "month", "day", "week", "dayOfWeek", "quarter", "dayOfQuarter", "ordinalDay", "date"))
    if "date" in f:
        base = f["date"].cast("date")
        year, month, day = f.get("year", F.year(base)), f.get("month", F.month(base)), f.get("day", F.dayofmonth(base))
        return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))
    year = f["year"].cast("int")
    if "week" in f:
        return _week(year, f["week"].cast("int"), f.get("dayOfWeek", F.lit(1)).cast("int"))
    if "ordinalDay" in f:
        return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), f["ordinalDay"].cast("int") - 1)
    if "quarter" in f:
        return F.date_add(F.make_date(year, (f["quarter"] * 3 - 2).cast("int"), F.lit(1)), f.get("dayOfQuarter", F.lit(1)).cast("int") - 1)
    return F.make_date(year, f.get("month", F.lit(1)).cast("int"), f.get("day", F.lit(1)).cast("int"))


def _week(year, week, day) -> Column:
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(fourth, (week - 1) * 7 + day - 1 - F.weekday(fourth))


def _with_base(args) -> list:
    """A map's ``datetime`` as its ``date``, and a date of any kind as a date."""
    x, t = args[0]
    types = dict(t[1])
    base = next((k for k in ("date", "datetime") if k in types), None)
    if base is None:
        return args
    fields = {k: (x[k], v) for k, v in types.items() if k not in ("date", "datetime")}
    fields["date"] = (_from_micros(local((x[base], types[base]))).cast("date"), "date")
    return [(F.struct(*(c.alias(k) for k, (c, _) in fields.items())), ("map", tuple((k, v) for k, (_, v) in fields.items())))]


def _parse_clock(s: Column) -> tuple[Column, Column, Column]:
    """Nanoseconds of the day, offset and zone of text; the first is null for other text."""
    part = lambda k: F.coalesce(F.regexp_extract(s, CLOCK, k).try_cast("bigint"), F.lit(0))
    frac = F.rpad(F.regexp_extract(s, CLOCK, 4), 9, "0").try_cast("bigint")
    nanos = ((part(1) * 60 + part(2)) * 60 + part(3)) * 1_000_000_000 + F.coalesce(frac, F.lit(0))
    return F.when(s.rlike(CLOCK), nanos), _offset(F.regexp_extract(s, CLOCK, 5)), F.nullif(F.regexp_extract(s, CLOCK, 6), F.lit(""))


def _split(s: Column) -> tuple[Column, Column]:
    """Date and clock of text; a date alone is midnight."""
    return F.substring_index(s, "T", 1), F.when(s.contains("T"), F.regexp_replace(s, "^[^T]*T", "")).otherwise("00")


def _clock_of(args) -> Column:
    """Nanoseconds of the day of a map or of another value."""
    x, t = args[0]
    if t in KINDS:
        return nanos_of_day(args[0])
    f, types = _fields(args, ("hour", "minute", "second", "millisecond", "microsecond", "nanosecond")), dict(t[1])
    base = next((k for k in ("time", "datetime") if k in types), None)
    if base:
        n = nanos_of_day((x[base], types[base]))
        whole = {"hour": _div(n, 3_600_000_000_000), "minute": _div(n, 60_000_000_000) % 60, "second": _div(n, 1_000_000_000) % 60}
        rest = n % 1_000_000_000 if not {"millisecond", "microsecond", "nanosecond"} & set(f) else F.lit(0)
    else:
        whole, rest = {}, F.lit(0)
    at = lambda k: f.get(k, whole.get(k, F.lit(0))).cast("bigint")
    return ((at("hour") * 60 + at("minute")) * 60 + at("second")) * 1_000_000_000 + at("millisecond") * 1_000_000 + at("microsecond") * 1000 + at("nanosecond") + rest


def _zone_of(args) -> tuple[Column, Column]:
    """Offset and zone that a map names or that its parts have; UTC otherwise."""
    x, t = args[0]
    none = F.lit(None).cast("string")
    if kind_of(t) == "map":
        types = dict(t[1])
        if "timezone" in types:
            at = _offset(x["timezone"])
            return at, F.when(at.isNull(), x["timezone"])
        for k in ("time", "datetime"):
            if types.get(k) in ZONED:
                return x[k]["offset"], x[k]["zone"] if types[k] == "datetime" else none
    elif t in ZONED:
        return x["offset"], x["zone"] if t == "datetime" else none
    return F.lit(0), none


def kind_of(t) -> str:
    return t if isinstance(t, str) else t[0]


def _datetime_of(args) -> Column:
    """A local date-time: zoned ones lose their zone."""
    x, t = args[0]
    if t == "str":
        day, clock = _split(x)
        return _from_micros(_micros(_date_of([(day, "str")]).cast("timestamp_ntz")) + _div(_parse_clock(clock)[0], 1000))
    if t in ("date", "localdatetime", "datetime"):
        return _from_micros(local(args[0]))
    if t == "null":
        return F.lit(None).cast("timestamp_ntz")
    return _from_micros(_micros(_date_of(args).cast("timestamp_ntz")) + _div(_clock_of(args), 1000))


def _zoned_of(args) -> Column:
    x, t = args[0]
    if t == "null":
        return F.lit(None).cast("struct<utc:bigint,offset:int,zone:string>")
    if t == "datetime":
        return x
    if t == "str":
        _, offset, zone = _parse_clock(_split(x)[1])
    else:
        offset, zone = _zone_of(args)
    return make_datetime(_micros(_datetime_of(args)), F.coalesce(offset, F.lit(0)), zone)


def _time_of(args, zoned: bool) -> Column:
    x, t = args[0]
    if t == "null":
        return F.lit(None).cast("struct<utc:bigint,offset:int>" if zoned else "struct<nanos:bigint>")
    if t == "str":
        nanos, offset, zone = _parse_clock(F.regexp_replace(x, "^[^T]*T", ""))
    else:
        nanos, (offset, zone) = _clock_of(args), _zone_of(args)
    if not zoned:
        return make_localtime(nanos)
    return make_time(nanos, F.coalesce(offset, F.when(zone.isNull(), 0)))


def _duration_of(args) -> Column:
    x, t = args[0]
    if t == "str":
        return parse_duration(x)
    if t == "duration":
        return x
    if t == "null":
        return F.lit(None).cast("struct<months:bigint,days:bigint,seconds:bigint,nanos:bigint>")
    f = _fields(args, ("years", "quarters", "months", "weeks", "days", "hours", "minutes", "seconds", "milliseconds", "microseconds", "nanoseconds"))
    at = lambda n: f.get(n, F.lit(0)).cast("double")
    return _fractions(at("years") * 12 + at("quarters") * 3 + at("months"), at("weeks") * 7 + at("days"), at("hours") * 3600 + at("minutes") * 60 + at("seconds") + at("milliseconds") / 1e3 + at("microseconds") / 1e6, at("nanoseconds"))


def truncate(unit: str, value, to: str, extra=None) -> tuple[Column, str]:
    """The beginning of the unit that ``value`` is in; fields of the map ``extra`` then take the place of its own."""
    have = {k: extra[0][k] for k, _ in extra[1][1]} if extra is not None and kind_of(extra[1]) == "map" else {}
    if to in ("time", "localtime"):
        step = {"day": DAY * 10**9, "hour": 3600 * 10**9, "minute": 60 * 10**9, "second": 10**9, "millisecond": 10**6, "microsecond": 1000}.get(unit)
        if step is None:
            raise QueryError("InvalidArgumentValue", unit)
        n = nanos_of_day(value)
        nanos, day = n - n % step, None
    else:
        x = _from_micros(local(value))
        if unit in SPANS:
            out = F.make_date((F.year(x) - F.year(x) % SPANS[unit]).cast("int"), F.lit(1), F.lit(1))
        elif unit == "weekYear":
            out = _week(_week_year(x), F.lit(1), F.lit(1))
        elif unit in UNITS:
            out = F.date_trunc(UNITS[unit], x)
        else:
            raise QueryError("InvalidArgumentValue", unit)
        at = out.cast("timestamp_ntz")
        day, nanos = at.cast("date"), nanos_of_day((at, "localdatetime"))
        if {"year", "month", "day"} & set(have):
            day = F.make_date(*(have.get(k, f(day)).cast("int") for k, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth))))
        if "dayOfWeek" in have:
            day = F.date_add(day, have["dayOfWeek"].cast("int") - 1 - F.weekday(day))
        if "ordinalDay" in have:
            day = F.date_add(F.date_trunc("year", day).cast("date"), have["ordinalDay"].cast("int") - 1)
        if "dayOfQuarter" in have:
            day = F.date_add(F.date_trunc("quarter", day).cast("date"), have["dayOfQuarter"].cast("int") - 1)
    for field, size, above in (("hour", 3600 * 10**9, DAY * 10**9), ("minute", 60 * 10**9, 3600 * 10**9), ("second", 10**9, 60 * 10**9), ("millisecond", 10**6, 10**9), ("microsecond", 1000, 10**6), ("nanosecond", 1, 1000)):
        if field in have:
            own = _div(nanos % above, size)
            nanos = nanos + (have[field].cast("bigint") - own) * size
    if to == "date":
        return day, "date"
    if to == "localtime":
        return make_localtime(nanos), to
    offset, zone = _zone_of([(F.struct(have["timezone"].alias("timezone")), ("map", (("timezone", "str"),)))] if "timezone" in have else [value])
    if to == "time":
        return make_time(nanos, F.coalesce(offset, F.lit(0))), to
    micros = _micros(day.cast("timestamp_ntz")) + _div(nanos, 1000)
    return (_from_micros(micros), "localdatetime") if to == "localdatetime" else (make_datetime(micros, F.coalesce(offset, F.lit(0)), zone), "datetime")


def _week_year(x) -> Column:
    return F.year(F.date_add(x.cast("date"), 3 - F.weekday(x))).cast("int")


def _both(a, b) -> tuple[Column, Column]:
    """Two values as local date-times: by UTC if both are zoned, on one day if either has no date."""
    if a[1] in ZONED and b[1] in ZONED and a[1] == b[1]:
        each = [v[0]["utc"] if v[1] == "datetime" else _div(v[0]["utc"], 1000) for v in (a, b)]
    elif {a[1], b[1]} & {"time", "localtime"}:
        each = [_div(nanos_of_day(v), 1000) for v in (a, b)]
    else:
        each = [local(v) for v in (a, b)]
    return _from_micros(each[0]), _from_micros(each[1])


def between(a, b) -> Column:
    """Whole months, then days, then seconds from the first to the second."""
    x, y = _both(a, b)
    given = named(x=x, y=y)
    div = lambda c, n: F.call_function("div", c, F.lit(n).cast("bigint"))
    after = lambda p: shift((p["x"], "localdatetime"), make_duration(p["m"], 0, 0), 1)[0]

    def months(p):
        m = (F.year(p["y"]) * 12 + F.month(p["y"]) - F.year(p["x"]) * 12 - F.month(p["x"])).cast("bigint")
        return named(x=p["x"], y=p["y"], m=m)

    def held(p):
        m = p["m"] - F.when((p["t"] > p["y"]) & (p["m"] > 0), 1).when((p["t"] < p["y"]) & (p["m"] < 0), -1).otherwise(0)
        return named(x=p["x"], y=p["y"], m=m)

    with_after = lambda p: named(x=p["x"], y=p["y"], m=p["m"], t=after(p))
    rest = lambda p: named(m=p["m"], r=_micros(p["y"]) - _micros(after(p)))
    made = lambda p: make_duration(p["m"], div(p["r"], DAY * 1_000_000), div(p["r"] % (DAY * 1_000_000), 1_000_000), (p["r"] % 1_000_000) * 1000)
    return let(let(let(let(let(given, months), with_after), held), rest), made)


def call(name: str, args: list) -> tuple[Column, str]:
    base, _, rest = name.partition(".")
    if base == "duration":
        if rest == "":
            return _duration_of(args), "duration"
        if rest == "between":
            return between(*args), "duration"
        if rest == "inmonths":
            return make_duration(between(*args)["months"], 0, 0), "duration"
        x, y = _both(*args)
        gap = _micros(y) - _micros(x)
        if rest == "indays":
            return make_duration(F.lit(0), _div(gap, DAY * 1_000_000), F.lit(0)), "duration"
        if rest == "inseconds":
            return make_duration(F.lit(0), F.lit(0), _div(gap, 1_000_000), (gap % 1_000_000) * 1000), "duration"
        raise QueryError("UnknownFunction", name)
    if rest == "truncate":
        raise QueryError("InvalidArgumentValue", "the unit must be a literal")
    if rest in ("transaction", "statement", "realtime") or not args:
        zone = args[0][0] if args and args[0][1] == "str" else None
        now = make_datetime(F.unix_micros(F.current_timestamp()), F.lit(0), F.lit(None))
        args, rest = [(now, "datetime")], ""
        if zone is not None:
            args = [(make_datetime(F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(now["utc"]), zone)), F.lit(0), zone), "datetime")]
    elif rest in ("fromepoch", "fromepochmillis"):
        nanos = args[1][0] if len(args) > 1 else F.lit(0)
        micros = args[0][0] * 1_000_000 + _div(nanos.cast("bigint"), 1000) if rest == "fromepoch" else args[0][0] * 1000
        args, rest = [(make_datetime(micros, F.lit(0), F.lit(None)), "datetime")], ""
    if rest:
        raise QueryError("UnknownFunction", name)
    if base == "date":
        return _date_of(args), "date"
    if base in ("time", "localtime"):
        return _time_of(args, base == "time"), base
    return (_datetime_of(args), base) if base == "localdatetime" else (_zoned_of(args), "datetime")


def accessor(value, field: str) -> tuple[Column, str]:
    x, t = value
    if t == "duration":
        div = lambda c, n: F.call_function("div", c, F.lit(n).cast("bigint"))
        found = {
            "years": div(x["months"], 12), "quarters": div(x["months"], 3), "months": x["months"], "weeks": div(x["days"], 7), "days": x["days"], "hours": div(x["seconds"], 3600), "minutes": div(x["seconds"], 60), "seconds": x["seconds"],
            "milliseconds": x["seconds"] * 1000 + div(x["nanos"], 1_000_000), "microseconds": x["seconds"] * 1_000_000 + div(x["nanos"], 1000), "nanoseconds": x["seconds"] * 1_000_000_000 + x["nanos"],
            "monthsOfYear": x["months"] % 12, "minutesOfHour": div(x["seconds"], 60) % 60, "secondsOfMinute": x["seconds"] % 60, "nanosecondsOfSecond": x["nanos"],
        }.get(field)
        return (found, "int") if found is not None else (F.lit(None), "null")
    zoned = {}
    if t in ZONED:
        named_zone = F.coalesce(x["zone"], zone_text(x["offset"])) if t == "datetime" else zone_text(x["offset"])
        zoned = {"timezone": (named_zone, "str"), "offset": (zone_text(x["offset"]), "str"), "offsetSeconds": (x["offset"].cast("bigint"), "int"), "offsetMinutes": (_div(x["offset"], 60), "int")}
    if t in ("time", "localtime"):
        n = nanos_of_day(value)
        found = {"hour": _div(n, 3_600_000_000_000), "minute": _div(n, 60_000_000_000) % 60, "second": _div(n, 1_000_000_000) % 60, "millisecond": _div(n % 1_000_000_000, 1_000_000), "microsecond": _div(n % 1_000_000_000, 1000), "nanosecond": n % 1_000_000_000}
        return zoned[field] if field in zoned else (found[field].cast("bigint"), "int") if field in found else (F.lit(None), "null")
    if t == "datetime":
        if field in zoned:
            return zoned[field]
        if field in ("epochSeconds", "epochMillis"):
            return F.floor(x["utc"] / (1_000_000 if field == "epochSeconds" else 1000)).cast("bigint"), "int"
        x, t = _from_micros(local(value)), "localdatetime"
    day = x.cast("date")
    found = {"year": F.year(x), "quarter": F.quarter(x), "month": F.month(x), "week": F.weekofyear(x), "weekYear": _week_year(x), "day": F.dayofmonth(x), "ordinalDay": F.dayofyear(x), "weekDay": F.weekday(x) + 1, "dayOfWeek": F.weekday(x) + 1, "dayOfQuarter": F.datediff(day, F.date_trunc("quarter", day).cast("date")) + 1}
    if t == "localdatetime":
        micro = _micros(x)
        found |= {"hour": F.hour(x), "minute": F.minute(x), "second": F.second(x), "millisecond": F.floor(micro % 1_000_000 / 1000), "microsecond": micro % 1_000_000, "nanosecond": micro % 1_000_000 * 1000, "epochSeconds": F.floor(micro / 1_000_000), "epochMillis": F.floor(micro / 1000)}
    return (found[field].cast("bigint"), "int") if field in found else (F.lit(None), "null")
