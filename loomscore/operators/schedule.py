"""Schedules of five fields (minute, hour, day, month, weekday) as columns: parsing, matching, the next run.

A field is `*`, a number, a range a-b, either with a step /n, or a list of these; weekdays are 0 (Sunday) to 6, and 7 is Sunday too. A time
matches if all five fields hold it. A text that is no schedule parses to null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

#: The fields with their least and greatest values.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))


def _once(rows: DataFrame, *values: Column) -> DataFrame:
    """rows with the values, each worked out once however often it is looked at: as plain columns they would be written out at each place."""
    return rows.select("*", F.inline(F.array(F.struct(*values))))


def _chunks(field: Column, low: int, high: int) -> Column:
    """The values of each part of a field's list, null for a part that is none."""
    part = lambda x, k: F.regexp_extract(x, r"^(\*|([0-9]{1,4})(?:-([0-9]{1,4}))?)(?:/([0-9]{1,4}))?$", k)
    parts = F.transform(F.split(field, ","), lambda x: F.struct(*[part(x, k + 1).alias(n) for k, n in enumerate(("span", "first", "last", "step"))]))

    def bounds(x: Column) -> Column:
        number = lambda n: x[n].try_cast("int")
        start = F.when(x["span"] == "*", F.lit(low)).otherwise(number("first"))
        step = F.when(x["step"] == "", F.lit(1)).otherwise(number("step"))
        # A step without a range goes on to the field's end.
        stop = F.when(x["span"] == "*", F.lit(high)).when(x["last"] != "", number("last")).when(x["step"] != "", F.lit(high)).otherwise(start)
        return F.struct(start.alias("start"), stop.alias("stop"), step.alias("step"))

    def span(x: Column) -> Column:
        sound = x["start"].between(low, high) & x["stop"].between(low, high) & (x["start"] <= x["stop"]) & (x["step"] >= 1)
        return F.when(sound, F.sequence(x["start"], x["stop"], x["step"]))

    return F.transform(F.transform(parts, bounds), span)


def _split(cron: Column | str) -> dict[str, Column]:
    """The chunks of each field."""
    parts = F.split(F.trim(col(cron)), r"\s+")
    sound = F.size(parts) == len(FIELDS)
    return {name: F.when(sound, _chunks(F.get(parts, F.lit(k)), low, high)) for k, (name, low, high) in enumerate(FIELDS)}


def _values(name: str, chunks: Column) -> Column:
    """The field's values in ascending order, or null."""
    listed = F.flatten(chunks)  # null if one of them is
    return F.array_sort(F.array_distinct(F.transform(listed, lambda d: d % 7) if name == "weekday" else listed))


def _struct(own: dict[str, Column]) -> Column:
    sound = F.lit(True)
    for values in own.values():
        sound = sound & values.isNotNull()
    return F.when(sound, F.struct(*[v.alias(k) for k, v in own.items()]))


def parsed(cron: Column | str) -> Column:
    """A struct of the five fields' values, or null for what is no schedule."""
    return _struct({name: _values(name, chunks) for name, chunks in _split(cron).items()})


def compiled(cron: str) -> Column:
    """The fields' values of one known schedule, worked out once; a text that is none raises an error."""
    parts = cron.split()
    if len(parts) != len(FIELDS):
        raise ValueError(f"{cron!r} has not five fields")
    values = []
    for field, (name, low, high) in zip(parts, FIELDS, strict=True):
        own: set[int] = set()
        for chunk in field.split(","):
            span, _, step = chunk.partition("/")
            start, _, stop = (str(low), "-", str(high)) if span == "*" else span.partition("-")
            stop = stop or (str(high) if step else start)
            if not (start.isdigit() and stop.isdigit() and (step or "1").isdigit()) or not low <= int(start) <= int(stop) <= high or int(step or 1) < 1:
                raise ValueError(f"{field!r} is no {name}")
            own.update(range(int(start), int(stop) + 1, int(step or 1)))
        values.append(F.array(*map(F.lit, sorted({v % 7 for v in own} if name == "weekday" else own))).alias(name))
    return F.struct(*values)


def matches(ts: Column | str, fields: Column) -> Column:
    """Whether a time is one of a parsed schedule; null for none."""
    at = col(ts)
    own = {"minute": F.minute(at), "hour": F.hour(at), "day": F.dayofmonth(at), "month": F.month(at), "weekday": F.dayofweek(at) - 1}
    held = F.lit(True)
    for name, value in own.items():
        held = held & F.array_contains(fields[name], value)
    return held


def _days(fields: Column, first: Column, months: int) -> Column:
    """The schedule's days from a date on, in the months from its own on, unsorted."""
    starts = F.transform(F.sequence(F.lit(0), F.lit(months)), lambda k: F.add_months(F.trunc(first, "month"), k))
    starts = F.filter(starts, lambda m: F.array_contains(fields["month"], F.month(m)))

    def of(month: Column) -> Column:
        inside = F.filter(fields["day"], lambda d: d <= F.dayofmonth(F.last_day(month)))
        return F.transform(inside, lambda d: F.date_add(month, d - 1))

    days = F.flatten(F.transform(starts, of))
    return F.filter(days, lambda d: (d >= first) & F.array_contains(fields["weekday"], F.dayofweek(d) - 1))


def _times(fields: Column) -> Column:
    """The minutes of a day at which a schedule runs, sorted."""
    return F.array_sort(F.flatten(F.transform(fields["hour"], lambda h: F.transform(fields["minute"], lambda m: h * 60 + m))))


def _later(fields: Column, after: Column, years: int) -> Column:
    """The schedule's first day after that of a time. The near months are looked at first, the others only if those have none."""
    tomorrow = F.date_add(F.to_date(after.cast("timestamp")), 1)
    return F.coalesce(F.array_min(_days(fields, tomorrow, 2)), F.array_min(_days(fields, tomorrow, 12 * years)))


def _run(fields: Column, times: Column, later: Column, after: Column, years: int) -> Column:
    at = after.cast("timestamp")
    today = F.to_date(at)
    rest = F.filter(times, lambda t: t > F.hour(at) * 60 + F.minute(at))
    is_today = F.array_contains(fields["month"], F.month(today)) & F.array_contains(fields["day"], F.dayofmonth(today)) & F.array_contains(fields["weekday"], F.dayofweek(today) - 1)
    day, minute = (
        F.when(is_today & (F.size(rest) > 0), today).otherwise(later),
        F.when(is_today & (F.size(rest) > 0), F.get(rest, F.lit(0))).otherwise(F.get(times, F.lit(0))),
    )
    start = F.unix_seconds(day.cast("timestamp"))
    return F.when(F.months_between(day, today) <= 12 * years, F.timestamp_seconds(start + minute * 60))


def next_run(fields: Column, after: Column, years: int = 40) -> Column:
    """The first time after `after` at which a parsed schedule runs, within so many years; null if there is none.

    Days and times of a day are sought apart, each as the successor among sorted values: the next time on the day itself if it is one of
    the schedule's, else the first time of its next day."""
    return _run(fields, _times(fields), _later(fields, after, years), after, years)


def next_runs(schedules: DataFrame, cron: str, after: Column, years: int = 40) -> DataFrame:
    """schedules with next_at: when each runs next, null if it never does within so many years or its text is no schedule.

    Schedules are short and take long, so a file of very many is one task's to read: they are dealt anew over all cores."""
    schedules = schedules.repartition(4 * schedules.sparkSession.sparkContext.defaultParallelism)
    rows = _once(schedules, *[c.alias(f"_{name}") for name, c in _split(cron).items()])
    rows = _once(rows, _struct({name: _values(name, F.col(f"_{name}")) for name, *_ in FIELDS}).alias("_fields")).drop(*[f"_{name}" for name, *_ in FIELDS])
    rows = _once(rows, _times(F.col("_fields")).alias("_times"), _later(F.col("_fields"), after, years).alias("_later"))
    return rows.withColumn("next_at", _run(F.col("_fields"), F.col("_times"), F.col("_later"), after, years)).drop("_fields", "_times", "_later")
