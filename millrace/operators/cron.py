"""Five-field POSIX cron in UTC; no backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6))


def parse(expression: str) -> list[tuple[list[int], bool]]:
    """For each field, its values and whether it restricts; ValueError for what is no cron expression."""
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError(f"{expression!r}: five fields are needed")
    out = []
    for text, (name, lo, hi) in zip(parts, FIELDS):
        got: set[int] = set()
        for item in text.split(","):
            span, _, step = item.partition("/")
            if step and (not step.isdigit() or not int(step)):
                raise ValueError(f"{expression!r}: step of {name}")
            if span == "*":
                a, b = lo, hi
            else:
                a, _, b = span.partition("-")
                if not a.isdigit() or (b and not b.isdigit()):
                    raise ValueError(f"{expression!r}: {name}")
                a = int(a)
                b = int(b) if b else (hi if step else a)
            top = 7 if name == "weekday" else hi
            if not lo <= a <= top or not a <= b <= max(top, hi):
                raise ValueError(f"{expression!r}: {name} out of range")
            got.update((v % 7 if name == "weekday" else v) for v in range(a, b + 1, int(step or 1)))
        out.append((sorted(got), text != "*"))
    return out


# any schedule that ever fires does so within this many days: the longest wait is for a 29 February across a year like 2100
LONGEST_WAIT, DAY_MS = 8 * 366 + 1, 86_400_000


def _moment(ts_ms: Column) -> Column:
    return F.expr("timestampadd(MICROSECOND, 0, TIMESTAMP_NTZ'1970-01-01 00:00:00')") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ts_ms / 1000).cast("decimal(18,6)"))


def day_matches(ts_ms: Column, expression: str) -> Column:
    """Whether a day matches; with both days restricted, either suffices."""
    _, _, (d, d_on), (mo, _), (w, w_on) = parse(expression)
    day = _moment(ts_ms)
    dom, dow = F.dayofmonth(day).isin(d), (F.dayofweek(day) - 1).isin(w)
    return F.month(day).isin(mo) & ((dom | dow) if d_on and w_on else (dom & dow))


def matches(ts_ms: Column, expression: str) -> Column:
    """Whether a minute matches."""
    (mi, _), (h, _) = parse(expression)[:2]
    return F.minute(_moment(ts_ms)).isin(mi) & F.hour(_moment(ts_ms)).isin(h) & day_matches(ts_ms, expression)


def minutes(spark: SparkSession, start_ms: int, end_ms: int) -> DataFrame:
    """Every minute from beyond ``start_ms`` up to ``end_ms``."""
    first = (start_ms // 60_000 + 1) * 60_000
    return spark.range(first, end_ms + 1, 60_000).select(F.col("id").alias("fire_at"))


def firings(spark: SparkSession, schedules: dict[str, str], start_ms: int, end_ms: int) -> DataFrame:
    """Rows (name, fire_at, dedup_key) of each schedule within a span."""
    base = minutes(spark, start_ms, end_ms)
    out = None
    for name, expression in sorted(schedules.items()):
        one = base.where(matches(F.col("fire_at"), expression)).select(F.lit(name).alias("name"), "fire_at", F.concat(F.lit(f"cron:{name}:"), F.col("fire_at").cast("string")).alias("dedup_key"))
        out = one if out is None else out.unionByName(one)
    return out


def next_firing(spark: SparkSession, schedules: dict[str, str], now_ms: int) -> DataFrame:
    """The first firing of each schedule strictly after ``now_ms``; no row for one that never fires.

    Days are looked through, not minutes: the first matching day has the schedule's first time, today the first after now.
    """
    today, minute = now_ms // DAY_MS, now_ms // 60_000 % 1440
    days = spark.range(today, today + LONGEST_WAIT).select((F.col("id") * DAY_MS).alias("day"))
    out = None
    for name, expression in sorted(schedules.items()):
        (mi, _), (h, _) = parse(expression)[:2]
        rest = [x * 60 + y for x in h for y in mi if x * 60 + y > minute]
        first = F.lit(min(rest)) if rest else F.lit(None).cast("int")
        at = F.when(F.col("day") == today * DAY_MS, first).otherwise(h[0] * 60 + mi[0])
        one = days.where(day_matches(F.col("day"), expression)).select(F.lit(name).alias("name"), (F.col("day") + at * 60_000).alias("fire_at"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("name").agg(F.min("fire_at").alias("next_fire")).where("next_fire IS NOT NULL")


def next_after(expression: str, now_ms: int) -> int | None:
    """The first firing strictly after ``now_ms``, for stateful callers; None for a schedule that never fires."""
    from datetime import datetime, timedelta, timezone

    (mi, _), (h, _), (d, d_on), (mo, _), (w, w_on) = parse(expression)
    now = datetime.fromtimestamp(now_ms // 60_000 * 60, timezone.utc)
    day = now.replace(hour=0, minute=0)
    for n in range(LONGEST_WAIT):
        at = day + timedelta(days=n)
        dom, dow = at.day in d, at.isoweekday() % 7 in w
        if at.month in mo and ((dom or dow) if d_on and w_on else (dom and dow)):
            times = [x * 60 + y for x in h for y in mi if n or x * 60 + y > now.hour * 60 + now.minute]
            if times:
                return int((at + timedelta(minutes=min(times))).timestamp()) * 1000
    return None
