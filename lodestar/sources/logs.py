"""Time-series logs: text fields and a Timestamp, in folders by day. Terms are substrings here; there are no links."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators.aggregate import truncated
from ..plans.ast import And, Clause, Everything, Not, Nothing, Or, Range
from ..plans.parser import DATE_PARTS, DQLError, Parser

_PART = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}


def append(df: DataFrame, path: str, ts: str = "Timestamp") -> None:
    df.withColumn("_day", F.to_date(ts)).write.mode("append").partitionBy("_day").parquet(path)


def compact(spark: SparkSession, path: str, out: str, ts: str = "Timestamp") -> None:
    """Each day's files as few, in order of time: days are dealt by ranges of time, so that a long day fills several tasks."""
    spark.read.parquet(path).repartitionByRange("_day", ts).sortWithinPartitions("_day", ts).write.mode("overwrite").partitionBy("_day").parquet(out)


def aged(df: DataFrame, days: int, now: datetime) -> DataFrame:
    """The days that retention keeps: whole partitions go."""
    return df.where(F.col("_day") > F.date_sub(F.lit(str(now.date())).cast("date"), days))


def synthetic(df: DataFrame, pattern: str) -> DataFrame:
    """Field=text{F1}text{F2}: new fields from between the texts, as short as may be."""
    field, _, body = pattern.partition("=")
    names = re.findall(r"\{(\w+)\}", body)
    parts = re.split(r"\{\w+\}", body)
    rx = "(?s)" + "".join(re.escape(p) + ("(.*?)" if i < len(parts) - 1 else "") for i, p in enumerate(parts)) + ("$" if not parts[-1] else "")
    hit = F.col(field).rlike(rx)
    return df.withColumns({n: F.when(hit, F.regexp_extract(field, rx, i + 1)) for i, n in enumerate(names)})


def _text(c: Column, op: str, v: str) -> Column:
    low = F.lower(c.cast("string"))
    if "*" in v or "?" in v:
        body = "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in v.lower())
        return low.rlike(f"(?s)^{body}$" if op == "=" else f"(?s){body}")
    return low == v.lower() if op == "=" else low.contains(v.lower())


def column(df: DataFrame, q, ts: str = "Timestamp") -> Column:
    sure = lambda c: F.coalesce(c, F.lit(False))
    if isinstance(q, Everything):
        return F.lit(True)
    if isinstance(q, Nothing):
        return F.lit(False)
    if isinstance(q, (And, Or)):
        out = column(df, q.parts[0], ts)
        for p in q.parts[1:]:
            out = out & column(df, p, ts) if isinstance(q, And) else out | column(df, p, ts)
        return out
    if isinstance(q, Not):
        return ~column(df, q.part, ts)
    if not isinstance(q, Clause):
        raise DQLError("logs have no links")
    if not q.steps:
        out = F.lit(False)
        for c, t in df.dtypes:
            if t == "string":
                out = out | sure(_text(F.col(f"`{c}`"), q.op, q.value))
        return out
    name = q.steps[0].name
    c = F.col(f"`{name}`")
    if len(q.steps) > 1:
        if q.steps[1].name not in DATE_PARTS:
            raise DQLError("logs have no links")
        return sure(_PART[q.steps[1].name](c) == int(q.value))
    if q.op == "null":
        return c.isNull()
    if q.op == "range":
        r: Range = q.value
        lit = (lambda v: F.lit(times.parse(v).isoformat(sep=" ")).cast("timestamp")) if name == ts else (lambda v: F.lit(v.lower()))
        x, out = (c if name == ts else F.lower(c.cast("string"))), F.lit(True)
        if r.low is not None:
            out = out & (x >= lit(r.low) if r.low_in else x > lit(r.low))
        if r.high is not None:
            out = out & (x <= lit(r.high) if r.high_in else x < lit(r.high))
        return sure(out)
    values = q.value if isinstance(q.value, tuple) else (q.value,)
    out = F.lit(False)
    for v in values:
        out = out | sure(c == F.lit(times.parse(v).isoformat(sep=" ")).cast("timestamp") if name == ts else _text(c, "=" if q.op in ("=", "in") else ":", v))
    return out


def query(df: DataFrame, q: str = "*", f: list[str] | None = None, o: str = "Timestamp DESC", s: int = 100, skip: int = 0, e: str | None = None, g: str | None = None, pattern: str | None = None, ts: str = "Timestamp", clock=None) -> DataFrame:
    """A page of a log: by time only; e and g go on at and after a time; pattern adds fields."""
    if pattern:
        df = synthetic(df, pattern)
    down = o.strip().endswith("DESC")
    if o.split()[0] != ts:
        raise DQLError(f"logs are ordered by {ts} only")
    df = df.where(column(df, Parser(q, clock).query(), ts))
    for v, same in ((e, True), (g, False)):
        if v:
            lit = F.lit(times.parse(v).isoformat(sep=" ")).cast("timestamp")
            df = df.where((F.col(ts) <= lit if same else F.col(ts) < lit) if down else (F.col(ts) >= lit if same else F.col(ts) > lit))
    rest = [F.col(c) for c, t in df.dtypes if c != ts and t not in ("map",)]
    df = df.orderBy(F.desc(ts) if down else F.asc(ts), *rest)
    df = df.offset(skip) if skip else df
    df = df.limit(s) if s else df
    return df.select(ts, *f) if f else df


def aggregate(df: DataFrame, q: str = "*", f: str | None = None, ts: str = "Timestamp", clock=None) -> DataFrame:
    """Counts in all, by a field, by a truncated time, or by named sets."""
    df = df.where(column(df, Parser(q, clock).query(), ts))
    n = F.count(F.lit(1)).alias("count")
    if not f:
        return df.agg(n)
    g = Parser(f, clock).group_sets()[0][0]
    if g.func == "SETS":
        sets = F.array_compact(F.array(*(F.when(column(df, x, ts), F.lit(name)) for x, name in g.args)))
        return df.select(F.explode(sets).alias("g1")).groupBy("g1").agg(n)
    key = F.col(f"`{g.steps[0].name}`")
    if g.steps[0].name == ts:
        key = truncated(key, g.args[0] if g.func == "TRUNCATE" else "SECOND", g.args[1] if len(g.args) > 1 else None)
    return df.groupBy(key.alias("g1")).agg(n)
