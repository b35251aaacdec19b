"""Queries as DataFrame plans. Logic is two-valued: a leaf is never null, so NOT includes objects without values.

Conjuncts on links become left-semi or left-anti joins; links under OR or NOT become a flag by a left join with distinct ids (an
existence join). A link that a table holds as a foreign key is joined on that column; of one that the other table holds, that
table's filtered foreign keys are the ids. Scalar conjuncts are plain filters, which reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, times
from ..plans.ast import And, Clause, Count, Everything, Not, Nothing, Or, PathSets, Range, Step
from ..plans.parser import DATE_PARTS, DQLError
from ..plans.schema import SPARK, Field, Table

_PART = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def literal(f: Field, value: str) -> Column:
    if f.type == "TIMESTAMP":
        return F.lit(times.parse(value).isoformat(sep=" ")).cast("timestamp")
    if f.type == "BOOLEAN":
        return F.lit(value.lower() == "true")
    if f.type in SPARK and f.type not in ("TEXT", "BINARY"):
        try:
            return F.lit(int(value)).cast("bigint") if f.type in ("INTEGER", "LONG") else F.lit(float(value))
        except ValueError:
            raise DQLError(f"not a number: {value}") from None
    return F.lit(value)


def in_range(c: Column, r: Range, f: Field) -> Column:
    out = F.lit(True)
    if f.type == "TEXT":
        c = F.lower(c)
    lit = (lambda v: F.lit(v.lower())) if f.type == "TEXT" else (lambda v: literal(f, v))
    if r.low is not None:
        out = out & (c >= lit(r.low) if r.low_in else c > lit(r.low))
    if r.high is not None:
        out = out & (c <= lit(r.high) if r.high_in else c < lit(r.high))
    return out & c.isNotNull()


def _one(f: Field, c: Column, op: str, value) -> Column:
    """A test of one value."""
    if op == "range":
        return in_range(c, value, f)
    if op in ("in", "any:"):
        out = F.lit(False)
        if f.type == "TEXT" and op == "in" and not any("*" in v or "?" in v for v in value):
            return F.lower(c).isin(*[v.lower() for v in value])
        for v in value:
            out = out | sure(_one(f, c, "=" if op == "in" else ":", v))
        return out
    if f.type == "TEXT":
        return text.equals(c, value) if op == "=" else text.matches(c, value) if op == "regexp" else text.contains(c, value, f.analyzer)
    if f.type == "BINARY":
        raise DQLError(f"field {f.name} can't be searched")
    if any(x in value for x in "*?"):
        raise DQLError(f"no wildcards in values of {f.name}")
    return c == literal(f, value)


def has_value(f: Field) -> Column:
    c = F.col(f"`{f.name}`")
    return c.isNotNull() & (F.size(c) > 0) if f.collection else c.isNotNull()


def scalar(f: Field, clause: Clause, quant: str = "ANY") -> Column:
    c = F.col(f"`{f.name}`")
    if clause.op == "null":
        return ~sure(has_value(f)) if quant != "NONE" else sure(has_value(f))
    test = lambda x: sure(_one(f, x, clause.op, clause.value))
    if f.collection:
        some = sure(F.exists(c, test))
        if quant == "ALL":
            return sure(has_value(f)) & sure(F.forall(c, test))
        return ~some if quant == "NONE" else some
    return ~test(c) if quant == "NONE" else test(c)


def id_clause(clause: Clause, c: Column | None = None) -> Column:
    c = F.col("_ID") if c is None else c
    if clause.op == "=":
        return c == clause.value
    if clause.op == "in":
        return c.isin(*clause.value)
    if clause.op == "range":
        r, out = clause.value, F.lit(True)
        if r.low is not None:
            out = out & (c >= r.low if r.low_in else c > r.low)
        if r.high is not None:
            out = out & (c <= r.high if r.high_in else c < r.high)
        return out
    if clause.op == "null":
        return F.lit(False)
    raise DQLError("_ID takes equality, IN and ranges")


class Predicates:
    """Compiles queries against an engine's tables and links."""

    def __init__(self, engine):
        self.engine = engine

    # -- which filters a DataFrame needs

    def filter(self, df: DataFrame, table: Table, q) -> DataFrame:
        if isinstance(q, And):
            for p in sorted(q.parts, key=lambda p: not self._plain(table, p)):  # cheap filters first
                df = self.filter(df, table, p)
            return df
        if isinstance(q, Everything):
            return df
        if self._plain(table, q):
            return df.where(self.column(table, q, True))
        q = self._rewritten(table, q)
        if isinstance(q, (And, Everything)) or self._plain(table, q):
            return self.filter(df, table, q)
        anti = False
        while isinstance(q, Not):
            q, anti = self._rewritten(table, q.part), not anti
        if not isinstance(q, (And, Or)) and not self._plain(table, q):
            on, ids, without = self.hits(table, q)
            return df.join(ids.select(F.col("_ID").alias("__hit")), on == F.col("__hit"), "left_anti" if anti != without else "left_semi")
        before = df.columns
        df, flag = self.flagged(df, table, Not(q) if anti else q)
        return df.where(flag).select(*(f"`{c}`" for c in before))

    def flagged(self, df: DataFrame, table: Table, q) -> tuple[DataFrame, Column]:
        """df with columns for the links in q, and q as a Column over them."""
        if self._plain(table, q):
            return df, self.column(table, q)
        q = self._rewritten(table, q)
        if isinstance(q, (And, Or)):
            flags = []
            for p in q.parts:
                df, f = self.flagged(df, table, p)
                flags.append(f)
            out = flags[0]
            for f in flags[1:]:
                out = out & f if isinstance(q, And) else out | f
            return df, out
        if isinstance(q, Not):
            df, f = self.flagged(df, table, q.part)
            return df, ~f
        if self._plain(table, q):
            return df, self.column(table, q)
        n = self.engine.serial()
        on, ids, without = self.hits(table, q)
        ids = ids.select(F.col("_ID").alias(f"__hit{n}")).distinct().withColumn(f"__has{n}", F.lit(True))
        df = df.join(ids, on == F.col(f"__hit{n}"), "left").drop(f"__hit{n}")
        flag = F.coalesce(F.col(f"__has{n}"), F.lit(False))
        return df, ~flag if without else flag

    # -- queries without links

    def _field(self, table: Table, steps: tuple) -> Field | None:
        """The scalar field that steps name, if they pass no link."""
        if len(steps) == 1 and steps[0].name in table.fields and not table.field(steps[0].name).is_link:
            return table.field(steps[0].name)
        if len(steps) == 2 and steps[1].name in DATE_PARTS and table.fields.get(steps[0].name, Field("")).type == "TIMESTAMP":
            return table.field(steps[0].name)
        return None

    def _own_link(self, table: Table, q: Clause) -> Column | None:
        """The foreign key that a clause on a link itself (its id, or whether it has one) needs alone."""
        s = q.steps[0]
        column = self.engine.held.get((table.name, s.name))
        if column is None or s.where or s.depth or s.quant != "ANY":
            return None
        alone = len(q.steps) == 1 and q.op in ("=", "in", "range", "null")
        return F.col(f"`{column}`") if alone or (q.op == "exists" and q.steps[1].name == "*") else None

    def _plain(self, table: Table, q) -> bool:
        if isinstance(q, (And, Or)):
            return all(self._plain(table, p) for p in q.parts)
        if isinstance(q, Not):
            return self._plain(table, q.part)
        if isinstance(q, (Everything, Nothing)):
            return True
        if isinstance(q, Clause):
            if not q.steps or q.steps[0].name == "_ID" or self._own_link(table, q) is not None:
                return True
            f = self._field(table, q.steps)
            return f is not None and f.type != "GROUP"
        if isinstance(q, Count):
            f = self._field(table, q.steps)
            return f is not None and not q.distinct and f.type != "GROUP"
        return False

    def column(self, table: Table, q, bare: bool = False) -> Column:
        """A query without links as a Column that is never null; bare: for a filter, where null will do for false and the scan takes more."""
        if isinstance(q, Everything):
            return F.lit(True)
        if isinstance(q, Nothing):
            return F.lit(False)
        if isinstance(q, (And, Or)):
            out = self.column(table, q.parts[0], bare)
            for p in q.parts[1:]:
                out = out & self.column(table, p, bare) if isinstance(q, And) else out | self.column(table, p, bare)
            return out
        if isinstance(q, Not):
            return ~self.column(table, q.part)
        if isinstance(q, Count):
            f = self._field(table, q.steps)
            c = F.col(f"`{f.name}`")
            n = F.coalesce(F.size(c), F.lit(0)) if f.collection else c.isNotNull().cast("int")
            n = F.when(c.isNull(), 0).otherwise(n)
            return in_range(n, q.test, Field("n", "LONG"))
        if not q.steps:
            out = F.lit(False)
            for f in table.scalars():
                if f.type == "TEXT":
                    out = out | scalar(f, q)
            return out
        if q.steps[0].name == "_ID":
            return sure(id_clause(q))
        if (key := self._own_link(table, q)) is not None:
            if q.op in ("null", "exists"):
                return key.isNull() if q.op == "null" else key.isNotNull()
            return sure(id_clause(q, key.cast("string")))
        f = self._field(table, q.steps)
        if len(q.steps) == 2:
            if q.op not in ("=", ":", "in"):
                raise DQLError("parts of timestamps take equality only")
            c = F.col(f"`{f.name}`")
            values = [int(v) for v in (q.value if q.op == "in" else [q.value])]
            part = _PART[q.steps[1].name]
            return sure(F.exists(c, lambda x: part(x).isin(*values))) if f.collection else sure(part(c).isin(*values))
        if bare and not f.collection and q.op != "null" and q.steps[0].quant != "NONE":
            return _one(f, F.col(f"`{f.name}`"), q.op, q.value)
        return scalar(f, q, q.steps[0].quant)

    # -- links

    def _rewritten(self, table: Table, q):
        """Quantifiers and group fields as NOT, AND and OR of ANY."""
        if isinstance(q, Clause) and q.steps and q.steps[0].name in table.fields:
            s, rest = q.steps[0], q.steps[1:]
            f = table.field(s.name)
            if f.type == "GROUP":
                return Or(tuple(Clause((Step(m, s.quant, s.where, s.depth), *rest), q.op, q.value) for m in f.members if not (rest and not table.field(m).is_link)))
            if f.is_link:
                if not rest and q.op == "null":
                    return Not(Clause((Step(s.name, "ANY", s.where, s.depth), Step("*")), "exists"))
                if s.quant == "NONE":
                    return Not(Clause((Step(s.name, "ANY", s.where, s.depth), *rest), q.op, q.value))
                if s.quant == "ALL":
                    return ("all", Step(s.name, "ANY", s.where, s.depth), Clause(rest, q.op, q.value) if rest else Clause((Step("_ID"),), q.op, q.value))
        return q

    def hits(self, table: Table, q) -> tuple[Column, DataFrame, bool]:
        """(a column of the table, values for it as _ID, not always distinct, whether the query holds where it has none of them)."""
        if isinstance(q, Count):
            return self._count(table, q)
        if isinstance(q, PathSets):
            return self._sets(table, q)
        engine = self.engine
        every = isinstance(q, tuple)
        s, rest, clause = (q[1], (), q[2]) if every else (q.steps[0], q.steps[1:], q)
        if not table.field(s.name).is_link:
            raise DQLError(f"{s.name} is not a link of {table.name}")
        target = engine.target(table, (s,))
        held, there = engine.held.get((table.name, s.name)), engine.held_there.get((table.name, s.name))
        if every and not (held and not s.depth):  # all linked objects take the clause
            rows, ident, _ = engine.walk(table, (s,), distinct=False)
            rows, flag = self.flagged(rows, target, clause)
            per = rows.groupBy("__src").agg(F.bool_and(flag).alias("all"))
            return ident, per.where("all").select(F.col("__src").alias("_ID")), False
        inner = self._inner(rest, clause, every)
        if held and not s.depth:
            return engine.reference(held, target), self.filter(engine.taken(s, target), target, inner or Everything()).select(engine.key(target).alias("_ID")), False
        if there and not s.depth:
            rows = self.filter(engine.taken(s, target), target, inner or Everything())
            return engine.key(table), rows.select(engine.reference(there, table).alias("_ID")).where("_ID is not null").distinct(), False
        rows, ident, _ = engine.walk(table, (s,), distinct=False, ids=inner is None or rest == ())
        return ident, self.filter(rows, target, inner or Everything()).select(F.col("__src").alias("_ID")).distinct(), False

    @staticmethod
    def _inner(rest: tuple, q: Clause, every: bool):
        """The clause on the linked objects; None if any linked object will do."""
        if every:
            return q
        if not rest:
            if q.op not in ("=", "in", "range"):
                raise DQLError("links take ids")
            return Clause((Step("_ID"),), q.op, q.value)
        if q.op == "exists" and rest[0].name == "*":
            return None
        return Clause(rest, q.op, q.value)

    def _count(self, table: Table, q: Count) -> tuple[Column, DataFrame, bool]:
        values, ident, _ = self.engine.values(table, q.steps, distinct=not q.distinct, count=not q.distinct)
        n = F.count_distinct("value") if q.distinct else F.count("value")
        counts = values.groupBy(F.col("src").alias("_ID")).agg(n.alias("n"))
        fits, zero = in_range(F.col("n"), q.test, Field("n", "LONG")), self._zero(q.test)  # objects without links count too
        return ident, counts.where(~fits if zero else fits).select("_ID"), zero

    @staticmethod
    def _zero(r: Range) -> bool:
        low = r.low is None or int(r.low) < 0 or (int(r.low) == 0 and r.low_in)
        return low and (r.high is None or int(r.high) > 0 or (int(r.high) == 0 and r.high_in))

    def _sets(self, table: Table, q: PathSets) -> tuple[Column, DataFrame, bool]:
        """Set comparison per object, by counts of shared and unshared values. Two empty sets intersect, are equal, and one holds the other."""
        parts, idents = [], []
        for path, is_left in ((q.left, 1), (q.right, 0)):
            rows, ident, _ = self.engine.values(table, path, distinct=False)
            idents.append(str(ident))
            parts.append(rows.where("value is not null").select("src", "value", F.lit(is_left).alias("l"), F.lit(1 - is_left).alias("r")))
        if len(set(idents)) > 1:  # keys' texts are _IDs
            ident, parts = F.col("_ID"), [p.withColumn("src", F.col("src").cast("string")) for p in parts]
        rows = self.engine.scattered(parts[0].union(parts[1]), table, "src", "value")
        per = rows.groupBy("src", "value").agg(F.max("l").alias("l"), F.max("r").alias("r"))
        per = per.groupBy(F.col("src").alias("_ID")).agg(F.sum(F.col("l") * F.col("r")).alias("both"), F.sum("l").alias("l"), F.sum("r").alias("r"))
        same = (F.col("l") == F.col("both")) & (F.col("r") == F.col("both"))
        meet = F.col("both") > 0
        holds = (F.col("both") == F.col("r")) & (F.col("r") > 0)
        test = {"EQUALS": same, "DIFFERS": ~same, "INTERSECTS": meet, "DISJOINT": ~meet, "CONTAINS": holds}[q.kind]
        empty = q.kind in ("EQUALS", "INTERSECTS", "CONTAINS")  # objects without any values take these
        return ident, per.where(~test if empty else test).select("_ID"), empty
