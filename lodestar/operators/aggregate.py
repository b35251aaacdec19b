"""Aggregate queries: groups over paths, metrics per object added once to each group that the object is in.

A row of the selected objects carries its scalar keys and the scalars that metrics need, so that these take no join. Keys over links are
joined to it; paths are followed from the selected objects only. Metrics over paths are first reduced to one row per object, those
over one path together. So a parent's metric is not a sum over its children where keys have several values. Grouping
paths that share their links are expanded once, together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, times
from ..plans.ast import And, Binary, Group, Metric, Number
from ..plans.parser import DATE_PARTS, DQLError
from ..plans.schema import Field, Table


def truncated(c: Column, unit: str, z: str | None = None) -> Column:
    if z:
        c = F.from_utc_timestamp(c, times.zone_name(z))
    return F.date_trunc(unit.upper(), c)


def _batches(c: Column, f: Field, bounds: tuple) -> Column:
    """The number of the bin: 0 under the first bound."""
    if f.type == "TIMESTAMP":
        lits = [F.lit(times.parse(b).isoformat(sep=" ")).cast("timestamp") for b in bounds]
    elif f.type == "TEXT":
        lits, c = [F.lit(b.lower()) for b in bounds], F.lower(c)
    else:
        v = [float(b) for b in bounds]
        if any(a >= b for a, b in zip(v, v[1:], strict=False)):
            raise DQLError("bounds of BATCH must ascend")
        lits = [F.lit(x) for x in v]
    out = F.lit(len(bounds))
    for i in range(len(lits) - 1, -1, -1):
        out = F.when(c < lits[i], i).otherwise(out)
    return F.when(c.isNotNull(), out)


def batch_labels(bounds: tuple, close: bool = False) -> list[str]:
    """Names of the bins; those of times and texts are written close."""
    if close:
        return [f"<{bounds[0]}", *(f"{a}-{b}" for a, b in zip(bounds, bounds[1:], strict=False)), f">={bounds[-1]}"]
    return [f"< {bounds[0]}", *(f"{a} - {b}" for a, b in zip(bounds, bounds[1:], strict=False)), f">= {bounds[-1]}"]


class _Plan:
    """What the metrics of an aggregate query need: columns of the objects, sums per object over paths, and sets of values over paths."""

    def __init__(self, engine, table: Table, docs: DataFrame | None):
        self.engine, self.table, self.docs = engine, table, docs
        self.owned: list = []  # (name, value, where, aggregate, 0 where there is none)
        self.paths: dict = {}  # (steps, where): (metric, [(name, aggregate per object, over objects, 0 where there is none)])
        self.distinct: list = []  # (metric, name, what is compared)
        self.looked: dict = {}  # (links, field): name

    def own(self, name: str, value: Column, where: tuple, over, zero: bool = False) -> None:
        self.owned.append((name, value, where, over, zero))

    def path(self, m: Metric, name: str, per: Column, over, zero: bool = False) -> None:
        self.paths.setdefault((m.steps, m.where, m.func in ("MIN", "MAX")), (m, []))[1].append((name, per, over, zero))

    def look(self, links: tuple, field: str) -> Column:
        return F.col(self.looked.setdefault((links, field), f"__v{len(self.looked)}"))

    def sets(self, m: Metric, name: str, low) -> None:
        self.distinct.append((m, name, low))

    def _rows(self, m: Metric, distinct: bool, count: bool) -> tuple[DataFrame, Column]:
        """(src, v) of a metric's path, and what src stands for."""
        engine, docs = self.engine, self.docs
        if m.where:
            docs = engine.predicates.filter(engine.frame(self.table) if docs is None else docs, self.table, And(m.where))
        rows, ident, _ = engine.values(self.table, m.steps, docs, distinct, count)
        return rows.withColumnRenamed("value", "v"), ident

    def carried(self, keys: DataFrame) -> DataFrame:
        """The objects with their keys, own values and sums over paths."""
        flags: dict = {}
        for (links, field), name in self.looked.items():
            sub, ref = self.engine.lookup(self.table, links, {name: F.col(f"`{field}`")})
            keys = keys.join(sub, ref == F.col("__k"), "left").drop("__k")
        for name, value, where, _, zero in self.owned:
            if where:
                if where not in flags:
                    keys, flag = self.engine.predicates.flagged(keys, self.table, And(where))
                    flags[where] = f"__w{len(flags)}"
                    keys = keys.withColumn(flags[where], flag)
                value = F.when(F.col(flags[where]), value).otherwise(0) if zero else F.when(F.col(flags[where]), value)
            keys = keys.withColumn(name, value)
        for m, parts in self.paths.values():
            rows, ident = self._rows(m, m.func not in ("MIN", "MAX"), all(str(per) == str(F.count(F.col("v"))) for _, per, _, _ in parts))
            per = rows.groupBy(F.col("src").alias("__of")).agg(*(p.alias(name) for name, p, _, _ in parts))
            keys = keys.join(per, ident == F.col("__of"), "left").drop("__of")
            keys = keys.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name, _, _, zero in parts if zero}) if any(p[3] for p in parts) else keys
        return keys

    def grouped(self, keys: DataFrame, names: list[str], low: list[str], ident: Column, several: bool) -> DataFrame:
        """A row for each group of the keys `low`: the names' least values, and the metrics' columns."""
        if several:
            keys = keys.withColumn("__id", ident).dropDuplicates(["__id", *low])
        aggs = [F.min(n).alias(n) for n in names]
        aggs += [over(F.col(name)).alias(name) for name, _, _, over, _ in self.owned]
        aggs += [over(F.col(name)).alias(name) for _, parts in self.paths.values() for name, _, over, _ in parts]
        out = keys.groupBy(*low).agg(*aggs or [F.count(F.lit(1)).alias("__n")])
        for m, name, lower in self.distinct:
            rows, of = self._rows(m, False, False)
            rows = rows.select(F.col("src").alias("__of"), lower(F.col("v")).alias(name)).where(F.col(name).isNotNull())
            per = keys.select(of.alias("__k"), *low).join(rows, F.col("__k") == F.col("__of")).groupBy(*low).agg(F.count_distinct(name).alias(name))
            if low:
                per = per.select(*(F.col(o).alias("__r" + o) for o in low), name)
                out = out.join(per, reduce(lambda a, b: a & b, (F.col(o).eqNullSafe(F.col("__r" + o)) for o in low)), "left").drop(*("__r" + o for o in low))
            else:
                out = out.crossJoin(per)  # a row and a row
        return out


class Aggregates:
    def __init__(self, engine):
        self.engine = engine

    # -- keys

    def _key(self, g: Group, table: Table, steps: tuple) -> tuple[Column, bool]:
        """The key's expression over the table at the end of the links, and whether it is an array of several keys."""
        if g.func == "SETS":
            return F.array_compact(F.array(*(F.when(self.engine.predicates.column(table, q), F.lit(n)) for q, n in g.args))), True
        if not steps or steps[0].name in ("_ID", "*"):
            return F.col("_ID"), False
        f = table.field(steps[0].name)
        c = F.col(f"`{f.name}`")
        one = lambda x: self._value(g, f, steps, x)
        if g.func == "TERMS":
            stop = [w.lower() for w in g.args[0]] if g.args else []
            words = F.flatten(F.transform(c, lambda x: text.analyzed(x, f.analyzer))) if f.collection else text.analyzed(c, f.analyzer)
            return F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop)) if stop else words), True
        return (F.array_distinct(F.transform(c, one)), True) if f.collection else (one(c), False)

    def _value(self, g: Group, f: Field, steps: tuple, c: Column) -> Column:
        if g.func == "BATCH":
            return _batches(c, f, g.args)
        if g.func == "TRUNCATE":
            return truncated(c, g.args[0], g.args[1] if len(g.args) > 1 else None)
        if g.func in ("UPPER", "LOWER"):
            return (F.upper if g.func == "UPPER" else F.lower)(c)
        if len(steps) > 1 and steps[1].name in DATE_PARTS:
            return {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}[steps[1].name](c)
        if f.type == "TIMESTAMP":
            return F.date_trunc("SECOND", c)
        return c

    def keys(self, table: Table, docs: DataFrame, groups: list[Group], names: list[str], whole: bool) -> tuple[DataFrame, bool]:
        """docs with columns `names`, an object's keys of each group, null where it has none; whether an object may have several rows."""
        engine, out, several = self.engine, docs, False
        paths = [engine.spread(table, g.steps) for g in groups]
        split = [engine.split(table, p[0]) for p in paths]
        for i, g in enumerate(groups):  # keys of the objects themselves
            if len(paths[i]) == 1 and not split[i][0]:
                key, many = self._key(g, table, split[i][1])
                if many:
                    key, several = F.explode_outer(F.filter(key, lambda x: x.isNotNull())), True
                out = out.withColumn(names[i], key)
        linked = [i for i in range(len(groups)) if len(paths[i]) > 1 or split[i][0]]
        shared = len(linked) > 1 and all(len(paths[i]) == 1 and split[i][0] == split[linked[0]][0] and not groups[i].where for i in linked)
        for part in [linked] if shared else [[i] for i in linked]:
            if len(paths[part[0]]) == 1 and engine.looks_up(table, split[part[0]][0]):
                links, found = split[part[0]][0], {}
                for i in part:
                    found[names[i]], array = self._key(groups[i], engine.target(table, links), split[i][1])
                    found[names[i]] = (F.filter(found[names[i]], lambda x: x.isNotNull()), True) if array else (found[names[i]], False)
                sub, ref = engine.lookup(table, links, {n: c for n, (c, _) in found.items()})
                out = out.join(sub, ref == F.col("__k"), "left").drop("__k")
                for n, (_, array) in found.items():
                    if array:
                        out, several = out.withColumn(n, F.explode_outer(n)), True
                continue
            parts, idents = [], []
            for path in paths[part[0]]:
                links, rest = engine.split(table, path)
                rows, ident, many = engine.walk(table, links, None if whole else docs) if links else (docs, engine.key(table), False)
                rows = rows if links else rows.withColumn("__src", ident)
                target = engine.target(table, links)
                for i in part:
                    key, array = self._key(groups[i], target, engine.split(table, paths[i][0])[1] if shared else rest)
                    rows, many = rows.withColumn(names[i], F.explode_outer(key) if array else key), many or array
                parts.append(rows.select("__src", *(names[i] for i in part)))
                idents.append(ident)
            if len(parts) > 1:  # a group field: the keys of all its members
                parts, idents, many = [p.withColumn("__src", F.col("__src").cast("string")) for p in parts], [F.col("_ID")], True
            rows = reduce(DataFrame.union, parts)
            if many:
                rows = engine.scattered(rows, table, "__src").distinct()
            if len(part) == 1:  # null keys stand for objects without keys only
                rows = rows.where(F.col(names[part[0]]).isNotNull())
            several = several or many
            out = out.join(rows, idents[0] == F.col("__src"), "left").drop("__src")
        for i, g in enumerate(groups):
            if g.where:
                before = out.columns
                out, flag = engine.predicates.flagged(out, table, And(g.where))
                out = out.withColumn(names[i], F.when(flag, F.col(names[i]))).select(*(f"`{c}`" for c in before))
        return out, several

    # -- metrics

    def _leaf(self, table: Table, m: Metric, plan: "_Plan") -> Column:
        """The metric's final Column over a group's row; what that needs goes into the plan."""
        engine, n = self.engine, f"__m{self.engine.serial()}"
        star = not m.steps or m.steps[0].name == "*"
        if star and m.func != "COUNT":
            raise DQLError(f"{m.func} needs a field")
        if star:
            plan.own(n, F.lit(1), m.where, F.count)
            return F.coalesce(F.col(n), F.lit(0))
        paths = engine.spread(table, m.steps)
        links, rest = engine.split(table, paths[0])
        kind = engine.value_type(table, m.steps)
        if kind == "TEXT" and m.func in ("SUM", "AVERAGE") and engine.app.options.get("text-sums") == "none":
            raise DQLError(f"{m.func} takes no text")  # an application may have it so; otherwise values are counted
        held = engine.held.get((table.name, links[0].name)) if len(links) == 1 and not links[0].where and not links[0].depth else None
        own = None
        if len(paths) == 1 and not links and (not rest or rest[0].name == "_ID" or not table.field(rest[0].name).collection):
            own = F.col(f"`{rest[0].name}`") if rest else F.col("_ID")
        elif len(paths) == 1 and held and not rest:
            own = F.col(f"`{held}`")  # the link itself, held by the object
        elif len(paths) == 1 and rest and rest[0].name not in ("*", "_ID") and engine.looks_up(table, links) and not engine.target(table, links).field(rest[0].name).collection:
            own = plan.look(links, rest[0].name)  # of one linked object at most
        if m.func == "DISTINCT":
            low = (lambda v: F.lower(v)) if kind == "TEXT" else (lambda v: v)
            if own is not None:
                plan.own(n, low(own), m.where, F.count_distinct)
            else:
                plan.sets(m, n, low)
            return F.coalesce(F.col(n), F.lit(0))
        many = own is None
        v = own if own is not None else F.col("v")
        if m.roundup:
            r = m.roundup
            v = v + F.when(v % r == 0, 0).otherwise(F.lit(r) - v % r)
        put = lambda suffix, value, per, over, zero=False: plan.path(m, n + suffix, per(value), over, zero) if many else plan.own(n + suffix, value, m.where, over, zero)
        if m.func == "COUNT":
            put("", v if many else F.when(v.isNotNull(), 1), F.count, F.sum if many else F.count)
            return F.coalesce(F.col(n), F.lit(0))
        ones = v if many else v.isNotNull().cast("long")
        if m.func in ("MINCOUNT", "MAXCOUNT"):
            put("", ones, F.count, F.min if m.func == "MINCOUNT" else F.max, True)
            return F.col(n)
        if m.func in ("MIN", "MAX"):
            f = F.min if m.func == "MIN" else F.max
            if kind == "TEXT":  # by lower case, then by the value itself
                put("", F.when(v.isNotNull(), F.struct(F.lower(v).alias("l"), v.alias("v"))), f, f)
                return F.col(n)["v"]
            put("", v, f, f)
            return F.col(n)
        number = {"BOOLEAN": lambda: v.cast("long"), "TIMESTAMP": lambda: F.unix_millis(v), "FLOAT": lambda: v.cast("double"), "DOUBLE": lambda: v.cast("double"), "INTEGER": lambda: v.cast("long"), "LONG": lambda: v.cast("long")}
        x = number[kind]() if kind in number else None
        if m.func == "SUM":
            if x is None:
                put("", ones, F.count, F.sum)
            else:
                put("", x, F.sum, F.sum)
            return F.col(n)
        if x is None:  # the mean number of values of an object
            put("t", ones, F.count, F.sum, True)
            plan.own(n + "c", F.lit(1), (), F.count)
        else:
            put("t", x.cast("double"), F.sum, F.sum)
            put("c", x if many else F.when(x.isNotNull(), 1), F.count, F.sum if many else F.count)
        return F.col(n + "t") / F.when(F.col(n + "c") > 0, F.col(n + "c"))

    def _expression(self, table: Table, m, plan: "_Plan") -> Column:
        if isinstance(m, Number):
            return F.lit(m.value)
        if isinstance(m, Binary):
            a, b = self._expression(table, m.left, plan).cast("double"), self._expression(table, m.right, plan).cast("double")
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b != 0, a / b)}[m.op]()
        return self._leaf(table, m, plan)

    def run(self, table: Table, ways: list[tuple[DataFrame, list[Group]]], metrics: list, level: int | None = None, composite: bool = False, flat: int | None = None, whole: bool = False) -> DataFrame:
        """Rows of one level (the deepest by default): its keys and metrics.

        ways: the selected objects and the groups; several where a pair of links is taken in either order. whole: all of the table's objects.
        """
        groups = ways[0][1]
        groups = groups[: len(groups) if level is None else level]
        names = [f"__g{i + 1}" for i in range(len(groups))]
        found, several = [], len(ways) > 1
        for docs, its in ways:
            k, many = self.keys(table, docs, list(its[: len(groups)]), names, whole)
            found.append(k)
            several = several or many
        keys = reduce(DataFrame.union, found)
        if composite:
            groups, names, several = groups[-1:], names[-1:], True
        low = ["__l" + n for n in names]
        keys = keys.withColumns({o: F.lower(n) if self._text_key(table, g) else F.col(n) for o, n, g in zip(low, names, groups, strict=True)})
        plan = _Plan(self.engine, table, None if whole else ways[0][0] if len(ways) == 1 else keys)
        finals = [(self._expression(table, m, plan), name) for m, name in metrics]
        keys = plan.carried(keys)
        ident = self.engine.key(table)
        out = plan.grouped(keys, names, low, ident, several).select(*names, *low, *(c.alias(n) for c, n in finals))
        for i, (o, g) in enumerate(zip(low, groups, strict=True)):
            if g.pick and g.n > 0:
                parents = out if i == len(low) - 1 else plan.grouped(keys, names[: i + 1], low[: i + 1], ident, several).select(*low[: i + 1], finals[0][0].alias(finals[0][1]))
                out = self._pick(out, parents, low[: i + 1], g, finals[0][1], i == len(low) - 1)
        for n, g in zip(names, groups, strict=True):
            out = self._shown(out, n, g, self._labels(table, g) if g.func == "BATCH" else [])
        if flat is not None and finals:
            out = out.orderBy(F.desc_nulls_last(f"`{finals[0][1]}`"), *(F.asc_nulls_first(o) for o in low)).limit(flat)
        first = len(ways[0][1][: level]) - len(groups)
        return out.select(*(F.col(n).alias(g.alias or f"g{first + i + 1}") for i, (n, g) in enumerate(zip(names, groups, strict=True))), *(f"`{n}`" for _, n in finals))

    def _text_key(self, table: Table, g: Group) -> bool:
        """Whether groups merge without regard to case."""
        if g.func in ("TERMS", "SETS", "BATCH", "TRUNCATE") or not g.steps or len(g.steps) and g.steps[-1].name in ("_ID", *DATE_PARTS):
            return False
        links, rest = self.engine.split(table, self.engine.spread(table, g.steps)[0])
        if not rest:
            return False
        t = self.engine.target(table, links)
        return t.field(rest[0].name).type == "TEXT"

    def _pick(self, out: DataFrame, parents: DataFrame, upto: list[str], g: Group, metric: str, last: bool) -> DataFrame:
        """TOP and BOTTOM by the first metric, FIRST and LAST by key, of a level's groups (parents) for each group above; on levels above the last, by the groups' own metric."""
        m, key = F.col(f"`{metric}`"), upto[-1]
        order = {"TOP": [m.desc_nulls_last(), F.asc_nulls_first(key)], "BOTTOM": [m.asc_nulls_last(), F.asc_nulls_first(key)], "FIRST": [F.asc_nulls_first(key)], "LAST": [F.desc_nulls_last(key)]}[g.pick]
        if len(upto) == 1:
            best = parents.orderBy(*order).limit(g.n)
        else:
            best = parents.withColumn("__r", F.row_number().over(Window.partitionBy(*upto[:-1]).orderBy(*order))).where(F.col("__r") <= g.n).drop("__r")
        if last:
            return best
        best = best.select(*(F.col(u).alias("__b" + u) for u in upto))
        return out.join(best, reduce(lambda a, b: a & b, (F.col(u).eqNullSafe(F.col("__b" + u)) for u in upto)), "left_semi")

    def _shown(self, out: DataFrame, n: str, g: Group, labels: list[str]) -> DataFrame:
        for values, keep in ((g.include, True), (g.exclude, False)):
            if values:
                hit = F.lit(False)
                for v in values:
                    hit = hit | (F.col(n).isNull() if v == "NULL" else F.coalesce(text.equals(F.col(n).cast("string"), v), F.lit(False)))
                out = out.where(hit if keep else ~hit)
        if g.func == "BATCH":
            label = F.element_at(F.array(*map(F.lit, labels)), F.col(n) + 1)
            out = out.withColumn(n, F.when(F.col(n).isNotNull(), label))
        elif g.steps and g.steps[-1].name == "MONTH":
            out = out.withColumn(n, F.when(F.col(n).isNotNull(), F.date_format(F.make_date(F.lit(2000), F.col(n), F.lit(1)), "MMMM")))
        return out

    def _labels(self, table: Table, g: Group) -> list[str]:
        return batch_labels(g.args, self.engine.value_type(table, g.steps) in ("TIMESTAMP", "TEXT"))

    def with_empty(self, table: Table, out: DataFrame, g: Group) -> DataFrame:
        """Rows for bins or sets that no object is in (their counts are 0)."""
        labels = self._labels(table, g) if g.func == "BATCH" else [n for _, n in g.args]
        all_ = self.engine.spark.createDataFrame([(x,) for x in labels], "k string")
        name = g.alias or "g1"
        joined = all_.join(out.withColumnRenamed(name, "k"), "k", "left")
        zero = [F.coalesce(c, F.lit(0)).alias(c) if t in ("bigint", "int") else F.col(f"`{c}`") for c, t in joined.dtypes if c != "k"]
        nulls = out.where(F.col(name).isNull())
        return joined.select(F.col("k").alias(name), *zero).unionByName(nulls)
