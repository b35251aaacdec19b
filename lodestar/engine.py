"""The engine: an application's tables and links as DataFrames, with object and aggregate queries over them."""

from __future__ import annotations

from copy import copy
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.aggregate import Aggregates
from .operators.predicates import Predicates
from .operators.project import Projection
from .plans.ast import And, Step
from .plans.parser import DQLError, Parser
from .plans.schema import Application, Field, Table
from .sources.shared import shared_dir


class Engine:
    """tables: DataFrames with _ID; keys: the column, by table, whose text is the _ID, where there is one.

    links: by (table, link), edges (src, dst) of _IDs, or the name of a column of the table that holds the linked object's _ID or key (a
    foreign key). Inverse links are derived. A cross-link over a single-valued junction is a foreign key too. Links by foreign keys are
    followed on these columns alone: neither edges nor the _IDs of the objects that hold them are made.
    """

    DEFAULT_SIZE = 100
    #: Bytes of the files read for a piece of scattered rows, for one if there are fewer pieces than cores, and for one where they are many; times the objects' bytes up to which rows are scattered as they are.
    PIECE, SMALL, LARGE, FEW = 8 << 20, 1 << 20, 48 << 20, 32

    def __init__(self, spark: SparkSession, app: Application, tables: dict[str, DataFrame], links: dict[tuple[str, str], DataFrame | str] | None = None, clock: datetime | None = None, keys: dict[str, str] | None = None):
        self.spark, self.app, self.tables, self.clock, self.keys = spark, app, copy(tables), clock, dict(keys or {})
        self.links: dict[tuple[str, str], DataFrame] = {}
        self.held: dict[tuple[str, str], str] = {}  # links held in a column of their own table
        self.held_there: dict[tuple[str, str], str] = {}  # and their inverses, held in a column of the other table
        for t in app.tables.values():
            for f in t.links():
                if f.type == "XLINK" and f.junction not in (None, "_ID") and f.junction in t.fields and not t.fields[f.junction].collection:
                    self._hold(t.name, f, f.junction)
        for (t, name), edges in (links or {}).items():
            f = app.tables[t].field(name)
            if isinstance(edges, str):
                self._hold(t, f, edges)
                continue
            self.links[t, name] = edges
            if f.inverse and (f.table, f.inverse) not in (links or {}):
                self.links[f.table, f.inverse] = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        self._serial = 0
        self.predicates, self.aggregates, self.projection = Predicates(self), Aggregates(self), Projection(self)

    def _hold(self, table: str, f: Field, column: str) -> None:
        self.held[table, f.name] = column
        if f.inverse:
            self.held_there[f.table, f.inverse] = column

    def serial(self) -> int:
        self._serial += 1
        return self._serial

    def table(self, name: str) -> Table:
        if name not in self.app.tables:
            raise KeyError(f"application {self.app.name} has no table {name}")
        return self.app.tables[name]

    def frame(self, table: Table) -> DataFrame:
        return self.tables[table.name]

    def parser(self, table: Table, text: str) -> Parser:
        return Parser(text, self.clock, table.aliases)

    # -- links

    def key(self, table: Table) -> Column:
        """What objects are told apart by: the key column, or the _ID."""
        return F.col(f"`{self.keys.get(table.name, '_ID')}`")

    def reference(self, column: str, target: Table) -> Column:
        """A foreign key, to compare with key(target)."""
        c = F.col(f"`{column}`")
        return c if target.name in self.keys else c.cast("string")

    def edges(self, table: Table, name: str) -> DataFrame:
        """Edges of a link; of a cross-link, by its junction values."""
        if (table.name, name) in self.links:
            return self.links[table.name, name]
        f = table.field(name)
        if (table.name, name) in self.held:
            return self.frame(table).select(F.col("_ID").alias("src"), F.col(f"`{self.held[table.name, name]}`").cast("string").alias("dst")).where("dst is not null")
        other = self.app.tables[f.table]
        if (table.name, name) in self.held_there:
            return self.frame(other).select(F.col(f"`{self.held_there[table.name, name]}`").cast("string").alias("src"), F.col("_ID").alias("dst")).where("src is not null")
        if f.type != "XLINK":
            raise KeyError(f"no edges for {table.name}.{name}")
        if f.junction in (None, "_ID"):  # the other side holds the junction
            back = other.field(f.inverse)
            return self._junction(other, back.junction).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return self._junction(table, f.junction)

    def _junction(self, table: Table, name: str) -> DataFrame:
        f = table.field(name)
        value = F.explode(f"`{name}`") if f.collection else F.col(f"`{name}`")
        return self.frame(table).select(F.col("_ID").alias("src"), value.cast("string").alias("dst")).where("dst is not null")

    def target(self, table: Table, steps: tuple) -> Table:
        for s in steps:
            table = self.app.tables[table.field(s.name).table]
        return table

    def split(self, table: Table, steps: tuple) -> tuple[tuple, tuple]:
        """Steps over links, and those after."""
        n, t = 0, table
        while n < len(steps) and steps[n].name in t.fields and t.field(steps[n].name).is_link:
            t = self.app.tables[t.field(steps[n].name).table]
            n += 1
        return steps[:n], steps[n:]

    def spread(self, table: Table, steps: tuple) -> list[tuple]:
        """The paths that a path over a group field stands for: one for each member."""
        if steps and steps[0].name in table.fields and table.field(steps[0].name).type == "GROUP":
            s = steps[0]
            out = []
            for m in table.field(s.name).members:
                if len(steps) == 1 or table.field(m).is_link or table.field(m).type == "GROUP":
                    out += self.spread(table, (Step(m, s.quant, s.where, s.depth), *steps[1:]))
            return out
        return [steps]

    def taken(self, s: Step, target: Table) -> DataFrame:
        """The objects of a step's target that its filters take."""
        return self.predicates.filter(self.frame(target), target, And(s.where)) if s.where else self.frame(target)

    def walk(self, table: Table, steps: tuple, docs: DataFrame | None = None, distinct: bool = True, ids: bool = False) -> tuple[DataFrame, Column, bool]:
        """Each object's linked objects over a path: rows of __src and the last table's columns (ids: only _ID is wanted).

        Also what of the objects __src stands for, and whether one may have several rows. docs: the objects wanted, if not all.
        distinct: each linked object once, though several ways lead to it.
        """
        rows, ident, t, many = None, None, table, False
        for i, s in enumerate(steps):
            target, last = self.target(t, (s,)), i == len(steps) - 1
            held, there = self.held.get((t.name, s.name)), self.held_there.get((t.name, s.name))
            if s.depth or (held is None and there is None):
                edges = self.edges(t, s.name)
                edges = closure(edges, s.depth) if s.depth else edges
                if rows is None:
                    ident = F.col("_ID")
                    left = edges.select(F.col("src").alias("__src"), F.col("dst").alias("__to"))
                    left = left if docs is None else left.join(docs.select(F.col("_ID").alias("__in")), F.col("__src") == F.col("__in"), "left_semi")
                else:
                    left = rows.select("__src", F.col("_ID").alias("__from")).join(edges.select(F.col("src").alias("__at"), F.col("dst").alias("__to")), F.col("__from") == F.col("__at")).select("__src", "__to")
                    left = left.distinct() if distinct else left
                many, on = True, F.col("_ID")
            elif held:
                ref = self.reference(held, target)
                if rows is None:
                    ident = self.key(table)
                    left = (self.frame(table) if docs is None else docs).select(ident.alias("__src"), ref.alias("__to"))
                else:
                    left = rows.select("__src", ref.alias("__to"))
                    left = left.distinct() if many and distinct else left
                left, on = left.where("__to is not null"), self.key(target)
            else:
                ref, many = self.reference(there, t), True
                if rows is None:
                    ident = self.key(table)
                    rows = self.taken(s, target).withColumn("__src", ref).where("__src is not null")
                    rows = rows if docs is None else rows.join(docs.select(ident.alias("__in")), F.col("__src") == F.col("__in"), "left_semi")
                    t = target
                    continue
                left, on = rows.select("__src", self.key(t).alias("__to")), ref
            if ids and last and not s.where and not there:
                rows = left.select("__src", F.col("__to").cast("string").alias("_ID"))
            else:
                rows = left.join(self.taken(s, target), F.col("__to") == on).drop("__to")
            t = target
        return rows, ident, many

    def scattered(self, rows: DataFrame, table: Table, *keys: str) -> DataFrame:
        """Rows over links of a table's objects, by keys in pieces whose number grows with the files read, so that what a task then holds of them does not.

        Where objects have many rows each on average, these are left to be merged before they travel; so are rows of unknown size.
        """
        size, own = read_bytes(rows), read_bytes(self.frame(table))
        if not size or size > self.FEW * own:
            return rows
        context = self.spark.sparkContext
        least = min(context.defaultParallelism, -(-size // self.SMALL))
        open_files = int(context.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))  # with more pieces, a task that deals rows out holds them to sort
        return rows.repartition(max(min(-(-size // self.PIECE), open_files), -(-size // self.LARGE), least), *keys)

    def looks_up(self, table: Table, steps: tuple) -> bool:
        """Whether a path leads over foreign keys that each object holds itself, so to one object at most."""
        for s in steps:
            if s.depth or (table.name, s.name) not in self.held:
                return False
            table = self.target(table, (s,))
        return bool(steps)

    def lookup(self, table: Table, steps: tuple, columns: dict[str, Column]) -> tuple[DataFrame, Column]:
        """For such a path: (__k, columns over its last table), and the table's foreign key to join with __k, which is unique."""
        s, target = steps[0], self.target(table, steps[:1])
        rows = self.taken(s, target)
        if len(steps) == 1:
            sub = rows.select(self.key(target).alias("__k"), *(c.alias(n) for n, c in columns.items()))
        else:
            inner, ref = self.lookup(target, steps[1:], columns)
            sub = rows.select(self.key(target).alias("__k"), ref.alias("__f")).join(inner.withColumnRenamed("__k", "__to"), F.col("__f") == F.col("__to")).select("__k", *columns)
        return sub, self.reference(self.held[table.name, s.name], target)

    def values(self, table: Table, steps: tuple, docs: DataFrame | None = None, distinct: bool = True, count: bool = False) -> tuple[DataFrame, Column, bool]:
        """(src, value) of a path's values, of each linked object once; what src stands for; whether an object may have several.

        count: values are only counted, so that those of a path that ends in a link needn't be ids.
        """
        paths = self.spread(table, steps)
        if len(paths) != 1:
            parts = [self.values(table, p, docs, distinct) for p in paths]
            rows = [r.select(F.col("src").cast("string").alias("src"), F.col("value").cast("string").alias("value") if self.value_type(table, steps) in ("LINK", "TEXT") else "value") for r, _, _ in parts]
            return reduce(DataFrame.union, rows), F.col("_ID"), True
        links, rest = self.split(table, paths[0])
        target = self.target(table, links)
        ends = not rest or rest[0].name in ("*", "_ID")
        if ends:
            value, many = F.col("_ID"), False
        else:
            f = target.field(rest[0].name)
            value, many = F.explode(f"`{f.name}`") if f.collection else F.col(f"`{f.name}`"), f.collection
        if not links:
            key = self.key(table)
            return (self.frame(table) if docs is None else docs).select(key.alias("src"), value.alias("value")), key, many
        rows, ident, several = self.walk(table, links, docs, distinct, ends)
        if ends and count:
            value = F.lit("")
        return rows.select(F.col("__src").alias("src"), value.alias("value")), ident, many or several

    def value_type(self, table: Table, steps: tuple) -> str:
        links, rest = self.split(table, self.spread(table, steps)[0])
        if not rest or rest[0].name in ("*", "_ID"):
            return "LINK"
        return self.target(table, links).field(rest[0].name).type

    # -- queries

    def select(self, table: str, q: str = "*", shards: list[str] | None = None, range_: tuple | None = None) -> DataFrame:
        """The objects that a query takes, with all their columns."""
        t = self.table(table)
        df = self.frame(t)
        if shards is not None:
            df = df.where(F.col("_shard").isin(*shards))
        if range_ is not None:
            df = df.where(F.lower("_shard") >= range_[0].lower())
            if len(range_) > 1 and range_[1] is not None:
                df = df.where(F.lower("_shard") <= range_[1].lower())
        return self.predicates.filter(df, t, self.parser(t, q).query())

    def pair(self, table: str, q: str, pair: tuple[str, str]) -> DataFrame:
        """Objects that a query takes with _pair.first and _pair.second standing for two links, in either order."""
        a, b = pair
        one = self.select(table, q.replace("_pair.first", a).replace("_pair.second", b))
        two = self.select(table, q.replace("_pair.first", b).replace("_pair.second", a))
        return one.union(two).dropDuplicates(["_ID"])

    def query(self, table: str, q: str = "*", f: str = "*", o: str | None = None, s: int | None = None, k: int = 0, e: str | None = None, g: str | None = None, m: str | None = None, total: bool = False, **scope) -> DataFrame:
        """An object query: q query, f fields, o order, s page size (0: all), k skipped, e or g the id to go on at or after, m metrics.

        total: a column _total says how many objects the query takes in all, wherever the page begins.
        """
        t = self.table(table)
        df = self.select(table, q, **scope)
        count = df.agg(F.count(F.lit(1)).alias("_total"))
        if (e or g) and o:
            raise DQLError("continuation goes by id, without an order")
        if e:
            df = df.where(F.col("_ID") >= e)
        if g:
            df = df.where(F.col("_ID") > g)
        size = self.DEFAULT_SIZE if s is None else s
        df = self.projection.ordered(df, t, self.parser(t, o).orders() if o else [])
        if k:
            df = df.offset(k)
        if size:
            df = df.limit(size)
        out = self.projection.select(df, t, self.parser(t, f).outputs(), None if q == "*" and not (size or k or e or g or scope) else df)
        if m:
            per = self.aggregates.run(t, [(df, Parser("_ID AS _mid").groups())], self.parser(t, m).metrics())
            out = out.join(per, F.col("_ID") == F.col("_mid"), "left").drop("_mid")
        return out.crossJoin(F.broadcast(count)) if total else out  # one row

    def count(self, table: str, q: str = "*", **scope) -> DataFrame:
        return self.select(table, q, **scope).agg(F.count(F.lit(1)).alias("count"))

    def aggregate(self, table: str, q: str = "*", f: str | None = None, m: str = "COUNT(*)", level: int | None = None, flat: int | None = None, empty: bool = False, pair: tuple[str, str] | None = None, **scope) -> DataFrame:
        """An aggregate query: f groups, m metrics. Key columns are g1, g2 and so on, or the groups' aliases.

        pair: two links that _pair.first and _pair.second stand for, in either order; an object counts once in a group that both give it.
        """
        t = self.table(table)
        metrics = self.parser(t, m).metrics()
        ways = [(q, f)] if pair is None else [tuple(x and x.replace("_pair.first", a).replace("_pair.second", b) for x in (q, f)) for a, b in (pair, pair[::-1])]
        docs = [self.select(table, x, **scope) for x, _ in ways]
        sets = [self.parser(t, x).group_sets() if x else [[]] for _, x in ways]
        outs = []
        for i, groups in enumerate(zip(*sets, strict=True)):
            out = self.aggregates.run(t, list(zip(docs, groups, strict=True)), metrics, level, flat=flat, whole=q == "*" and not scope and pair is None)
            if empty and len(groups[0]) == 1:
                out = self.aggregates.with_empty(t, out, groups[0][0])
            outs.append(out.withColumn("_set", F.lit(i)) if len(sets[0]) > 1 else out)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outs)

    def composite(self, table: str, q: str = "*", cf: str = "", m: str = "COUNT(*)") -> DataFrame:
        """The extra groups of a composite grouping: the last level over all parents."""
        t = self.table(table)
        return self.aggregates.run(t, [(self.select(table, q), self.parser(t, cf).group_sets()[0])], self.parser(t, m).metrics(), composite=True, whole=q == "*")


def read_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan reads, those read twice counted twice; 0 where it reads what has no size."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(sizes) if all(n < 1 << 58 for n in sizes) else 0


def closure(edges: DataFrame, depth: int = -1, most: int = 40) -> DataFrame:
    """Pairs reachable over edges (without an object itself), in depth steps or until nothing is new.

    Each round doubles the paths: from all pairs of at most k steps, those of exactly k steps are carried on by all to at most 2k. So a
    chain's pairs are made once each, and `most` rounds do for 2**most steps; running out is an error. Each round is checkpointed.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    found = edges.select("src", "dst").where("src <> dst").distinct().withColumn("d", F.lit(1).cast("long")).checkpoint()
    k = 1
    for _ in range(most):
        if 0 <= depth <= k:
            break
        last = found.where(F.col("d") == k).select("src", F.col("dst").alias("mid"))
        more = found.where(F.col("d") <= depth - k) if depth >= 0 else found
        new = last.join(more.select(F.col("src").alias("mid"), "dst", "d"), "mid").where("src <> dst").groupBy("src", "dst").agg((F.min("d") + k).alias("d"))
        new = new.join(found, ["src", "dst"], "left_anti").checkpoint()
        if new.isEmpty():
            break
        found, k = found.union(new), 2 * k
    else:
        raise RuntimeError("closure: not settled")
    return found.select("src", "dst")
