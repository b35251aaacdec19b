"""Fields and order of an object query's results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ast import Output, Step
from ..plans.schema import Table


class Projection:
    def __init__(self, engine):
        self.engine = engine

    def ordered(self, df: DataFrame, table: Table, orders: list) -> DataFrame:
        """By the keys' sorted values, text without regard to case; objects without values first going up, last going down; then by _ID."""
        keys, before = [], df.columns
        for i, (steps, down) in enumerate(orders):
            links, rest = self.engine.split(table, steps)
            kind, name = self.engine.value_type(table, steps), f"__o{i}"
            if not links and rest and rest[0].name != "_ID" and not table.field(rest[0].name).collection:
                c = F.col(f"`{rest[0].name}`")
                df = df.withColumn(name, F.lower(c) if kind == "TEXT" else c)
            elif rest and rest[0].name != "_ID" and self.engine.looks_up(table, links) and not self.engine.target(table, links).field(rest[0].name).collection:
                c = F.col(f"`{rest[0].name}`")
                sub, ref = self.engine.lookup(table, links, {name: F.lower(c) if kind == "TEXT" else c})
                df = df.join(sub, ref == F.col("__k"), "left").drop("__k")
            else:
                v = F.lower("value") if kind == "TEXT" else F.col("value")
                rows, ident, many = self.engine.values(table, steps, df)
                rows = rows.where("value is not null").select(F.col("src").alias("__s"), v.alias(name))
                if many:  # a descending key is led by the largest value
                    rows = rows.groupBy("__s").agg(F.sort_array(F.collect_set(name), not down).alias(name))
                df = df.join(rows, ident == F.col("__s"), "left").drop("__s")
            keys.append(F.desc_nulls_last(name) if down else F.asc_nulls_first(name))
        return df.orderBy(*keys, "_ID").select(*(f"`{c}`" for c in before))

    def select(self, df: DataFrame, table: Table, outputs: tuple, docs: DataFrame | None = None, keep: tuple = ()) -> DataFrame:
        """The fields of df's objects, and its columns in `keep`. docs: the objects that linked ones are wanted for, if not all of the table's."""
        shard = ["_shard"] if "_shard" in df.columns else []
        cols, links, key = [], [], self.engine.key(table)
        for o in self._expanded(table, outputs):
            if o.name == "_ID":
                continue
            f = table.field(o.name)
            if f.is_link:
                links.append(o)
            else:
                c = F.col(f"`{f.name}`")
                cols.append((F.sort_array(c) if f.collection else c).alias(o.alias or o.name))
        out = df.select("_ID", *shard, *cols, *keep, *([key.alias("__key")] if links else []))
        for o in links:
            name = o.alias or o.name
            held = (table.name, o.name) in self.engine.held or (table.name, o.name) in self.engine.held_there
            out = out.join(self._linked(table, o, docs, name), F.col("__key" if held else "_ID") == F.col("__of"), "left").drop("__of")
        return out.drop("__key")

    def _linked(self, table: Table, o: Output, docs: DataFrame | None, name: str) -> DataFrame:
        """__of and an array of the objects that each object's link holds, in order, at most the limit.

        With a limit, rows are ranked and cut before they are collected: no more than the limit's ever meet.
        """
        target, inner = self.engine.app.tables[table.field(o.name).table], None
        # several filters, as in Items.WHERE(..).WHERE(..), all hold
        rows, _, _ = self.engine.walk(table, (Step(o.name, where=tuple(o.where)),), docs)
        if docs is not None or o.where:
            key = self.engine.key(target)
            inner = self.engine.frame(target).join(rows.select(key.alias("__in")), key == F.col("__in"), "left_semi")
        rows = self.select(rows, target, o.inner or (Output("_ID"),), inner, ("__src",))
        names = [c for c in rows.columns if c != "__src"]
        fields = F.struct(*(F.col(f"`{n}`") for n in names)) if len(names) > 1 or o.inner else F.col("_ID")
        rows = rows.select(F.col("__src").alias("__of"), fields.alias("__row"))
        if o.limit:
            rank = F.row_number().over(Window.partitionBy("__of").orderBy("__row"))
            rows = rows.withColumn("__rank", rank).where(F.col("__rank") <= o.limit)
        return rows.groupBy("__of").agg(F.sort_array(F.collect_list("__row")).alias(name))

    def _expanded(self, table: Table, outputs: tuple) -> list[Output]:
        out = []
        for o in outputs:
            if o.name in ("*", "_all", "_local"):
                out += [Output(f.name) for f in table.scalars()]
                if o.name == "_local":
                    out += [Output(f.name) for f in table.links()]
                if o.name == "_all":
                    out += [Output(f.name, inner=(Output("*"),)) for f in table.links()]
            else:
                out.append(o)
        return out
