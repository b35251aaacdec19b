"""Batches of objects in shards, merged into snapshots.

A batch row has _shard, _ID, _order (its place among the batches: a batch that must not override comes before those there are), _deleted, and
the table's fields. A merge keeps, per object, what came after its last deletion: of a single-valued field the last value there is, of a
multi-valued field the union.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

META = ("_shard", "_ID", "_order", "_deleted")


def batch(docs: DataFrame, shard: str, order: int) -> DataFrame:
    """docs as a batch; objects without an _ID get one; _deleted may be among the columns."""
    if "_ID" not in docs.columns:
        docs = docs.withColumn("_ID", F.lit(None).cast("string"))
    deleted = F.coalesce("_deleted", F.lit(False)) if "_deleted" in docs.columns else F.lit(False)
    fields = [c for c in docs.columns if c not in META]
    return docs.select(F.lit(shard).alias("_shard"), F.coalesce("_ID", F.expr("uuid()")).alias("_ID"), F.lit(order).cast("long").alias("_order"), deleted.alias("_deleted"), *fields)


def merged(batches: DataFrame) -> DataFrame:
    """The snapshot of batches: one row per shard and _ID."""
    gone = Window.partitionBy("_shard", "_ID")
    last = F.coalesce(F.max(F.when(F.col("_deleted"), F.col("_order"))).over(gone), F.lit(-(1 << 62)))
    live = batches.withColumn("__last", last).where((F.col("_order") > F.col("__last")) & ~F.col("_deleted"))
    aggs = []
    for c, t in batches.dtypes:
        if c not in META:
            if t.startswith("array"):
                aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c))
            else:
                aggs.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c))
    out = live.groupBy("_shard", "_ID")
    return out.agg(*aggs) if aggs else out.agg(F.max("_order")).select("_shard", "_ID")


def uncommitted(batches: DataFrame) -> DataFrame:
    """All rows of all batches, as live queries see them: no overriding and no deletions."""
    return batches.where(~F.col("_deleted")).drop("_order", "_deleted")


def duplicates(snapshot: DataFrame) -> DataFrame:
    """_IDs that several shards hold, with the shards."""
    found = snapshot.groupBy("_ID").agg(F.sort_array(F.collect_set("_shard")).alias("s")).where(F.size("s") > 1)
    return found.select("_ID", F.array_join("s", ",").alias("shards"))


def latest(snapshot: DataFrame) -> DataFrame:
    """One row per _ID: that of the highest shard."""
    rows = F.max_by(F.struct(*snapshot.columns), "_shard").alias("r")
    return snapshot.groupBy("_ID").agg(rows).select("r.*")


def shard_stats(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("_shard").agg(F.count(F.lit(1)).alias("objects"))


def field_statistics(snapshot: DataFrame) -> DataFrame:
    """Per field: objects that have it, its values (of multi-valued fields each one), and the least and greatest as text.

    One pass with map-side partial aggregates; the rows of the result are as many as the fields.
    """
    cells = []
    for c, t in snapshot.dtypes:
        if c in META:
            continue
        many = t.startswith("array")
        some = F.size(c) if many else F.lit(1)
        low, high = (F.array_min(c), F.array_max(c)) if many else (F.col(c), F.col(c))
        cells.append((c, F.sum(F.when(F.col(c).isNotNull() & (some > 0), 1).otherwise(0)), F.sum(F.when(F.col(c).isNotNull(), some).otherwise(0)), F.min(low), F.max(high)))
    rows = [F.struct(F.lit(c).alias("field"), F.coalesce(n, F.lit(0)).cast("long").alias("objects"), F.coalesce(v, F.lit(0)).cast("long").alias("values"), lo.cast("string").alias("least"), hi.cast("string").alias("greatest")) for c, n, v, lo, hi in cells]
    return snapshot.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def dangling(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges to objects that don't exist."""
    return edges.join(objects.select(F.col("_ID").alias("dst")), "dst", "left_anti")


def aged(df: DataFrame, field: str, age: str, now) -> DataFrame:
    """Objects not older than an age such as "30 DAYS" by a timestamp field; those without it stay."""
    n, unit = age.split() if " " in age else (age, "DAYS")
    unit = unit.upper().rstrip("S")
    limit = F.lit(str(now)).cast("timestamp") - F.expr(f"INTERVAL {int(n)} {unit}")
    return df.where(F.col(field).isNull() | (F.col(field) > limit))


def unexpired(snapshot: DataFrame, properties: DataFrame, now) -> DataFrame:
    """Objects of shards whose expire date, if any, is to come. properties: shard, expire."""
    over = properties.where(F.col("expire") <= F.lit(str(now)).cast("timestamp")).select(F.col("shard").alias("_shard"))
    return snapshot.join(over, "_shard", "left_anti")


def with_delta(df: DataFrame, field: str, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """A multi-valued field with values added and removed; add and remove: _ID and values."""
    for delta, f in ((add, F.array_union), (remove, F.array_except)):
        if delta is not None:
            d = delta.select("_ID", F.col("values").alias("__d"))
            none = F.array().cast(df.schema[field].dataType)
            df = df.join(d, "_ID", "left").withColumn(field, f(F.coalesce(field, none), F.coalesce("__d", none))).drop("__d")
    return df


def with_links(edges: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst) with some added and removed; the inverse link is made of the same edges, so it follows."""
    if add is not None:
        edges = edges.union(add.select("src", "dst")).distinct()
    return edges if remove is None else edges.join(remove.select("src", "dst"), ["src", "dst"], "left_anti")


def edges(snapshot: DataFrame, field: str) -> DataFrame:
    """(src, dst) of a link that a snapshot holds as an array of ids."""
    return snapshot.select(F.col("_ID").alias("src"), F.explode(field).alias("dst"))


def upserted(df: DataFrame, changes: DataFrame, nulls: tuple = ()) -> DataFrame:
    """df with new objects, and with the values that changes have for those there are; fields in `nulls` become null for them."""
    fields = [c for c in df.columns if c != "_ID"]
    new = changes.select(F.col("_ID").alias("__id"), F.lit(True).alias("__new"), *(F.col(c).alias("__" + c) for c in fields if c in changes.columns))
    both = df.join(new, F.col("_ID") == F.col("__id"), "full")
    value = lambda c: F.when(F.col("__new"), F.lit(None)).otherwise(F.col(c)) if c in nulls else F.coalesce("__" + c, c) if c in changes.columns else F.col(c)
    return both.select(F.coalesce("_ID", "__id").alias("_ID"), *(value(c).alias(c) for c in fields))


def update_where(df: DataFrame, hit, values: dict) -> DataFrame:
    """df with new values where the Column hit holds."""
    return df.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


class ShardStore:
    """Batches and snapshots as Parquet folders. A batch is a folder batches/_shard=s/_order=n; a shard's snapshot one of cubes/.

    What snapshot a shard has, how far it has merged, and when it expires, is in a small file of the store, written last, so that a merge that
    breaks off leaves the snapshot before it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = [o for of in self._segments().values() for o in of]
        self.orders = [min([0, *found]), max([0, *found])]  # the lowest and highest place given out

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str, key: str) -> list[str]:
        path, fs = self._fs(name)
        return sorted(s.getPath().getName()[len(key) :] for s in fs.listStatus(path) if s.getPath().getName().startswith(key)) if fs.exists(path) else []

    def _segments(self) -> dict[str, list[int]]:
        return {s: sorted(int(o) for o in self._names(f"batches/_shard={s}", "_order=")) for s in self._names("batches", "_shard=")}

    def segments(self, shard: str) -> list[int]:
        return self._segments().get(shard, [])

    def properties(self) -> dict:
        """By shard: cube, segments merged, expire (as text)."""
        path, fs = self._fs("shards.json")
        if not fs.exists(path):
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/shards.json").collect()))

    def _put(self, properties: dict) -> None:
        path, fs = self._fs("shards.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(properties).encode()))
        out.close()

    def add(self, docs: DataFrame, shard: str, overwrite: bool = True) -> int:
        """Add a batch; its place (segment) is given back."""
        if overwrite:
            self.orders[1] += 1
        else:
            self.orders[0] -= 1
        order = self.orders[1] if overwrite else self.orders[0]
        batch(docs, shard, order).drop("_shard", "_order").write.mode("append").parquet(f"{self.path}/batches/_shard={shard}/_order={order}")
        return order

    def delete(self, ids: DataFrame, shard: str) -> int:
        return self.add(ids.select("_ID").withColumn("_deleted", F.lit(True)), shard)

    def get(self, id_: str, *shards: str) -> DataFrame:
        """The object of an id as the batches have it now, in all shards or some."""
        return merged(self.batches(*shards).where(F.col("_ID") == id_))

    def drop(self, shard: str) -> None:
        """Forget a shard: its batches and its snapshot go."""
        self._remove(f"batches/_shard={shard}")
        self._put({s: p for s, p in self.properties().items() if s != shard})
        self._remove(f"cubes/{shard}")

    def drop_segment(self, shard: str, order: int) -> None:
        """Forget one batch of a shard."""
        self._remove(f"batches/_shard={shard}/_order={order}")

    def _remove(self, name: str) -> None:
        path, fs = self._fs(name)
        fs.delete(path, True)

    def expire(self, shard: str, date: str | None) -> None:
        """Set or take back the time from which on a shard is out of date."""
        properties = self.properties()
        properties.setdefault(shard, {})["expire"] = date
        self._put(properties)

    def age(self, now) -> list[str]:
        """Drop the shards whose time has come; their names."""
        gone = [s for s, p in self.properties().items() if p.get("expire") and p["expire"] <= str(now)]
        for s in gone:
            self.drop(s)
        return gone

    def shards(self) -> DataFrame:
        return self.spark.createDataFrame([(s,) for s in self._segments()], "_shard string")

    def batches(self, *shards: str) -> DataFrame:
        """Rows of the batches of all shards, or of some: no other shard's files are looked at."""
        paths = [f"{self.path}/batches/_shard={s}" for s in shards or self._segments()]
        df = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.path}/batches").parquet(*paths)
        return df.withColumns({"_shard": F.col("_shard").cast("string"), "_order": F.col("_order").cast("long")})

    def merge(self, *shards: str, expire: str | None = None, force: bool = False) -> DataFrame:
        """Bring the snapshots of some shards, or all, up to date, and read the whole snapshot. Shards without new batches are left as they are, unless forced."""
        properties, segments = self.properties(), self._segments()
        for s in shards or segments:
            p = properties.setdefault(s, {})
            if expire is not None:
                p["expire"] = expire
            if not segments.get(s) or (p.get("merged") == segments[s] and not force):
                continue
            out = f"{self.path}/cubes/{s}/{uuid.uuid4().hex}"
            merged(self.batches(s)).drop("_shard").write.parquet(out)
            p |= {"cube": out, "merged": segments[s]}
        self._put(properties)
        return self.snapshot()

    def snapshot(self, *shards: str) -> DataFrame:
        """The last snapshots of all shards, or of some."""
        parts = [self.spark.read.parquet(p["cube"]).select(F.lit(s).alias("_shard"), "*") for s, p in self.properties().items() if p.get("cube") and (not shards or s in shards)]
        if not parts:
            raise ValueError("nothing merged")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


class MonoStore(ShardStore):
    """A store of one shard, named mono, merged with each update."""

    def update(self, docs: DataFrame, overwrite: bool = True) -> DataFrame:
        self.add(docs, "mono", overwrite)
        return self.merge("mono")


#: Stands between the values of a multi-valued field in a CSV cell.
CSV_VALUES = "\ufffe"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV folder with a header; schema: DDL in which a multi-valued field is an array."""
    if schema is None:
        return spark.read.csv(path, header=True, inferSchema=True)
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    want = StructType.fromDDL(schema)
    flat = StructType([StructField(f.name, StringType() if isinstance(f.dataType, ArrayType) else f.dataType) for f in want])
    df = spark.read.csv(path, header=True, schema=flat)
    return df.select(*(F.split(f.name, CSV_VALUES).cast(f.dataType).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f"`{f.name}`") for f in want))


def write_csv(df: DataFrame, path: str) -> None:
    flat = [F.array_join(c, CSV_VALUES).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON documents (column value); absent values are left out."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("value"))


def as_xml(df: DataFrame, tag: str = "doc") -> DataFrame:
    """Rows as XML elements (column value); absent values are left out."""
    return df.select(F.to_xml(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"rowTag": tag, "attributePrefix": "@"}).alias("value"))
