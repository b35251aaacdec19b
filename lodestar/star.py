"""The star schema as an application of linked tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .engine import Engine
from .plans.schema import Application, Field, Table

_TYPE = {"string": "TEXT", "int": "INTEGER", "bigint": "LONG", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
#: table, file, key
TABLES = (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey"), ("LineItem", "lineitem", None), ("Event", "events", "event_id"), ("Document", "documents", "doc_id"), ("Turn", "conversations", None))
#: table, link, foreign key, target, inverse
LINKS = (("Order", "Customer", "o_custkey", "Customer", "Orders"), ("LineItem", "Order", "l_orderkey", "Order", "Items"), ("LineItem", "Part", "l_partkey", "Part", "Items"), ("LineItem", "Supplier", "l_suppkey", "Supplier", "Items"), ("Customer", "Nation", "c_nationkey", "Nation", "Customers"), ("Supplier", "Nation", "s_nationkey", "Nation", "Suppliers"), ("Nation", "Region", "n_regionkey", "Region", "Nations"), ("Turn", "Before", "_before", "Turn", "After"))
CLOCK = datetime(1998, 6, 15, 12, 30)


#: Schemas by path: a path's table keeps its schema, which takes a job to infer.
_schemas: dict[str, StructType] = {}


class _Frames(dict):
    """Tables' DataFrames, made when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def schema(self, file: str) -> StructType:
        path = f"{self.sf_dir}/{file}.parquet"
        if path not in _schemas:
            _schemas[path] = self.spark.read.parquet(path).schema
        return _schemas[path]

    def __missing__(self, name: str) -> DataFrame:
        file, key = next((f, k) for t, f, k in TABLES if t == name)
        schema = self.schema(file)
        df = self.spark.read.schema(schema).parquet(f"{self.sf_dir}/{file}.parquet")
        naive = [f.name for f in schema if f.dataType.simpleString() == "timestamp_ntz"]
        more = {c: F.col(c).cast("timestamp") for c in naive}
        if name == "Turn":
            more["_ID"] = F.concat_ws("-", "conv_id", "turn")
            more["_before"] = F.when(F.col("turn") > 0, F.concat_ws("-", "conv_id", F.col("turn") - 1))
        elif key is None:
            # no column tells items apart: two hashes of all of them, made only where the _ID itself is asked for
            more["_ID"] = F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), *df.columns)), 16, "0") for seed in (1, 2)))
        else:
            more["_ID"] = F.col(key).cast("string")
        self[name] = df.withColumns(more)
        return self[name]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    app, frames, links = Application("Star"), _Frames(spark, sf_dir), {}
    for name, file, _ in TABLES:
        app.tables[name] = Table(name, {f.name: Field(f.name, _TYPE[f.dataType.simpleString()]) for f in frames.schema(file)})
    for t, name, fk, target, inverse in LINKS:
        app.tables[t].fields[name] = Field(name, "LINK", False, target, inverse)
        app.tables[target].fields[inverse] = Field(inverse, "LINK", True, t, name)
        links[t, name] = fk
    app.tables["Event"].fields["User"] = Field("User", "XLINK", False, "Customer", "Events", "user_id")
    app.tables["Customer"].fields["Events"] = Field("Events", "XLINK", True, "Event", "User", "_ID")
    return Engine(spark, app, frames, links, CLOCK, {name: key for name, _, key in TABLES if key})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return engine(spark, sf_dir).tables[name]
