"""What the plans read: links by foreign keys take no edges, no ids and no self-joins."""

import os
import re
from functools import reduce

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar import star
from lodestar.engine import Engine
from lodestar.features import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: query, table, how often it is scanned at most, the columns read in all
READS = [
    ("p19_link_all", "lineitem", 1, {"l_orderkey", "l_quantity"}),
    ("p25_link_count", "lineitem", 2, {"l_orderkey", "l_quantity"}),
    ("p27_path_distinct", "lineitem", 1, {"l_orderkey", "l_partkey"}),
    ("p28_set_comparison", "lineitem", 4, {"l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"}),
    ("m07_distinct", "lineitem", 1, {"l_orderkey", "l_partkey"}),
    ("m08_path_metric", "lineitem", 1, {"l_orderkey", "l_quantity"}),
    ("g10_correlated", "lineitem", 1, {"l_orderkey", "l_returnflag", "l_linestatus"}),
    ("g06_link_path", "orders", 1, {"o_custkey", "o_totalprice"}),
    ("m03_sum", "orders", 1, {"o_custkey", "o_orderstatus", "o_totalprice"}),
    ("p23_link_ids", "orders", 1, {"o_orderkey", "o_custkey"}),
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "table", "scans", "columns"), READS)
def test_reads(spark, name, table, scans, columns):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = re.findall(r"FileScan parquet \[([^\]]*)\].*?Location: [^\[]*\[[^\]]*/(\w+)\.parquet\]", plan(QUERIES[name](spark, SF)))
    mine = [set(re.findall(r"(\w+)#", c)) for c, t in found if t == table]
    assert 1 <= len(mine) <= scans
    assert set().union(*mine) <= columns


def test_selections_reach_the_scan(spark):
    text = plan(QUERIES["m01_count"](spark, SF))
    assert "PushedFilters" in text
    text = plan(QUERIES["p21_link_where"](spark, SF))
    assert "GreaterThan(l_quantity,40.0)" in text and "xxhash64" not in text


def test_link_limits_are_ranked_before_they_are_collected(spark):
    text = plan(QUERIES["pr05_limit_order"](spark, SF))
    assert "WindowGroupLimit" in text and "slice(" not in text


def test_top_level_tops_take_no_global_window(spark):
    text = plan(QUERIES["g11_nested_top"](spark, SF))
    assert "TakeOrderedAndProject" in text
    assert all("_l" in w for w in re.findall(r"Window \[[^\]]*\], \[([^\]]*)\]", text))


@pytest.fixture(scope="module")
def larger(spark, tmp_path_factory):
    """The tables with orders, items and parts four times over, with keys of their own."""
    d = tmp_path_factory.mktemp("larger")
    for f in os.listdir(SF):
        if f not in ("orders.parquet", "lineitem.parquet", "part.parquet"):
            (d / f).symlink_to(f"{SF}/{f}")
    for t, keys in (("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_partkey"]), ("part", ["p_partkey"])):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        out = reduce(DataFrame.union, [df.withColumns({k: F.col(k) + i * 1_000_000 for k in keys}) for i in range(4)])
        out.write.parquet(str(d / f"{t}.parquet"))
    return str(d)


def pieces(spark, name, sf, exchange):
    found = re.findall(exchange + r", (\d+)\), REPARTITION_BY_NUM", plan(QUERIES[name](spark, sf)))
    return [int(n) for n in found]


@pytest.mark.parametrize(("name", "exchange", "times"), [("p28_set_comparison", r"hashpartitioning\(src#\w+, value#\w+", 2), ("g10_correlated", r"hashpartitioning\(__src#\w+", 1), ("g09_upper_level", r"hashpartitioning\(__src#\w+", 1), ("g07_path_where", r"hashpartitioning\(__src#\w+", 1)])
def test_pieces_grow_with_the_input(spark, larger, monkeypatch, name, exchange, times):
    monkeypatch.setattr(Engine, "PIECE", 16 << 10)
    few, many = pieces(spark, name, SF, exchange), pieces(spark, name, larger, exchange)
    assert len(few) == len(many) == times
    assert all(n > 1 and m > 2 * n for n, m in zip(few, many, strict=True))
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{larger}/{t}.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL[name])
    got = QUERIES[name](spark, larger).select([d[0] for d in want.description]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_rows_of_few_objects_are_merged_before_they_travel(spark, monkeypatch):
    monkeypatch.setattr(Engine, "PIECE", 1 << 10)
    e = star.engine(spark, SF)
    nation, order = e.table("Nation"), e.table("Order")
    assert "REPARTITION_BY_NUM" not in plan(e.aggregate("Nation", "*", "Customers.Orders.Items.l_returnflag"))
    assert "REPARTITION_BY_NUM" not in plan(e.select("Nation", "EQUALS(Customers.Orders.Items.l_returnflag, Customers.Orders.Items.l_linestatus)"))
    rows = e.frame(e.table("LineItem")).select("l_orderkey")
    assert e.scattered(rows, nation, "l_orderkey") is rows
    unsized = spark.createDataFrame(rows.rdd)
    assert e.scattered(unsized, order, "l_orderkey") is unsized


def test_pieces_are_few_enough_to_be_written_unsorted(spark, monkeypatch):
    exchange = r"hashpartitioning\(__src#\w+"
    monkeypatch.setattr(Engine, "PIECE", 64)
    assert pieces(spark, "g10_correlated", SF, exchange) == [200]
    monkeypatch.setattr(Engine, "LARGE", 256)
    assert pieces(spark, "g10_correlated", SF, exchange)[0] > 200
