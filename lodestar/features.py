"""More of the engine's operators as queries with SQL: quantified sets, cross-links, transitive groups, projections, orders, stores, streams."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.ast import Clause, Step
from .plans.schema import Field
from .queries import _HAS, _IDS, ORACLE_SQL, QUERIES, _add, _agg, _orders, _with_group, _yearly
from .sources import logs, shards
from .sources.shared import shared_dir
from .streaming import live

__all__ = ["ORACLE_SQL", "QUERIES"]

_TURN = 'SELECT concat(conv_id, \'-\', turn) AS "_ID" FROM conversations t WHERE '
_EVENT = "SELECT {} FROM events v WHERE v.user_id = c.c_custkey"


def _path(e, name: str) -> str:
    return f"{shared_dir(e.spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------------- predicates

# values of two paths per object, as SQL lists
_SETS = "SELECT o_orderkey, coalesce(list_sort(list(DISTINCT l_returnflag) FILTER (l_returnflag IS NOT NULL)), []) AS a, coalesce(list_sort(list(DISTINCT l_linestatus) FILTER (l_linestatus IS NOT NULL)), []) AS b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"


def _sets(kind: str, test: str, left: str = "Items.l_returnflag", right: str = "Items.l_linestatus") -> None:
    _add(f"p28_{kind.lower()}", lambda e: e.select("Order", f"{kind}({left}, {right})").select("_ID"), f'SELECT CAST(o_orderkey AS VARCHAR) AS "_ID" FROM ({_SETS}) WHERE {test}')


_sets("EQUALS", "len(a) = 0 AND len(b) = 0 OR a = b")
_sets("CONTAINS", "len(list_intersect(a, b)) = len(b) AND (len(b) > 0 OR len(a) = 0)")
_sets("DISJOINT", "len(list_intersect(a, b)) = 0 AND (len(a) > 0 OR len(b) > 0)")
_add("p10_regexp", lambda e: e.predicates.filter(e.tables["Order"], e.table("Order"), Clause((Step("o_orderpriority"),), "regexp", "[12]-[a-z]+")).select("_ID"), _IDS + "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_add("p29_cross_link_any", lambda e: e.select("Customer", "Events.event_type=error AND COUNT(Events)>40").select("_ID"), f"SELECT CAST(c_custkey AS VARCHAR) AS \"_ID\" FROM customer c WHERE EXISTS ({_EVENT.format(1)} AND v.event_type = 'error') AND ({_EVENT.format('count(*)')}) > 40")
_add("p29_cross_link_all", lambda e: e.select("Customer", "ALL(Events).value<200").select("_ID"), f'SELECT CAST(c_custkey AS VARCHAR) AS "_ID" FROM customer c WHERE EXISTS ({_EVENT.format(1)}) AND NOT EXISTS ({_EVENT.format(1)} AND NOT v.value < 200)')
_add("p29_cross_link_none", lambda e: e.select("Customer", "NONE(Events).event_type=signup AND NOT Events IS NULL OR c_acctbal>9000 AND Events IS NULL").select("_ID"), f"SELECT CAST(c_custkey AS VARCHAR) AS \"_ID\" FROM customer c WHERE (NOT EXISTS ({_EVENT.format(1)} AND v.event_type = 'signup') AND EXISTS ({_EVENT.format(1)})) OR (c_acctbal > 9000 AND NOT EXISTS ({_EVENT.format(1)}))")
_add("p29_cross_link_direct", lambda e: e.select("Event", "ALL(User).c_mktsegment=building AND value>100").select("_ID"), "SELECT CAST(event_id AS VARCHAR) AS \"_ID\" FROM events WHERE value > 100 AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
_WAY = "EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = t.conv_id AND x.turn = t.turn {} AND {})"
_way = lambda a, b: f"({_WAY.format('- 1', a)} AND {_WAY.format('+ 1', b)} OR {_WAY.format('+ 1', a)} AND {_WAY.format('- 1', b)})"
_add("p34_pair", lambda e: e.pair("Turn", "_pair.first.turn=2 AND _pair.second.turn=(0,4)", ("Before", "After")).select("_ID"), _TURN + _way("x.turn = 2", "x.turn IN (0, 4)"))
_orders("fn22_escapes", "o_orderpriority='\\u0031-URGENT' OR o_orderpriority=\"5\\-LOW\"", "o_orderpriority IN ('1-URGENT', '5-LOW')")
for _unit, _from, _to in (("THISYEAR", "'1998-01-01'", "'1999-01-01'"), ("THISQUARTER", "'1998-04-01'", "'1998-07-01'"), ("THISWEEK", "'1998-06-15'", "'1998-06-22'"), ("TODAY", "'1998-06-15'", "'1998-06-16'")):
    _orders(f"p31_{_unit.lower()}", f"o_orderdate=PERIOD().{_unit}", f"o_orderdate >= TIMESTAMP {_from} AND o_orderdate < TIMESTAMP {_to}")
for _unit, _from in (("LASTMONTH", "1998-05-15 12:30:00"), ("LASTWEEK", "1998-06-08 12:30:00"), ("LASTDAY", "1998-06-14 12:30:00"), ("LASTQUARTER", "1998-03-15 12:30:00")):
    _orders(f"p31_{_unit.lower()}", f"o_orderdate=PERIOD().{_unit}", f"o_orderdate >= TIMESTAMP '{_from}' AND o_orderdate <= TIMESTAMP '1998-06-15 12:30:00'")
_orders("p30_now_zone", "o_orderdate > NOW(GMT+5:30 -2 MONTHS)", "o_orderdate > TIMESTAMP '1998-04-15 18:00:00'")
_orders("j03_every_item_or", "ALL(Items).l_tax<0.05 OR NONE(Items).l_quantity>10 OR COUNT(Items)=0", "(EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND NOT l_tax < 0.05)) OR NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 10)")

# ---------------------------------------------------------------------------- metrics, groups

_agg("m06_average_kinds", "Order", "*", "o_orderstatus AS k", "AVERAGE(Items) AS l, AVERAGE(o_orderpriority) AS t, AVERAGE(o_orderdate) AS d, AVERAGE(Customer.c_acctbal) AS c", "SELECT o_orderstatus AS k, round(avg(n), 4) AS l, CAST(1 AS DOUBLE) AS t, round(avg(epoch_ms(o_orderdate)), 4) AS d, round(avg(c_acctbal), 4) AS c FROM (SELECT o.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders o) JOIN customer ON c_custkey = o_custkey GROUP BY 1")
_agg("m19_min_max_all", "Order", "*", None, "MIN(o_orderdate) AS a, MAX(o_orderdate) AS b", "SELECT CAST(min(o_orderdate) AS VARCHAR) AS a, CAST(max(o_orderdate) AS VARCHAR) AS b FROM orders")
_agg("m07_distinct_links", "Customer", "c_acctbal>0", "c_mktsegment AS k", "DISTINCT(Nation) AS n, DISTINCT(Nation.Region.r_name) AS r, DISTINCT(Orders.o_orderpriority) AS p", "SELECT c_mktsegment AS k, count(DISTINCT c_nationkey) AS n, count(DISTINCT r_name) AS r, count(DISTINCT o_orderpriority) AS p FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1")
_agg("g08_transitive", "Turn", "*", "Before^.role AS k", "COUNT(*) AS n", "SELECT k, count(*) AS n FROM (SELECT DISTINCT t.conv_id, t.turn, b.role AS k FROM conversations t LEFT JOIN conversations b ON b.conv_id = t.conv_id AND b.turn < t.turn) GROUP BY 1")
_agg("g08_transitive_depth", "Turn", "role=assistant", "Before^(2).turn AS k", "COUNT(*) AS n", "SELECT k, count(*) AS n FROM (SELECT DISTINCT t.conv_id, t.turn, b.turn AS k FROM conversations t LEFT JOIN conversations b ON b.conv_id = t.conv_id AND b.turn < t.turn AND b.turn >= t.turn - 2 WHERE t.role = 'assistant') GROUP BY 1")
_agg("g11_bottom", "Order", "*", "BOTTOM(3,Customer.Nation.n_name) AS k", "SUM(o_custkey) AS s", "SELECT n_name AS k, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY 2, lower(n_name) LIMIT 3")
_PER = "SELECT n_name AS a, o_orderpriority AS b, {} AS m FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY {}"
_agg("g11_nested_top", "Order", "*", "TOP(3,Customer.Nation.n_name) AS a,BOTTOM(2,o_orderpriority) AS b", "MAX(o_totalprice) AS m", f"SELECT a, b, round(m, 4) AS m FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY m, lower(b)) AS r FROM ({_PER.format('max(o_totalprice)', '1, 2')}) WHERE a IN (SELECT n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY max(o_totalprice) DESC, lower(n_name) LIMIT 3)) WHERE r <= 2")
_agg("g12_first_nested", "Order", "*", "FIRST(2,o_orderstatus) AS a,LAST(1,o_orderpriority) AS b", "COUNT(*) AS n", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders WHERE o_orderstatus IN (SELECT DISTINCT o_orderstatus FROM orders ORDER BY 1 LIMIT 2) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC) = 1")
_agg("g15_batch_times", "Order", "*", "BATCH(o_orderdate,'1996-01-01','1997-07-01') AS k", "COUNT(*) AS n", "SELECT CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN '<1996-01-01' WHEN o_orderdate < TIMESTAMP '1997-07-01' THEN '1996-01-01-1997-07-01' ELSE '>=1997-07-01' END AS k, count(*) AS n FROM orders GROUP BY 1")
_agg("g15_batch_texts", "Part", "*", "BATCH(p_name,d,n) AS k", "COUNT(*) AS n", "SELECT CASE WHEN lower(p_name) < 'd' THEN '<d' WHEN lower(p_name) < 'n' THEN 'd-n' ELSE '>=n' END AS k, count(*) AS n FROM part GROUP BY 1")
for _unit in ("SECOND", "MINUTE", "HOUR", "DAY", "MONTH", "QUARTER", "YEAR"):
    _agg(f"g17_truncate_{_unit.lower()}", "Event", "value>20", f"TRUNCATE(ts,{_unit},GMT+5:30) AS k", "COUNT(*) AS n", f"SELECT CAST(CAST(date_trunc('{_unit}', ts + INTERVAL 330 MINUTE) AS TIMESTAMP) AS VARCHAR) AS k, count(*) AS n FROM events WHERE value > 20 GROUP BY 1")
_agg("g17_named_zone", "Order", "*", "TRUNCATE(o_orderdate,MONTH,America/Bogota) AS k", "COUNT(*) AS n", "SELECT CAST(CAST(date_trunc('month', o_orderdate - INTERVAL 5 HOUR) AS TIMESTAMP) AS VARCHAR) AS k, count(*) AS n FROM orders GROUP BY 1")
_agg("g18_seconds", "Event", "event_type=error", "ts AS k", "COUNT(*) AS n", "SELECT CAST(CAST(date_trunc('second', ts) AS TIMESTAMP) AS VARCHAR) AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
_agg("g19_date_parts", "Order", "*", "o_orderdate.YEAR AS y,o_orderdate.DAY AS d", "COUNT(*) AS n", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(day(o_orderdate) AS INTEGER) AS d, count(*) AS n FROM orders GROUP BY 1, 2")
_agg("g22_include", "Order", "*", "o_orderpriority.INCLUDE('*h*','5-low') AS k", "COUNT(*) AS n", "SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE lower(o_orderpriority) LIKE '%h%' OR o_orderpriority = '5-LOW' GROUP BY 1")
_add("g29_group_field", lambda e: _with_group(e).aggregate("Order", "*", "Marks AS k", "COUNT(*) AS n, SUM(o_custkey) AS s"), "SELECT k, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM (SELECT o_custkey, unnest([o_orderstatus, o_orderpriority]) AS k FROM orders) GROUP BY 1")


def _with_ends(e):
    """Turns with a group field of both links."""
    e.app.tables["Turn"].fields["Ends"] = Field("Ends", "GROUP", members=["Before", "After"])
    return e


_BOTH = "SELECT t.conv_id, t.turn, x.role FROM conversations t LEFT JOIN conversations x ON x.conv_id = t.conv_id AND abs(x.turn - t.turn) = 1"
_add("g29_group_of_links", lambda e: _with_ends(e).aggregate("Turn", "*", "Ends.role AS k", "COUNT(*) AS n"), f"SELECT role AS k, count(*) AS n FROM (SELECT DISTINCT * FROM ({_BOTH})) GROUP BY 1")
_add("g29_metric", lambda e: _with_ends(e).aggregate("Turn", "*", "role AS k", "COUNT(Ends.role) AS n, DISTINCT(Ends.role) AS d"), "SELECT t.role AS k, count(x.role) AS n, count(DISTINCT x.role) AS d FROM conversations t LEFT JOIN conversations x ON x.conv_id = t.conv_id AND abs(x.turn - t.turn) = 1 GROUP BY 1")
_add("p32_group_of_links", lambda e: _with_ends(e).select("Turn", "Ends.role=system").select("_ID"), _TURN + "EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = t.conv_id AND abs(x.turn - t.turn) = 1 AND x.role = 'system')")
_PAIRED = "SELECT t.conv_id, t.turn, b.role AS k FROM conversations t JOIN conversations a ON a.conv_id = t.conv_id AND a.turn = t.turn {} AND a.role = 'system' LEFT JOIN conversations b ON b.conv_id = t.conv_id AND b.turn = t.turn {}"
_agg("g30_pair", "Turn", "_pair.first.role=system", "_pair.second.role AS k", "COUNT(*) AS n, SUM(turn) AS s", f"SELECT k, count(*) AS n, CAST(sum(turn) AS BIGINT) AS s FROM ({_PAIRED.format('- 1', '+ 1')} UNION {_PAIRED.format('+ 1', '- 1')}) GROUP BY 1", pair=("Before", "After"))

# ---------------------------------------------------------------------------- projection, order, paging

_flat = lambda df: df.select(*((F.round(c, 4) if t == "double" else F.col(c).cast("string") if t == "timestamp" else F.col(c)).alias(c) for c, t in df.dtypes))
_n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
_ORDER = 'CAST(o_orderkey AS VARCHAR) AS "_ID", o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority'
_add("pr01_default", lambda e: _flat(e.query("Order", "o_orderstatus=P", s=0)), f"SELECT {_ORDER} FROM orders WHERE o_orderstatus = 'P'")
_add("pr02_all", lambda e: e.query("Nation", "*", "_all", s=0).select("_ID", "n_name", F.col("Region")[0]["r_name"].alias("region"), F.array_max(F.transform("Customers", lambda c: c["c_name"])).alias("last"), _n("Suppliers").alias("suppliers")), "SELECT CAST(n_nationkey AS VARCHAR) AS \"_ID\", n_name, r_name AS region, (SELECT max(c_name) FROM customer WHERE c_nationkey = n_nationkey) AS last, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation JOIN region ON r_regionkey = n_regionkey")
_add("pr03_local", lambda e: e.query("Nation", "*", "_local", s=0).select("_ID", "n_name", F.element_at("Region", 1).alias("region"), F.array_join("Suppliers", ",").alias("suppliers")), "SELECT CAST(n_nationkey AS VARCHAR) AS \"_ID\", n_name, CAST(n_regionkey AS VARCHAR) AS region, (SELECT string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY CAST(s_suppkey AS VARCHAR)) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
_add("pr05_limit_order", lambda e: e.query("Customer", "*", "Orders[3](o_orderkey)", s=0).select("_ID", F.array_join(F.transform("Orders", lambda o: o["_ID"]), ",").alias("orders")), "SELECT CAST(c_custkey AS VARCHAR) AS \"_ID\", string_agg(i, ',' ORDER BY i) FILTER (r <= 3) AS orders FROM (SELECT c_custkey, CAST(o_orderkey AS VARCHAR) AS i, row_number() OVER (PARTITION BY c_custkey ORDER BY CAST(o_orderkey AS VARCHAR)) AS r FROM customer LEFT JOIN orders ON o_custkey = c_custkey) GROUP BY 1")
_add("pr06_two_filters", lambda e: e.query("Order", "o_orderstatus=P", "Items.WHERE(l_quantity>20).WHERE(l_tax<0.04)(l_quantity) AS x", s=0).select("_ID", _n("x").alias("n")), "SELECT CAST(o_orderkey AS VARCHAR) AS \"_ID\", count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 20 AND l_tax < 0.04 WHERE o_orderstatus = 'P' GROUP BY o_orderkey")
_add("pr04_two_levels", lambda e: e.query("Nation", "n_name=(NATION_1,NATION_2)", "Customers(c_name,Orders[1](o_totalprice))", s=0).select("_ID", F.explode("Customers").alias("c")).select("_ID", F.col("c.c_name").alias("c_name"), F.col("c.Orders")[0]["_ID"].alias("o")), "SELECT CAST(c_nationkey AS VARCHAR) AS \"_ID\", c_name, (SELECT min(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_custkey = c_custkey) AS o FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name IN ('NATION_1', 'NATION_2')")
_add("pr08_shard", lambda e: _sharded(e).query("Order", "o_orderstatus=P", "o_custkey", s=0, shards=["1996", "1997"]), "SELECT CAST(o_orderkey AS VARCHAR) AS \"_ID\", strftime(o_orderdate, '%Y') AS _shard, o_custkey FROM orders WHERE o_orderstatus = 'P' AND year(o_orderdate) IN (1996, 1997)")
_add("pr09_cross_link", lambda e: e.query("Customer", "c_acctbal>5000", "c_name,Events(value)", s=0).select("c_name", _n("Events").alias("n"), F.round(F.array_max(F.transform("Events", lambda v: v["value"])), 4).alias("most")), "SELECT c_name, count(event_id) AS n, round(max(value), 4) AS most FROM customer LEFT JOIN events ON user_id = c_custkey WHERE c_acctbal > 5000 GROUP BY c_custkey, c_name")
_add("pr09_cross_link_direct", lambda e: e.query("Event", "value>100", "User(c_name)", s=0).select("_ID", F.col("User")[0]["c_name"].alias("c_name")), "SELECT CAST(event_id AS VARCHAR) AS \"_ID\", c_name FROM events LEFT JOIN customer ON c_custkey = user_id WHERE value > 100")


def _sharded(e):
    e.tables["Order"] = e.tables["Order"].withColumn("_shard", F.date_format("o_orderdate", "yyyy"))
    return e


_VALUES = "(SELECT list_sort(list(DISTINCT o_orderpriority)) FROM orders WHERE o_custkey = c_custkey{})"


def _with_priorities(e):
    """Customers with a multi-valued field: the priorities of their large orders, absent for many."""
    per = e.tables["Order"].where("o_totalprice > 400000").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("big"))
    e.tables["Customer"] = e.tables["Customer"].join(per, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    e.app.tables["Customer"].fields["big"] = Field("big", "TEXT", True)
    return e


_add("p11_absent", lambda e: _with_priorities(e).select("Customer", "big IS NULL AND c_acctbal>0").select("_ID"), f'SELECT CAST(c_custkey AS VARCHAR) AS "_ID" FROM customer c WHERE NOT {_HAS.format(" AND o_totalprice > 400000")} AND c_acctbal > 0')
_add("p11_present", lambda e: _with_priorities(e).select("Customer", "big=*").select("_ID"), f'SELECT CAST(c_custkey AS VARCHAR) AS "_ID" FROM customer c WHERE {_HAS.format(" AND o_totalprice > 400000")}')
_BIG = _VALUES.format(" AND o_totalprice > 400000")
_PLACE = lambda down: f"SELECT CAST(c_custkey AS VARCHAR) AS \"_ID\", CAST(row_number() OVER (ORDER BY {'array_reverse(' + _BIG + ') DESC NULLS LAST' if down else _BIG + ' ASC NULLS FIRST'}, CAST(c_custkey AS VARCHAR)) AS INTEGER) AS place FROM customer ORDER BY place LIMIT 300"
_add("pr10_sorted_values", lambda e: _with_priorities(e).query("Customer", "*", "big", s=0).select("_ID", F.array_join("big", ",").alias("big")), f"SELECT CAST(c_custkey AS VARCHAR) AS \"_ID\", array_to_string({_BIG}, ',') AS big FROM customer")
for _name, _down in (("s02_many_valued_key", False), ("s03_nulls_last", True)):
    _add(_name, (lambda down: lambda e: _places(_with_priorities(e).query("Customer", "*", "c_custkey", "big" + " DESC" * down, s=300)))(_down), _PLACE(_down))


def _places(page: DataFrame) -> DataFrame:
    """A page's rows with their places."""
    one = page.agg(F.collect_list("_ID").alias("x"))  # a page is as long as its size
    return one.select(F.posexplode("x").alias("p", "_ID")).select("_ID", (F.col("p") + 1).alias("place"))


_add("s07_continue_at", lambda e: e.query("Order", "o_orderstatus=F", "o_custkey", e="500", s=30), "SELECT CAST(o_orderkey AS VARCHAR) AS \"_ID\", o_custkey FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderkey AS VARCHAR) >= '500' ORDER BY 1 LIMIT 30")
_add("s09_total", lambda e: e.query("Order", "o_orderstatus=F", "o_custkey", s=7, k=3, total=True), "SELECT CAST(o_orderkey AS VARCHAR) AS \"_ID\", o_custkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS _total FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 7 OFFSET 3")

# ---------------------------------------------------------------------------- stores, logs, streams


def _store(e) -> shards.ShardStore:
    """Orders by year as batches: all, then new prices of a status over them, then customers' earlier batches under them, and deletions."""
    store, o = shards.ShardStore(e.spark, _path(e, "store")), e.tables["Order"]
    for year in ("1996", "1997"):
        mine = o.where(F.year("o_orderdate") == int(year)).select("_ID", "o_orderstatus", "o_totalprice", F.array("o_orderpriority").alias("p"))
        store.add(mine, year)
        store.add(mine.where("o_orderstatus = 'F'").select("_ID", F.lit(1.0).alias("o_totalprice"), F.array(F.lit("new")).alias("p")), year)
        store.add(mine.select("_ID", F.lit("old").alias("o_orderstatus"), F.array(F.lit("old")).alias("p")), year, overwrite=False)
        store.delete(mine.where("o_orderstatus = 'P'"), year)
    return store


_KEPT = "SELECT strftime(o_orderdate, '%Y') AS _shard, CAST(o_orderkey AS VARCHAR) AS \"_ID\", o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE round(o_totalprice, 4) END AS o_totalprice, array_to_string(list_sort([o_orderpriority, 'old'] || CASE WHEN o_orderstatus = 'F' THEN ['new'] ELSE [] END), ',') AS p FROM orders WHERE o_orderstatus <> 'P' AND year(o_orderdate) IN ({})"
_snap = lambda df: df.select("_shard", "_ID", "o_orderstatus", F.round("o_totalprice", 4).alias("o_totalprice"), F.array_join("p", ",").alias("p"))
_add("src01_batches", lambda e: _snap(_store(e).merge()), _KEPT.format("1996, 1997"))
_add("src04_merge_one_shard", lambda e: _snap(_store(e).merge("1997")), _KEPT.format("1997"))
_add("src10_get", lambda e: _snap(_store(e).get(e.tables["Order"].where("year(o_orderdate) = 1996 AND o_orderstatus = 'F'").agg(F.min("_ID")).first()[0], "1996", "1997")), "SELECT * FROM (" + _KEPT.format("1996, 1997") + ") WHERE \"_ID\" = (SELECT min(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE year(o_orderdate) = 1996 AND o_orderstatus = 'F')")


def _segment_gone(e) -> DataFrame:
    store = _store(e)
    store.drop_segment("1997", max(store.segments("1997")))  # the deletions
    store.expire("1996", "1998-01-01 00:00:00")
    store.age(e.clock)
    return store.merge().groupBy("_shard", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


_add("src07_segment_and_expiry", _segment_gone, "SELECT '1997' AS _shard, o_orderstatus, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 2")
_add("src08_shard_expiry", lambda e: shards.unexpired(_yearly(e).select("_shard", "_ID"), e.spark.createDataFrame([("1996", "1997-01-01"), ("1997", "2010-01-01")], "shard string, expire string").withColumn("expire", F.col("expire").cast("timestamp")), e.clock).groupBy("_shard").agg(F.count(F.lit(1)).alias("n")), "SELECT strftime(o_orderdate, '%Y') AS _shard, count(*) AS n FROM orders WHERE year(o_orderdate) <> 1996 GROUP BY 1")
_add("src06_dangling", lambda e: shards.dangling(e.edges(e.table("Order"), "Customer"), e.tables["Customer"].where("c_acctbal > 0")), "SELECT CAST(o_custkey AS VARCHAR) AS dst, CAST(o_orderkey AS VARCHAR) AS src FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE NOT c_acctbal > 0)")
_add("src10_upsert", lambda e: shards.upserted(e.tables["Nation"].select("_ID", "n_name", "n_regionkey"), e.tables["Nation"].where("n_regionkey = 1").select((F.col("n_nationkey") + 20).cast("string").alias("_ID"), F.lower("n_name").alias("n_name"))), "SELECT coalesce(CAST(a.n_nationkey AS VARCHAR), b.i) AS \"_ID\", coalesce(b.n, a.n_name) AS n_name, a.n_regionkey FROM nation a FULL JOIN (SELECT CAST(n_nationkey + 20 AS VARCHAR) AS i, lower(n_name) AS n FROM nation WHERE n_regionkey = 1) b ON b.i = CAST(a.n_nationkey AS VARCHAR)")


def _deltas(e) -> DataFrame:
    """Customers' links to orders, after one order of each is moved to the customer before; read by the inverse link."""
    links = e.edges(e.table("Order"), "Customer")
    moved = links.where("cast(src as int) % 10 = 0")
    now = shards.with_links(links, moved.select("src", F.greatest(F.col("dst").cast("long") - 1, F.lit(0)).cast("string").alias("dst")), moved.where("dst <> '0'"))
    e.held.pop(("Order", "Customer")), e.held_there.pop(("Customer", "Orders"))
    e.links |= {("Order", "Customer"): now, ("Customer", "Orders"): now.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}
    return e.aggregate("Customer", "*", "c_mktsegment AS k", "COUNT(Orders) AS n")


_add("src11_link_deltas", _deltas, "SELECT c_mktsegment AS k, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN greatest(o_custkey - 1, 0) ELSE o_custkey END AS c FROM orders) ON c = c_custkey GROUP BY 1")
_add("src11_value_deltas", lambda e: shards.with_delta(_with_priorities(e).tables["Customer"].select("_ID", "big"), "big", e.tables["Customer"].where("c_acctbal > 5000").select("_ID", F.array(F.lit("vip")).alias("values")), e.tables["Customer"].select("_ID", F.array(F.lit("5-LOW")).alias("values"))).select("_ID", F.array_join(F.sort_array("big"), ",").alias("big")), f"SELECT CAST(c_custkey AS VARCHAR) AS \"_ID\", coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(coalesce({_BIG}, []) || CASE WHEN c_acctbal > 5000 THEN ['vip'] ELSE [] END) AS x) WHERE x <> '5-LOW'), '') AS big FROM customer")
_add("st01_uncommitted", lambda e: shards.uncommitted(_store(e).batches("1996")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "SELECT o_orderstatus, count(*) AS n FROM (SELECT o_orderstatus FROM orders WHERE year(o_orderdate) = 1996 UNION ALL SELECT NULL FROM orders WHERE year(o_orderdate) = 1996 AND o_orderstatus = 'F' UNION ALL SELECT 'old' FROM orders WHERE year(o_orderdate) = 1996) GROUP BY 1")


def _csv(e) -> DataFrame:
    path, df = _path(e, "csv"), _with_priorities(e).tables["Customer"].select("c_custkey", "c_name", "big")
    shards.write_csv(df, path)
    return shards.read_csv(e.spark, path, "c_custkey long, c_name string, big array<string>").select("c_custkey", "c_name", F.array_join(F.sort_array("big"), ",").alias("big"))


_add("src16_csv", _csv, f"SELECT c_custkey, c_name, array_to_string({_BIG}, ',') AS big FROM customer")


def _log(e, stream: bool = False) -> tuple[str, DataFrame]:
    """Events as a log: appended in two parts, or by a stream."""
    path, rows = _path(e, "log"), e.tables["Event"].drop("_ID")
    if stream:
        rows.write.parquet(_path_in := _path(e, "log-in"))
        live.ingest(live.tail(e.spark, _path_in, rows.schema), path, _path(e, "log-checkpoint"), "ts").awaitTermination()
    else:
        for half in (0, 1):
            logs.append(rows.where(F.col("event_id") % 2 == half), path, "ts")
    return path, e.spark.read.parquet(path)


_DAYS = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 4) AS v FROM events {} GROUP BY 1"
_by_day = lambda df: df.groupBy(F.col("_day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))
_add("src14_log_append", lambda e: _by_day(_log(e)[1]), _DAYS.format(""))
_add("st02_log_stream", lambda e: _by_day(_log(e, True)[1]), _DAYS.format(""))


def _compacted(e) -> DataFrame:
    path, _ = _log(e)
    out = _path(e, "log-compact")
    logs.compact(e.spark, path, out, "ts")
    return _by_day(logs.aged(e.spark.read.parquet(out), 10, e.clock.replace(year=2024, month=1, day=30)))


_add("src15_log_merge_and_age", _compacted, _DAYS.format("WHERE CAST(ts AS DATE) > DATE '2024-01-20'"))


def _stream_counts(e) -> DataFrame:
    """Hourly counts by a stream with a watermark, into a table, each bucket once."""
    rows = e.tables["Event"].select("ts", "event_type")
    rows.write.parquet(source := _path(e, "stream-in"))
    found = live.counts(live.tail(e.spark, source, rows.schema), "ts", "1 hour", "1 day", "event_type")
    name = f"counts_{uuid.uuid4().hex}"
    found.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", _path(e, "stream-checkpoint")).start().awaitTermination()
    return e.spark.table(name).select(F.col("bucket").cast("string").alias("bucket"), "event_type", "count")


_add("st03_stream_counts", _stream_counts, "SELECT CAST(CAST(date_trunc('hour', ts) AS TIMESTAMP) AS VARCHAR) AS bucket, event_type, count(*) AS \"count\" FROM events GROUP BY 1, 2")
_add("src12_log_pages", lambda e: logs.query(e.tables["Event"], "event_type=error", ["event_id"], "ts DESC", 25, skip=5, e=str(e.clock.replace(year=2024, month=1, day=20) + timedelta(0)), ts="ts").select("event_id"), "SELECT event_id FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-20 12:30:00' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 5")
_add("fn20_html_terms", lambda e: _pages(e), "SELECT k, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS k FROM part) GROUP BY 1")


def _pages(e) -> DataFrame:
    """Terms of a field with markup, which its analyzer leaves out."""
    e.tables["Part"] = e.tables["Part"].withColumn("page", F.concat(F.lit('<b class="x">'), F.regexp_replace("p_name", " ", "<br> "), F.lit("</b>")))
    e.app.tables["Part"].fields["page"] = Field("page", analyzer="HTMLAnalyzer")
    return e.aggregate("Part", "*", "TERMS(page) AS k", "COUNT(*) AS n")
