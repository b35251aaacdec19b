"""The engine's operators as queries over the star schema, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import star
from .plans.schema import Field
from .sources import logs, shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(star.engine(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = sql


_IDS = 'SELECT CAST(o.o_orderkey AS VARCHAR) AS "_ID" FROM orders o WHERE '


def _orders(name: str, q: str, where: str) -> None:
    """The ids of orders that a query takes."""
    _add(name, lambda e: e.select("Order", q).select("_ID"), _IDS + where)


_ITEM = "SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey"
_NATION = "EXISTS (SELECT 1 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_custkey = o.o_custkey AND {})"

_orders("p01_all", "*", "true")
_orders("p02_none", "", "false")
_orders("p03_and", "o_orderstatus=F o_totalprice>100000 AND o_orderpriority=1-URGENT", "o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority = '1-URGENT'")
_orders("p04_or", "o_orderstatus=P OR o_orderstatus=F o_totalprice<50000", "o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_totalprice < 50000)")
_orders("p05_not", "NOT o_orderstatus=F -o_orderpriority=5-LOW", "o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'")
_orders("p06_text_equality", "o_orderpriority='1-urgent'", "lower(o_orderpriority) = '1-urgent'")
_orders("p07_wildcard", "o_orderpriority=?-*h*", "lower(o_orderpriority) LIKE '_-%h%'")
_add("p08_phrase", lambda e: e.select("Part", 'p_name:"cold wid*"').select("_ID"), "SELECT CAST(p_partkey AS VARCHAR) AS \"_ID\" FROM part WHERE regexp_matches(' ' || lower(p_name) || ' ', ' cold wid[^ ]* ')")
_add("p09_all_fields", lambda e: e.select("Part", "widget *=economy").select("_ID"), "SELECT CAST(p_partkey AS VARCHAR) AS \"_ID\" FROM part WHERE (regexp_matches(lower(p_name), '(^|[^a-z0-9])widget($|[^a-z0-9])') OR regexp_matches(lower(p_brand), '(^|[^a-z0-9])widget($|[^a-z0-9])') OR regexp_matches(lower(p_type), '(^|[^a-z0-9])widget($|[^a-z0-9])')) AND (lower(p_name) = 'economy' OR lower(p_brand) = 'economy' OR lower(p_type) = 'economy')")
_orders("p11_null", "o_orderdate IS NULL OR o_totalprice=*", "o_orderdate IS NULL OR o_totalprice IS NOT NULL")
_orders("p12_typed_equality", "o_custkey=7 OR o_orderdate='1997-01-15'", "o_custkey = 7 OR o_orderdate = TIMESTAMP '1997-01-15'")
_orders("p13_range", "o_totalprice=[1000 TO 150000} AND o_orderpriority>=2-HIGH", "o_totalprice >= 1000 AND o_totalprice < 150000 AND lower(o_orderpriority) >= '2-high'")
_orders("p14_in", "o_orderpriority IN (1-urgent,5-LOW) AND o_orderstatus=(F,P)", "lower(o_orderpriority) IN ('1-urgent', '5-low') AND o_orderstatus IN ('F', 'P')")
_orders("p15_ids", "_ID IN (1,5,9) OR _ID=[200 TO 21}", "o_orderkey IN (1, 5, 9) OR (CAST(o_orderkey AS VARCHAR) >= '200' AND CAST(o_orderkey AS VARCHAR) < '21')")
_orders("p16_date_part", "o_orderdate.YEAR=1997 AND o_orderdate.MONTH=(1,2)", "year(o_orderdate) = 1997 AND month(o_orderdate) IN (1, 2)")
_orders("p18_link_path", "Customer.Nation.n_name=NATION_3", _NATION.format("n.n_name = 'NATION_3'"))
_orders("p19_link_all", "ALL(Items).l_quantity>10", f"EXISTS ({_ITEM}) AND NOT EXISTS ({_ITEM} AND NOT l.l_quantity > 10)")
_orders("p20_link_none", "NONE(Items).l_quantity>45", f"NOT EXISTS ({_ITEM} AND l.l_quantity > 45)")
_orders("p21_link_where", "Items.WHERE(l_quantity>40 AND l_tax<0.02)", f"EXISTS ({_ITEM} AND l.l_quantity > 40 AND l.l_tax < 0.02)")
_orders("p22_start_where", "WHERE(o_orderstatus=F).Items.l_returnflag=R", f"o_orderstatus = 'F' AND EXISTS ({_ITEM} AND l.l_returnflag = 'R')")
_orders("p23_link_ids", "Customer IN (1,2,3) OR Items IS NULL", f"o_custkey IN (1, 2, 3) OR NOT EXISTS ({_ITEM})")
_add("p24_transitive", lambda e: e.select("Turn", "Before^.role=system OR Before^(2).turn=0").select("_ID"), "SELECT concat(conv_id, '-', turn) AS \"_ID\" FROM conversations t WHERE EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = t.conv_id AND b.turn < t.turn AND (b.role = 'system' OR (b.turn = 0 AND t.turn - b.turn <= 2)))")
_orders("p25_link_count", "COUNT(Items)=[2 TO 4} AND COUNT(Items.WHERE(l_quantity>25))>=1", f"(SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) IN (2, 3) AND EXISTS ({_ITEM} AND l.l_quantity > 25)")
_orders("p26_value_count", "COUNT(o_totalprice)=1 AND o_totalprice>300000", "o_totalprice > 300000")
_orders("p27_path_distinct", "DCOUNT(Items.Part.p_brand)>4", "(SELECT count(DISTINCT p.p_brand) FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_orderkey = o.o_orderkey) > 4")
_orders("p28_set_comparison", "INTERSECTS(Items.Part.p_size, Items.l_linenumber) AND DIFFERS(Items.l_returnflag, Items.l_linestatus)", f"(NOT EXISTS ({_ITEM}) OR EXISTS (SELECT 1 FROM lineitem a JOIN part p ON a.l_partkey = p.p_partkey JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = p.p_size WHERE a.l_orderkey = o.o_orderkey)) AND (EXISTS ({_ITEM} AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = o.o_orderkey AND m.l_linestatus = l.l_returnflag)) OR EXISTS ({_ITEM} AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = o.o_orderkey AND m.l_returnflag = l.l_linestatus)))")
_orders("p30_now", "o_orderdate > NOW(-6 MONTHS)", "o_orderdate > TIMESTAMP '1997-12-15 12:30:00'")
_orders("p31_period", "o_orderdate=PERIOD().LASTYEAR OR o_orderdate=PERIOD().THISMONTH", "(o_orderdate >= TIMESTAMP '1997-06-15 12:30:00' AND o_orderdate <= TIMESTAMP '1998-06-15 12:30:00') OR (o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '1998-07-01')")
_add("p03_link_or", lambda e: e.select("LineItem", "Part.p_size<3 OR Supplier.s_nationkey=1").select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 3) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 1)")
_orders("j03_link_under_or", "o_orderstatus=P OR NOT Items.l_discount>0.05", f"o_orderstatus = 'P' OR NOT EXISTS ({_ITEM} AND l.l_discount > 0.05)")

# ---------------------------------------------------------------------------- metrics


def _agg(name: str, table: str, q: str, f: str | None, m: str, sql: str, cast: dict | None = None, **more) -> None:
    def run(e):
        out = e.aggregate(table, q, f, m, **more)
        return out.select(*((F.round(c, 4) if t == "double" else F.col(c).cast("string") if t == "timestamp" else F.col(c)).alias(c) for c, t in out.dtypes))

    _add(name, run, sql)


_agg("m01_count", "Order", "o_orderstatus=F", None, "COUNT(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
_agg("m02_count_links", "Order", "*", "o_orderstatus AS k", "COUNT(Items) AS n", "SELECT o_orderstatus AS k, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
_agg("m03_sum", "Order", "*", "o_orderstatus AS k", "SUM(o_custkey) AS s, SUM(o_totalprice) AS t", "SELECT o_orderstatus AS k, CAST(sum(o_custkey) AS BIGINT) AS s, round(sum(o_totalprice), 4) AS t FROM orders GROUP BY 1")
_agg("m04_min_max", "Order", "*", "o_orderpriority AS k", "MIN(o_totalprice) AS a, MAX(o_totalprice) AS b, MIN(o_orderstatus) AS c, MAX(Items.l_shipdate) AS d", "SELECT o_orderpriority AS k, round(min(o_totalprice), 4) AS a, round(max(o_totalprice), 4) AS b, min(o_orderstatus) AS c, CAST(max(l_shipdate) AS VARCHAR) AS d FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
_agg("m05_count_extremes", "Order", "*", "o_orderstatus AS k", "MINCOUNT(Items) AS a, MAXCOUNT(Items) AS b", "SELECT o_orderstatus AS k, min(n) AS a, max(n) AS b FROM (SELECT o_orderkey, any_value(o_orderstatus) AS o_orderstatus, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1")
_agg("m06_average", "Order", "*", "o_orderstatus AS k", "AVERAGE(o_totalprice) AS a, AVERAGE(Items.l_quantity) AS b", "SELECT k, round(a, 4) AS a, round(b, 4) AS b FROM (SELECT o_orderstatus AS k, avg(o_totalprice) AS a FROM orders GROUP BY 1) JOIN (SELECT o_orderstatus AS k, avg(l_quantity) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) USING (k)")
_agg("m07_distinct", "Order", "*", "o_orderstatus AS k", "DISTINCT(Customer) AS c, DISTINCT(Items.Part.p_brand) AS b, COUNT(*) AS n", "SELECT o_orderstatus AS k, count(DISTINCT o_custkey) AS c, count(DISTINCT p_brand) AS b, count(DISTINCT o_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1")
_agg("m08_path_metric", "Customer", "*", "c_mktsegment AS k", "SUM(Orders.Items.l_quantity) AS q", "SELECT c_mktsegment AS k, round(sum(l_quantity), 4) AS q FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
_agg("m09_metric_where", "Order", "*", "o_orderstatus AS k", "COUNT(Items.WHERE(l_quantity>40)) AS a, COUNT(WHERE(o_totalprice>200000).*) AS b", "SELECT o_orderstatus AS k, CAST(sum(n) AS BIGINT) AS a, count(*) FILTER (o_totalprice > 200000) AS b FROM (SELECT o.*, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 40) AS n FROM orders o) GROUP BY 1")
_agg("m10_transitive_metric", "Turn", "*", "role AS k", "COUNT(Before^) AS n", "SELECT role AS k, CAST(sum(turn) AS BIGINT) AS n FROM conversations GROUP BY 1")
_agg("m11_cross_link_metric", "Customer", "*", "c_mktsegment AS k", "COUNT(Events) AS n, SUM(Events.value) AS v", "SELECT c_mktsegment AS k, count(event_id) AS n, round(sum(value), 4) AS v FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
_agg("m12_roundup", "Order", "*", None, "SUM(ROUNDUP(o_custkey,10)) AS s", "SELECT round(sum(CASE WHEN o_custkey % 10 = 0 THEN o_custkey ELSE o_custkey - o_custkey % 10 + 10 END), 4) AS s FROM orders".replace("round(sum(", "CAST(sum(").replace("), 4) AS s", ") AS BIGINT) AS s"))
_agg("m14_arithmetic", "Order", "*", "o_orderstatus AS k", "(MAX(o_totalprice)+MIN(o_totalprice))/2 AS r, COUNT(*)*100-1 AS h", "SELECT o_orderstatus AS k, round((max(o_totalprice) + min(o_totalprice)) / 2, 4) AS r, round(count(*) * 100.0::DOUBLE - 1, 4) AS h FROM orders GROUP BY 1")
_agg("m15_datediff", "Order", "*", None, "COUNT(*)*0+DATEDIFF(MONTH,'1997-11-30','1998-02-01') AS d", "SELECT CAST(count(*) * 0 + 3 AS DOUBLE) AS d FROM orders")

# ---------------------------------------------------------------------------- groups

_agg("g03_scalar", "Order", "*", "o_orderpriority AS k", "COUNT(*) AS n", "SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1")
_agg("g06_link_path", "Order", "*", "Customer.Nation.n_name AS k", "COUNT(*) AS n, SUM(o_totalprice) AS s", "SELECT n_name AS k, count(*) AS n, round(sum(o_totalprice), 4) AS s FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
_agg("g07_path_where", "Order", "*", "Items.WHERE(l_quantity>30).l_returnflag AS k", "COUNT(*) AS n", "SELECT k, count(*) AS n FROM (SELECT DISTINCT o_orderkey, l_returnflag AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 30) GROUP BY 1")
_agg("g09_nested", "Customer", "*", "Nation.Region.r_name AS r,c_mktsegment AS s", "COUNT(*) AS n", "SELECT r_name AS r, c_mktsegment AS s, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
_agg("g09_upper_level", "Order", "*", "Items.l_returnflag AS a,Items.l_linestatus AS b", "COUNT(*) AS n", "SELECT a, count(*) AS n FROM (SELECT DISTINCT o_orderkey, l_returnflag AS a FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1", level=1)
_agg("g10_correlated", "Order", "*", "Items.l_returnflag AS a,Items.l_linestatus AS b", "COUNT(*) AS n", "SELECT a, b, count(*) AS n FROM (SELECT DISTINCT o_orderkey, l_returnflag AS a, l_linestatus AS b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1, 2")
_agg("g11_top", "Order", "*", "TOP(3,Customer.Nation.n_name) AS k", "SUM(o_custkey) AS s", "SELECT n_name AS k, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY 2 DESC, lower(n_name) LIMIT 3")
_agg("g12_first", "Order", "*", "LAST(2,o_orderpriority) AS k", "COUNT(*) AS n", "SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 2")
_agg("g13_flat", "Order", "*", "o_orderstatus AS a,o_orderpriority AS b", "SUM(o_custkey) AS s", "SELECT o_orderstatus AS a, o_orderpriority AS b, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 4", flat=4)
_agg("g14_batch", "Order", "*", "BATCH(o_totalprice,50000,100000,9000000) AS k", "COUNT(*) AS n", "SELECT k, count(o_orderkey) AS n FROM (VALUES ('< 50000', -1e18, 50000.0), ('50000 - 100000', 50000.0, 100000.0), ('100000 - 9000000', 100000.0, 9000000.0), ('>= 9000000', 9000000.0, 1e18)) v(k, a, b) LEFT JOIN orders ON o_totalprice >= a AND o_totalprice < b GROUP BY 1", empty=True)
_agg("g16_sets", "Order", "*", "SETS(o_totalprice>200000 AS big,o_orderstatus=F AS done,o_custkey<0 AS none) AS k", "COUNT(*) AS n", "SELECT 'big' AS k, count(*) AS n FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'done', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'none', 0 UNION ALL SELECT NULL, n FROM (SELECT count(*) AS n FROM orders WHERE NOT (o_totalprice > 200000 OR o_orderstatus = 'F')) WHERE n > 0", empty=True)
_agg("g17_truncate", "Event", "*", "TRUNCATE(ts,WEEK,GMT-5) AS k", "COUNT(*) AS n", "SELECT CAST(CAST(date_trunc('week', ts - INTERVAL 5 HOUR) AS TIMESTAMP) AS VARCHAR) AS k, count(*) AS n FROM events GROUP BY 1")
_agg("g19_month", "Order", "*", "o_orderdate.MONTH AS k", "COUNT(*) AS n", "SELECT monthname(o_orderdate) AS k, count(*) AS n FROM orders GROUP BY 1")
_agg("g20_terms", "Part", "*", "TERMS(p_name,(cold the)) AS k", "COUNT(*) AS n", "SELECT k, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS k FROM part) WHERE k NOT IN ('cold', 'the') GROUP BY 1")
_agg("g21_lower", "Order", "*", "LOWER(o_orderpriority) AS k", "COUNT(*) AS n", "SELECT lower(o_orderpriority) AS k, count(*) AS n FROM orders GROUP BY 1")
_agg("g22_exclude", "Order", "*", "o_orderpriority.EXCLUDE('*low',NULL) AS k", "COUNT(*) AS n", "SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderpriority NOT LIKE '%LOW' GROUP BY 1")
_agg("g24_sets_of_groups", "Order", "*", "GROUP(o_orderstatus AS k),GROUP(*)", "COUNT(*) AS n", "SELECT o_orderstatus AS k, count(*) AS n, 0 AS _set FROM orders GROUP BY 1 UNION ALL SELECT NULL, count(*), 1 FROM orders")
_add("g25_composite", lambda e: e.composite("Order", "*", "o_orderstatus,o_orderpriority AS k", "COUNT(*) AS n"), "SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1")
_agg("g28_cross_link", "Event", "*", "User.c_mktsegment AS k", "COUNT(*) AS n", "SELECT c_mktsegment AS k, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1")
_add("g31_log_counts", lambda e: logs.aggregate(e.tables["Event"], "event_type:err", "TRUNCATE(ts,DAY)", ts="ts").select(F.col("g1").cast("string").alias("g1"), "count"), "SELECT CAST(CAST(date_trunc('day', ts) AS TIMESTAMP) AS VARCHAR) AS g1, count(*) AS \"count\" FROM events WHERE event_type LIKE '%err%' GROUP BY 1")
_add("g31_log_sets", lambda e: logs.aggregate(e.tables["Event"], "*", "SETS(event_type=error AS e,ts.HOUR=3 AS three)", ts="ts"), "SELECT 'e' AS g1, count(*) AS \"count\" FROM events WHERE event_type = 'error' UNION ALL SELECT 'three', count(*) FROM events WHERE hour(ts) = 3")

# ---------------------------------------------------------------------------- projection, order, paging

_add("pr04_nested", lambda e: e.query("Customer", "c_acctbal>5000", "c_name,Nation(n_name),Orders(o_totalprice)", s=0).select("c_name", F.col("Nation")[0]["n_name"].alias("nation"), F.coalesce(F.size("Orders"), F.lit(0)).alias("orders"), F.round(F.array_max(F.transform("Orders", lambda o: o["o_totalprice"])), 4).alias("most")).withColumn("orders", F.greatest("orders", F.lit(0)).cast("long")), "SELECT c_name, any_value(n_name) AS nation, count(o_orderkey) AS orders, round(max(o_totalprice), 4) AS most FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 GROUP BY c_custkey, c_name")
_add("pr05_link_limit", lambda e: e.query("Order", "*", "Items[2](l_quantity)", s=0).select("_ID", F.greatest(F.coalesce(F.size("Items"), F.lit(0)), F.lit(0)).cast("long").alias("n")), "SELECT CAST(o_orderkey AS VARCHAR) AS \"_ID\", least(count(l_orderkey), 2) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
_add("pr06_link_where", lambda e: e.query("Order", "o_orderstatus=P", "Items.WHERE(l_quantity>20)(l_quantity) AS x", s=0).select("_ID", F.greatest(F.coalesce(F.size("x"), F.lit(0)), F.lit(0)).cast("long").alias("n")), "SELECT CAST(o_orderkey AS VARCHAR) AS \"_ID\", count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 20 WHERE o_orderstatus = 'P' GROUP BY o_orderkey")
_add("pr11_log_pattern", lambda e: logs.synthetic(e.tables["Event"], 'props={"k": {K}}').groupBy("K").agg(F.count(F.lit(1)).alias("n")), "SELECT regexp_extract(props, '\\{\"k\": (.*?)\\}', 1) AS \"K\", count(*) AS n FROM events GROUP BY 1")
_add("s01_order_page", lambda e: e.query("Order", "*", "o_totalprice", "Customer.Nation.n_name DESC,o_orderpriority", s=25, k=10).select("_ID", F.round("o_totalprice", 4).alias("o_totalprice")), "SELECT CAST(o_orderkey AS VARCHAR) AS \"_ID\", round(o_totalprice, 4) AS o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey ORDER BY lower(n_name) DESC, lower(o_orderpriority), CAST(o_orderkey AS VARCHAR) LIMIT 25 OFFSET 10")
_add("s07_continuation", lambda e: e.query("Order", "o_orderstatus=F", "o_custkey", g="500", s=30), "SELECT CAST(o_orderkey AS VARCHAR) AS \"_ID\", o_custkey FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderkey AS VARCHAR) > '500' ORDER BY 1 LIMIT 30")
_add("m17_row_metrics", lambda e: e.query("Order", "o_orderstatus=P", "o_custkey", m="COUNT(Items) AS n", s=0), "SELECT CAST(o_orderkey AS VARCHAR) AS \"_ID\", any_value(o_custkey) AS o_custkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey")
_add("s10_log_page", lambda e: logs.query(e.tables["Event"], "event_type=(error,click) AND ts>='2024-01-02'", ["event_id", "event_type"], "ts ASC", 40, ts="ts").select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'click') AND ts >= TIMESTAMP '2024-01-02' ORDER BY ts, event_id LIMIT 40")

# ---------------------------------------------------------------------------- ingest, shards


def _yearly(e) -> DataFrame:
    return e.tables["Order"].select(F.date_format("o_orderdate", "yyyy").alias("_shard"), F.col("o_custkey").cast("string").alias("_ID"), F.col("o_orderkey").alias("_order"), (F.col("o_orderstatus") == "P").alias("_deleted"), "o_totalprice", F.array("o_orderpriority").alias("p"))


def _merge(e) -> DataFrame:
    return shards.merged(_yearly(e)).select("_shard", "_ID", F.round("o_totalprice", 4).alias("o_totalprice"), F.array_join("p", ",").alias("p"))


_add("src04_merge", _merge, "WITH b AS (SELECT strftime(o_orderdate, '%Y') AS _shard, CAST(o_custkey AS VARCHAR) AS _ID, o_orderkey AS o, o_orderstatus = 'P' AS d, o_totalprice, o_orderpriority FROM orders), l AS (SELECT *, coalesce(max(CASE WHEN d THEN o END) OVER (PARTITION BY _shard, _ID), -1) AS last FROM b) SELECT _shard, _ID AS \"_ID\", round(arg_max(o_totalprice, o), 4) AS o_totalprice, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS p FROM l WHERE o > last AND NOT d GROUP BY 1, 2")
_add("src06_shard_stats", lambda e: shards.shard_stats(e.tables["Order"].withColumn("_shard", F.date_format("o_orderdate", "yyyy"))), "SELECT strftime(o_orderdate, '%Y') AS _shard, count(*) AS objects FROM orders GROUP BY 1")
_add("src09_duplicates", lambda e: shards.duplicates(_yearly(e)), "SELECT \"_ID\", array_to_string(list_sort(list(DISTINCT s)), ',') AS shards FROM (SELECT CAST(o_custkey AS VARCHAR) AS \"_ID\", strftime(o_orderdate, '%Y') AS s FROM orders) GROUP BY 1 HAVING count(DISTINCT s) > 1")
_add("src12_aging", lambda e: shards.aged(e.tables["Order"], "o_orderdate", "300 DAYS", e.clock).select("_ID"), _IDS + "o_orderdate > TIMESTAMP '1998-06-15 12:30:00' - INTERVAL 300 DAY")
_add("src13_update_where", lambda e: shards.update_where(e.tables["Order"], e.predicates.column(e.table("Order"), e.parser(e.table("Order"), "o_totalprice>300000").query()), {"o_orderstatus": "X"}).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
_add("u01_shard_union", lambda e: shards.latest(_yearly(e).groupBy("_shard", "_ID").agg(F.max("o_totalprice").alias("t"))).select("_shard", "_ID", F.round("t", 4).alias("t")), "SELECT max(s) AS _shard, i AS \"_ID\", round(arg_max(t, s), 4) AS t FROM (SELECT strftime(o_orderdate, '%Y') AS s, CAST(o_custkey AS VARCHAR) AS i, max(o_totalprice) AS t FROM orders GROUP BY 1, 2) GROUP BY 2")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a nation over a price: their top priorities by number, with mean prices."""
    return star.engine(spark, sf_dir).aggregate("Order", "Customer.Nation.n_name=NATION_3 AND o_totalprice>100000", "TOP(5,o_orderpriority) AS priority", "COUNT(*) AS n,AVERAGE(o_totalprice) AS mean")


def _with_statuses(e):
    """Customers with a multi-valued field: the statuses of their orders."""
    per = e.tables["Order"].groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("statuses"))
    e.tables["Customer"] = e.tables["Customer"].join(per, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    e.app.tables["Customer"].fields["statuses"] = Field("statuses", "TEXT", True)
    return e


def _customers(name: str, q: str, where: str) -> None:
    _add(name, lambda e: _with_statuses(e).select("Customer", q).select("_ID"), f'SELECT CAST(c_custkey AS VARCHAR) AS "_ID" FROM customer c WHERE {where}')


_HAS = "EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey{})"
_customers("p17_any_value", "ANY(statuses)=p", _HAS.format(" AND o_orderstatus = 'P'"))
_customers("p17_all_values", "ALL(statuses)=F", _HAS.format("") + " AND NOT " + _HAS.format(" AND o_orderstatus <> 'F'"))
_customers("p17_no_value", "NONE(statuses)=P", "NOT " + _HAS.format(" AND o_orderstatus = 'P'"))
_customers("p26_many_values", "COUNT(statuses)>=2", "(SELECT count(DISTINCT o_orderstatus) FROM orders o WHERE o.o_custkey = c.c_custkey) >= 2")
_add("g04_many_values", lambda e: _with_statuses(e).aggregate("Customer", "*", "statuses AS status", "COUNT(*) AS n"), "SELECT s AS status, count(*) AS n FROM (SELECT DISTINCT c_custkey, o_orderstatus AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey) GROUP BY 1")


def _with_group(e):
    """Orders with a group field and an alias."""
    e.app.tables["Order"].fields["Marks"] = Field("Marks", "GROUP", members=["o_orderstatus", "o_orderpriority"])
    e.app.tables["Order"].aliases["$dear"] = "o_totalprice>300000"
    return e


_add("p32_group_field", lambda e: _with_group(e).select("Order", "Marks:urgent").select("_ID"), _IDS + "o_orderpriority = '1-URGENT'")
_add("p33_alias", lambda e: _with_group(e).select("Order", "$dear AND o_orderstatus=F").select("_ID"), _IDS + "o_totalprice > 300000 AND o_orderstatus = 'F'")
_STATS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
_add("src06_statistics", lambda e: shards.field_statistics(e.tables["Order"].select("_ID", *_STATS)), " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS objects, count({c}) AS values, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM orders" for c in _STATS))
