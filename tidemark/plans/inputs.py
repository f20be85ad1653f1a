"""Inputs of the event operators derived from the driver's tables, in Spark and as SQL for the same rows.

A ticker is a supplier's or customer's nation, a price 100 plus a thousandth of the mean unit price of a nation's line items of a ship date, an event an
order, a person its customer, a score the value of an event row, a sleeve an order priority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return sold.groupBy(F.col("s_nationkey").cast("string").alias("ticker"), F.col("l_shipdate").cast("date").alias("d")).agg((100 + F.sum("l_extendedprice") / F.sum("l_quantity") / 1000).alias("close"), F.sum("l_quantity").alias("volume"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.when(F.col("o_orderstatus") == "O", "BUY").when(F.col("o_orderstatus") == "F", "SELL").otherwise("UNKNOWN")
    return o.select(
        F.col("o_orderkey").cast("string").alias("msg_id"), F.col("o_orderdate").cast("date").alias("d"), (F.col("o_orderkey") % 1440).cast("int").alias("minute"), F.col("c_nationkey").cast("string").alias("ticker"),
        F.col("o_custkey").cast("string").alias("person"), kind.alias("class"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"), F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderkey") % 7 == 0, None).otherwise((F.col("o_orderkey") % 50).cast("double")).alias("increase"), F.when(F.col("o_orderkey") % 11 == 0, 0.4).otherwise(0.9).alias("confidence"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("date").alias("d"), F.col("user_id").cast("string").alias("ticker"), F.col("value").alias("raw"))


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order priority a curve: 100 chained by 1 + (daily revenue / mean revenue - 1) / 50."""
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("sleeve"), F.col("o_orderdate").cast("date").alias("d")).agg(F.sum("o_totalprice").alias("revenue"))
    step = 1 + (F.col("revenue") / F.avg("revenue").over(W.partitionBy("sleeve")) - 1) / 50
    return daily.withColumn("step", step).select("sleeve", "d", (100 * F.exp(F.sum(F.log("step")).over(W.partitionBy("sleeve").orderBy("d")))).alias("nav"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "A", "BUY").when(F.col("l_returnflag") == "R", "SELL").otherwise("HOLD")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("ticker"), F.col("l_shipdate").cast("date").alias("d"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), side.alias("side"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("shares"))


PRICES = """prices AS (SELECT CAST(s_nationkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS d, 100 + sum(l_extendedprice) / sum(l_quantity) / 1000 AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
EVENTS = """ev AS (SELECT CAST(o_orderkey AS VARCHAR) AS msg_id, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 1440 AS INT) AS minute, CAST(c_nationkey AS VARCHAR) AS ticker, CAST(o_custkey AS VARCHAR) AS person,
  CASE o_orderstatus WHEN 'O' THEN 'BUY' WHEN 'F' THEN 'SELL' ELSE 'UNKNOWN' END AS class, CAST(substr(o_orderpriority, 1, 1) AS INT) AS rank, o_totalprice AS amount,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS DOUBLE) END AS increase, CASE WHEN o_orderkey % 11 = 0 THEN 0.4 ELSE 0.9 END AS confidence
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
SCORES = "scores AS (SELECT event_type AS source, CAST(ts AS DATE) AS d, CAST(user_id AS VARCHAR) AS ticker, value AS raw FROM events)"
NAV = """daily AS (SELECT o_orderpriority AS sleeve, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS revenue FROM orders GROUP BY 1, 2),
steps AS (SELECT sleeve, d, 1 + (revenue / avg(revenue) OVER (PARTITION BY sleeve) - 1) / 50 AS step FROM daily),
nav AS (SELECT sleeve, d, 100 * exp(sum(ln(step)) OVER (PARTITION BY sleeve ORDER BY d)) AS nav FROM steps)"""
TRADES = """trades AS (SELECT CAST(l_partkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS d, l_orderkey * 10 + l_linenumber AS seq,
  CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'R' THEN 'SELL' ELSE 'HOLD' END AS side, l_extendedprice AS price, l_quantity AS shares FROM lineitem)"""
CALENDAR = """lives AS (SELECT ticker, min(d) AS a, max(d) AS z FROM prices GROUP BY 1),
seen AS (SELECT d, count(DISTINCT ticker) AS n FROM prices GROUP BY 1),
cal AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos FROM (SELECT d, n, (SELECT count(*) FROM lives WHERE seen.d BETWEEN a AND z) AS alive FROM seen) WHERE n >= greatest(1, floor(0.2 * alive)))"""
ALIGNED = """valid AS (SELECT ticker, pos, cal.d, close, volume FROM prices JOIN cal ON prices.d = cal.d WHERE close > 0),
ends AS (SELECT ticker, min(pos) AS a, max(pos) AS z FROM valid GROUP BY 1),
grid AS (SELECT ticker, pos, d, z AS last_pos FROM ends JOIN cal ON pos BETWEEN a AND z),
aligned AS (SELECT g.ticker, g.pos, g.d, CASE WHEN g.pos - v.pos <= 5 THEN v.close END AS px, v.pos AS own_pos, g.last_pos FROM grid g ASOF JOIN valid v ON g.ticker = v.ticker AND g.pos >= v.pos)"""
PLACED = """near AS (SELECT ev.*, (SELECT min(pos) FROM cal WHERE cal.d >= ev.d) AS p_same, (SELECT min(pos) FROM cal WHERE cal.d > ev.d) AS p_after FROM ev),
placed AS (SELECT n.* EXCLUDE (p_same, p_after), CASE WHEN date_diff('day', n.d, c.d) <= 21 THEN c.pos END AS pos0, CASE WHEN date_diff('day', n.d, c.d) <= 21 THEN c.d END AS trade_d
  FROM near n LEFT JOIN cal c ON c.pos = CASE WHEN n.minute < 980 THEN n.p_same ELSE n.p_after END)"""
STATUS = """merged AS (SELECT p.*, e.z AS last_pos, a.px AS px0, CASE WHEN p.ticker IS NULL THEN 'NO_TICKER' WHEN l.ticker IS NULL THEN 'UNKNOWN_TICKER' WHEN p.pos0 IS NULL THEN 'OUTSIDE'
  WHEN p.pos0 > e.z THEN 'DELISTED' WHEN a.px IS NULL THEN 'NO_PRICE' WHEN p.pos0 >= (SELECT max(pos) FROM cal) THEN 'TOO_NEW' ELSE 'OK' END AS status
  FROM placed p LEFT JOIN lives l ON l.ticker = p.ticker LEFT JOIN ends e ON e.ticker = p.ticker LEFT JOIN aligned a ON a.ticker = p.ticker AND a.pos = p.pos0)"""
INDEX = """daily_ret AS (SELECT ticker, d, close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS ret FROM prices),
idx AS (SELECT d, 100 * exp(sum(ln(1 + r)) OVER (ORDER BY d)) AS level FROM (SELECT d, avg(ret) AS r FROM daily_ret WHERE ret IS NOT NULL GROUP BY 1))"""
RETURNS = """level AS (SELECT pos, level FROM idx JOIN cal ON idx.d = cal.d),
wanted AS (SELECT msg_id, ticker, class, trade_d, pos0, px0, last_pos, h, pos0 + h AS target, (pos0 + h > last_pos AND last_pos > pos0) AS delisted FROM merged, (SELECT unnest([-20, -5, -1, 1, 5, 10, 20, 60, 120]) AS h) WHERE status = 'OK'),
rets AS (SELECT w.msg_id, w.ticker, w.class, w.trade_d, w.h, a.px / w.px0 - 1 AS ret, lh.level / l0.level - 1 AS reference, (a.px / w.px0 - 1) - (lh.level / l0.level - 1) AS excess, w.delisted
  FROM wanted w JOIN aligned a ON a.ticker = w.ticker AND a.pos = CASE WHEN w.delisted THEN w.last_pos ELSE w.target END LEFT JOIN level lh ON lh.pos = w.target LEFT JOIN level l0 ON l0.pos = w.pos0
  WHERE a.px IS NOT NULL AND w.target >= 0 AND w.target <= (SELECT max(pos) FROM cal))"""


def sql(*parts: str) -> str:
    """WITH parts but the last, then the last."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
