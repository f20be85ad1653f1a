"""Trading calendar derived from prices, effective dates, and price series aligned to the calendar.

Windows without a key run over day-level rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLOSE_MINUTE = 980


def trading_days(prices: DataFrame, share: float = 0.2) -> DataFrame:
    """d, pos: days on which at least max(1, floor(share * alive)) tickers have a price; alive from first to last price."""
    lives = prices.groupBy("ticker").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    steps = lives.select(F.col("first").alias("d"), F.lit(1).alias("step")).unionByName(lives.select(F.date_add("last", 1).alias("d"), F.lit(-1).alias("step")))
    seen = prices.groupBy("d").agg(F.count_distinct("ticker").alias("n"))
    daily = seen.select("d", "n", F.lit(0).alias("step")).unionByName(steps.groupBy("d").agg(F.sum("step").cast("int").alias("step")).select("d", F.lit(0).alias("n"), "step"))
    daily = daily.groupBy("d").agg(F.sum("n").alias("n"), F.sum("step").alias("step"))
    alive = daily.withColumn("alive", F.sum("step").over(W.orderBy("d")))
    return alive.where(F.col("n") >= F.greatest(F.lit(1), F.floor(share * F.col("alive")))).select("d", (F.row_number().over(W.orderBy("d")) - 1).alias("pos"))


def shifted(calendar: DataFrame, n: int) -> DataFrame:
    """d, pos, shifted_d: the trading day n positions away, null beyond the calendar."""
    other = calendar.select((F.col("pos") - n).alias("pos"), F.col("d").alias("shifted_d"))
    return calendar.join(other, "pos", "left").select("d", "pos", "shifted_d")


def day_map(calendar: DataFrame, first, last) -> DataFrame:
    """For every date from first to last: pos of the trading day on it or next, and of the one strictly after."""
    days = calendar.sparkSession.sql(f"select explode(sequence(date'{first}', date'{last}')) as d")
    both = days.join(calendar, "d", "left").withColumnRenamed("pos", "own").unionByName(calendar.where(F.col("d") > F.lit(last).cast("date")).withColumnRenamed("pos", "own"))
    ahead = W.orderBy("d").rowsBetween(0, W.unboundedFollowing)
    after = W.orderBy("d").rowsBetween(1, W.unboundedFollowing)
    return both.select("d", F.first("own", ignorenulls=True).over(ahead).alias("on_or_next"), F.first("own", ignorenulls=True).over(after).alias("after"))


def effective(events: DataFrame, calendar: DataFrame, close_minute: int = CLOSE_MINUTE, most_days: int = 21) -> DataFrame:
    """Adds trade_d and pos0. Published before the close: that day if it trades, else the next that does; at or after the close, or at an
    unknown time: strictly the next. Null when that is more than `most_days` days away."""
    ends = events.agg(F.min("d").alias("a"), F.max("d").alias("z")).first()
    if ends["a"] is None:
        return events.withColumn("pos0", F.lit(None).cast("int")).withColumn("trade_d", F.lit(None).cast("date"))
    days = day_map(calendar, ends["a"], ends["z"])
    early = F.col("minute").isNotNull() & (F.col("minute") < close_minute)
    placed = events.join(days, "d", "left").withColumn("pos0", F.when(early, F.col("on_or_next")).otherwise(F.col("after"))).drop("on_or_next", "after")
    placed = placed.join(calendar.select(F.col("pos").alias("pos0"), F.col("d").alias("trade_d")), "pos0", "left")
    near = F.datediff("trade_d", "d") <= most_days
    return placed.withColumn("pos0", F.when(near, F.col("pos0"))).withColumn("trade_d", F.when(near, F.col("trade_d")))


def aligned(prices: DataFrame, calendar: DataFrame, most_gap: int = 5, field: str = "close") -> DataFrame:
    """ticker, pos, d, px, volume, own_pos, last_pos: each ticker's life on the calendar. A gap keeps the last price for at most
    `most_gap` positions, then px is null; own_pos is the position of the price used, last_pos the ticker's last price."""
    valid = prices.where((F.col(field) > 0) & (F.col(field) < float("inf"))).join(F.broadcast(calendar), "d").select("ticker", "pos", "d", F.col(field).alias("own"), "volume")
    lives = valid.groupBy("ticker").agg(F.min("pos").alias("a"), F.max("pos").alias("z"))
    grid = lives.select("ticker", F.col("z").alias("last_pos"), F.explode(F.sequence("a", "z")).alias("pos")).join(F.broadcast(calendar), "pos")
    before = W.partitionBy("ticker").orderBy("pos")
    filled = grid.join(valid.drop("d"), ["ticker", "pos"], "left").withColumn("own_pos", F.last(F.when(F.col("own").isNotNull(), F.col("pos")), ignorenulls=True).over(before))
    px = F.last("own", ignorenulls=True).over(before)
    return filled.select("ticker", "pos", "d", F.when(F.col("pos") - F.col("own_pos") <= most_gap, px).alias("px"), "volume", "own_pos", "last_pos", px.alias("last_px"))
