"""Events against prices: status, horizon returns, liquidity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .calendar import CLOSE_MINUTE, effective
from .order import as_of, with_facts

HORIZONS = (-20, -5, -1, 1, 5, 10, 20, 60, 120)


def traded(prices: DataFrame, calendar: DataFrame, field: str = "close") -> DataFrame:
    """ticker, own_pos, px: the usable prices and their places on the calendar."""
    usable = (F.col(field) > 0) & (F.col(field) < float("inf"))
    return prices.where(usable).join(F.broadcast(calendar), "d").select("ticker", F.col("pos").alias("own_pos"), F.col(field).alias("px"))


def priced(rows: DataFrame, series: DataFrame, at: str, most_gap: int = 5) -> DataFrame:
    """rows (ticker, last_pos and place `at`) with own_pos and px: the latest price at or before the place, at most `most_gap` positions old, null
    after the ticker's last. Attached as of the place: no grid of tickers and days."""
    found = as_of(rows, series, "ticker", at, "own_pos", ["px"])
    lives = (F.col(at) <= F.col("last_pos")) & (F.col(at) - F.col("own_pos") <= most_gap)
    return found.withColumn("px", F.when(lives, F.col("px")))


def merged(events: DataFrame, prices: DataFrame, calendar: DataFrame, field: str = "close") -> DataFrame:
    """Every event with its day 0, price there, and status; the first that applies: NO_TICKER, UNKNOWN_TICKER, OUTSIDE (no
    trading day near), DELISTED, NO_PRICE, TOO_NEW (no later day), OK. field: the price basis (close, or adjclose for total return).

    All of it follows from the ticker, the date and whether that was before the close: it is worked out once for each of these and joined to the events."""
    early = F.coalesce(F.col("minute") < CLOSE_MINUTE, F.lit(False))
    marked = events.withColumn("_early", early)
    slots = stored(marked.select("ticker", "d", "_early").distinct().withColumn("minute", F.when(F.col("_early"), 0)), "slots")
    series = traded(prices, calendar, field)
    known = prices.select(F.col("ticker").alias("_t")).distinct()
    lives = series.groupBy(F.col("ticker").alias("_l")).agg(F.max("own_pos").alias("last_pos"))
    end = calendar.agg(F.max("pos").alias("end"))
    placed = effective(slots, calendar).join(known, F.col("ticker") == F.col("_t"), "left").join(lives, F.col("ticker") == F.col("_l"), "left").crossJoin(F.broadcast(end))
    placed = priced(placed, series, "pos0").withColumnRenamed("px", "px0")
    status = (
        F.when(F.col("ticker").isNull(), "NO_TICKER").when(F.col("_t").isNull(), "UNKNOWN_TICKER").when(F.col("pos0").isNull(), "OUTSIDE")
        .when(F.col("pos0") > F.col("last_pos"), "DELISTED").when(F.col("px0").isNull(), "NO_PRICE").when(F.col("pos0") >= F.col("end"), "TOO_NEW").otherwise("OK")
    )
    facts = stored(placed.select("ticker", "d", "_early", "pos0", "trade_d", "last_pos", "px0", status.alias("status")), "slots")
    return with_facts(marked, facts, ["ticker", "d", "_early"], "left").drop("_early")


#: places of which the returns are sent to all tasks; more of them meet the events in a shuffle
MOST_SENT = 200_000


def horizon_returns(placed: DataFrame, prices: DataFrame, calendar: DataFrame, index: DataFrame, horizons: tuple[int, ...] = HORIZONS, field: str = "close", kept: tuple[str, ...] = ("msg_id",)) -> DataFrame:
    """The kept columns, h, ret, reference, excess, delisted for the events that are OK. After a ticker's last day its last price stands, if
    that lies after day 0; such rows are marked, not dropped. field: the price basis of stocks; `index` is to be of the same.

    Returns are worked out once for each ticker and day 0 and joined to the events of that place; only then a row becomes one for each horizon."""
    ok, place = placed.where("status = 'OK'"), ["ticker", "pos0", "px0"]
    places = stored(ok.select(*place, "last_pos").distinct(), "places")
    wanted = places.withColumn("h", F.explode(F.array(*map(F.lit, horizons))))
    wanted = wanted.withColumn("target", F.col("pos0") + F.col("h")).withColumn("delisted", (F.col("target") > F.col("last_pos")) & (F.col("last_pos") > F.col("pos0")))
    end = calendar.agg(F.max("pos").alias("end"))
    wanted = wanted.crossJoin(F.broadcast(end)).where("target >= 0 and target <= end").drop("end")
    wanted = wanted.withColumn("pos", F.when(F.col("delisted"), F.col("last_pos")).otherwise(F.col("target")))
    level = index.join(calendar, "d").select("pos", "level")
    found = priced(wanted, traded(prices, calendar, field), "pos").where("px is not null")
    found = found.join(F.broadcast(level.select(F.col("pos").alias("target"), F.col("level").alias("level_h"))), "target", "left")
    found = found.join(F.broadcast(level.select(F.col("pos").alias("pos0"), F.col("level").alias("level_0"))), "pos0", "left")
    ret, reference = F.try_divide(F.col("px"), F.col("px0")) - 1, F.try_divide(F.col("level_h"), F.col("level_0")) - 1
    each = stored(found.groupBy(*place).agg(F.collect_list(F.struct("h", ret.alias("ret"), reference.alias("reference"), "delisted")).alias("_at")), "horizons")
    each = F.broadcast(each) if places.count() <= MOST_SENT else each
    rows = ok.select(*dict.fromkeys([*kept, *place])).join(each, place).select(*kept, F.explode("_at").alias("_at"))
    return rows.select(*kept, "_at.h", "_at.ret", "_at.reference", (F.col("_at.ret") - F.col("_at.reference")).alias("excess"), "_at.delisted")


def liquidity(placed: DataFrame, turnover: DataFrame, half: float = 0.1) -> DataFrame:
    """Adds turnover before day 0, size = amount / turnover and adjusted = score * (0.75 .. 1.25 by size); null without turnover."""
    prior = turnover.select(F.col("ticker").alias("_t"), F.col("d").alias("trade_d"), "turnover")
    size = F.try_divide(F.col("amount"), F.col("turnover"))
    strength = F.try_divide(size, size + half)
    return placed.join(prior, (F.col("ticker") == F.col("_t")) & placed["trade_d"].eqNullSafe(prior["trade_d"]), "left").drop("_t").drop(prior["trade_d"]).withColumn("size", size).withColumn("adjusted", F.col("score") * (0.75 + 0.5 * strength))


def latest_by_ticker(placed: DataFrame, at: str = "trade_d") -> DataFrame:
    """ticker, msg_id, `at` of each ticker's latest announcement that has a day; of one day the greatest msg_id. Kept per partition before the shuffle."""
    last = F.max(F.struct(at, "msg_id")).alias("_last")
    return placed.where(F.col(at).isNotNull() & F.col("ticker").isNotNull()).groupBy("ticker").agg(last).select("ticker", F.col("_last.msg_id").alias("msg_id"), F.col(f"_last.{at}").alias(at))
