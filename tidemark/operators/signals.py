"""Signals: active candidates by day, target weights, returns of rebalanced portfolios, costs, trades, curve metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import stored
from .order import as_of, medians, with_facts


def active(signals: DataFrame, calendar: DataFrame, variants: DataFrame, prices: DataFrame) -> DataFrame:
    """variant, pos, d, ticker, strength, place: the k best signals alive on each day.

    A signal(pos0, d0, ticker, score) lives from its day for `days` calendar days (exclusive); its strength halves every `half_life` trading days and must reach `threshold`.
    It is exploded over the days it lives, an equi-join with the calendar instead of a range join; per ticker the strongest stands.
    variants(variant, days, half_life, threshold, k) is a small parameter table, so all variants run in one job.
    """
    lived = signals.crossJoin(F.broadcast(variants)).withColumn("day", F.explode(F.sequence(F.col("d0"), F.date_add("d0", F.col("days") - 1))))
    lived = lived.join(F.broadcast(calendar.select(F.col("d").alias("day"), "pos")), "day")
    strength = F.col("score") * F.when(F.col("half_life").isNull(), 1.0).otherwise(F.pow(F.lit(0.5), (F.col("pos") - F.col("pos0")) / F.col("half_life")))
    best = lived.where("pos >= pos0").withColumn("strength", strength).where("strength >= threshold").groupBy("variant", "pos", "day", "ticker", "k").agg(F.max("strength").alias("strength"))
    priced = best.join(prices.where("px is not null").select("ticker", "pos"), ["ticker", "pos"], "left_semi")
    place = F.row_number().over(W.partitionBy("variant", "pos").orderBy(F.desc("strength"), "ticker"))
    return priced.withColumn("place", place).where("place <= k").select("variant", "pos", F.col("day").alias("d"), "ticker", "strength", "place")


def decision_days(calendar: DataFrame, cadence: str) -> DataFrame:
    """Every day, or the first trading day of each ISO week or month."""
    if cadence == "day":
        return calendar
    return calendar.join(calendar.groupBy(F.date_trunc(cadence, "d")).agg(F.min("pos").alias("pos")).select("pos"), "pos", "left_semi")


def weights(candidates: DataFrame, least: int = 3, how: str = "equal", base: float = 50.0) -> DataFrame:
    """Adds w. Days with fewer than `least` names hold nothing. Equal, or by max(1, strength - base); at most 1 / least each, the rest is cash."""
    day = W.partitionBy("variant", "pos")
    raw = F.lit(1.0) if how == "equal" else F.greatest(F.lit(1.0), F.col("strength") - base)
    whole = candidates.withColumn("_n", F.count(F.lit(1)).over(day)).where(F.col("_n") >= least).withColumn("_raw", raw)
    return whole.withColumn("w", F.least(F.lit(1.0 / least), F.col("_raw") / F.sum("_raw").over(day))).drop("_n", "_raw")


def daily_returns(weighted: DataFrame, aligned: DataFrame, calendar: DataFrame) -> DataFrame:
    """variant, pos, d, g, value: growth with the weights of the day before, rebalanced daily; a held price that is lost counts -100 %.

    value is the chained product over days, so no day-by-day loop is needed.
    """
    ret = aligned.select("ticker", "pos", "px", F.lag("px").over(W.partitionBy("ticker").orderBy("pos")).alias("before"))
    held = weighted.select("variant", "ticker", (F.col("pos") + 1).alias("pos"), "w").join(ret, ["ticker", "pos"], "left")
    r = F.when(F.col("px").isNull(), -1.0).otherwise(F.try_divide(F.col("px"), F.col("before")) - 1)
    by_day = held.groupBy("variant", "pos").agg(F.sum(F.col("w") * r).alias("r"))
    grid = weighted.select("variant").distinct().crossJoin(F.broadcast(calendar))
    g = grid.join(by_day, ["variant", "pos"], "left").withColumn("g", 1 + F.coalesce("r", F.lit(0.0)))
    return g.select("variant", "pos", "d", "g", chained("g", W.partitionBy("variant").orderBy("pos")).alias("value"))


def chained(growth: str, window) -> Column:
    """Product so far of growth factors; 0 from the first factor that is not positive."""
    lost = F.max((F.col(growth) <= 0).cast("int")).over(window)
    return F.when(lost == 1, 0.0).otherwise(F.exp(F.sum(F.log(F.when(F.col(growth) > 0, F.col(growth)))).over(window)))


def turnover(weighted: DataFrame, aligned: DataFrame, rate: float) -> DataFrame:
    """variant, pos, turnover, cost: sum of |w - drifted w of the day before|, and rate times it. Going to or from cash counts."""
    ret = aligned.select("ticker", "pos", (F.col("px") / F.lag("px").over(W.partitionBy("ticker").orderBy("pos"))).alias("up"))
    before = weighted.select("variant", "ticker", (F.col("pos") + 1).alias("pos"), F.col("w").alias("w0")).join(ret, ["ticker", "pos"], "left").withColumn("grown", F.col("w0") * F.coalesce("up", F.lit(0.0)))
    total = before.groupBy("variant", "pos").agg((1 - F.sum("w0") + F.sum("grown")).alias("whole"))
    drift = before.join(total, ["variant", "pos"]).select("variant", "pos", "ticker", F.try_divide(F.col("grown"), F.col("whole")).alias("drift"))
    both = weighted.select("variant", "pos", "ticker", "w").join(drift, ["variant", "pos", "ticker"], "full_outer")
    moved = both.groupBy("variant", "pos").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("drift", F.lit(0.0)))).alias("turnover"))
    return moved.withColumn("cost", rate * F.col("turnover"))


def cohorts(signals: DataFrame, aligned: DataFrame, hold: int = 20) -> DataFrame:
    """pos, r: mean over live tranches of their mean daily return; each day's new signals form a tranche held `hold` positions.
    This states fixed holding as cohorts; it is not the path of a simulator with slots."""
    ret = aligned.select("ticker", "pos", (F.col("px") / F.lag("px").over(W.partitionBy("ticker").orderBy("pos")) - 1).alias("r"))
    held = signals.select("ticker", "pos0").distinct().select("ticker", "pos0", F.explode(F.sequence(F.col("pos0") + 1, F.col("pos0") + hold)).alias("pos"))
    tranche = held.join(ret, ["ticker", "pos"]).groupBy("pos0", "pos").agg(F.avg("r").alias("r"))
    return tranche.groupBy("pos").agg(F.avg("r").alias("r"), F.count(F.lit(1)).alias("tranches"))


def trades(weighted: DataFrame) -> DataFrame:
    """variant, pos, ticker, action, w0, w: changes from each held day to the next calendar position: BUY (new), ADD, TRIM, SELL (gone)."""
    now = weighted.select("variant", "pos", "ticker", "w")
    was = weighted.select("variant", (F.col("pos") + 1).alias("pos"), "ticker", F.col("w").alias("w0"))
    both = now.join(was, ["variant", "pos", "ticker"], "full_outer").select("variant", "pos", "ticker", F.coalesce("w0", F.lit(0.0)).alias("w0"), F.coalesce("w", F.lit(0.0)).alias("w"))
    action = F.when(F.col("w0") == 0, "BUY").when(F.col("w") == 0, "SELL").when(F.col("w") > F.col("w0"), "ADD").otherwise("TRIM")
    return both.where(F.abs(F.col("w") - F.col("w0")) > 1e-12).withColumn("action", action)


def cost_basis(lots: DataFrame, blocks: int | None = None) -> DataFrame:
    """key, shares, cost after a key's trades(key, seq, shares, price) in order: adds are weighted by shares, trims keep the cost, zero ends it (cost null).
    Trades of equal seq are taken by shares, then price. Rows without shares or price are left out.

    The value held, shares times cost, changes by an affine map at each trade: an add adds its money, a trim scales by what stays. Maps compose, so trades
    are cut into blocks of their order (key, seq), as many as `blocks` (the session's shuffle partitions if not given); a block folds its own trades to one map, given the
    shares that earlier blocks leave, and blocks' maps are put together. A key with most of the trades is many blocks.
    """
    n = blocks or int(lots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lots.where("shares is not null and price is not null").select("key", "seq", F.col("shares").cast("double"), F.col("price").cast("double")).repartitionByRange(n, "key", "seq").withColumn("_block", F.spark_partition_id())
    each = stored(dealt.groupBy("key", "_block").agg(F.sum("shares").alias("_sum"), F.array_sort(F.collect_list(F.struct("seq", "shares", "price"))).alias("_t")), "lots")
    order = W.partitionBy("key").orderBy("_block")
    before = each.select("key", "_block", F.coalesce(F.sum("_sum").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_s"))
    start = F.struct(F.col("_s").alias("s"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    none = lambda x: F.abs(x) < 1e-9

    def step(acc: Column, x: Column) -> Column:
        after = acc["s"] + x["shares"]
        stays = F.when(none(acc["s"]), 0.0).otherwise(after / acc["s"])
        a = F.when(none(after), 0.0).when(x["shares"] > 0, acc["a"]).otherwise(acc["a"] * stays)
        b = F.when(none(after), 0.0).when(x["shares"] > 0, acc["b"] + x["shares"] * x["price"]).otherwise(acc["b"] * stays)
        return F.struct(after.alias("s"), a.alias("a"), b.alias("b"))

    maps = each.join(before, ["key", "_block"]).select("key", "_block", F.aggregate("_t", start, step).alias("_m"))
    put = maps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_block", "_m"))).alias("_maps"))  # one small struct a block
    value = F.aggregate("_maps", F.lit(0.0), lambda v, m: m["_m"]["a"] * v + m["_m"]["b"])
    shares = F.element_at("_maps", -1)["_m"]["s"]
    return put.select("key", shares.alias("shares"), value.alias("_v")).select("key", "shares", F.when(~none(F.col("shares")), F.col("_v") / F.col("shares")).alias("cost"))


def variant_comparison(weighted: DataFrame, aligned: DataFrame, calendar: DataFrame, rates: DataFrame) -> DataFrame:
    """key (variant/scenario) and the metrics of each variant's curve under each scenario's costs. rates(scenario, rate): cost of a whole turn, by side;
    a few rows, which go to all tasks. Days of a curve are cut from the same returns and turnovers for all scenarios."""
    moved = turnover(weighted, aligned, 1.0).select("variant", "pos", "turnover")
    daily = daily_returns(weighted, aligned, calendar).join(moved, ["variant", "pos"], "left").crossJoin(F.broadcast(rates))
    net = daily.withColumn("net", F.col("g") * (1 - F.col("rate") * F.coalesce("turnover", F.lit(0.0)))).withColumn("key", F.concat_ws("/", "variant", "scenario"))
    return curve_metrics(net.withColumn("value", chained("net", W.partitionBy("key").orderBy("pos"))), "key")


def end_holdings(weighted: DataFrame, calendar: DataFrame) -> DataFrame:
    """Weights on the last calendar day, with the cash that is left as a row of its own."""
    last = weighted.join(F.broadcast(calendar.agg(F.max("pos").alias("pos"))), "pos").select("variant", "ticker", "w")
    cash = weighted.select("variant").distinct().join(last.groupBy("variant").agg(F.sum("w").alias("s")), "variant", "left").select("variant", F.lit("CASH").alias("ticker"), (1 - F.coalesce("s", F.lit(0.0))).alias("w"))
    return last.unionByName(cash)


def exposure(weighted: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per variant: days in the market, mean invested share, mean and median names, largest weight, cash days."""
    days = calendar.count()
    by_day = weighted.groupBy("variant", "pos").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("names"), F.max("w").alias("most"))
    out = by_day.groupBy("variant").agg(F.count(F.lit(1)).alias("days_in"), (F.sum("s") / days).alias("invested"), F.avg("names").alias("mean_names"), F.max("most").alias("largest"))
    out = with_facts(out, medians(by_day, ["variant"], "names", "median_names"), ["variant"], "left")
    return out.withColumn("cash_days", F.lit(days) - F.col("days_in"))


def curve_metrics(curve: DataFrame, key: str = "variant", per_year: float = 252.0, risk_free: float = 0.0, value: str = "value", at: str = "d") -> DataFrame:
    """Per key with 3 points or more: points, cagr, volatility, sharpe, sortino, drawdown, up."""
    w = W.partitionBy(key).orderBy(at)
    steps = curve.withColumn("_r", F.col(value) / F.lag(value).over(w) - 1).withColumn("_dd", F.col(value) / F.max(value).over(w) - 1)
    rf = risk_free / per_year
    down = F.sqrt(F.avg(F.pow(F.least(F.col("_r") - rf, F.lit(0.0)), 2)))
    n = F.count(F.lit(1))
    out = steps.groupBy(key).agg(n.alias("points"), (F.pow(F.max_by(value, at) / F.min_by(value, at), per_year / (n - 1)) - 1).alias("cagr"), (F.stddev_samp("_r") * per_year**0.5).alias("volatility"), F.try_divide((F.avg("_r") - rf) * per_year**0.5, F.stddev_samp("_r")).alias("sharpe"), F.try_divide((F.avg("_r") - rf) * per_year**0.5, down).alias("sortino"), F.min("_dd").alias("drawdown"), F.avg((F.col("_r") > 0).cast("double")).alias("up"))
    return out.where("points >= 3")


def risk_metrics(curve: DataFrame, key: str = "variant", per_year: float = 252.0, risk_free: float = 0.0, value: str = "value", at: str = "d", least_years: float = 2.0) -> DataFrame:
    """Per key: curve_metrics with the ratio (cagr - risk_free) / volatility, calmar (cagr by depth of the drawdown), downside (yearly
    deviation of the returns below the daily risk-free rate), and short: whether the curve spans less than `least_years`."""
    base = curve_metrics(curve, key, per_year, risk_free, value, at)
    steps = curve.withColumn("_r", F.col(value) / F.lag(value).over(W.partitionBy(key).orderBy(at)) - 1)
    low = steps.groupBy(key).agg((F.sqrt(F.avg(F.pow(F.least(F.col("_r") - risk_free / per_year, F.lit(0.0)), 2))) * per_year**0.5).alias("downside"), (F.datediff(F.max(at), F.min(at)) < 365.25 * least_years).alias("short"))
    ratio, calmar = F.try_divide(F.col("cagr") - risk_free, F.col("volatility")), F.when(F.col("drawdown") < 0, F.col("cagr") / -F.col("drawdown"))
    return base.join(low, key).select(key, "cagr", "volatility", ratio.alias("ratio"), calmar.alias("calmar"), "downside", "drawdown", "short")


def filtered(signals: DataFrame, series: DataFrame, momentum: float | None = None, reversal: tuple[float, float] | None = None, lift: float | None = None) -> DataFrame:
    """The signals(ticker, pos0, ..) that pass each filter that is given, by what was known on the day before.

    series: ticker, pos, long and short trailing returns, lift. momentum: long return at least this; reversal: long return at most the first and
    short return at least the second; lift: volume lift at least this. A signal whose measure is not known does not pass."""
    known = series.select("ticker", (F.col("pos") + 1).alias("pos0"), "long", "short", "lift")
    out = signals.join(known, ["ticker", "pos0"], "left")
    for bound, passes in ((momentum, lambda b: F.col("long") >= b), (reversal, lambda b: (F.col("long") <= b[0]) & (F.col("short") >= b[1])), (lift, lambda b: F.col("lift") >= b)):
        if bound is not None:
            out = out.where(F.coalesce(passes(bound), F.lit(False)))
    return out.select(*signals.columns)


def chosen_slice(tables: dict[str, DataFrame], choice: DataFrame, variant: str = "variant", cash: tuple[str, ...] = ("CASH",)) -> dict[str, DataFrame]:
    """Of every result table the chosen variant's rows, without the variant; of `holdings` without the cash rows; from `curve` also `period`: first_d, last_d and
    points. choice has one row; the tables are filtered, not shuffled."""
    one = F.broadcast(choice.select(F.col(variant)).distinct().limit(1))
    found = {name: table.join(one, variant, "left_semi").drop(variant) for name, table in tables.items()}
    if "holdings" in found:
        found["holdings"] = found["holdings"].where(~F.col("ticker").isin(*cash))
    if "curve" in found:
        found["period"] = found["curve"].agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count(F.lit(1)).alias("points"))
    return found


def annual_return(curve: DataFrame, key: str, value: str, floor_days: int = 0) -> DataFrame:
    """Calendar-day growth a year (365.25 days); null below the floor of days."""
    days = F.datediff(F.max("d"), F.min("d"))
    return curve.groupBy(key).agg(days.alias("days"), F.when((days > 0) & (days >= floor_days), F.pow(F.max_by(value, "d") / F.min_by(value, "d"), 365.25 / days) - 1).alias("cagr"))


def rebased(index: DataFrame, start: float) -> DataFrame:
    return index.select("d", (start * F.col("level") / F.first("level", ignorenulls=True).over(W.orderBy("d"))).alias("value"))


def halves(curve: DataFrame, key: str, split) -> DataFrame:
    """Each point with the parts it belongs to: train, test, first and second half of train; boundary points belong to both sides."""
    w = W.partitionBy(key).orderBy("d")
    train = F.col("d") <= F.lit(split).cast("date")
    marked = curve.withColumn("_train", train).withColumn("_n", F.row_number().over(W.partitionBy(key, train).orderBy("d"))).withColumn("_c", F.count(F.lit(1)).over(W.partitionBy(key, train)))
    marked = marked.withColumn("_last", F.col("_train") & F.lead("_train").over(w).eqNullSafe(F.lit(False)))
    mid = F.floor((F.col("_c") + 1) / 2)
    parts = F.array_compact(F.array(F.when(F.col("_train"), "train"), F.when(~F.col("_train") | F.col("_last"), "test"), F.when(F.col("_train") & (F.col("_n") <= mid), "half1"), F.when(F.col("_train") & (F.col("_n") >= mid), "half2")))
    return marked.withColumn("part", F.explode(parts)).drop("_train", "_n", "_c", "_last")


def entries(trades: DataFrame) -> DataFrame:
    """variant, entries, tickers: a buy counts when the ticker is not held already; adds and trims do not."""
    acts = trades.where("action in ('BUY', 'SELL')").withColumn("_last", F.lag("action").over(W.partitionBy("variant", "ticker").orderBy("pos")))
    return acts.where("action = 'BUY' and (_last is null or _last = 'SELL')").groupBy("variant").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("ticker").alias("tickers"))


def with_source(candidates: DataFrame, announcements: DataFrame) -> DataFrame:
    """candidates (ticker, d) with the latest announcement (ticker, trade_d, msg_id and facts) of their ticker at or before the day, and its age in days. Of
    several on a day the last id counts."""
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    facts = [c for c in announcements.columns if c not in ("ticker", "trade_d")]
    last = announcements.where("trade_d is not null").groupBy("ticker", "trade_d").agg(F.max_by(F.struct(*facts), "msg_id").alias("_a"))
    found = as_of(candidates.withColumn("_day", number(F.col("d"))), last.withColumn("_told", number(F.col("trade_d"))), "ticker", "_day", "_told", ["_a", "trade_d"])
    return found.select(*candidates.columns, *[F.col(f"_a.{c}").alias(c) for c in facts], "trade_d", (F.col("_day") - F.col("_told")).alias("age"))
