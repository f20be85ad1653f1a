"""Clusters of events and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import saturation


def anchored(events: DataFrame, days: int = 30) -> DataFrame:
    """Adds cluster: number from 1 per (ticker, class). A cluster holds what is at most `days` after its first event; the next event opens
    a new one. Anchors are found on distinct days per key, then joined back, so a day with very many events is one entry."""
    dates = events.groupBy("ticker", "class").agg(F.array_sort(F.collect_set("d")).alias("ds"))
    start = F.expr("cast(array() as array<date>)")
    step = lambda acc, d: F.when((F.size(acc) > 0) & (F.datediff(d, F.try_element_at(acc, F.lit(-1))) <= days), acc).otherwise(F.concat(acc, F.array(d)))
    anchors = dates.withColumn("anchors", F.aggregate("ds", start, step)).select("ticker", "class", F.explode("ds").alias("d"), "anchors")
    place = F.filter("anchors", lambda a: a <= F.col("d"))
    placed = anchors.select("ticker", "class", "d", F.size(place).alias("cluster"), F.try_element_at(place, F.lit(-1)).alias("anchor"))
    return events.join(placed, ["ticker", "class", "d"])


def running(clustered: DataFrame) -> DataFrame:
    """Adds, up to each row only: persons so far, messages, amount, and whether the row opens its cluster."""
    w = W.partitionBy("ticker", "class", "cluster").orderBy("d", "minute", "msg_id").rowsBetween(W.unboundedPreceding, 0)
    first = F.row_number().over(W.partitionBy("ticker", "class", "cluster", "person").orderBy("d", "minute", "msg_id"))
    marked = clustered.withColumn("_new", (F.col("person").isNotNull() & (first == 1)).cast("long"))
    persons, messages = F.sum("_new").over(w), F.count(F.lit(1)).over(w)
    return marked.select(*clustered.columns, F.when(persons > 0, persons).otherwise(messages).alias("persons"), messages.alias("messages"), F.sum("amount").over(w).alias("amount_so_far"), (messages == 1).alias("is_primary"))


#: The weights of the parts, of a role by rank, and of what is unknown.
WEIGHTS = {"role": 0.30, "increase": 0.28, "amount": 0.17, "cluster": 0.25}
BONUS, SELL = 0.10, -0.75
ROLE_RANK = {1: 1.0, 2: 0.9, 3: 0.75, 4: 0.6, 5: 0.45, 6: 0.3}
UNKNOWN = {"role": 0.35, "increase": 0.35, "amount": 0.30}
LABELS = [(75, "very strong buy"), (60, "strong buy"), (45, "buy"), (30, "weak buy"), (-15, "neutral"), (-45, "sell")]


def scored(rows: DataFrame, half_increase: float = 20.0, half_amount: float = 250_000.0) -> DataFrame:
    """Adds score (0 .. 100 for buys, down to -75 for sells) and label from rank, increase, amount, persons, confidence and class."""
    role = F.coalesce(*[F.when(F.col("rank") == k, F.lit(v)) for k, v in ROLE_RANK.items()], F.lit(UNKNOWN["role"]))
    increase = F.coalesce(saturation(F.col("increase"), half_increase), F.lit(UNKNOWN["increase"]))
    money = F.coalesce(saturation(F.col("amount"), half_amount), F.lit(UNKNOWN["amount"]))
    cluster = F.least(F.lit(1.0), (F.col("persons") - 1) / 3.0)
    total = WEIGHTS["role"] * role + WEIGHTS["increase"] * increase + WEIGHTS["amount"] * money + WEIGHTS["cluster"] * cluster + F.when(F.col("persons") >= 3, BONUS).otherwise(0.0)
    score = 100 * F.least(F.lit(1.0), total) * F.col("confidence") * F.when(F.col("class") == "SELL", SELL).otherwise(1.0)
    score = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), score))
    label = F.lit("strong sell")
    for least, name in reversed(LABELS):
        label = F.when(F.col("score") >= least, name).otherwise(label)
    return rows.withColumn("score", score).withColumn("label", label)


def top(rows: DataFrame, n: int) -> DataFrame:
    """The n best by score, then date and id, with their rank: a bounded top-n, so no full sort in one task."""
    best = rows.orderBy(F.desc("score"), "d", "msg_id").limit(n)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "d", "msg_id")))


def frequencies(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n, share of each value of some columns."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*")
    counted = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("field")))


def reading_quality(rows: DataFrame, most_unknown: float = 0.25) -> DataFrame:
    """One row on read announcements (class, identity): events, buys, sells, share of unknown class, how many could be held against their holdings and the share that agreed,
    and status: FAILED without buys, OK with fewer than `most_unknown` unknown, else PARTIAL."""
    count = lambda c: F.count(F.when(c, 1))
    found = rows.agg(
        F.count(F.lit(1)).alias("events"), count(F.col("class") == "BUY").alias("buys"), count(F.col("class") == "SELL").alias("sells"), F.avg((F.coalesce("class", F.lit("UNKNOWN")) == "UNKNOWN").cast("double")).alias("unknown_share"),
        F.count("identity").alias("checked"), F.avg(F.col("identity").cast("double")).alias("identity_rate"),
    )
    return found.withColumn("status", F.when(F.col("buys") == 0, "FAILED").when(F.col("unknown_share") < most_unknown, "OK").otherwise("PARTIAL"))


#: name: condition under which an event is refused; the first that holds is its reason
REFUSED = {
    "no class": "class is null or class = 'UNKNOWN'",
    "not primary": "not is_primary",
    "low confidence": "confidence < 0.5",
    "small": "amount < 20000",
}


def eligible(rows: DataFrame, refused: dict[str, str] = REFUSED) -> tuple[DataFrame, DataFrame]:
    """The events that no rule refuses, and per reason (the first that holds) how many were. A missing amount does not refuse."""
    reason = F.coalesce(*[F.when(F.expr(rule), F.lit(name)) for name, rule in refused.items()])
    marked = rows.withColumn("reject_reason", reason)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
