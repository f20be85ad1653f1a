"""Incremental loads: watermark tables, overlapping reads, and the streaming forms of upsert, clusters and boilerplate counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import fingerprint


def advanced(marks: DataFrame, loads: DataFrame) -> DataFrame:
    """marks(grp, key, complete_to, last_error) after loads(grp, key, loaded_to, error): a mark moves only on success and never back; an
    error is recorded without moving it, a success clears it."""
    now = loads.groupBy("grp", "key").agg(F.max(F.when(F.col("error").isNull(), F.col("loaded_to"))).alias("_to"), F.max("error").alias("_error"), F.max(F.col("error").isNull()).alias("_ok"))
    both = marks.join(now, ["grp", "key"], "full_outer")
    return both.select("grp", "key", F.greatest("complete_to", "_to").alias("complete_to"), F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("_ok"), None).otherwise(F.col("last_error")).alias("last_error"))


def next_reads(keys: DataFrame, marks: DataFrame, stored: DataFrame, oldest, overlap: int = 10) -> DataFrame:
    """grp, key, read_from: the mark less the overlap, or the oldest date where there is no mark or stored rows do not reach back to it."""
    back = stored.groupBy("key").agg(F.min("d").alias("_min"))
    found = keys.join(marks, ["grp", "key"], "left").join(back, "key", "left")
    start = F.lit(oldest).cast("date")
    return found.select("grp", "key", F.when(F.col("complete_to").isNull() | F.col("_min").isNull() | (F.col("_min") > start), start).otherwise(F.greatest(start, F.date_sub("complete_to", overlap))).alias("read_from"))


def mark_summary(marks: DataFrame) -> DataFrame:
    return marks.groupBy("grp").agg(F.count(F.lit(1)).alias("keys"), F.count("complete_to").alias("complete"), F.min("complete_to").alias("oldest"), F.max("complete_to").alias("newest"), F.count("last_error").alias("errors"))


def corrections(stream: DataFrame, key: str, content: str, ts: str = "ts", late: str = "10 days") -> DataFrame:
    """A stream's new versions: repeats of the same content of a key are dropped within the overlap, corrections pass."""
    hashed = stream.withColumn("content_hash", fingerprint(F.col(content), 40)).withWatermark(ts, late)
    return hashed.dropDuplicatesWithinWatermark([key, "content_hash"])


def upsert_batches(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str], ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the newest row of each key over what is stored and the batch, rewritten. Running a batch again changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        every = read().unionByName(batch)
        newest = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), ts).alias("_v"))
        write(newest.select(*keys, "_v.*"))

    return each


def upsert_partitions(path: str, keys: list[str], partition: str, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a table partitioned by `partition` (a column that follows from the keys) in which each key has its newest row.

    A batch reads and rewrites the partitions it touches, no others. Its result is first written whole to a folder of the batch, then takes the place of these
    partitions. A batch that runs again finds that folder and puts it in place once more, so a run that broke off between the two, or after, is
    repaired and none is counted twice. Of equal times the later batch wins. An empty batch changes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark, columns = batch.sparkSession, [*batch.columns, "_batch"]
        staged = f"{path}.staged/{number}"
        if not _there(spark, f"{staged}/_SUCCESS"):
            new = batch.withColumn("_batch", F.lit(number).cast("long"))
            touched = new.select(partition).distinct()
            if _there(spark, path):
                old = spark.read.schema(new.schema).parquet(path).join(F.broadcast(touched), partition, "left_semi")
                new = old.select(*columns).unionByName(new.select(*columns))
            rest = [c for c in columns if c not in keys]
            newest = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, "_batch")).alias("_v")).select(*keys, "_v.*")
            newest.select(*columns).write.mode("overwrite").parquet(staged)
        found = spark.read.schema(batch.withColumn("_batch", F.lit(0).cast("long")).schema).parquet(staged)
        if not found.isEmpty():
            found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

    return each


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


class AnchoredClusters(StatefulProcessor):
    """Running clusters per (ticker, class) in event time: a cluster holds what is at most `days` after its first event.

    Input are the times that the watermark has just passed, each with the number and the ids of its events, so nothing waits here: a key's times are put in order and numbered on from
    the state. ids are one text that is passed on as it is. A timer removes a key's state once the cluster's days are over.
    """

    def __init__(self, days: int = 30) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cluster = handle.getValueState("cluster", "anchor long, n long")

    def _over(self, anchor: int) -> int:
        return anchor + self.days * 86_400_000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        due = pd.concat(rows).sort_values(["at", "d"])
        anchor, n = self.cluster.get() if self.cluster.exists() else (None, 0)
        anchors, before = [], []
        for at, count in zip(due["at"].tolist(), due["n"].tolist(), strict=True):
            if anchor is None or at - anchor >= self._over(0):
                anchor, n = at, 0
            anchors.append(pd.Timestamp(anchor, unit="ms").date())
            before.append(n)
            n += count
        if now > self._over(anchor):
            self.cluster.clear()
        else:
            self.cluster.update((anchor, n))
            self.handle.registerTimer(max(self._over(anchor), now) + 1)
        yield pd.DataFrame({"ticker": key[0], "class": key[1], "d": due["d"].tolist(), "anchor": anchors, "before": before, "ids": due["ids"].tolist()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.cluster.exists() and timerValues.getCurrentWatermarkInMs() > self._over(self.cluster.get()[0]):
            self.cluster.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_clusters(events: DataFrame, days: int = 30, late: str = "10 days") -> DataFrame:
    """ticker, class, msg_id, d, anchor and messages of a cluster so far, for every event (ticker, class, msg_id, d, ts) that the watermark has passed.

    Events wait in an aggregate by (ticker, class, ts, d), so only times, not events, are folded in Python. It lets a time go that is equal to the watermark, hence the microsecond: what is due lies
    before the watermark. What comes when the watermark has already passed is too late and dropped; Spark itself drops it a batch later only, so what leaves in the batch in which it came is taken out here.
    """
    marked = events.where(F.col("ts").isNotNull()).withColumn("ts", F.date_trunc("MILLISECOND", "ts") + F.expr("interval 1 microsecond")).withColumn("_came", F.current_timestamp()).withWatermark("ts", late)
    waiting = marked.groupBy("ticker", "class", "ts", "d").agg(F.collect_list(F.struct("msg_id", "_came")).alias("_events"))
    ids = F.transform(F.filter("_events", lambda e: e["_came"] != F.current_timestamp()), lambda e: e["msg_id"])
    due = waiting.withColumn("_ids", F.sort_array(ids)).where(F.size("_ids") > 0)
    due = due.select("ticker", "class", "ts", F.unix_millis("ts").alias("at"), "d", F.size("_ids").cast("long").alias("n"), F.to_json("_ids").alias("ids"))
    placed = due.groupBy("ticker", "class").transformWithStateInPandas(AnchoredClusters(days), "ticker string, class string, d date, anchor date, before long, ids string", "append", "EventTime")
    each = placed.select("ticker", "class", "d", "anchor", "before", F.posexplode(F.from_json("ids", "array<string>")).alias("_i", "msg_id"))
    return each.select("ticker", "class", "msg_id", "d", "anchor", (F.col("before") + F.col("_i") + 1).alias("messages"))


def stream_block_counts(blocks: DataFrame) -> DataFrame:
    """Rolling counts of block fingerprints; write in update mode."""
    return blocks.groupBy(fingerprint(F.col("text")).alias("fp")).agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("sample"))
