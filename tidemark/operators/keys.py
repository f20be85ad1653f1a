"""Keys: deduplication, upserts, merges with status, differences and unions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import with_facts


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; unlike dropDuplicates the order is stated."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def language_duplicates(rows: DataFrame, minutes: int = 3, keep: str = "EN") -> DataFrame:
    """msg_id of announcements that repeat another of the same company and day in another known language, at most some minutes
    apart. Greedy in order of time and id: each pairs with the first unpaired earlier one; of a pair the one not in `keep` goes
    (the later where neither is).

    No pair spans a gap of more than `minutes`, so a day falls into sessions at such gaps: these are found on its distinct minutes, 1,440 at most, and dealt out one by one.
    A session streams through in order and only unpaired rows of the last minutes are held: a session without gaps may be long, and is never gathered.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, open_, n = None, {}, 0
        for batch in batches:
            gone = []
            for *key, minute, msg_id, lang in zip(*(batch.column(c).to_pylist() for c in ("company", "d", "_session", "minute", "msg_id", "lang")), strict=True):
                if session != key:
                    session, open_, n = key, {}, 0
                n += 1
                for waiting in open_.values():
                    while waiting and minute - waiting[0][1] > minutes:
                        waiting.popleft()
                first = min(((waiting[0][0], other) for other, waiting in open_.items() if waiting and other != lang), default=None)
                if first is None:
                    open_.setdefault(lang, deque()).append((n, minute, msg_id))
                else:
                    partner = open_[first[1]].popleft()
                    gone.append(partner[2] if lang == keep else msg_id)
            yield pa.record_batch([pa.array(gone, pa.string())], ["msg_id"])

    known = rows.where("lang is not null and minute is not null").select("company", "d", "minute", F.col("msg_id").cast("string").alias("msg_id"), "lang")
    day = W.partitionBy("company", "d").orderBy("minute")
    times = known.select("company", "d", "minute").distinct().withColumn("_new", (F.col("minute") - F.lag("minute").over(day) > minutes).cast("int"))
    sessions = times.select("company", "d", "minute", F.coalesce(F.sum("_new").over(day), F.lit(0)).alias("_session"))
    placed = with_facts(known, sessions, ["company", "d", "minute"])
    return placed.repartition("company", "d", "_session").sortWithinPartitions("company", "d", "_session", "minute", "msg_id", "lang").mapInArrow(fold, "msg_id string")


def index_merge(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, values and status: NEW, UPDATED, SAME or KEPT (only in old); new values win."""
    a = old.select(key, F.struct(*values).alias("_a"))
    b = new.select(key, F.struct(*values).alias("_b"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("_a").isNull(), "NEW").when(F.col("_b").isNull(), "KEPT").when(F.col("_a").eqNullSafe(F.col("_b")), "SAME").otherwise("UPDATED")
    return both.select(key, F.coalesce("_b", "_a").alias("_v"), status.alias("status")).select(key, "_v.*", "status")


def purged(rows: DataFrame, manifest: DataFrame, most_bytes: int = 100_000) -> DataFrame:
    """Rows without those of the old format: no node id, and a stored file of that size or more, or none."""
    sized = rows.join(manifest.select("page_id", F.col("bytes").alias("_bytes")), "page_id", "left")
    return sized.where(F.col("node_id").isNotNull() | (F.col("_bytes") < most_bytes)).drop("_bytes")


def first_nonempty(*tables: DataFrame) -> DataFrame:
    """ticker of the first table (by order) that has any rows."""
    every = None
    for i, t in enumerate(tables):
        part = t.select("ticker", F.lit(i).alias("_priority")).distinct()
        every = part if every is None else every.unionByName(part)
    best = every.agg(F.min("_priority").alias("_priority"))
    return every.join(F.broadcast(best), "_priority").select("ticker")


def enriched(rows: DataFrame, facts: DataFrame, key: str, columns: list[str], order: list | None = None) -> DataFrame:
    """rows with `columns` of the fact of their key, null where there is none; of several facts of a key the first by `order` (the columns
    themselves by default). No row is lost or doubled; a null key has no fact."""
    one = first_by(facts.where(F.col(key).isNotNull()), [key], order or columns).select(key, *columns)
    return rows.join(one, key, "left")


def bag_union(sources: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """source and `columns` of all rows of all sources, repeated rows too; a column that a source does not have is null."""
    parts = [rows.select(F.lit(name).alias("source"), *[c for c in columns if c in rows.columns]) for name, rows in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select("source", *[F.col(c) if c in out.columns else F.lit(None).alias(c) for c in columns])


def common(tables: list[DataFrame], column: str) -> DataFrame:
    """The distinct values of a column that all tables have; null is no value. Each table is reduced to its values before they meet."""
    values = [t.select(column).where(F.col(column).isNotNull()).distinct().select(column, F.lit(i).alias("_i")) for i, t in enumerate(tables)]
    every = values[0]
    for part in values[1:]:
        every = every.unionByName(part)
    return every.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(tables)).select(column)


def missing(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The distinct wanted keys that are not stored; a null is neither wanted nor stored."""
    asked = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    return asked.join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
