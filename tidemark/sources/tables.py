"""Tables at the boundary: explicit schemas, tolerant columns, vendor shapes, which load to take."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("d", T.DateType()), T.StructField("close", T.DoubleType()), T.StructField("adjclose", T.DoubleType()), T.StructField("volume", T.DoubleType())])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir or the program's checkpoint directory.

    Without either, a session on this machine alone gets one beside its warehouse; on a cluster that is an error, since each executor would
    write its part to a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints"
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder. What is read several times is computed once, its plan ends there, nothing stays in the executors'
    memory, and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)



def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with header, all cells text; a byte-order mark in the first name is ignored. A missing file is an empty table."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    try:
        found = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    return resolved(found.toDF(*[c.lstrip("﻿") for c in found.columns]), {c: [c] for c in columns})


def resolved(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns by their first alias that is there, without regard to case; null where none is. Nulls fall through to the next alias."""
    there = {c.lower().strip(): c for c in df.columns}
    pick = lambda names: [F.col(f"`{there[n.lower()]}`") for n in names if n.lower() in there]
    return df.select(*[(F.coalesce(*pick(names)) if pick(names) else F.lit(None).cast("string")).alias(c) for c, names in aliases.items()])


def write_table(df: DataFrame, path: str, columns: list[str], partition_by: str | None = None) -> None:
    """Fixed column order; with a partition column only the partitions in df are replaced."""
    writer = df.select(*columns).write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    writer.parquet(path)


def read_prices(spark: SparkSession, path: str, tickers: list[str] | None = None, indices: bool = False) -> DataFrame:
    """Prices partitioned by ticker; a list of tickers prunes partitions. IDX_ names are indices."""
    found = spark.read.schema(PRICES).parquet(path)
    found = found.where(F.col("ticker").isin(tickers)) if tickers is not None else found
    return found.where(F.col("ticker").startswith("IDX_") == F.lit(indices))


CHART = "struct<meta:struct<symbol:string,gmtoffset:bigint>,timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>,volume:array<bigint>>>,adjclose:array<struct<adjclose:array<double>>>>>"


def from_chart_json(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """A vendor's chart payload as rows; the date is that of the exchange (epoch seconds plus offset), not of UTC."""
    results = payloads.select(F.explode(F.from_json(column, f"struct<chart:struct<result:array<{CHART}>>>")["chart"]["result"]).alias("r"))
    quote, adjusted = F.col("r.indicators.quote")[0], F.get(F.col("r.indicators.adjclose"), 0)
    none = F.expr("cast(array() as array<double>)")
    zipped = results.select(F.col("r.meta.symbol").alias("ticker"), F.coalesce("r.meta.gmtoffset", F.lit(0)).alias("_off"), F.explode(F.arrays_zip(F.col("r.timestamp").alias("ts"), quote["close"].alias("close"), F.coalesce(adjusted["adjclose"], none).alias("adj"), F.coalesce(quote["volume"], none.cast("array<bigint>")).alias("volume"))).alias("x"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.col("x.ts") + F.col("_off")) / 86400).cast("int"))
    return zipped.select("ticker", day.alias("d"), F.col("x.close").alias("close"), F.coalesce("x.adj", "x.close").alias("adjclose"), F.col("x.volume").cast("double").alias("volume")).where("close > 0")


def html_of_commands(responses: DataFrame, column: str = "body") -> DataFrame:
    """HTML in the insert commands of a JSON envelope, joined in order."""
    commands = F.from_json(column, "array<struct<command:string,data:string>>")
    html = F.array_join(F.transform(F.filter(commands, lambda c: (c["command"] == "insert") & c["data"].isNotNull()), lambda c: c["data"]), "\n")
    return responses.withColumn("html", html)


def price_feed(rows: DataFrame, companies: DataFrame, start) -> DataFrame:
    """Long feed rows of stocks from `start` with a positive close, and the company's name."""
    good = rows.where(~F.col("ticker").startswith("IDX_") & (F.col("close") > 0) & (F.col("d") >= F.lit(start).cast("date")))
    return good.join(companies.select("ticker", "company"), "ticker", "left")


def latest_load(manifest: DataFrame) -> DataFrame:
    """Per dataset the newest valid load of manifest(dataset, name, modified, has_dataset): a date in the name beats the time of change;
    lock and backup names and loads without the dataset are passed over, and counted."""
    stamp = F.coalesce(F.try_to_timestamp(F.regexp_extract("name", r"(20\d{6}(?:_\d{4})?)", 1), F.lit("yyyyMMdd_HHmm")), F.try_to_timestamp(F.regexp_extract("name", r"(20\d{6})", 1), F.lit("yyyyMMdd")))
    bad = F.col("name").rlike(r"^(~\$|\.)|(?i)(backup|\.bak|\.tmp|\.lock)") | ~F.col("has_dataset")
    marked = manifest.withColumn("_stamp", stamp).withColumn("_bad", bad)
    order = F.struct(F.col("_stamp").isNotNull().alias("a"), F.coalesce("_stamp", "modified").alias("b"), F.col("modified").alias("c"), F.col("name").alias("e"))
    return marked.groupBy("dataset").agg(F.max_by(F.when(~F.col("_bad"), F.col("name")), F.when(~F.col("_bad"), order)).alias("name"), F.sum(F.col("_bad").cast("long")).alias("skipped"))


def paired_by_stamp(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sibling outputs of one run: names that share the run's stamp."""
    stamp = F.regexp_extract("name", r"(20\d{6}_\d{4,6})", 1)
    a = left.select(stamp.alias("stamp"), F.col("name").alias("left_name")).where("stamp <> ''")
    return a.join(right.select(stamp.alias("stamp"), F.col("name").alias("right_name")), "stamp")


def by_priority(rows: DataFrame, key: str, priority: str = "priority") -> DataFrame:
    """Rows of the engine with the smallest priority that a key has."""
    best = rows.groupBy(key).agg(F.min(priority).alias(priority))
    return rows.join(best, [key, priority], "left_semi")


def refreshed(sources: DataFrame, started) -> DataFrame:
    """Adds refreshed: changed at or after the run's start and not empty."""
    return sources.withColumn("refreshed", (F.col("modified") >= F.lit(started).cast("timestamp")) & (F.col("bytes") > 0))


def companies(rows: DataFrame, least: int = 50) -> DataFrame:
    """Listed companies: valid ISIN and symbol, the first row of each symbol; none at all when there are fewer than `least`."""
    good = rows.where(F.col("isin").rlike(r"^[A-Z]{2}[A-Z0-9]{9}\d$") & F.col("symbol").rlike(r"^[A-Z0-9][A-Z0-9.-]{0,11}$"))
    one = good.withColumn("_n", F.row_number().over(W.partitionBy("symbol").orderBy("ord"))).where("_n = 1").drop("_n")
    n = one.agg(F.count(F.lit(1)).alias("_count"))
    return one.crossJoin(F.broadcast(n)).where(F.col("_count") >= least).drop("_count")


def key_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A sheet of key and value as one row."""
    return rows.groupBy().pivot("key", keys).agg(F.first("value"))


def file_facts(df: DataFrame) -> DataFrame:
    """path, name, bytes, modified of the files that a file-based DataFrame reads; files without rows have none to tell of them."""
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified")).distinct()


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and digest of some columns' contents, whatever the order of rows and their files: MD5 of the count and of the sum of the rows' MD5 heads."""
    head = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])), 1, 12), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(head), F.lit(0).cast("decimal(38,0)")).cast("string").alias("_sum"))
    return sums.select("rows", F.md5(F.concat_ws(":", F.col("rows").cast("string"), "_sum")).alias("digest"))


def source_fingerprint(df: DataFrame, columns: list[str], started) -> DataFrame:
    """One row: rows, digest, files, bytes, newest file time, and whether all that is read was written at or after `started` and is not empty."""
    files = file_facts(df).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("modified").alias("_oldest"), F.max("modified").alias("modified"))
    both = content_digest(df, columns).crossJoin(F.broadcast(files))  # one row each
    fresh = F.coalesce(F.col("_oldest") >= F.lit(started).cast("timestamp"), F.lit(False)) & (F.col("bytes") > 0)
    return both.withColumn("refreshed", fresh).drop("_oldest")
