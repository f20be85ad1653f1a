"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as assistant, the others as named
users, and system turns as they are. The loss mask covers the speaker's own turns: their contents and end markers.

Turns are ordered by turn number (null last), then role, then text. Every text holds the whole dialogue, and its masks
count from its beginning. Segments of `span` turn numbers, cut again where more than `span` turns share them (equal or null numbers), are rendered first and then put together, so a
task that puts together a dialogue of very many turns meets few rows of it; `segments` gives them apart, with masks that count
from the beginning of the whole dialogue, for dialogues too long for one value.

Participants are those of the whole conversation. Every distinct role but the system's is a participant. A null role speaks as the
user `unknown`, and is no participant; a conversation without participants is rendered once with a null speaker and an empty mask.
A null or empty text is an empty turn. Rows with a null conversation are one conversation with a null key. Repeated rows are repeated turns.
The marker's first two characters in texts and names are set apart by a space so that no text can pass for a marker. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(role: Column, speaker: Column) -> Column:
    return F.when(role == SYSTEM, F.lit("<|system|>\n")).when(role.eqNullSafe(speaker) & speaker.isNotNull(), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), _plain(F.coalesce(role, F.lit("unknown"))), F.lit("|>\n")))


END = "<|end|>\n"


def _rendered(turns: DataFrame, conv: str, turn: str, role: str, text: str, span: int) -> DataFrame:
    """conv_id, speaker, segment, n_turns, text, length, masks that count from the segment's beginning."""
    turns = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = turns.withColumn("_late", F.col("turn").isNull()).withColumn("_number", F.floor(F.col("turn") / span))
    order = Window.partitionBy("conv_id", "_late", "_number").orderBy("turn", F.coalesce("role", F.lit("")), F.col("role").isNull(), "text")
    turns = turns.withColumn("_piece", F.floor((F.row_number().over(order) - 1) / span))
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("by"), F.col("role").isNull().alias("no_role"), "role", "text")
    segments = turns.groupBy("conv_id", "_late", "_number", "_piece").agg(F.array_sort(F.collect_list(said)).alias("said"))  # the window's partitioning serves
    segments = segments.select("conv_id", F.struct("_late", "_number", "_piece").alias("segment"), "said")
    speakers = turns.select("conv_id", F.when(F.col("role") != SYSTEM, F.col("role")).alias("speaker")).distinct()
    speakers = speakers.groupBy("conv_id").agg(F.collect_set("speaker").alias("speakers")).select(F.col("conv_id").alias("_conv"), "speakers")
    seen = segments.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "segment", "said", F.explode_outer("speakers").alias("speaker"))
    speaker = F.col("speaker")
    parts = F.transform("said", lambda s: F.struct(_head(s["role"], speaker).alias("head"), _plain(s["text"]).alias("body"), (s["role"].eqNullSafe(speaker) & speaker.isNotNull()).alias("own")))
    length = lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("masks"))

    def step(acc: Column, p: Column) -> Column:
        to = acc["at"] + length(p)
        own = F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), to.alias("end")))
        return F.struct(to.alias("at"), F.when(p["own"], F.concat(acc["masks"], own)).otherwise(acc["masks"]).alias("masks"))

    folded = seen.withColumn("parts", parts).withColumn("fold", F.aggregate("parts", start, step))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return folded.select("conv_id", "speaker", "segment", F.size("said").cast("long").alias("n_turns"), whole.alias("text"), F.col("fold.at").alias("length"), "fold.masks")


def _moved(masks: Column, by: Column) -> Column:
    return F.transform(masks, lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end")))


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = 256) -> DataFrame:
    """conv_id, speaker, n_turns, text, masks (array of start and end in code points, end exclusive): one whole dialogue a row."""
    parts = F.struct("segment", "n_turns", "text", "length", "masks")
    dialogues = _rendered(turns, conv, turn, role, text, span).groupBy("conv_id", "speaker").agg(F.array_sort(F.collect_list(parts)).alias("parts"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<array<struct<start:bigint,end:bigint>>>)").alias("masks"))
    put = lambda acc, p: F.struct((acc["at"] + p["length"]).alias("at"), F.concat(acc["masks"], F.array(_moved(p["masks"], acc["at"]))).alias("masks"))
    n_turns = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n_turns"])
    return dialogues.select("conv_id", "speaker", n_turns.alias("n_turns"), F.array_join("parts.text", "").alias("text"), F.flatten(F.aggregate("parts", start, put)["masks"]).alias("masks"))


def segments(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = 256) -> DataFrame:
    """conv_id, speaker, segment (from 0, in order), n_turns, text, masks of the pieces whose texts joined are the dialogue; masks count from the dialogue's beginning."""
    order = Window.partitionBy("conv_id", "speaker").orderBy("segment")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rendered = _rendered(turns, conv, turn, role, text, span).withColumn("_before", before)
    return rendered.select("conv_id", "speaker", (F.row_number().over(order) - 1).cast("long").alias("segment"), "n_turns", "text", _moved(F.col("masks"), F.col("_before")).alias("masks"))


def digest(rendered: DataFrame) -> DataFrame:
    """The masks as text, for comparison with SQL."""
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rendered.select("conv_id", "speaker", "n_turns", "text", masks.alias("masks"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), who AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), every AS (
  SELECT DISTINCT conv_id FROM t
), views AS (
  SELECT e.conv_id, w.speaker FROM every e LEFT JOIN who w ON e.conv_id IS NOT DISTINCT FROM w.conv_id
), parts AS (
  SELECT t.conv_id, v.speaker, coalesce(t.role = v.speaker, false) AS own,
    CASE WHEN t.role = 'system' THEN '<|system|>' || chr(10)
         WHEN t.role = v.speaker THEN '<|assistant|>' || chr(10)
         ELSE '<|user name=' || replace(coalesce(t.role, 'unknown'), '<|', '< |') || '|>' || chr(10) END AS head,
    replace(t.text, '<|', '< |') || '<|end|>' || chr(10) AS body,
    row_number() OVER (PARTITION BY t.conv_id, v.speaker ORDER BY t.turn NULLS LAST, coalesce(t.role, ''), t.role IS NULL, t.text) AS n
  FROM t JOIN views v ON t.conv_id IS NOT DISTINCT FROM v.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM parts
)
SELECT conv_id, speaker, count(*) AS n_turns, string_agg(head || body, '' ORDER BY n) AS text,
  coalesce(string_agg((stop - length(body))::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY n) FILTER (WHERE own), '') AS masks
FROM placed GROUP BY conv_id, speaker
"""
