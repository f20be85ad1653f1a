"""Benchmark decontamination by winnowing.

Both sides keep, of every `guarantee - k + 1` consecutive k-word hashes, the smallest (the last of equal ones). Two texts
that share `guarantee` words in a row then share a kept hash at the same place of that span, so joining the kept
hashes misses no such span. Each hit is extended word by word to both sides, and spans that reach `guarantee` words count.
Items shorter than `guarantee` words count where all their words occur in a row; they are looked up by that one hash.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Null or empty texts have no words and are never contaminated; a null item id counts as an item that is not listed;
repeated rows are judged one by one; items with equal ids count once; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import looked_up, trimmed, whole_rows, written
from .text import ALNUM, grams, slices, split

RESULT = "doc_id long, n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<start:long,end:long>>"


def winnow(h: np.ndarray, rows: np.ndarray, k: int, guarantee: int) -> tuple[np.ndarray, np.ndarray]:
    """The kept hashes and the positions of their first words."""
    g, at = grams(h, rows, k)
    w = guarantee - k + 1
    n = len(g) - w + 1
    if n <= 0:
        return g[:0], at[:0]
    low, pick = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        other = g[j : j + n]
        better = other <= low
        low[better], pick[better] = other[better], (np.arange(n) + j)[better]
    inside = at[w - 1 :] - at[:n] == w - 1
    row = np.searchsorted(rows, at, side="right")
    pick = np.unique(pick[inside & (row[w - 1 :] == row[:n])])
    return g[pick], at[pick]


@dataclass
class Index:
    """The benchmark's kept hashes in order, with the item and the word that each stands for."""

    ids: list
    h: np.ndarray
    rows: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    at: np.ndarray
    short: list[int]
    k: int
    guarantee: int

    @classmethod
    def build(cls, ids: list, texts: pa.Array, k: int, guarantee: int) -> Index:
        words = split(texts, ALNUM)
        h, size = words.hashes(), np.diff(words.rows)
        keys, at = winnow(h, words.rows, k, guarantee)
        keys, at = [keys], [at]
        short = sorted({int(n) for n in size if 0 < n < guarantee})
        for n in short:
            g, first = grams(h, words.rows, n)
            whole = size[np.searchsorted(words.rows, first, side="right") - 1] == n
            keys.append(g[whole])
            at.append(first[whole])
        keys, at = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        return cls(ids, h, words.rows, keys, np.searchsorted(words.rows, at, side="right") - 1, at, short, k, guarantee)

    def fingerprints(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What has to be looked up for these texts: kept hashes, and all runs as long as a short item."""
        found = [winnow(h, rows, self.k, self.guarantee), *(grams(h, rows, n) for n in self.short)]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def hits(self, keys: np.ndarray, at: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a text's word and the index entry with the same hash, about `most` at a time."""
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        some = np.flatnonzero(high > low)
        low, n, at = low[some], (high - low)[some], at[some]
        total, i = np.concatenate([[0], np.cumsum(n)]), 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(total, total[i] + most, side="right")) - 1)
            own = n[i:j]
            yield np.repeat(at[i:j], own), np.repeat(low[i:j] - (total[i:j] - total[i]), own) + np.arange(total[j] - total[i])
            i = j

    def found(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items and word ranges of the texts' words that items hold too. Pairs are extended some at a time; a text and an item that
        both repeat a few words make very many pairs, but spans no more than their lengths."""
        kept = np.zeros((3, 0), np.int64)
        for at, entry in self.hits(*self.fingerprints(h, rows)):
            kept = np.unique(np.concatenate([kept, np.stack(self.spans(h, rows, at, entry))], axis=1), axis=1)
        return kept[0], kept[1], kept[2]

    def spans(self, h: np.ndarray, rows: np.ndarray, at: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items and word ranges of the hits that extend to the guaranteed length, or to the whole of a short item."""
        item, other = self.item[entry], self.at[entry]
        size = self.rows[item + 1] - self.rows[item]
        need = np.minimum(size, self.guarantee)
        row = np.searchsorted(rows, at, side="right") - 1
        left, right = np.zeros_like(at), np.zeros_like(at)
        for step, reach, room in ((-1, left, np.minimum(at - rows[row], other - self.rows[item])), (1, right, np.minimum(rows[row + 1] - at, self.rows[item + 1] - other))):
            live = np.arange(len(at))
            while len(live):
                live = live[reach[live] < room[live]]
                n = reach[live] * step + min(step, 0)
                live = live[h[at[live] + n] == self.h[other[live] + n]]
                reach[live] += 1
        enough = left + right >= need
        found = np.unique(np.stack([item[enough], (at - left)[enough], (at + right)[enough]]), axis=1)
        return found[0], found[1], found[2]


def _result(doc_ids: pa.Array, index: Index, rows: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    n = len(doc_ids)
    depth = np.zeros(rows[-1] + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    hit = np.cumsum(depth)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    row = np.searchsorted(rows, start, side="right") - 1
    names: list[list[str]] = [[] for _ in range(n)]
    spans: list[list[dict]] = [[] for _ in range(n)]
    for r in np.unique(row):
        names[r] = sorted({str(index.ids[i]) for i in item[row == r] if index.ids[i] is not None})
        mine = hit[rows[r] : rows[r + 1]].astype(np.int8)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mine, [0]])))
        spans[r] = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return pa.record_batch(
        [doc_ids.cast(pa.int64()), pa.array(np.diff(rows)), pa.array(total[rows[1:]] - total[rows[:-1]]), pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
        ["doc_id", "n_words", "n_hit", "n_items", "item_ids", "spans"],
    )


def _packed(texts: DataFrame, k: int, guarantee: int, short: list[int], name: str) -> DataFrame:
    """Distinct texts by content, with their fingerprints: `name` (SHA-256), text, prints (hash and word)."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = split(batch.column("text"), ALNUM)
            h = words.hashes()
            found = [winnow(h, words.rows, k, guarantee), *(grams(h, words.rows, n) for n in short)]
            key, at = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            row = np.searchsorted(words.rows, at, side="right") - 1
            yield pa.record_batch([batch.column(name).take(pa.array(row)), pa.array(key.view(np.int64)), pa.array(at - words.rows[row])], [name, "key", "at"])

    return texts.mapInArrow(trimmed(prints), f"{name} string, key long, at long")


def _by_join(docs: DataFrame, items: DataFrame, k: int, guarantee: int, keep: str = "doc_id") -> DataFrame:
    """The same result for a benchmark of any size: fingerprints meet in a shuffled join, and each pair of different texts that share
    any is extended in a task of its own pair. Nothing passes through the driver; equal texts are compared once."""
    docs = written(docs.withColumn("doc", F.sha2("text", 256)), "docs")
    items = written(items.withColumn("item", F.sha2("text", 256)), "items")
    own = docs.groupBy("doc").agg(F.first("text").alias("text"))
    theirs = items.groupBy("item").agg(F.first("text").alias("text"))
    sizes = theirs.mapInArrow(_word_counts, "n long").where(f"n > 0 and n < {guarantee}").distinct()
    short = sorted(r["n"] for r in sizes.collect())  # fewer than guarantee numbers
    of_items = _packed(theirs, k, guarantee, short, "item")
    pairs = _packed(own, k, guarantee, short, "doc").join(of_items.select("item", "key").distinct(), "key").select("doc", "item").distinct()
    both = pairs.join(own, "doc").join(theirs.withColumnRenamed("text", "other"), "item")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                index = Index.build([0], one.column("other"), k, guarantee)
                words = split(one.column("text"), ALNUM)
                _, start, end = index.found(words.hashes(), words.rows)
                n = len(start)
                yield pa.record_batch([one.column("doc").take(pa.array([0] * n, pa.int64())), one.column("item").take(pa.array([0] * n, pa.int64())), pa.array(start), pa.array(end)], ["doc", "item", "start", "end"])

    found = written(both.mapInArrow(trimmed(extend), "doc string, item string, start long, end long"), "spans")
    named = found.select("doc", "item").distinct().join(items.select("item", F.col("item_id").cast("string").alias("id")), "item").groupBy("doc").agg(F.array_sort(F.collect_set("id")).alias("item_ids"))
    runs = found.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")).select("doc", _merged(F.col("spans")).alias("spans"))
    facts = written(runs.join(named, "doc", "left"), "overlaps")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    counted = docs.select("doc_id", "doc", "text").mapInArrow(trimmed(_counted), "doc_id long, doc string, n_words long")
    met = looked_up(written(counted, "counted"), facts, "doc")
    none = F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return met.select(
        keep, "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none[0]).alias("item_ids"), F.coalesce("spans", none[1]).alias("spans"),
    )


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.record_batch([pa.array(np.diff(split(batch.column("text"), ALNUM).rows))], ["n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.record_batch([batch.column("doc_id"), batch.column("doc"), pa.array(np.diff(split(batch.column("text"), ALNUM).rows))], ["doc_id", "doc", "n_words"])


def _merged(spans: F.Column) -> F.Column:
    """The union of sorted spans as runs without gaps: a fold that grows the last run or begins one."""
    start = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def step(runs: F.Column, s: F.Column) -> F.Column:
        last = F.element_at(runs, -1)
        grown = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(runs) > 0) & (s["start"] <= F.try_element_at(runs, F.lit(-1))["end"]), grown).otherwise(F.concat(runs, F.array(s)))

    return F.aggregate(spans, start, step)


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = 5, guarantee: int = 10, max_index_chars: int = 8 << 20) -> DataFrame:
    """Per row of docs its words, the words inside spans shared with items, the items (ids as strings) and the spans as runs of words.

    Items of at most `max_index_chars` characters together go to all tasks as one index, and documents are not
    shuffled; beyond that fingerprints of both sides meet in a join. Both ways have the same rows.
    """
    items = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not _fits(items, max_index_chars):
        return _by_join(docs, items, k, guarantee)
    shared = _index(items, k, guarantee)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches, "text"):
            words = split(batch.column("text"), ALNUM)
            yield _result(batch.column("doc_id"), index, words.rows, *index.found(words.hashes(), words.rows))

    return docs.mapInArrow(trimmed(match), RESULT)


def _fits(items: DataFrame, most: int) -> bool:
    return items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] <= most


def _index(items: DataFrame, k: int, guarantee: int) -> Broadcast:
    """The index of a benchmark whose size has been checked, for all tasks."""
    table = items.toArrow()
    return items.sparkSession.sparkContext.broadcast(Index.build(table.column("item_id").to_pylist(), table.column("text").combine_chunks(), k, guarantee))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 5, guarantee: int = 10, max_index_chars: int = 8 << 20) -> DataFrame:
    """The rows of docs without a hit, all columns kept. Whether a row stays rests on its text alone, so docs may be any frame.

    With an index that fits, rows are judged and kept in one pass; beyond that the distinct texts that are hit are joined out.
    """
    columns = docs.columns
    items = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    packed = whole_rows(docs)
    if not _fits(items, max_index_chars):
        content = F.coalesce(F.col("_doc")[text], F.lit(""))
        hit = _by_join(packed.select(F.lit(None).cast("long").alias("doc_id"), content.alias("text")).distinct(), items, k, guarantee, keep="doc")
        kept = packed.withColumn("_blob", F.sha2(content, 256)).join(hit.where("n_hit > 0").select(F.col("doc").alias("_blob")), "_blob", "left_anti")
        return kept.select(*[F.col("_doc")[c].alias(c) for c in columns])
    shared = _index(items, k, guarantee)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches, ("_doc", text)):
            words = split(pc.struct_field(batch.column("_doc"), text), ALNUM)
            _, start, _ = index.found(words.hashes(), words.rows)
            clean_ = np.ones(batch.num_rows, bool)
            clean_[np.searchsorted(words.rows, start, side="right") - 1] = False
            yield batch.filter(pa.array(clean_))

    return packed.mapInArrow(trimmed(keep), packed.schema).select(*[F.col("_doc")[c].alias(c) for c in columns])
