"""Best-fit packing of token sequences by minimum bin slack.

Documents become token ids and one end id; only documents longer than a sequence are cut. Pieces are dealt at random
into groups of bounded size, and each group is packed by itself: the largest remaining piece opens a sequence, a
subset-sum programme over the remaining lengths (one big integer as bitset per length added) finds the fullest
combination that fits beside it, and the pieces of that combination are removed. Equal combinations are taken at once
while their lengths last. What the groups leave in sequences that are not full is dealt into fewer groups and packed again, until one
group holds it, so splitting costs about what one sequence costs.

A text's ids are put together from those of its words where the tokenizer allows it; an encoder proves that on a set of texts when it is
made, and otherwise encodes whole texts.

A null or empty text is its end id alone. Repeated rows are packed one by one. An empty table gives an empty result. A null
id is kept. Columns other than the two named are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import trimmed, written
from .text import NOT_SPACE, Words, buffers, slices, split

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_PLAIN = np.isin(np.arange(256), list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


_WORDS = "The quick brown fox isn't here Straße NAÏVE école 你好 世界 привет hello_world (foo) [bar] a/b x@y.z 3.14 1,000 -- ... 'quoted' \"said\" e.g. U.S. #tag $5 50% <b> x;y ¡hola! ﬁn e\u0301 ½ ™ \u200bzero don’t".split()
#: Texts on which ids by words are held against ids of the whole: words, marks and white space next to each other in many ways.
PROBES = ["", " ", "\n\n x", *(f"{a}{m}{s}{b}{m} {a.upper()}{m}" for i, (a, b) in enumerate(zip(_WORDS, _WORDS[1:], strict=False)) for m, s in ((m, " \n\t\r"[(i + j) % 4] * (1 + (i + j) % 3)) for j, m in enumerate(("", ".", ",", "!", "?", ":", ";"))))]


class Encoder:
    """Token ids of whole texts, with the ids of each distinct word kept for the next texts.

    The tokenizer never joins what white space separates, so a text's ids are those of its words in order. Nor does it join
    a letter or digit with the mark that ends a word, or tell capitals of A-Z from small letters (special tokens apart, which hold
    `<|`), so words are looked up without their capitals and last mark.
    """

    @staticmethod
    def _words(column: pa.Array) -> Words:
        data, _ = buffers(column)
        words = split(column, NOT_SPACE, lower=b"<|" not in data.tobytes())
        last = words.end - 1
        parted = _MARK[words.data[last]] & _PLAIN[words.data[np.maximum(last - 1, 0)]] & (last > words.start)
        start = np.concatenate([words.start, last[parted]])
        end = np.concatenate([np.where(parted, last, words.end), words.end[parted]])
        order = np.argsort(start, kind="stable")
        rows = words.rows + np.concatenate([[0], np.cumsum(parted)])[words.rows]
        return Words(words.data, words.offsets, start[order], end[order], rows)

    def __init__(self, path: str, most_ids: int = 8 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most_ids, self.by_words = Tokenizer.from_file(path), most_ids, True
        self._clear()
        whole = [[*x.ids, 0] for x in self.tokenizer.encode_batch(PROBES, add_special_tokens=False)]
        try:
            ids, rows = self(pa.array(PROBES))
            self.by_words = ids.tolist() == [i for x in whole for i in x] and np.diff(rows).tolist() == list(map(len, whole))
        except (IndexError, ValueError):
            self.by_words = False
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        new = [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        size = np.fromiter(map(len, new), np.int64, len(new))
        at = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in new for i in x), np.uint32, int(size.sum()))])
        keys, at, size = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.size, size])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], at[order], size[order]

    def __call__(self, column: pa.Array, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, each row followed by the end id, and the rows' offsets."""
        if not self.by_words:
            texts = [x.ids for x in self.tokenizer.encode_batch([x or "" for x in column.to_pylist()], add_special_tokens=False)]
            return np.fromiter((i for x in texts for i in [*x, end]), np.uint32), np.cumsum([0, *(len(x) + 1 for x in texts)])
        words = self._words(column)
        keys, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.ids) > self.most_ids:
            self._clear()
        known = self.keys[np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            raw = words.data.tobytes()
            self._learn(keys[new], [raw[a:b].decode() for a, b in zip(words.start[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)])
        entry = np.searchsorted(self.keys, keys)[inverse]
        size, at = self.size[entry], self.at[entry]
        to = np.concatenate([[0], np.cumsum(size)])
        rows = to[words.rows] + np.arange(len(words.rows))
        ids = np.full(rows[-1], end, dtype=np.uint32)
        place = np.arange(to[-1]) + np.repeat(words.row, size)
        ids[place] = self.ids[np.repeat(at - to[:-1], size) + np.arange(to[-1])]
        return ids, rows


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length and the CRC-32 of the ids (little-endian, 32 bits each) of each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in slices(batches, "text", 2 << 20):
            ids, rows = encode(batch.column("text"), end)
            length = np.diff(rows)
            n = -(-length // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            size = np.minimum(length[row] - start, capacity)
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((rows[row] + start).tolist(), (rows[row] + start + size).tolist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(cut), PIECES)


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths, by how often they remain (counts[length]), whose sum is as near to room as any, and not over it.

    reach holds all sums of the lengths added so far as bits; adding stops when room itself is reached.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        for _ in range(min(int(counts[length]), room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def minimum_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each length and its offset there."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    left = counts.copy()
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for largest in range(capacity, 0, -1):
        while left[largest]:
            left[largest] -= 1
            combination = [largest, *fullest(left, capacity - largest)]
            left[largest] += 1
            need = np.bincount(combination, minlength=capacity + 1)
            used = np.flatnonzero(need)
            times = int((left[used] // need[used]).min())
            at = 0
            for length in combination:
                place = first[length] + left[length] - 1 - np.arange(times)
                bins[order[place]], offsets[order[place]] = n + np.arange(times), at
                left[length] -= times
                at += length
            n += times
    return bins, offsets


def _by_group(left: DataFrame, n_groups: int, level: int, capacity: int) -> DataFrame:
    """Pieces dealt into groups and each group packed; _full: whether the piece's sequence has no room left."""

    def each(key: tuple, table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        bins, offsets = minimum_slack(length, capacity)
        full = np.bincount(bins, weights=length, minlength=1)[bins] == capacity
        names = pa.array((level << 56) + (key[0].as_py() << 24) + bins)
        return table.drop_columns("_group").append_column("sequence_id", names).append_column("offset", pa.array(offsets)).append_column("_full", pa.array(full))

    dealt = left.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)))
    return dealt.groupBy("_group").applyInArrow(each, PACKED + ", _full boolean")


def pack(cut: DataFrame, capacity: int = 2048, group_pieces: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (as pieces() gives them). Lengths are shuffled, not ids."""
    columns = [x.split()[0] for x in PIECES.split(", ")]
    left, level, done = written(cut, "pieces"), 0, []
    n_left = left.count()
    while (n_groups := -(-n_left // group_pieces)) > 1:
        packed = written(_by_group(left, n_groups, level, capacity), "packed")
        n_open = packed.where("not _full").count()
        if 2 * n_open > n_left:  # few lengths that never fill a sequence: another deal would not either
            done.append(packed.drop("_full"))
            break
        done.append(packed.where("_full").drop("_full"))
        left, n_left, level = packed.where("not _full").select(*columns), n_open, level + 1
    else:
        done.append(_by_group(left, 1, level, capacity).drop("_full"))
    return reduce(DataFrame.unionByName, done)
