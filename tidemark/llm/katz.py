"""Katz backoff language model of any order: Good-Turing discounted n-grams, recursively over shorter ones, over one unknown word.

P1(w) = d(c) c / N for training words; what the discounts take from all of them is the unknown word's.
Pn(w | v) = d(c) c / c(v) for n-grams v w seen in training, else alpha(v) times P(n-1)(w | v without its first word); alpha(v) is
exactly what the seen n-grams leave, divided by what their words leave in P(n-1), so the probabilities after any v sum to 1.
After an unseen v, alpha is 1. Where no n-gram after v is discounted, c(v) + 1 takes the place of c(v), so that something is left
to back off with.

Counts up to 5 are discounted by Good-Turing with the usual correction; where the counts of counts give no discount in
(0, 1), by half an occurrence, (c - 0.5) / c.

How it runs. Documents are cut once into blocks of whole texts, one row a block of a written table, so every later step reads the same
blocks however often it is run. A block knows its distinct n-grams of each order. Counts are held in tables partitioned by
ranges of hash (`served`): every block sends each range the sorted keys it has, with its own counts; a range adds up and answers
each block in the order asked. A frequent word is one key of a block, however often it stands there, so no range is
hot, and no block holds more than its own texts. Such tables serve the counts of each order, and then order by order what the
seen n-grams of each context hold and what their words hold in the order below, from which alpha follows. Each distinct n-gram
is summed once, by the first block that has it. Blocks then evaluate every token recursively and add up per text. A block sends
at most one message a distinct key, so messages grow with the distinct n-grams of the blocks, not with blocks times ranges.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, and one end token for each text; before a text's first token stand as many starts as
the order asks for. Keys are 64-bit hashes, counts 64-bit integers. A null or empty text is its end token alone. Rows with a null id
are learned from where `held` is not true of them. Repeated rows are counted and scored one by one. An empty table gives an
empty result; other columns are ignored. With nothing to learn from, every token is unknown and has probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import shuffled_to, trimmed, written
from .text import NOT_SPACE, mix, slices, split, sums

END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)
_STEP = np.uint64(0xD6E8FEB86659FD93)
CUT = 5
_ASKED = "kind string, range long, block long, keys binary, sums binary"
_ANSWER = "kind string, range long, block long, sums binary, first binary"
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# --- sums by key, served by ranges of hash


def planes(values: np.ndarray) -> bytes:
    """Rows of 64-bit numbers, each byte by byte of all and packed: high bytes are alike, low ones need few bits."""
    rows = np.atleast_2d(np.ascontiguousarray(values))
    return zstandard.compress(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1, 8).transpose(0, 2, 1).tobytes(), 1)


def unplaned(packed: bytes, kind: str, rows: int = 1) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(rows, 8, -1).transpose(0, 2, 1)).view(kind).reshape(rows, -1)


def sorted_keys(packed: bytes) -> np.ndarray:
    """Sorted keys from their differences."""
    return np.cumsum(unplaned(packed, "<u8")[0], dtype=np.uint64)


def asked(kind: str, block: int, keys: np.ndarray, values: np.ndarray, n_ranges: int) -> pa.RecordBatch:
    """Rows that bring a block's sorted keys and their values (column, key) to the ranges they fall in."""
    bounds = np.array([(b << 64) // n_ranges for b in range(1, n_ranges)], dtype=np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).tolist()
    parts = [(b, a, z) for b, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
    n = len(parts)
    return pa.record_batch({
        "kind": pa.array([kind] * n, pa.string()), "range": pa.array([b for b, _, _ in parts], pa.int64()), "block": pa.array([block] * n, pa.int64()),
        "keys": pa.array([planes(np.diff(keys[a:z], prepend=np.uint64(0))) for _, a, z in parts], pa.binary()),
        "sums": pa.array([planes(values[:, a:z]) for _, a, z in parts], pa.binary()),
    })


def _located(table: pa.Table) -> tuple[pa.Table, np.ndarray, int, list[tuple[int, int]]]:
    """A range's table by block; each asked key's place among the distinct ones, the number of these, and the blocks' parts."""
    table = table.sort_by("block")
    keys = [sorted_keys(x) for x in table.column("keys").to_pylist()]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    cuts = np.cumsum([0, *map(len, keys)]).tolist()
    return table, inverse, len(distinct), list(zip(cuts[:-1], cuts[1:], strict=True))


def _answered(table: pa.Table, sums_: list[bytes], first: list[bytes]) -> pa.Table:
    return pa.table({"kind": table.column("kind"), "range": table.column("range"), "block": table.column("block"), "sums": pa.array(sums_, pa.binary()), "first": pa.array(first, pa.binary())})


def _first(learned: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """1 where a block is the first that learned a key (blocks are in order)."""
    own = np.flatnonzero(learned)
    _, at = np.unique(inverse[own], return_index=True)
    first = np.zeros(len(inverse), np.uint8)
    first[own[at]] = 1
    return first


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """Answers of one range of n-grams: total counts, and who is to sum them."""
    table, inverse, n, parts = _located(table)
    own = np.concatenate([unplaned(x, "<i8")[0] for x in table.column("sums").to_pylist()])
    total = np.zeros(n, np.int64)
    np.add.at(total, inverse, own)
    back, first = total[inverse], _first(own > 0, inverse)
    return _answered(table, [planes(back[a:z]) for a, z in parts], [np.packbits(first[a:z]).tobytes() for a, z in parts])


def _backoff(key: tuple, table: pa.Table) -> pa.Table:
    """Answers of one range of contexts: alpha, and the divisor of its n-grams' counts (0 where unseen)."""
    table, inverse, n, parts = _located(table)
    values = np.concatenate([unplaned(x, "<f8", 3) for x in table.column("sums").to_pylist()], axis=1)
    lost, held, c = (np.bincount(inverse, weights=v, minlength=n) for v in values)
    divisor = np.where(c > 0, c + (lost <= 0), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.where(c > 0, np.maximum(lost, lost <= 0) / divisor / np.maximum(1.0 - held, 1e-300), 1.0)
    answer = np.stack([alpha, divisor])[:, inverse]
    return _answered(table, [planes(answer[:, a:z]) for a, z in parts], [b""] * len(parts))


def _spectrum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Types by count, tokens and types of the counted tables: each type by the first block that learned it."""
    for batch in batches:
        for kind, counts, first in zip(*(batch.column(x).to_pylist() for x in ("kind", "sums", "first")), strict=True):
            c = unplaned(counts, "<i8")[0]
            c = c[np.unpackbits(np.frombuffer(first, np.uint8), count=len(c)).astype(bool)]
            n = np.bincount(np.minimum(c, CUT + 2), minlength=CUT + 3)
            yield pa.record_batch([pa.array([kind]), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([int(c.sum())]), pa.array([len(c)])], ["kind", "n", "tokens", "types"])


# --- discounts


def discounts(n: list[float], cut: int = CUT) -> list[float]:
    """d(1) .. d(cut) from the numbers of types that occur once, twice, .. cut + 1 times."""
    common = (cut + 1) * n[cut] / n[0] if n[0] else 1.0
    out = []
    for r in range(1, cut + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts times their discounts."""
    return c * np.array([0.0, *d, 1.0])[np.minimum(c, len(d) + 1)]


# --- blocks


class Block:
    """Tokens of some whole texts and their distinct n-grams, order by order.

    grams[n]: sorted keys of the distinct n-grams; of[n]: each token's; lower[n], context[n]: for each distinct n-gram that of
    the order below without its first word, and its context's place in contexts[n], the sorted keys of what stands before.
    """

    def __init__(self, row: bytes, order: int) -> None:
        self.docs = pa.ipc.open_stream(row).read_all().combine_chunks()
        words = split(self.docs.column("text"), NOT_SPACE)
        n_docs = len(words.rows) - 1
        self.rows = words.rows + np.arange(n_docs + 1)
        self.learn = np.repeat(~self.docs.column("held_out").to_numpy(), np.diff(self.rows))
        token = np.empty(self.rows[-1], np.uint64)
        inner = np.ones(len(token), bool)
        inner[self.rows[1:] - 1] = False
        token[inner], token[~inner] = words.hashes(), END
        self.grams, self.of, self.lower, self.contexts, self.context = {}, {}, {}, {}, {}
        self.grams[1], self.of[1] = np.unique(token, return_inverse=True)
        before, place = np.zeros(len(token), np.uint64), np.arange(len(token)) - np.repeat(self.rows[:-1], np.diff(self.rows))
        for n in range(2, order + 1):
            # the key of a context grows by the word before it, or by a start
            far = np.full(len(token), START)
            far[n - 1 :] = np.where(place[n - 1 :] >= n - 1, token[: len(token) - n + 1], START)
            before = mix(before + far * _STEP + np.uint64(n))
            self.contexts[n], of_context = np.unique(before, return_inverse=True)
            self.grams[n], at, self.of[n] = np.unique(mix(before * _STEP + token), return_index=True, return_inverse=True)
            self.lower[n], self.context[n] = self.of[n - 1][at], of_context[at]

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.of[n][self.learn], minlength=len(self.grams[n])).astype(np.int64)


class Model:
    """What the driver knows of the counts: discounts of each order, tokens, types, and the unknown word's probability."""

    def __init__(self, facts: dict[str, dict], order: int) -> None:
        self.order = order
        spread = {n: [facts.get(f"n{n}", {}).get(f"n{r}") or 0.0 for r in range(1, CUT + 2)] for n in range(1, order + 1)}
        self.d = {n: discounts(x) for n, x in spread.items()}
        self.n_tokens, self.n_types = (facts.get("n1", {}).get(x) or 0 for x in ("tokens", "types"))
        kept = 1.0 - sum(r * s * (1 - d) for r, s, d in zip(range(1, CUT + 1), spread[1], self.d[1], strict=False)) / self.n_tokens if self.n_tokens else 0.0
        self.unknown = max(1.0 - kept, 0.0) or 1.0 / (self.n_tokens + 1)
        self.scale = (1.0 - self.unknown) / kept if kept else 0.0

    def probabilities(self, block: Block, answers: Answers, n: int) -> np.ndarray:
        """Pn of the block's distinct n-grams, recursively."""
        c, _ = answers.counts(n)
        if n == 1:
            p = _discounted(c, self.d[1]) / self.n_tokens * self.scale if self.n_tokens else np.zeros(len(c))
            return np.where(p > 0, p, self.unknown)
        alpha, divisor = answers.backoff(n)
        at = block.context[n]
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = _discounted(c, self.d[n]) / divisor[at]
        return np.where(c > 0, seen, alpha[at] * self.probabilities(block, answers, n - 1)[block.lower[n]])


class Answers:
    """What the ranges answered a block, in the order of its keys."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table

    def _of(self, kind: str) -> pa.Table:
        return self.table.filter(pc.equal(self.table.column("kind"), kind)).sort_by("range")

    def counts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the distinct n-grams, and whether this block is to sum them."""
        own = self._of(f"n{n}")
        counts = [unplaned(x, "<i8")[0] for x in own.column("sums").to_pylist()]
        first = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)).astype(bool) for x, c in zip(own.column("first").to_pylist(), counts, strict=True)]
        return np.concatenate(counts), np.concatenate(first)

    def backoff(self, n: int) -> np.ndarray:
        """alpha and divisor of the contexts of order n."""
        return np.concatenate([unplaned(x, "<f8", 2) for x in self._of(f"c{n}").column("sums").to_pylist()], axis=1)


def blocks(docs: DataFrame, held: str, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    """block, docs: whole rows of bounded text together, packed as one compressed value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId() << 32, 0
        waiting: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                for batch in waiting:
                    out.write_batch(batch)
            return pa.record_batch([pa.array([task + number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "docs"])

        for batch in slices(batches, "text", block_bytes):
            if waiting and sum(x.nbytes for x in waiting) + batch.nbytes > block_bytes:
                yield packed()
                waiting, number = [], number + 1
            waiting.append(batch)
        if waiting:
            yield packed()

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.select("doc_id", "text", F.coalesce(F.expr(held), F.lit(False)).alias("held_out")).mapInArrow(trimmed(pack), "block long, docs binary")


def scores(docs: DataFrame, held: str = "false", order: int = 2, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    held: SQL condition on doc_id of rows that are scored but not learned from. order: words of the longest n-grams.
    """
    texts = written(blocks(docs, held, doc_id, text, block_bytes), "blocks")
    n_ranges = 2 * shuffled_to(docs.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, row in zip(batch.column("block").to_pylist(), batch.column("docs"), strict=True):
                block = Block(row.as_buffer(), order)
                for n in range(1, order + 1):
                    yield asked(f"n{n}", number, block.grams[n], block.counts(n)[None], n_ranges)

    counted = written(texts.mapInArrow(trimmed(ask), _ASKED).groupBy("kind", "range").applyInArrow(_count, _ANSWER), "counts")
    facts = counted.select("kind", "sums", "first").mapInArrow(_spectrum, "kind string, n array<long>, tokens long, types long")
    facts = facts.groupBy("kind").agg(*[F.sum(F.col("n")[r]).cast("double").alias(f"n{r}") for r in range(1, CUT + 2)], F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
    model = Model({r["kind"]: r.asDict() for r in facts.collect()}, order)

    def contexts(n: int):
        """Per context of a block: of the n-grams it has to sum, what they lose, what their words hold in the order below, and their counts."""

        def ask_of(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
            block, known = Block(table.column("docs")[0].as_buffer(), n), Answers(answers)
            c, mine = known.counts(n)
            p = model.probabilities(block, known, n - 1)[block.lower[n]]
            at, size = block.context[n][mine], len(block.contexts[n])
            values = np.stack([np.bincount(at, weights=x[mine], minlength=size) for x in (c - _discounted(c, model.d[n]), p, c)]).astype(np.float64)
            return pa.Table.from_batches([asked(f"c{n}", key[0].as_py(), block.contexts[n], values, n_ranges)])

        return ask_of

    every = counted
    for n in range(2, order + 1):
        known = every.where(F.substring("kind", 2, 9).cast("int") <= n).groupBy("block")
        answers = texts.groupBy("block").cogroup(known).applyInArrow(contexts(n), _ASKED).groupBy("kind", "range").applyInArrow(_backoff, _ANSWER)
        every = every.unionByName(answers if n == order else written(answers, "backoff"))

    def evaluate(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block, answers = Block(table.column("docs")[0].as_buffer(), order), Answers(answers)
        score = np.log10(model.probabilities(block, answers, order))[block.of[order]]
        c, _ = answers.counts(1)
        base = np.log10((c + 0.5) / (model.n_tokens + 0.5 * (model.n_types + 1)))[block.of[1]]
        return pa.table({
            "doc_id": block.docs.column("doc_id"), "held_out": block.docs.column("held_out"), "n_tokens": pa.array(np.diff(block.rows)), "n_known": pa.array(sums((c > 0).astype(np.int64)[block.of[1]], block.rows)),
            "train_tokens": pa.array(np.full(len(block.rows) - 1, model.n_tokens)), "base_score": pa.array(np.add.reduceat(base, block.rows[:-1])), "score": pa.array(np.add.reduceat(score, block.rows[:-1])),
        })

    return texts.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(evaluate, _RESULT)
