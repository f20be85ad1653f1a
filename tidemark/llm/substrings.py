"""Removal of repeated passages: fixed-block anchors find repeats, which are extended to maximal exact ones.

A window is `window` consecutive words of one document. A word is removed if a window over it stands, with the same words, in a document
of a smaller id too. A window holds, wherever it begins, one whole block of window / 2 words that its document is cut into, and that
block stands at the same offset in every copy. So:

1. Texts are cut once into pieces of whole documents, rows of a written table.
2. Reference blocks that don't overlap are indexed, and every rolling window of a block's length probes them: a piece sends its distinct hashes to ranges of
   hash, marked where they begin a block, and where more than one of its documents has them. A range answers with one bit a hash: it is an anchor if it
   begins a block somewhere and two documents have it. Hashes are cut to the bits that the number of blocks asks for; anchors by
   mistake only cost a look.
3. An anchor is extended to every window over it, by 64-bit hashes of all its words; ranges answer with the smallest document of each. Runs of windows that a
   smaller document has are the maximal exact repeats. Windows without an anchor are never sent.

No step pairs documents: what is shared by thousands is one hash of a piece, sent once for each piece, so no passage is hot. Pieces and
ranges follow the size of the texts.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A null text has no words and an empty rest. A null id counts as greater than any id. Rows of equal ids take nothing
from each other, so repeated rows fare alike. Windows are judged on the input, not on what is left. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .katz import blocks, planes, sorted_keys, unplaned
from .tables import shuffled_to, trimmed, written
from .text import NOT_SPACE, mix, split, sums

_STEP = 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 1 << 64)
_LAST = np.int64((1 << 63) - 1)
#: packed bytes of texts for one range: some two million words
_RANGE = 6 << 20
_MESSAGE = "kind string, range long, piece long, keys binary, marks binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"


def _bits(flags: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(flags).tobytes(), 1)


def _flags(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(packed), np.uint8), count=n).astype(bool)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Piece:
    """Some whole documents, their words, and hashes of runs of their words."""

    def __init__(self, row: pa.Buffer) -> None:
        self.docs = pa.ipc.open_stream(row).read_all().combine_chunks()
        self.words = split(self.docs.column("text"), NOT_SPACE, lower=False)
        self.rows, self.size = self.words.rows, np.diff(self.words.rows)
        h = self.words.hashes()
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_STEP, len(h)), dtype=np.uint64)])
        self.ids = self.docs.column("doc_id").fill_null(int(_LAST)).to_numpy()

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of k words of a document, their first words, and their documents."""
        n = np.maximum(self.size - k + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + self.rows[:-1][doc]
        back = _powers(_BACK, len(self.total))
        return mix((self.total[at + k] - self.total[at]) * back[at] + np.uint64(k)), at, doc

    def anchors(self, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of runs, where each run's is among them, first words of runs, which begin a block and which more than one document has."""
        g, at, doc = self.runs(k)
        keys, inverse = np.unique(g >> np.uint64(64 - bits), return_inverse=True)
        begins = np.zeros(len(keys), bool)
        begins[inverse[(at - self.rows[:-1][doc]) % k == 0]] = True
        # documents ascend, so a hash of one document alone has the same first and last
        first, last = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        last[inverse] = doc
        first[inverse[::-1]] = doc[::-1]
        return keys, inverse, at, begins, first != last

    def candidates(self, live: np.ndarray, inverse: np.ndarray, at: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the windows over a live anchor, their first words, and their documents."""
        hit = at[live[inverse]] if len(live) else at[:0]
        near = np.zeros(self.rows[-1] + 2, np.int64)
        np.add.at(near, np.maximum(hit - (window - k), 0), 1)
        np.add.at(near, hit + 1, -1)
        g, first, doc = self.runs(window)
        own = np.flatnonzero(np.cumsum(near)[first] > 0)
        return g[own], first[own], doc[own]

    def removed(self, first: np.ndarray, window: int) -> np.ndarray:
        """The words that windows beginning at these words cover."""
        edge = np.zeros(self.rows[-1] + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + window, -1)
        return np.cumsum(edge)[:-1] > 0

    def kept(self, gone: np.ndarray) -> pa.Array:
        """The documents' other words, joined by one space."""
        w, stays = self.words, np.flatnonzero(~gone)
        doc = np.searchsorted(self.rows, stays, side="right") - 1
        inner = np.ones(len(stays), bool)
        inner[1:] = doc[1:] == doc[:-1]
        inner[:1] = False
        data, mask = w.data.copy(), np.zeros(len(w.data) + 1, np.int8)
        # a document's last word may end where the next one's first begins
        mask[w.start[stays]] += 1
        mask[w.end[stays]] -= 1
        mask = np.cumsum(mask[:-1], dtype=np.int8) > 0
        # the byte before a word that is not its document's first is white space of that document
        gap = w.start[stays[inner]] - 1
        data[gap], mask[gap] = 0x20, True
        offsets = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[w.offsets]
        text = pa.LargeStringArray.from_buffers(len(self.size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[mask].tobytes()))
        return text.cast(pa.string())

    def spans(self, gone: np.ndarray) -> pa.Array:
        """Runs of removed words of each document, counted from its first word."""
        start, end = gone.copy(), gone.copy()
        start[1:] &= ~gone[:-1]
        end[:-1] &= ~gone[1:]
        edge = self.rows[1:-1][(self.rows[1:-1] > 0) & (self.rows[1:-1] < len(gone))]
        start[edge], end[edge - 1] = gone[edge], gone[edge - 1]
        start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        doc = np.searchsorted(self.rows, start, side="right") - 1
        base = self.rows[:-1][doc]
        each = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], ["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(self.size) + 1)), pa.int32()), each)


def _cuts(keys: np.ndarray, bits: int, n: int) -> list[tuple[int, int, int]]:
    """Range, first and last place of the sorted keys of every range that has some."""
    bounds = np.array([(b << bits) // n for b in range(1, n)], dtype=np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).tolist()
    return [(b, a, z) for b, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]


def _messages(kind: str, piece: int, rows: list[tuple[int, bytes | None, bytes]]) -> pa.Table:
    n = len(rows)
    return pa.table({"kind": pa.array([kind] * n, pa.string()), "range": pa.array([r for r, _, _ in rows], pa.int64()), "piece": pa.array([piece] * n, pa.int64()), "keys": pa.array([k for _, k, _ in rows], pa.binary()), "marks": pa.array([x for *_, x in rows], pa.binary())})


def _sent(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def _located(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, int]:
    """The messages' keys, each key's place among the distinct ones, and the number of these."""
    keys = [sorted_keys(x) for x in table.column("keys").to_pylist()]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, inverse, len(distinct)


def _replies(table: pa.Table, marks: list[bytes | None]) -> pa.Table:
    """Answers to the pieces; those without news are left out."""
    out = table.set_column(table.schema.get_field_index("keys"), "keys", pa.nulls(table.num_rows, pa.binary())).set_column(table.schema.get_field_index("marks"), "marks", pa.array(marks, pa.binary()))
    return out.select(["kind", "range", "piece", "keys", "marks"]).filter(pc.is_valid(out.column("marks")))


def _live(key: tuple, table: pa.Table) -> pa.Table:
    """Which hashes of a range are anchors: they begin a block, and two documents have them."""
    keys, inverse, n = _located(table)
    cuts = np.cumsum([0, *map(len, keys)]).tolist()
    both = [(_flags(x[8 : 8 + (a := int.from_bytes(x[:8], "little"))], len(k)), _flags(x[8 + a :], len(k))) for x, k in zip(table.column("marks").to_pylist(), keys, strict=True)]
    begins, many = (np.concatenate([x[i] for x in both]) for i in (0, 1))
    block = np.zeros(n, bool)
    block[inverse[begins]] = True
    holders = np.bincount(inverse, minlength=n) + np.bincount(inverse[many], minlength=n)
    live = (block & (holders > 1))[inverse]
    return _replies(table, [_bits(live[a:z]) if live[a:z].any() else None for a, z in zip(cuts[:-1], cuts[1:], strict=True)])


def _least(key: tuple, table: pa.Table) -> pa.Table:
    """By how much the smallest document of each window of a range lies below the asking piece's smallest."""
    keys, inverse, n = _located(table)
    own = np.concatenate([unplaned(x, "<i8")[0] for x in table.column("marks").to_pylist()])
    least = np.full(n, _LAST)
    np.minimum.at(least, inverse, own)
    below = own.view(np.uint64) - least[inverse].view(np.uint64)
    cuts = np.cumsum([0, *map(len, keys)]).tolist()
    return _replies(table, [planes(below[a:z]) if below[a:z].any() else None for a, z in zip(cuts[:-1], cuts[1:], strict=True)])


def _smallest(g: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, each one's smallest document id, and every hash's place among them."""
    keys, inverse = np.unique(g, return_inverse=True)
    low = np.full(len(keys), _LAST)
    np.minimum.at(low, inverse, ids)
    return keys, low, inverse


def _heard(table: pa.Table, kind: str) -> dict[int, bytes]:
    own = table.filter(pc.equal(table.column("kind"), kind))
    return dict(zip(own.column("range").to_pylist(), own.column("marks").to_pylist(), strict=True))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, piece_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words joined by one space) and spans (the maximal repeats, in words) for every row of docs."""
    if window < 2:
        raise ValueError("a window needs two words")
    k = window // 2
    pieces = written(blocks(docs, "false", doc_id, text, piece_bytes).withColumnRenamed("block", "piece"), "pieces")
    size = pieces.agg(F.sum(F.length("docs"))).first()[0] or 0
    n = max(2 * shuffled_to(docs.sparkSession), -(-size // _RANGE))
    bits = min(64, max(32, math.ceil(math.log2(max(size, 2) / k)) + 14))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, row in zip(batch.column("piece").to_pylist(), batch.column("docs"), strict=True):
                keys, _, _, begins, many = Piece(row.as_buffer()).anchors(k, bits)
                rows = []
                for r, a, z in _cuts(keys, bits, n):
                    first = _bits(begins[a:z])
                    rows.append((r, _sent(keys[a:z]), len(first).to_bytes(8, "little") + first + _bits(many[a:z])))
                yield from _messages("anchor", number, rows).to_batches()

    def found(piece: Piece, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        heard = _heard(answers, "anchor")
        if not heard:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, inverse, at, _, _ = piece.anchors(k, bits)
        live = np.zeros(len(keys), bool)
        for r, a, z in _cuts(keys, bits, n):
            if r in heard:
                live[a:z] = _flags(heard[r], z - a)
        return piece.candidates(live, inverse, at, k, window)

    def extend(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        piece = Piece(table.column("docs")[0].as_buffer())
        g, _, doc = found(piece, answers)
        keys, low, _ = _smallest(g, piece.ids[doc])
        return _messages("window", key[0].as_py(), [(r, _sent(keys[a:z]), planes(low[a:z])) for r, a, z in _cuts(keys, 64, n)])

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        piece = Piece(table.column("docs")[0].as_buffer())
        g, first, doc = found(piece, answers)
        keys, low, inverse = _smallest(g, piece.ids[doc])
        heard = _heard(answers, "window")
        for r, a, z in _cuts(keys, 64, n):
            if r in heard:
                low[a:z] = (low[a:z].view(np.uint64) - unplaned(heard[r], "<u8")[0]).view(np.int64)
        gone = piece.removed(first[low[inverse] < piece.ids[doc]], window)
        return pa.table({"doc_id": piece.docs.column("doc_id"), "n_words": pa.array(piece.size, pa.int64()), "n_removed": pa.array(sums(gone.astype(np.int64), piece.rows), pa.int64()), "kept": piece.kept(gone), "spans": piece.spans(gone)})

    asked = pieces.mapInArrow(trimmed(probe), _MESSAGE)
    anchors = written(asked.groupBy("range").applyInArrow(_live, _MESSAGE), "anchors")
    # pieces without an anchor have no window to ask for
    some = pieces.join(anchors.select("piece").distinct(), "piece", "left_semi")
    windows = some.groupBy("piece").cogroup(anchors.groupBy("piece")).applyInArrow(extend, _MESSAGE)
    answers = anchors.unionByName(windows.groupBy("range").applyInArrow(_least, _MESSAGE))
    return pieces.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(remove, _RESULT)


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS line, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT line, id, unnest(range(1, len(words) - 48)) AS pos, words FROM t
), windows AS (
  SELECT line, id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS name FROM starts
), least AS (
  SELECT name, min(id) AS id FROM windows GROUP BY name
), gone AS (
  SELECT w.line, list(DISTINCT p.pos) AS places FROM windows w JOIN least l ON l.name = w.name AND l.id < w.id, unnest(range(w.pos, w.pos + 50)) AS p(pos) GROUP BY w.line
), places AS (
  SELECT line, unnest(places) AS pos FROM gone
), word AS (
  SELECT line, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM t
), kept AS (
  SELECT word.line, string_agg(word.word, ' ' ORDER BY word.pos) FILTER (WHERE places.pos IS NULL) AS text, count(places.pos) AS n FROM word LEFT JOIN places ON places.line = word.line AND places.pos = word.pos GROUP BY 1
)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM t LEFT JOIN kept k ON k.line = t.line
"""


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
