"""Secret scans over an incremental blob ledger.

Every historical version of a path's content is addressed by its SHA-256. A blob is scanned once per version of the
rules: pairs of blob and rule version that the ledger holds are skipped, copies are scanned once, and findings are joined back
to all paths and versions that hold the blob. A null content counts as empty. Offsets are code points, ends exclusive.
Repeated rows get equal findings; an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import HOT, looked_up, shuffled_to, trimmed, whole_rows, written

RULE_VERSION = 1
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "jwt", "github")
_ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MORE = (
    ("pem", (b"-----BEGIN ",), re.compile(r"(?P<before>)-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?")),
    # only a run's beginning starts a match, and its first eyJ is the only one that can hold: each run is read once
    ("jwt", (b"eyJ",), re.compile(r"(?<![A-Za-z0-9_-])(?>(?P<before>[A-Za-z0-9_-]*?)eyJ)[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")),
    ("github", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), re.compile(r"(?P<before>)gh[pousr]_[A-Za-z0-9]{36,}")),
)
SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind. Kinds are found on their own; spans of different kinds may overlap."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for kind, _, rule in _MORE:
        found += [(kind, m.end("before"), m.end()) for m in rule.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def may_hold(raw: bytes) -> bool:
    """Whether a text has what every rule's match must have. Texts without are known to be clean and need no scan."""
    low = raw.lower()
    return any(x in low for x in _HINTS) or b"AKIA" in raw or any(x in raw for _, hints, _ in _MORE for x in hints) or _HEX_RUN.search(raw) is not None


_HEX_RUN = re.compile(rb"[0-9a-f]{24}")


def _addressed(docs: DataFrame, content: str) -> DataFrame:
    """_doc: the row; _blob: the SHA-256 of its content in hexadecimal, null where no rule could match; _spread: to deal out rows by."""

    def address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            doc = batch.column("_doc")
            raw = [x.encode() if x else b"" for x in pc.struct_field(doc, content).to_pylist()]
            names = [hashlib.sha256(x).hexdigest() if may_hold(x) else None for x in raw]
            yield pa.record_batch([doc, pa.array(names, pa.string()), pa.array([(number << 20) + i for i in range(len(raw))], pa.int64())], ["_doc", "_blob", "_spread"])

    packed = whole_rows(docs)
    return packed.mapInArrow(trimmed(address), T.StructType([*packed.schema.fields, T.StructField("_blob", T.StringType()), T.StructField("_spread", T.LongType())]))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each blob of a batch once with its rows, so that a hot blob is few rows; its text only the first time and where a rule could match."""
    seen: set[bytes] = set()
    for batch in batches:
        rows: dict[bytes, int] = {}
        texts: dict[bytes, str] = {}
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            name = hashlib.sha256(raw).digest()
            rows[name] = rows.get(name, 0) + 1
            if name not in seen:
                seen.add(name)
                if may_hold(raw):
                    texts[name] = text
        yield pa.record_batch([pa.array([x.hex() for x in rows], pa.string()), pa.array([texts.get(x) for x in rows], pa.string()), pa.array(list(rows.values()), pa.int64())], ["blob", "text", "rows"])


_OUT = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs are dealt by address, so a task sees all copies of a blob and scans the first that has its text."""
    rows: dict[str, int] = {}
    found: dict[str, list] = {}
    for batch in batches:
        for name, text, n in zip(*(batch.column(c).to_pylist() for c in ("blob", "text", "rows")), strict=True):
            rows[name] = rows.get(name, 0) + n
            if text is not None and name not in found:
                found[name] = scan(text)
    names = list(rows)
    for i in range(0, len(names), 10_000):
        part = names[i : i + 10_000]
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in found.get(x, ())] for x in part]
        yield pa.record_batch([pa.array(part, pa.string()), pa.array([rows[x] for x in part], pa.int64()), pa.array(spans, _OUT)], ["blob", "rows", "spans"])


def _findings(versions: DataFrame, content: str, ledger: DataFrame | None, rule_version: int) -> DataFrame:
    """blob, rows, spans of the unseen blobs; rows: how many versions hold it."""
    blobs = versions.select(F.col(content).alias("text")).mapInArrow(trimmed(_once), "blob string, text string, rows long")
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob").distinct(), "blob", "left_anti")
    dealt = blobs.repartition(shuffled_to(versions.sparkSession), "blob")
    return dealt.mapInArrow(trimmed(_scanned), f"blob string, rows long, spans {SPANS}")


def new_findings(versions: DataFrame, content: str = "text", ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """blob, rule_version, spans for the blobs that the ledger has not under this rule version: what to append to it.

    A blob without secrets gets a row with no spans, so it is not scanned again.
    """
    return _findings(versions, content, ledger, rule_version).select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def findings(versions: DataFrame, path: list[str], content: str = "text", ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """Every row's path columns and blob with the spans found in it, now or by an earlier scan.

    The join carries addresses and spans, no contents; the findings of a blob that is much of the table go to all tasks.
    """
    known = written(new_findings(versions, content, ledger, rule_version), "found")
    if ledger is not None:
        known = known.unionByName(ledger.where(F.col("rule_version") == rule_version).select("blob", "rule_version", "spans").dropDuplicates(["blob"]))
    addressed = written(versions.select(*path, F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("blob")), "addressed")
    return looked_up(addressed, known, "blob").select(*path, "blob", "rule_version", "spans")


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The rows with every found span replaced by the mask, other columns as they are; null stays null.

    Only rows in which a rule could match go to the join with the findings; the others pass in the scan's own tasks.
    """
    rows = _addressed(docs, text)
    found = written(_findings(docs, text, None, RULE_VERSION), "found")
    total = found.agg(F.sum("rows")).first()[0] or 0
    hit = found.where(F.size("spans") > 0).select(F.col("blob").alias("_blob"), "rows", F.col("spans").alias("fact"))
    cut = looked_up(rows.where("_blob is not null"), hit.drop("rows"), "_blob", hit.where(F.col("rows") > HOT * total).select("_blob"), F.col("_spread"))
    cut = cut.withColumn("_new", F.when(F.col("fact").isNotNull(), _cut(F.col("_doc")[text], F.col("fact"), mask)).otherwise(F.col("_doc")[text]))
    as_before = [F.col("_doc")[c].alias(c) for c in docs.columns]
    return rows.where("_blob is null").select(*as_before).union(cut.select(*[F.col("_new").alias(c) if c == text else x for c, x in zip(docs.columns, as_before, strict=True)]))


def _cut(text: F.Column, spans: F.Column, mask: str) -> F.Column:
    """The text with the union of the spans replaced: a fold over spans in order of start, carrying text so far and place."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: F.Column, s: F.Column) -> F.Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["end"] <= acc["at"], acc).when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), s["end"].alias("at"))).otherwise(F.struct(F.concat(acc["out"], gap, F.lit(mask)).alias("out"), s["end"].alias("at")))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def with_length(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows with `length` set to the code points of the text, where the table has such a column."""
    return docs.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length in docs.columns else docs
