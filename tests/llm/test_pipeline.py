"""The corpus pipeline stage by stage on documents with every odd case, each stage against a plain version."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import secrets
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.tables import written

from .test_word_operators import linked, overlap


@pytest.fixture(scope="module")
def folder(spark, docs, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def test_stages(spark, docs, folder):
    kept = {"documents": spark.read.parquet(f"{folder}/documents.parquet")}
    before = kept["documents"]
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = before = written(stage(spark, before, folder), name)
        if name != "packing":
            assert before.columns == docs.columns
    rows = lambda name: [(r.doc_id, r.text, r.source) for r in kept[name].collect()]
    assert set(rows("toxicity")) <= set(rows("documents"))
    first = rows("toxicity")
    classes = linked([(i, t, s) for i, (_, t, s) in enumerate(first)])
    assert len(rows("near_duplicates")) == len({c for _, _, c in classes})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [r for r in rows("near_duplicates") if not overlap(r[1], items)[-1]]
    assert sorted(clean, key=repr) == sorted(rows("decontamination"), key=repr)
    assert len(rows("secrets")) == len(clean)
    found = {d: secrets.scan(t) for d, t, _ in clean if t}
    assert any(found.values())
    for r in kept["secrets"].collect():
        assert r.n_chars == (len(r.text) if r.text is not None else None)
        assert ("[secret]" in (r.text or "")) == bool(found.get(r.doc_id))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = sorted((d, len(x), zlib.crc32(np.array(x[:2048], "<u4").tobytes())) for d, t, _ in rows("secrets") if d is not None and (x := [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]))
    pieces = [r for r in kept["packing"].collect() if r.doc_id is not None]
    total = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {d: n for d, n, _ in ids}
    assert {(r.doc_id, r.ids_crc32) for r in pieces if r.piece == 0} == {(d, c) for d, _, c in ids}


def test_run_returns_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_no_documents(spark, folder, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_smallest_id_of_a_group_stays(spark, clashing, rows):
    """Ids, copies and repeated rows; only null ids leave the choice among equal texts open."""
    from tidemark.llm import jaccard

    kept = sorted((r.doc_id for r in jaccard.one_of_each(clashing).collect()), key=repr)
    lows = {c for _, n, c in linked(rows) if n}
    empty = [d for d, n, _ in linked(rows) if not n]
    assert kept == sorted([*lows, *empty], key=repr)
