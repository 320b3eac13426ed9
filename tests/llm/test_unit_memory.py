"""Digests leave Python in small batches, and removal of passages writes no files of its own."""

from __future__ import annotations

import pyarrow as pa

from tracewell.llm import common, passages


def test_digests_leave_in_small_batches():
    texts = [None, "", *(f"line {k} of text\n" * (1 + k % 90) for k in range(1500))]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array([7] * len(texts), pa.int64()), pa.array(texts)], names=["doc_id", "row", "text"])
    got = list(passages._digest(iter([batch, batch.slice(0, 300)])))
    assert max(b.num_rows for b in got) < 20_000
    alone = [r for b in (batch, batch.slice(0, 300)) for k in range(b.num_rows) for x in passages._digest(iter([b.slice(k, 1)])) for r in x.to_pylist()]
    assert [r for b in got for r in b.to_pylist()] == alone and len(alone) > 60_000


def test_removal_writes_no_files(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, f"{text}\nfirst"), (2, f"second\n{text}"), (3, f"{text}. third")], "doc_id long, text string")
    stored = []
    monkeypatch.setattr(common, "new_path", lambda spark, name, f=common.new_path: stored.append(name) or f(spark, name))
    out = passages.spans(docs)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # by digest, then by text
    assert {r.doc_id for r in out.collect()} == {2, 3} and not stored
