"""The pipeline on a small folder of tables: stages take effect and keep the columns of documents."""

import re

import numpy as np

import corpus_pipeline
from tracewell.llm import common


def text(seed, n):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def test_stages(spark, tmp_path):
    item = text(999, 30)
    docs = [(i, "the and " + text(i, 60), "en", "abc"[i % 3], 1) for i in range(120)]
    docs += [(200 + i, " ".join(x + "###" for x in text(200 + i, 60).split()), "en", "a", 1) for i in range(40)]
    docs += [(300 + i, docs[i][1], "en", "b", 1) for i in range(10)] + [(400, f"{text(400, 20)} {item} {text(401, 9)}", "en", "c", 1), (401, None, "en", None, 0)]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(d[0], int("###" not in (d[1] or "")), 0) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now, seen = common.read(spark, sf, "documents"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.stored(stage(spark, now, sf), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = [r.doc_id for r in out.collect()]
        now = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-dedup", "decontamination", "mixing", "sharding"]
    assert len(set(seen["quality"]) & set(range(200, 240))) <= 4 and len(set(seen["quality"]) & set(range(120))) >= 115
    assert not set(seen["near-dedup"]) & set(range(300, 310)) and set(seen["near-dedup"]) >= set(seen["quality"]) & set(range(120))
    assert 400 in seen["near-dedup"] and set(seen["near-dedup"]) - set(seen["decontamination"]) == {400}
    assert max(seen["mixing"].count(i) for i in seen["mixing"]) <= 2 and sorted(seen["sharding"]) == sorted(seen["mixing"])
    words = sum(len(re.findall(r"\S+", d[1] or "")) for d in docs if d[0] in set(seen["decontamination"]))
    assert abs(sum(len(r.text.split()) for r in now.collect()) - 1.5 * words) < 150
    for s in range(16):
        slots = sorted(r.slot for r in now.where(f"shard = {s}").collect())
        assert slots == list(range(len(slots)))


def test_stages_hold_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows, nulls and columns named like the operators' own, through every stage."""
    sf = str(tmp_path / "sf")
    rows = [(i, "the and " + text(i, 30), "en", "ab"[i % 2], 7, f"mine {i}", True) for i in range(30)]
    rows += [rows[3], rows[3], (None, "the and " + text(77, 20), None, None, None, "null id", None), (90, None, None, None, 1, "null text", False)]
    names = "doc_id long, text string, lang string, source string, size int, shard string, taken boolean"
    spark.createDataFrame([(1, text(5000, 30))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    given = {(r[0], r[5]): r for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        for docs in (spark.createDataFrame(rows, names), spark.createDataFrame([], names)):
            out = stage(spark, docs, sf)
            got = out.collect()
            if name != "sharding":
                assert out.columns == docs.columns
                assert all(tuple(r) == given[r.doc_id, r.shard] for r in got)
            assert bool(got) == bool(docs.limit(1).count()) or name == "quality"
            if name == "near-dedup" and got:
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [*((False, i) for i in range(30)), (False, 90), (True, 0)]
            if name == "decontamination" and got:
                assert len(got) == len(rows)
            if name == "mixing" and got:
                words = {}
                for r in rows:
                    words[r[3]] = words.get(r[3], 0) + len((r[1] or "").split())
                taken = {}
                for r in got:
                    taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
                assert all(taken[k] <= 2 * words[k] for k in taken) and abs(sum(taken.values()) - 1.5 * sum(words.values())) < 60
