"""Near copies against all pairs compared one by one."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tracewell.llm import neardup, simhash

SCHEMA = "doc_id long, text string, h string, sid int"


def text(seed, n):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def words_apart(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(data):
    """(components over pairs of the similarity within the radius, share of the pairs of the similarity within it)."""
    sets = {i: words_apart(t) for i, t in data}
    fp = dict(zip(sets, simhash.fold([neardup.shingle_set(t) for _, t in data]), strict=True))
    alike = [(a, b) for a, b in combinations(sets, 2) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    linked = [(a, b) for a, b in alike if int(fp[a] ^ fp[b]).bit_count() <= neardup.RADIUS]
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return label, len(linked) / len(alike)


def near_copies():
    """Copies with 0 to 8 words changed at the ends or inside, of bases that share a line; short texts that differ in a word."""
    rng, line, out = np.random.default_rng(4), text(7, 12), []
    for k in range(6):
        base = f"{text(100 + k, 90)} {line}".split()
        for c in range(12):
            w = list(base)
            for at in rng.integers(0, len(w), c % 9):
                w[at] = f"x{rng.integers(1 << 30)}"
            out.append(" ".join(w))
    out += ["a b c d e f g", "a b c d e f h", "a b c", "A b  c", None, "", " \t", *(f"{text(900 + i, 60)} {line}" for i in range(30))]
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("floor,block", [(neardup.FLOOR, simhash.BLOCK), (0, 8)])
def test_every_near_copy_and_no_other(spark, monkeypatch, floor, block):
    monkeypatch.setattr(neardup, "FLOOR", floor)
    monkeypatch.setattr(simhash.dealt, "__defaults__", (block, ()))
    data = near_copies()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in [*data, (3, data[3][1])]], SCHEMA)
    got = neardup.cluster(docs, dense=neardup.DENSE if floor else 0).collect()
    want, recall = brute(data)
    assert len(got) == len(data) + 1 and {r.doc_id: r.component_id for r in got} == want and recall > 0.9
    assert neardup.cluster(docs.limit(0)).count() == 0


def test_stage_takes_the_similarity(spark):
    data = near_copies()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in data] + [(None, data[0][1], "x", 1)], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, i) for i in set(brute(data)[0].values())] + [(True, 0)])


def test_counts_never_refuse_what_is_alike():
    """The bound from counts against the true similarity of random pairs of sets."""
    rng = np.random.default_rng(11)
    pairs = []
    for _ in range(400):
        both, a, b = (rng.integers(0, 1 << 63, int(k), dtype=np.uint64) for k in (rng.integers(1, 300), rng.integers(0, 60), rng.integers(0, 60)))
        pairs.append((np.unique(np.concatenate((both, a))), np.unique(np.concatenate((both, b)))))
    x, y = (np.frombuffer(b"".join(neardup.counts_of(p[k]) for p in pairs), dtype=np.uint8).reshape(-1, neardup.PARTS) for k in (0, 1))
    said = neardup.possible(x, y, np.array([len(p[0]) for p in pairs]), np.array([len(p[1]) for p in pairs]), 0.8)
    true = np.array([len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in pairs])
    assert said[true >= 0.8].all() and not said[true < 0.5].any()
