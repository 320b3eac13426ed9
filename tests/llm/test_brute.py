"""Operators against plain versions: convolution, passages and benchmark windows."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm import decontamination, passages, toxicity


def text(seed, n, most=5000):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, most, n))


def test_pooling_against_a_plain_convolution():
    rng = np.random.default_rng(3)
    filters = [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS]
    bias = rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS))
    out = rng.normal(size=len(bias))
    m = toxicity.Model({}, np.zeros((1, toxicity.DIM)), filters, bias, out, 0.25, np.zeros(5))
    for n in (0, 1, 2, 3, 17):
        x = rng.normal(size=(n, toxicity.DIM))
        want = []
        for w, k in zip(toxicity.WIDTHS, filters, strict=True):
            for f in range(toxicity.FILTERS):
                best = max([sum(x[i + j, d] * k[j, d, f] for j in range(w) for d in range(toxicity.DIM)) for i in range(n - w + 1)], default=0.0)
                want.append(max(0.0, best + bias[len(want)]))
        assert np.allclose(m.pooled(x)[0], want) and m.logit(x) == pytest.approx(float(np.dot(want, out) + 0.25))


def test_passages_against_a_dictionary(spark):
    rng = np.random.default_rng(9)
    pool = [text(100 + k, int(rng.integers(2, 40))).capitalize() + "." for k in range(30)]
    docs = {}
    for i in range(60):
        parts = [pool[int(k)] if rng.random() < 0.4 else text(1000 + 50 * i + j, int(rng.integers(1, 30))) for j, k in enumerate(rng.integers(0, 30, rng.integers(0, 9)))]
        docs[i] = "".join(p + ["\n", " ", ". ", "\n\n"][int(rng.integers(0, 4))] for p in parts)
    first, rows = {}, defaultdict(list)
    for i, t in docs.items():  # in the order of doc_id
        found = passages.units(t)
        keys = [(k, 0, " ".join(ws)) for k, (_, _, ws) in enumerate(found)]
        for k, n in passages.lines(t, found):
            words = [w for _, _, ws in found[k : k + n] for w in ws]
            if n == 1:
                keys[k] = (k, 1, keys[k][2])
            else:
                keys.append((k, n, "\n" + " ".join(words)))
        rows[i] = [(k, covers, key) for k, covers, key in keys]
        for k, _, key in sorted(rows[i], key=lambda r: r[0]):
            first.setdefault(key, (i, k))
    want = {}
    for i, keys in rows.items():
        found = passages.units(docs[i])
        late = [(k, covers) for k, covers, key in keys if first[key] != (i, k)]
        whole = {k + j for k, covers in late if covers for j in range(covers)}
        some = sorted({k for k, _ in late} | whole)
        gone, run = set(whole), []
        for k in [*some, None]:
            if run and (k is None or k != run[-1] + 1):
                if sum(len(found[x][2]) for x in run) >= passages.RUN_WORDS:
                    gone |= set(run)
                run = []
            run = [*run, k] if k is not None else []
        spans, gone = [], sorted(gone)
        for k in gone:
            if spans and spans[-1][2] == k - 1:
                spans[-1] = (spans[-1][0], found[k][1], k)
            else:
                spans.append((found[k][0], found[k][1], k))
        if spans:
            want[i] = [(s, e) for s, e, _ in spans]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in passages.spans(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == want


def alike(a, b):
    """Weighted Jaccard similarity of two runs of words by their shingles."""
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_leaks_against_every_window(spark):
    rng = np.random.default_rng(17)
    items = {k: text(300 + k, int(rng.integers(8, 70))).split() for k in range(8)}
    docs = {}
    for i in range(70):
        w = list(items[i % 8])
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(w)))
            kind = rng.integers(0, 3)
            w[at : at + (kind != 1)] = ["x" + str(rng.integers(1 << 30))] if kind else []
        lo, hi = (int(rng.integers(0, 1 + len(w) // 12)) for _ in range(2))
        w = w[lo : len(w) - hi]
        docs[i] = text(600 + i, int(rng.integers(0, 30))).split() + w + text(800 + i, int(rng.integers(0, 30))).split()
    best, inside = {}, {}
    for i, d in docs.items():
        for k, item in items.items():
            n = len(item)
            inside[i, k] = max(alike(d[s : s + n], item) for s in range(max(1, len(d) - n + 1)))
            cut = [d[:m] for m in range(5, n)] + [d[-m:] for m in range(5, n)]  # the item reaches beyond the text's ends
            best[i, k] = max([inside[i, k], *(alike(v, item) for v in cut)])
    got = decontamination.leaks(spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r.similarity for r in got}
    assert all(0.8 <= s <= best[p] + 1e-9 for p, s in found.items())
    want = {p for p, s in inside.items() if s >= 0.8 - 1e-9}
    assert len(want) > 20 and want <= set(found), sorted((p, inside[p]) for p in want - set(found))
