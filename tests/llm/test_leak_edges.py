"""Benchmark items that the beginning or the end of a text cuts short."""

from __future__ import annotations

import numpy as np
import pytest

from tracewell.llm import decontamination


def text(seed, n):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def test_items_cut_by_a_texts_ends(spark):
    item = [text(40, 60), text(41, 20)]
    bench = spark.createDataFrame(list(enumerate(item)), "item_id long, text string")
    a, b = item[0].split(), item[1].split()
    data = {
        1: f"{text(1, 40)} {' '.join(a[:-1])}",
        2: f"{text(2, 40)} {' '.join(a[:-2])}",
        3: " ".join(a[:-2]),
        4: " ".join(a[1:]),
        5: " ".join(a[:30] + a[31:]),
        6: f"{text(3, 40)} {' '.join(a[:50] + a[51:])}",
        7: f"{' '.join(a[11:])} {text(4, 40)}",  # 45 of 56 shingles
        8: f"{text(5, 40)} {' '.join(a[:-11])}",
        9: f"{text(6, 40)} {' '.join(a[:-12])}",  # 44 of 56: below 0.8
        10: f"{text(7, 3)} {' '.join(b[:-3])}",
        11: " ".join(b[:-4]),
    }
    docs = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, bench).collect()}
    assert set(got) == {*((i, 0) for i in range(1, 9)), (10, 1)}
    assert got[2, 0].similarity == pytest.approx(54 / 56) and got[2, 0].start == 40 and got[7, 0].start == 0 and got[8, 0].similarity == pytest.approx(45 / 56)
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [9, 11]
