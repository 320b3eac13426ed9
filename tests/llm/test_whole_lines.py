"""Repeated lines and copies of short texts go at any length; sentences inside a line only in longer runs."""

from __future__ import annotations

import numpy as np

from tracewell.llm import passages


def text(seed, n):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def test_repeated_lines_of_any_length(spark):
    line, long = "A line of nine words that comes again here.", f"{text(70, 9)}. {text(71, 30)}"
    data = [
        (1, f"{text(1, 20)}\n{line}\n{text(2, 20)}"),
        (2, f"{line}\n{text(3, 20)}\n{long}"),
        (3, f"{text(4, 20)}\n  {line.upper()}\n{long}\n{line}"),
        (4, "short copy"), (5, "Short  copy"), (6, "漢字" * 40), (7, f"x\n{'漢字' * 40}"), (None, "of no id"), (8, "of no id"),
        (9, f"{text(5, 20)}. {line} {text(6, 20)}"), (10, "one row"), (10, "one row"), (11, None), (12, "twice\n\ntwice"),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r for r in passages.spans(docs).collect()}
    texts = dict(data)
    cut = {i: [texts[i][s.start : s.end] for s in r.spans] for i, r in got.items()}
    assert cut == {2: [line], 3: [f"{line.upper()}\n{long}\n{line}"], 5: ["Short  copy"], 7: ["漢字" * 40], 8: ["of no id"], 12: ["twice"]}
    assert got[3].removed_words == 9 + 39 + 9 and got[3].kept_in == [1, 2] and got[8].kept_in == [] and got[7].removed_words == 1
