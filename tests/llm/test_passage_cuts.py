"""Shared passages hold matched runs in any context, and whole lines go at any length."""

from __future__ import annotations

import numpy as np

from tracewell.llm import passages


def shared_run(passage, contexts):
    """Words of the longest run of units that stand in the passage in both texts."""
    found = []
    for before, after in contexts:
        whole = " ".join([*before, *passage, *after])
        at = len(" ".join([*before, ""])) if before else 0
        end, n = at + len(" ".join(passage)), len(before)
        cuts, k = {}, 0
        for s, e, ws in passages.units(whole):
            if s >= at and e <= end:
                cuts[k - n] = (tuple(ws), k - n + len(ws))
            k += len(ws)
        found.append(cuts)
    best = 0
    for k in found[0]:
        n, at = 0, k
        while at in found[0] and found[0][at] == found[1].get(at):
            n, at = n + len(found[0][at][0]), found[0][at][1]
        best = max(best, n)
    return best


def test_every_passage_of_fifty_words_holds_a_run():
    rng = np.random.default_rng(2)
    for k in range(6000):
        words = lambda n, share, few: [f"w{x}" + "." * (rng.random() < share) for x in rng.integers(0, few, n)]
        share, few = (0, 0.02, 0.1, 0.3, 0.6)[k % 5], (5000, 30)[k % 2]
        passage = words(50, share, few)
        if k % 3 == 0:
            passage[:20] = [w.rstrip(".") for w in passage[:20]]
        contexts = [(words(int(rng.integers(0, 30)), share, few), words(int(rng.integers(0, 30)), share, few)) for _ in range(2)]
        assert shared_run(passage, contexts) >= passages.RUN_WORDS
