"""The corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
import xxhash

from tracewell.llm import common, decontamination, learn, licenses, mixing, passages, quality, sharding, simhash, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, key string, row int"


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def table(spark, rows):
    """(doc_id, text, source) rows, with columns that are named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", "y", 2) for i, t, s in rows], SCHEMA)


def rows():
    base = text(1, 300).split()
    near = " ".join(base[:150] + ["other"] + base[151:])
    out = [(1, " ".join(base), "b"), (2, near, "a"), (3, None, None), (4, "", "a"), (5, "  \t", ""), (6, "one", "a"), (7, "one", "b"), (8, text(8, 30_000), "a"), (2, near, "a"), (None, text(9, 40), "a"), (11, "Ünï cödé 漢字 🙂", "ä")]
    return out + [(100 + i, text(50 + i % 7, 60), "ab"[i % 2]) for i in range(40)]


# -- sharding


def test_sharding(spark):
    got = sharding.shard_documents(table(spark, rows()), 4, 64).collect()
    assert len(got) == len(rows())
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.shard_documents(table(spark, []), 4, 64).count() == 0


def test_slot_maps(spark, tmp_path):
    rng = np.random.default_rng(3)
    first = sharding.SlotMap.first(16)
    weight = {i: int(w) for i, w in enumerate(rng.pareto(1.5, sharding.SLOTS) * 1000)}
    m = first.rebalanced(weight)
    load = [sum(weight[i] for i, s in enumerate(m.shard_of) if s == k) for k in range(16)]
    assert max(load) - min(load) <= max(1, sum(load) * 0.001) and m.version == 1
    g = m.grown(17)
    assert all(a == b or b == 16 for a, b in zip(m.shard_of, g.shard_of, strict=True)) and g.shard_of.count(16) == sharding.SLOTS // 17
    path = str(tmp_path / "map")
    sharding.save(spark, [first, m], path)
    sharding.save(spark, [g], path)
    assert sharding.load(spark, path) == g and sharding.load(spark, path, 1) == m


def test_stored_map_is_edited(spark, tmp_path):
    """Against a plain recount: the newest map decides, a balanced one stays, new sizes add one version that moves few slots."""
    path = str(tmp_path / "map")
    docs = table(spark, [(i, "x" * (i % 97 * 7), "a") for i in range(1500)])

    def run(docs, n=4):
        got = sharding.shard_documents(docs, n, 64, path).collect()
        m = sharding.load(spark, path)
        assert all(r.shard == m.shard_of[r.vslot] and r.map_version == m.version for r in got)
        for s in range(n):
            mine = sorted((r.vslot, r.doc_id) for r in got if r.shard == s)
            assert [(r.vslot, r.doc_id) for r in sorted((r for r in got if r.shard == s), key=lambda r: r.slot)] == mine
            assert sorted(r.slot for r in got if r.shard == s) == list(range(len(mine)))
        load = [sum(r.size for r in got if r.shard == s) for s in range(n)]
        assert max(load) - min(load) <= 0.02 * sum(load)
        return {r.doc_id: r.shard for r in got}, m

    one, first = run(docs)
    two, again = run(docs)
    assert one == two and first == again and sharding.versions(spark, path) == [0, 1]
    more = docs.union(table(spark, [(2000 + i, "y" * 400, "a") for i in range(300)]))
    three, edited = run(more)
    assert edited.version == 2 and sharding.load(spark, path, 1) == first
    assert sum(a != b for a, b in zip(first.shard_of, edited.shard_of, strict=True)) <= 16
    _, grown = run(more, 5)
    assert grown.n_shards == 5 and sharding.versions(spark, path) == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="stored already"):
        sharding.save(spark, [first], path)
    clash = docs.select("doc_id", "text", F.lit("mine").alias("shard"), F.lit(1).alias("size"), F.lit("k").alias("law"))
    out = sharding.shard_documents(clash, 4, 64, keep=("doc_id", "text", "shard", "size", "law"))
    assert out.columns.count("shard") == 1 and out.where("law = 'bytes'").count() == 1500


# -- mixing


@pytest.mark.parametrize("seed", range(40))
def test_knapsack(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted({int(x) for x in rng.integers(1, 40, 5)})
    counts = [int(x) for x in rng.integers(0, 4, len(lengths))]
    budget = int(rng.integers(1, 120))
    best = min((sum(a * b for a, b in zip(c, lengths, strict=True)) for c in product(*(range(n + 1) for n in counts))), key=lambda s: (abs(s - budget), s))
    got = mixing.knapsack(lengths, counts, budget)
    assert sum(a * b for a, b in zip(got, lengths, strict=True)) == best and all(a <= b for a, b in zip(got, counts, strict=True))


def test_fit_large():
    rng = np.random.default_rng(5)
    lengths = sorted({int(x) for x in rng.lognormal(6, 1, 3000)} - {0})
    counts = [int(x) for x in rng.integers(1, 400, len(lengths))]
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    for share in (0.0, 0.01, 0.37, 1.0, 1.63, 2.0):
        copies, extra = mixing.fit(lengths, counts, share * total)
        assert abs(copies * total + sum(a * b for a, b in zip(lengths, extra, strict=True)) - share * total) <= 1
        assert all(0 <= e <= c for e, c in zip(extra, counts, strict=True)) and copies + (max(extra) > 0) <= 2


def test_mix(spark):
    data = rows()
    got = mixing.mix(table(spark, data)).collect()
    assert len(got) == len(data) and {f.name for f in mixing.mix(table(spark, data)).schema} >= set(SCHEMA.split()[::2]) & {"doc_id", "text", "lang", "source", "n_chars", "fp", "row"}
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in data)
    source = defaultdict(int)
    for r in got:
        source[r.source] += r["size"]
        assert r["size"] == 0 or r.taken in (0, r["size"], 2 * r["size"])
        assert r.taken <= 2 * r["size"]
    order = sorted(source, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(source.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * source[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * source[s]
            left -= target[s]
        free -= over
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == source[r.source] and r.target == pytest.approx(target[r.source])
    for s in order:
        reach = 1
        for r in got:
            if r.source == s:
                reach |= reach << r["size"]
        copies, rest = divmod(round(target[s]), max(source[s], 1))
        best = min(abs(k - rest) for k in range(2 * source[s] + 1) if reach >> k & 1)
        assert abs(taken[s] - target[s]) <= best + 1 and copies <= 2
    again = mixing.mix(table(spark, data)).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    assert mixing.mix(table(spark, [])).count() == 0
    out = mixing.mixed(table(spark, data))
    assert out.columns == table(spark, data).columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in got)


def test_ranks_over_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 7)
    got = mixing.mix(table(spark, [(i, "a b c", "s") for i in range(100)] + [(1000, text(1, 100), "t")])).collect()
    s = [r for r in got if r.source == "s"]
    assert abs(sum(r.taken for r in s) - s[0].target) <= 3 and len(s) == 100


# -- SimHash


def brute_fp(t, n):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def components(fps, radius):
    label = {i: i for i in fps}
    while True:
        new = {i: min(label[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= radius) for i in fps}
        if new == label:
            return label
        label = new


def test_fingerprints():
    for t in ["", None, "a", "A b", "x y z w v", "Ünï A É b\tc\nd", text(4, 500)]:
        assert simhash.fingerprint((t or "").encode() if t is not None else None) == brute_fp(t, 4)


@pytest.mark.parametrize("radius,seed", [(0, 1), (1, 2), (4, 3), (7, 4)])
def test_links_are_complete(spark, radius, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 1 << 63, 150)]
    fps = set(base)
    for b in base[:60]:
        for _ in range(6):
            x = b
            for bit in rng.integers(0, 64, radius + 1):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = {i: f for i, f in enumerate(sorted(fps))}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()], "fp long, rep long")
    want = components(fps, radius)
    for small, block in ((simhash.SMALL_RUN, simhash.BLOCK), (1, 5)):
        monkeypatch.setattr(simhash, "SMALL_RUN", small)
        comp = {r.node: r.component for r in common.components(simhash.links(df, radius, block)).collect()}
        assert {i: comp.get(i, i) for i in fps} == want


@pytest.mark.parametrize("n", [1000, 10**6, 10**9])
def test_plans_keep_the_pigeonhole(n):
    rng = np.random.default_rng(n % 97)
    bits = rng.integers(0, 2, (2000, 64))
    both = (bits.T @ bits).astype(float) * (n / 2000)
    for radius in (0, 3, 4, 7):
        plan = simhash.plan(n, both, radius)
        assert sum(t + 1 for _, t in plan) == radius + 1 and len({b for bits, _ in plan for b in bits}) == sum(len(b) for b, _ in plan)


def test_cluster(spark):
    data = rows()
    got = simhash.cluster(table(spark, data)).collect()
    assert len(got) == len(data)
    fps = {i: brute_fp(t, 4) for i, t, _ in data if i is not None}
    want = components(fps, 4)
    for r in got:
        if r.doc_id is not None:
            assert (r.fp % (1 << 64), r.component_id) == (fps[r.doc_id], want[r.doc_id])
    assert simhash.cluster(table(spark, [])).count() == 0
    kept = simhash.dedup(table(spark, data))
    assert kept.columns == table(spark, data).columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter([*set(want.values()), None])


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(500, 400), (400, 450), (7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 400: 400, 450: 400, 500: 400}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- token shards


def test_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    data = rows() + [(200, " a  b \n\n c\t ", "a"), (201, "don't x's   y", "a"), (-5, "neg", "a"), (-(1 << 63), "least", "a"), ((1 << 63) - 1, "greatest", "a"), (202, "a <|endoftext|> b, c", "a"), (203, "x\x00, y", "a")]
    path = str(tmp_path / "shards")
    tokens.write(table(spark, data), path, shard_bytes=20_000)
    got = sorted(tokens.scan(spark, path).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(tokens.tokenizer_path())
    want = {(i, x): np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, x, _ in data}
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(got) == len(data) and len({r.shard for r in got}) > 2
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(want[i, x]), zlib.crc32(want[i, x].tobytes())) for i, x, _ in data)
    opened = [tokens.Shard(bytes(r.content)) for r in tokens.shards(spark, path).collect()]
    for key in {i for i, _, _ in data}:
        found = sorted(d.tolist() for s in opened for d in s.get(key))
        assert found == sorted(want[i, x].tolist() for i, x, _ in data if i == key)
    assert not any(s.get(k) for s in opened for k in range(5000, 7000))
    assert sum(50256 in d.tolist() for s in opened for d in s.get(202)) == 1
    empty = str(tmp_path / "none")
    tokens.write(table(spark, []), empty)
    assert tokens.scan(spark, empty).count() == 0


def test_encoder_caches_restart(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "UNITS", 50)
    t, e = Tokenizer.from_file(tokens.tokenizer_path()), tokens.Encoder(tokens.tokenizer_path())
    texts = [text(i, 40) + ". It's, (so)!" for i in range(600)]
    alphabet = ["a", "b", "Z", "é", "1", " ", " ", "  ", "\n", ".", ",", "'s", "\x00", "<|endoftext|>", "_", "漢", "\u0301", "\xa0", "\t", "?", "Ġ", "the", "\u2026", "²", "\x1c", "🙂"]
    rng = np.random.default_rng(8)
    texts += ["".join(alphabet[k] for k in rng.integers(0, len(alphabet), rng.integers(0, 15))) for _ in range(5000)]
    assert [np.frombuffer(b, dtype="<u2").tolist() for b in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_learns_little(monkeypatch):
    """Units that keep coming stay known however many rare ones pass, and words beside marks and line feeds aren't learned anew."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "UNITS", 4000)
    t, e = Tokenizer.from_file(tokens.tokenizer_path()), tokens.Encoder(tokens.tokenizer_path())
    learned, learn = Counter(), e.learn
    monkeypatch.setattr(e, "learn", lambda units: (learned.update(units), learn(units)))
    rng = np.random.default_rng(11)
    common = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600)]
    between = [" "] * 12 + [", ", ".\n", ".*** ", "\n", "!! ", "%%%\n", "...\n\n", "-", "'s "]
    for k in range(30):
        texts = ["".join(common[i] + between[j] for i, j in zip(rng.integers(0, 600, 60), rng.integers(0, 21, 60), strict=True)) + "x" + " ".join(rng.bytes(6).hex() for _ in range(4)) for _ in range(256)]
        assert [np.frombuffer(b, dtype="<u2").tolist() for b in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)], k
    again = sum(learned[u] - 1 for u in common)
    assert all(learned[u] for u in common) and again <= 60, again
    assert not any("\n" in u.strip("\0\n") and "\n\n" not in u for u in learned)
    marks = ["a", "Bc", "é", "7", "_", "'", "'s", ".", "***", "-", "$", "\n", "\n", "\n\n", "\r\n", "\t", " ", " ", "  ", "\xa0", "\u2028", "\x1c", "²", "漢", "Ċ", "Ġ", "\x00", "<|endoftext|>"]
    texts = ["".join(marks[k] for k in rng.integers(0, len(marks) - 2 * (n % 8 > 0), rng.integers(0, 24))) for n in range(20_000)]
    assert [np.frombuffer(b, dtype="<u2").tolist() for b in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_keeps_many():
    """Units of a large vocabulary are learned once, not each time they come again."""
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokens.tokenizer_path()), tokens.Encoder(tokens.tokenizer_path())
    words = ["".join(w) for w in product("abcdefghijklmnopqrstuvwxyz", repeat=4)]
    texts = [" ".join(words[at : at + 200]) for at in range(0, len(words), 200)]
    first, learned, learn = e.encode(texts), [], e.learn
    e.learn = lambda units: (learned.append(len(units)), learn(units))
    assert e.encode(texts) == first and sum(learned) == 0, sum(learned)
    assert [np.frombuffer(b, dtype="<u2").tolist() for b in first[::200]] == [x.ids for x in t.encode_batch(texts[::200], add_special_tokens=False)]


@pytest.mark.parametrize(("units", "window"), [(1_000_000, 1 << 18), (60, 64), (2000, 1), (1_000_000, 300)])
def test_encoder_windows(monkeypatch, units, window):
    """Ids are the library's wherever windows end, however small the cache, for long units and every kind of character."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "UNITS", units)
    monkeypatch.setattr(tokens, "WINDOW", window)
    t, e = Tokenizer.from_file(tokens.tokenizer_path()), tokens.Encoder(tokens.tokenizer_path())
    points = [c for c in [*range(0x3100), *range(0x3100, 0x110000, 211)] if not 0xD800 <= c < 0xE000]
    texts = [f"x{chr(c)}. {chr(c)} y{chr(c)}\nz,{chr(c)}!" for c in points[:: 1 if units > 2000 else 40]]
    texts += ["", " ", "", "a" * 3000 + " b. " + "漢字" * 2000, "x. " * 3000, " " * 2000 + "b", "<|endoftext|>", "a <|endoftext|><|endoftext|>b", "<|endof", "text|>", " \x00y", "\x00y y", "z\n\x00y\nx", "w" * 15 + " " + "w" * 14 + "\n" + "w" * 16 + " " + "w" * 80]
    for _ in range(2):
        assert [np.frombuffer(b, dtype="<u2").tolist() for b in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert e.encode([]) == []


def test_shard_parts(monkeypatch):
    """A shard's rows come in parts of few rows and bytes, from slices of batches with nulls, in either kind of string."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "PART_ROWS", 3)
    monkeypatch.setattr(tokens, "PART_BYTES", 40)
    t = Tokenizer.from_file(tokens.tokenizer_path())
    data = [(None, "no key"), (1, None), (2, ""), (2, "two, twice"), (3, "three " * 30), (4, None), (5, "é. <|endoftext|>"), (6, "x" * 41), (7, "y"), (8, "z"), (9, "w"), (10, "v")]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.record_batch([pa.array([0, *(k for k, _ in data)], pa.int64()), pa.array(["before", *(x for _, x in data)], kind)], names=["doc_id", "text"])
        out = list(tokens._shard(tokens.tokenizer_path())(iter([batch.slice(1, 0), batch.slice(1, 7), batch.slice(8)])))
        assert max(b.num_rows for b in out) == 3
        s = tokens.Shard(b"".join(v + b"\0\0" for b in out for v in b.column(0).to_pylist()))
        assert s.keys.tolist()[1:] == [k for k, _ in data[1:]] and s.nulls == 1
        assert [s.document(i).tolist() for i in range(len(data))] == [[*t.encode(x or "", add_special_tokens=False).ids, 0] for _, x in data]


# -- licences


def test_licenses(spark):
    mit = dict(licenses.SENTENCES[::-1])
    grant = next(s for i, s in licenses.SENTENCES if i == "MitGrant")
    notice = next(s for i, s in licenses.SENTENCES if i == "MitNotice")
    data = [
        (1, "Words.\nReleased under the MIT License.\nMore words."),
        (2, "Licensed under the Apache\nLicense, Version 2.0. You may not use this file except in compliance with the License."),
        (3, f"# {grant[0].upper()}{grant[1:]}:\n#\n# {notice}."),
        (4, "You may not use this file except in compliance with the License."),
        (5, None), (6, ""), (7, "no licence at all. free software is nice"),
        (8, "All rights reserved. Licensed under CC BY-NC 4.0. " * 3), (8, "SPDX-License-Identifier: MIT"), (None, "Released under the MIT License"),
        (9, text(3, 20_000) + ".\nThis work is licensed under the GNU General Public License, version 3.\n" + text(4, 20_000)),
        (10, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ]
    got = defaultdict(list)
    for r in licenses.scan(spark.createDataFrame([(*x, "q") for x in data], "doc_id long, text string, seq string")).collect():
        got[r.doc_id].append((r.licenses, r.status))
    assert mit and got[1] == [("MIT", "licensed")] and got[2] == [("Apache-2.0", "licensed")] and got[3] == [("MIT", "licensed")]
    assert got[4] == [("", "unknown")] and got[5] == got[6] == got[7] == [("", "none")]
    assert sorted(got[8]) == [(",".join(["AllRightsReserved", "CC-BY-NC-4.0"] * 3), "licensed"), ("MIT", "licensed")]
    assert got[None] == [("MIT", "licensed")] and got[9] == [("GPL-3.0-only", "licensed")] and got[10] == [("GPL-2.0-or-later", "licensed")]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- decontamination


def test_leaks(spark):
    item = [text(900 + i, 15 + 7 * i) for i in range(6)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(item)] + [(77, "too short", 1), (78, None, 1), (3, item[3], 1)], "item_id long, text string, doc_id int")
    w = item[4].split()
    near = " ".join(w[:1] + ["zz"] + w[2:])  # two of the 5-word shingles differ
    far = " ".join(x if k % 4 else "zz" for k, x in enumerate(w))
    data = [(1, f"{text(1, 50)} {item[0].upper()}, {text(2, 33)}", "a"), (2, item[1], "a"), (3, f"{text(5, 7)} {near} {item[2]} {text(6, 9)} {item[2]}", "a"), (4, far, "a"), (5, None, "a"), (6, "", "a"), (7, text(7, 20_000) + " " + item[5], "a"), (2, item[1], "a"), (None, item[3], "a"), (8, text(8, 300), "a")]
    got = decontamination.leaks(table(spark, data), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 0), (2, 1), (3, 4), (3, 2), (7, 5), (None, 3)} and len(got) == 6
    best = {(r.doc_id, r.item_id): r for r in got}
    assert best[1, 0].similarity == 1 and best[1, 0].start == 50 and best[1, 0].hamming == 0 and best[3, 2].start == 7 + len(w)
    n = len(w) - 4
    assert best[3, 4].similarity == pytest.approx((n - 2) / (n + 2)) and best[3, 4].similarity >= 0.8
    kept = decontamination.clean(table(spark, data), bench)
    assert kept.columns == table(spark, data).columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 8]
    assert decontamination.leaks(table(spark, []), bench).count() == 0 and decontamination.leaks(table(spark, data), bench.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 20)
    item = [text(900 + i, 30) for i in range(6)]
    bench = spark.createDataFrame(list(enumerate(item)), "item_id long, text string")
    got = decontamination.leaks(table(spark, [(i, f"x y {t} z", "a") for i, t in enumerate(item)]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(6)}


@pytest.mark.parametrize("counts", [[11], [1, 2], [4], [11, 25, 55], [100]])
def test_stride_never_skips(counts):
    stride = decontamination.stride_for(counts)
    for n in counts:
        missing = int(n * 0.2 / 1.8 + 1e-9)
        for first in range(stride):
            assert len(range(first, n, stride)) > missing or stride == 1


# -- passages


def test_passages(spark):
    shared = ". ".join(" ".join(text(70 + i, 9).split()).capitalize() for i in range(8)) + "."
    flat = text(99, 70)
    data = [(5, f"{text(1, 30)} {shared} {text(2, 30)}", "a"), (2, f"{text(3, 40)}. Then {shared}\n{text(4, 10)}", "a"), (9, f"{text(5, 31)} {flat} {text(6, 20)}", "a"), (7, f"{flat} {text(7, 25)}", "a"), (1, text(8, 500), "a"), (3, None, "a"), (4, "", "a"), (1, text(8, 500), "a"), (6, "Short. Short. Short.", "a"), (8, "Short.", "a"), (None, text(11, 60), "a")]
    got = {r.doc_id: r for r in passages.spans(table(spark, data)).collect()}
    assert set(got) == {5, 9}
    texts = {i: t for i, t, _ in data}
    assert got[5].kept_in == [2] and got[9].kept_in == [7] and got[5].removed_words >= 60 and got[9].removed_words >= 40
    for i, whole in ((5, shared), (9, flat)):
        for s in got[i].spans:
            assert texts[i][s.start : s.end] in whole
    out = passages.remove(table(spark, data))
    kept = defaultdict(list)
    for r in out.collect():
        kept[r.doc_id].append(r)
    for i, t, _ in data:
        want = t
        for s in reversed(got[i].spans if i in got else []):
            want = want[: s.start] + want[s.end :]
        assert kept[i][0].text == want
    assert len(kept[1]) == 2 and out.columns == [*table(spark, data).columns, "removed_spans"]
    assert passages.spans(table(spark, [])).count() == 0


@pytest.mark.parametrize("t", ["", "  ", "\n\n", "a", "A b. C d. E\nF", text(1, 100), "x" * 10_000, "a.b.c d? E! " * 9, "é 漢. " * 30])
def test_units_cover_the_words(t):
    u = passages.units(t)
    assert [w for _, _, ws in u for w in ws] == t.lower().split()
    assert all(a[1] <= b[0] for a, b in zip(u, u[1:], strict=False)) and all(t[s:e].lower().split() == ws for s, e, ws in u)


# -- classifiers


def corpus(n):
    out, labels = [], []
    for i in range(n):
        bad, rude = i % 4 == 0, i % 3 == 0
        w = text(i, 80).split()
        if bad:
            w = [x + "###" for x in w]
        if rude:
            w[10:12] = ["dolt", "nitwit"]
        out.append((i, "the of and " + " ".join(w), "a"))
        labels.append((i, int(not bad), int(rude), 5))
    return out, labels


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers(spark, which):
    data, labels = corpus(240)
    extra = [(900, None, "a"), (901, "", "a"), (None, "the end", "a"), (902, text(3, 20_000), "a"), (1, data[1][1], "a")]
    lab = spark.createDataFrame([*labels, (None, 1, 1, 5), (3, None, None, 5), (77_777, 1, 0, 5)], "doc_id long, quality int, toxic int, text int")
    docs = table(spark, data + extra)
    module, column = (quality, 1) if which == "quality" else (toxicity, 2)
    got = module.score(docs, module.train(docs, lab)).collect()
    assert len(got) == len(data) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.3 if which == "quality" else 0.5)) for r in got)
    score = {r.doc_id: r.score for r in got}
    out = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert learn.auc(np.array([score[i] for i in out]), np.array([labels[i][column] for i in out])) > 0.9
    again = {r.doc_id: r.score for r in module.score(docs, module.train(docs, lab)).collect()}
    assert again == score
    none = module.train(docs, lab.limit(0))
    assert module.score(docs, none).count() == len(got) and module.score(table(spark, []), none).count() == 0


def test_sample_is_bounded_and_leaves_the_fifth(spark):
    data, labels = corpus(100)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text int")
    got = learn.sample(table(spark, data), lab, "toxic", 30)
    assert len(got) == 30 and all(zlib.crc32(str(i).encode()) % 5 for i, _, _ in got) and got == learn.sample(table(spark, data[::-1]), lab, "toxic", 30)


def test_contexts_are_exact(spark, monkeypatch):
    data, _ = corpus(60)
    lookup, index = learn.Lookup(quality.bucket), quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIM), dtype=np.int64)
    for _, t, _ in data:
        ids = quality.tokens(t, lookup)
        for i, w in enumerate(ids):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ids):
                    want[w] += index[ids[j]].astype(np.int64)
    monkeypatch.setattr(quality, "FAN_IN", 3)
    assert (quality.contexts(table(spark, data).repartition(11)) == want).all()


def test_keep(spark):
    data, labels = corpus(200)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text int")
    out = quality.keep(table(spark, data), lab)
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == table(spark, data).columns and len(ids & {i for i in range(200) if i % 4}) >= 145 and len(ids & {i for i in range(200) if i % 4 == 0}) <= 10
