"""Token ids in raw binary shards with a minimal perfect hash index.

A shard file is, in order: the ids of its documents as little-endian unsigned 16-bit integers (each document followed
by the end id 0), the index, a footer, and one closing zero id. Files are written by Spark's own writer, one per range
of doc_id, so any file system Spark can write to will do and a repeated task replaces its file; they are read back
through Spark too. The index holds the documents' keys in order, their offsets, and a minimal perfect hash from a key to
its row, with a stored fingerprint of the key that tells absent keys apart.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MAGIC = b"TWTOKEN1"
END = 0
#: UTF-8 bytes of text in a shard, about.
SHARD_BYTES = 24 << 20
#: Entries of an encoder's cache; when it is full, those stay that were used again since it was full before.
UNITS = 1_000_000
#: Ids in the cache, for each entry on average, beyond which it counts as full.
UNIT_IDS = 8
#: Units that are encoded as one text.
JOINED = 256
#: Bytes of text that are cut into units at a time, and bytes and rows that are written at a time.
WINDOW, PART_BYTES, PART_ROWS = 1 << 18, 64 << 20, 512
#: Bytes of the longest unit that is found by numbers, and of the longest that is kept.
SHORT, KEPT = 15, 64

#: A unit given to `learn` stands for a space and itself, or after MARK, for itself alone.
MARK = "\x00"
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII's, without the apostrophe, which may begin a piece with letters
_ALNUM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: A cut stands where _AT of a byte and _AFTER of the byte before it share a bit. 1: a space or line feed after a character that
#: isn't white space; 2: a mark after a letter or digit; 4: the character before isn't ASCII and has to be looked at.
_AT = bytes(5 if c in b" \n" else 6 if c in _MARKS else 0 for c in range(256))
_AFTER = bytes(7 if c > 0x7F else 3 if c in _ALNUM else 1 if 0x20 < c < 0x7F else 0 for c in range(256))
#: Two-byte UTF-8 whose every character is a letter, by first byte: U+00C0 to U+027F (but for two) and U+0400 to U+047F.
_LETTERS = np.isin(np.arange(256), [*range(0xC3, 0xCA), 0xD0, 0xD1])
#: The lowest n bytes of a word.
_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(256)], dtype="<u8")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _no_cuts(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places, all after a character beyond ASCII, can't be cut: white space is before a space or line feed, or no known letter before a mark."""
    a, b, c = buf[at - 1], buf[np.maximum(at - 2, 0)], buf[np.maximum(at - 3, 0)]
    space = (b == 0xC2) & ((a == 0x85) | (a == 0xA0)) | (c == 0xE1) & (b == 0x9A) & (a == 0x80) | (c == 0xE3) & (b == 0x80) & (a == 0x80)
    space |= (c == 0xE2) & ((b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF)) | (b == 0x81) & (a == 0x9F))
    letter = _LETTERS[b] & ~((b == 0xC3) & ((a == 0x97) | (a == 0xB7)))
    return np.where((buf[at] == 0x20) | (buf[at] == 0x0A), space, ~letter)


def _starts(text: bytes) -> np.ndarray:
    """Where units begin in UTF-8 that begins with one, as flags."""
    out = np.frombuffer(bytearray(text.translate(_AT)), dtype=np.uint8)
    out[1:] &= np.frombuffer(text.translate(_AFTER), dtype=np.uint8)[:-1]
    out[:1] = 1
    if not text.isascii():
        at = np.flatnonzero(out & 4)
        out[at[_no_cuts(np.frombuffer(text, dtype=np.uint8), at)]] = 0
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class Encoder:
    """The tokenizer with a cache in front, from UTF-8 to ids as unsigned 16-bit integers.

    The tokenizer cuts a text by its own pattern before it merges. It always cuts before a space or line feed that follows
    something else than white space, and between a letter or digit and a mark (not the apostrophe). What stands between
    such places, a unit, is encoded apart, and once: no piece of the pattern spans them, and as a unit ends in white
    space only where its text ends, the pattern's look ahead sees the same. Texts that hold an added token's own text
    are encoded whole.

    Units of a window of text are looked up all at once, in arrays: a unit's bytes and their number are two words, its
    key, which is hashed to an entry, compared, and if it is another's, looked for in the next slots. Longer units are
    kept in a dict. New units are encoded many at a time, joined: each holds one space or one line feed, its first byte,
    so that its ids begin at a token that begins with that.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        if "\u010a" not in vocabulary:  # how byte-level tokens write a line feed
            raise ValueError("not a byte-level vocabulary")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.begins = np.zeros(1 << 16, dtype=bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how byte-level tokens write a space
        self.breaks = np.zeros(1 << 16, dtype=bool)
        self.breaks[vocabulary["\u010a"]] = True
        # by entry: the key's words (0, 0: none), where its ids begin, how many they are, whether it was used again
        self.size, self.keys, self.at, self.count, self.used = 0, np.zeros((2, 1), dtype="<u8"), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int32), np.zeros(1, dtype=bool)
        self.ids, self.filled, self.long = np.empty(0, dtype="<u2"), 0, {}
        self.slots, self.shift = np.full(2, -1, dtype=np.int32), np.uint64(63)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u2") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, units: list[str]) -> None:
        """Enters the ids of ' ' + unit for each, of what follows MARK where a unit begins with that, as the next entries."""
        words, lines, others = [], [], []
        for i, u in enumerate(units):
            if u[:1] == MARK:
                (lines if u[1:2] == "\n" and u[2:].split() == [u[2:]] else others).append(i)
            else:
                (words if u.split() == [u] else others).append(i)
        some = [units[i] for i in others]
        parts = self.plain([u[1:] if u[:1] == MARK else " " + u for u in some])
        self.enter(others, parts, [len(p) for p in parts])
        self.joined(units, words, " ", self.begins)
        self.joined(units, lines, "", self.breaks)
        self.size += len(units)

    def joined(self, units: list[str], which: list[int], before: str, first: np.ndarray) -> None:
        """Enters the ids of `before` and each of these units, whose first tokens alone are marked in `first`."""
        parts = [which[at : at + JOINED] for at in range(0, len(which), JOINED)]
        marked = not before  # these units have MARK in front
        ids, counts = self.plain([before + before.join([units[i][marked:] for i in p]) for p in parts]), []
        for part, x in zip(parts, ids, strict=True):
            starts = np.flatnonzero(first[x])
            if len(starts) != len(part) or starts[0]:
                raise ValueError("not a byte-level vocabulary")
            counts += np.diff(starts, append=len(x)).tolist()
        self.enter(which, ids, counts)

    def enter(self, which: list[int], ids: list[np.ndarray], counts: list[int]) -> None:
        """The ids of new entries, so many for each."""
        if not which:
            return
        end = self.filled + sum(counts)
        if end > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.filled], np.empty(max(end, 2 * self.filled) - self.filled, dtype="<u2")))
        self.ids[self.filled : end] = np.concatenate(ids)
        rows = self.size + np.array(which)
        self.count[rows] = counts
        self.at[rows] = self.filled + np.cumsum(counts) - counts
        self.filled = end

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        """The first slot of each key."""
        x = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> self.shift).astype(np.int64)

    def found(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        slot = self.hashed(keys)
        out = self.slots[slot].astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & ((self.keys[0][out] != keys[0]) | (self.keys[1][out] != keys[1])))
        slot, last = slot[open_], len(self.slots) - 1
        while len(open_):
            slot = (slot + 1) & last
            e = self.slots[slot]
            out[open_] = e
            other = (e >= 0) & ((self.keys[0][e] != keys[0][open_]) | (self.keys[1][e] != keys[1][open_]))
            open_, slot = open_[other], slot[other]
        return out

    def place(self, entries: np.ndarray) -> None:
        """Gives the entries, whose keys are in no slot yet, the next free slot."""
        slot, last = self.hashed(self.keys[:, entries]), len(self.slots) - 1
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            left = self.slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & last

    def room(self, more: int, now: np.ndarray) -> np.ndarray:
        """Makes room for more entries; the new numbers of all entries, -1 for those dropped. Those of `now` are in use."""
        number = np.arange(self.size)
        if self.size + more > UNITS or self.filled > UNIT_IDS * UNITS:
            keep = np.flatnonzero(self.used[: self.size])
            if len(keep) + more > UNITS or self.count[keep].sum() > UNIT_IDS * UNITS // 2:
                keep = np.unique(now)
            number = np.full(self.size, -1)
            number[keep] = np.arange(len(keep))
            counts = self.count[keep]
            self.ids = self.ids[_ranges(self.at[keep], counts)]
            self.keys, self.at, self.count, self.used = self.keys[:, keep], np.cumsum(counts) - counts, counts, np.zeros(len(keep), dtype=bool)
            self.size, self.filled = len(keep), len(self.ids)
            self.long = {k: n for k, e in self.long.items() if (n := int(number[e])) >= 0}
            self.slots = np.empty(0, dtype=np.int32)
        if (need := self.size + more) > len(self.at):
            add = max(need, min(2 * self.size, UNITS)) - len(self.at)
            self.keys = np.concatenate((self.keys, np.zeros((2, add), dtype="<u8")), axis=1)
            self.at, self.count = (np.concatenate((x, np.zeros(add, dtype=x.dtype))) for x in (self.at, self.count))
            self.used = np.concatenate((self.used, np.zeros(add, dtype=bool)))
        if 2 * need > len(self.slots):
            bits = (2 * need).bit_length()
            self.slots, self.shift = np.full(1 << bits, -1, dtype=np.int32), np.uint64(64 - bits)
            self.place(np.flatnonzero(self.keys[1, : self.size]))
        return number

    def entries(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each unit, which is entered if it is new."""
        words, size = np.frombuffer(text + bytes(-len(text) % 8 + 24), dtype="<u8"), ends - starts
        at, bits = starts >> 3, ((starts & 7) << 3).astype(np.uint64)
        rest = np.uint64(63) - bits
        a, b, c = words[at], words[at + 1], words[at + 2]
        one = np.uint64(1)
        low = np.minimum(size, SHORT)
        keys = np.stack((((a >> bits) | ((b << one) << rest)) & _LOW[low], ((b >> bits) | ((c << one) << rest)) & _LOW[np.maximum(low - 8, 0)] | (low.astype(np.uint64) << np.uint64(56))))
        longer = np.flatnonzero(size > SHORT)
        keys[:, longer] = 0
        out = self.found(keys)
        out[longer] = [self.long.get(text[s:e], -1) for s, e in zip(starts[longer].tolist(), ends[longer].tolist(), strict=True)]
        old = out[out >= 0]
        self.used[old] = True
        if len(old) == len(out):
            return out
        new = np.flatnonzero((out < 0) & (size <= SHORT))
        new = new[np.lexsort(keys[:, new])]
        first = np.concatenate(([True], (np.diff(keys[:, new]) != 0).any(axis=0)))[: len(new)]
        group, lead = np.cumsum(first) - 1, new[first]
        others: dict[bytes, int] = {}
        new_long = longer[out[longer] < 0]
        of_long = [others.setdefault(text[s:e], len(others)) for s, e in zip(starts[new_long].tolist(), ends[new_long].tolist(), strict=True)]
        number = self.room(len(lead) + len(others), old)
        out[out >= 0] = number[old]
        units = [text[s:e] for s, e in zip(starts[lead].tolist(), ends[lead].tolist(), strict=True)] + list(others)
        size0 = self.size
        self.keys[:, size0 : size0 + len(lead)] = keys[:, lead]
        self.keys[:, size0 + len(lead) : size0 + len(units)] = 0
        self.learn([u[1:].decode() if u[:1] == b" " and u[1:2] != b"\x00" else MARK + u.decode() for u in units])
        self.place(np.arange(size0, size0 + len(lead)))
        self.long.update((u, size0 + len(lead) + k) for u, k in others.items() if len(u) <= KEPT)
        out[new], out[new_long] = size0 + group, size0 + len(lead) + np.array(of_long, dtype=np.int64)
        return out

    def windows(self, text: memoryview, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Where units begin, their numbers of ids and their ids, window by window; texts begin at the cuts, which ascend from 0."""
        at, size = 0, WINDOW
        while at < len(text):
            end = min(len(text), at + size)
            some = bytes(text[at:end])
            flags = _starts(some)
            here = cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, end)]
            flags[here - at] = 1
            starts = np.flatnonzero(flags)
            if end < len(text):  # the last unit may go on
                starts, end = starts[:-1], at + int(starts[-1])
                if not len(starts):
                    size *= 2
                    continue
            e = self.entries(some, starts, np.append(starts[1:], end - at))
            counts = self.count[e]
            yield at + starts, counts, self.ids[_ranges(self.at[e], counts)]
            at, size = end, WINDOW

    def numbers(self, data: memoryview, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin, with the end of the last; text i is data[offsets[i] : offsets[i + 1]]."""
        low, high = int(offsets[0]), int(offsets[-1])
        data, offsets = data[low:high], offsets - low
        text, whole = bytes(data), set()
        for a in self.added:
            at = text.find(a)
            while at >= 0:
                whole.add(i := int(np.searchsorted(offsets, at, side="right")) - 1)
                at = text.find(a, int(offsets[i + 1]))
        starts, counts, ids = [], [], []
        done = 0
        for i in [*sorted(whole), len(offsets) - 1]:
            base = int(offsets[done])
            for s, n, x in self.windows(data[base : int(offsets[i])], offsets[done:i] - base):
                starts.append(base + s)
                counts.append(n)
                ids.append(x)
            if i in whole:
                ids += self.plain([text[int(offsets[i]) : int(offsets[i + 1])].decode()])
                starts.append(offsets[i : i + 1])
                counts.append(np.array([len(ids[-1])]))
            done = i + 1
        if not ids:
            return np.empty(0, dtype="<u2"), np.zeros(len(offsets), dtype=np.int64)
        return np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(counts))))[np.searchsorted(np.concatenate(starts), offsets)]

    def encode(self, texts: list[str]) -> list[bytes]:
        some = [t.encode() for t in texts]
        ids, at = self.numbers(memoryview(b"".join(some)), np.cumsum([0, *map(len, some)]))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process: its caches last from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of keys (SplitMix64's finaliser)."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level keys that hash alone claim a bit, the others go on.

    A key's number is the count of claimed bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels  # bits as bytes, packed
        self.bits = [np.unpackbits(x) for x in levels]
        sums = [int(b.sum()) for b in self.bits]
        self.before = np.concatenate(([0], np.cumsum(sums))).astype(np.int64)
        self.rank = [np.cumsum(b, dtype=np.int64) - b for b in self.bits]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left, seed = [], keys, 0
        while len(left):
            size = -(-2 * len(left) // 8) * 8
            at = (_mix(left, seed) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            left, seed = left[~alone[at]], seed + 1
            if seed > 200:
                raise ValueError("keys repeat")
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where no level holds it; a key not built in may get any number."""
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for seed, (bits, rank) in enumerate(zip(self.bits, self.rank, strict=True)):
            at = (_mix(keys[open_], seed) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at].astype(bool)
            out[open_[hit]] = self.before[seed] + rank[at[hit]]
            open_ = open_[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1000) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: np.ndarray, lengths: np.ndarray, nulls: int = 0) -> bytes:
    """The index and footer of a shard whose documents, in order, have these keys and numbers of ids (end id included).

    The first `nulls` documents have no key; the perfect hash is built over the others.
    """
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype("<u8")
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, dtype=np.int64)
    first = np.unique(np.concatenate((first[first >= nulls], [nulls] if nulls < len(keys) else []))).astype(np.int64)
    distinct = keys[first]
    hashed = PerfectHash.build(distinct)
    number = hashed.numbers(distinct)
    row, mark = np.empty(len(distinct), dtype="<u4"), np.empty(len(distinct), dtype="<u4")
    row[number], mark[number] = first, fingerprints(distinct)
    body = keys.astype("<i8").tobytes() + offsets.tobytes() + row.tobytes() + mark.tobytes() + struct.pack("<I", len(hashed.levels)) + b"".join(struct.pack("<I", len(x)) + x.tobytes() for x in hashed.levels)
    return body + struct.pack("<QQQQ", len(keys), nulls, len(distinct), len(body)) + MAGIC


class Shard:
    """A shard file's contents, opened for scans and for access by key."""

    def __init__(self, data: bytes) -> None:
        end = len(data) - 2
        if data[end - 8 : end] != MAGIC:
            raise ValueError("not a token shard")
        n, self.nulls, distinct, size = struct.unpack_from("<QQQQ", data, end - 40)
        at = end - 40 - size
        self.ids = np.frombuffer(data, dtype="<u2", count=at // 2)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += x.nbytes
            return x

        self.keys, self.offsets = take("<i8", n), take("<u8", n + 1)
        self.row, self.mark = take("<u4", distinct), take("<u4", distinct)
        levels = []
        for _ in range(take("<u4", 1)[0]):
            levels.append(take("u1", int(take("<u4", 1)[0])))
        self.hash = PerfectHash(levels)

    def document(self, i: int) -> np.ndarray:
        return self.ids[int(self.offsets[i]) : int(self.offsets[i + 1])]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, by the perfect hash, the stored fingerprint and the stored key; -1 where the key isn't here."""
        if not len(self.row):
            return np.full(len(keys), -1, dtype=np.int64)
        number = self.hash.numbers(keys)
        row = np.where((number >= 0) & (self.mark[number] == fingerprints(keys)), self.row[number].astype(np.int64), -1)
        return np.where((row >= 0) & (self.keys[row] == keys), row, -1)  # another key may have this fingerprint

    def get(self, key: int | None) -> list[np.ndarray]:
        """Ids of the documents of a key (its rows stand side by side), in constant time; none if it isn't here."""
        if key is None:
            return [self.document(i) for i in range(self.nulls)]
        i, out = int(self.places(np.array([key], dtype=np.int64))[0]), []
        while 0 <= i < len(self.keys) and self.keys[i] == key:
            out.append(self.document(i))
            i += 1
        return out


def _parts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows from and to, a few at a time."""
    at = 0
    while at < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[at] + PART_BYTES, side="right")) - 1
        yield at, (at := min(max(end, at + 1), at + PART_ROWS, len(offsets) - 1))


def _shard(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths, nulls, enc = [], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            enc = enc or encoder(path)
            nulls += batch.column(0).null_count
            keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            texts = batch.column(1)
            texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = memoryview(texts.buffers()[2] or b"")
            for a, b in _parts(offsets):
                ids, at = enc.numbers(data, offsets[a : b + 1])
                lengths.append(np.diff(at) + 1)
                values = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(2 * at), pa.py_buffer(ids)])
                yield pa.record_batch([values.cast(pa.binary())], names=["value"])
        if keys:
            yield pa.record_batch([pa.array([index_bytes(np.concatenate(keys), np.concatenate(lengths), nulls)], pa.binary())], names=["value"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the ids of every whole text (null: empty), by ascending doc_id, nulls first; rows of one doc_id by a hash of the text.

    Every row is written, repeated rows too. An empty table writes no shard. A text of any length is one row of its
    shard and is never cut. Columns other than doc_id and text are ignored. The ids of a document, then the end id: Spark's text writer puts the separator, two zero bytes, after every row, and
    writes the row's bytes as they are.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    dealt = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(max(1, -(-total // shard_bytes)), "doc_id", "h")
    rows = dealt.sortWithinPartitions("doc_id", "h").select("doc_id", "text").mapInArrow(_shard(tokenizer or tokenizer_path()), "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\x00\x00").text(path)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = Shard(data.as_py())
            n = np.arange(len(s.keys))
            # a document's place is its key's by the hash, and as many rows on as the key came before
            fresh = (n == s.nulls) | (n > s.nulls) & np.concatenate(([True], s.keys[1:] != s.keys[:-1]))
            row = n - np.maximum.accumulate(np.where(fresh, n, s.nulls))
            row = np.where(n < s.nulls, n, s.places(s.keys) + row)
            if (row != n).any():
                raise ValueError("the index doesn't fit the keys")
            crc = [zlib.crc32(s.document(i).astype("<u4").tobytes()) for i in row.tolist()]
            keys = pa.array(s.keys, mask=n < s.nulls)
            starts = s.offsets.astype(np.int64)
            yield pa.record_batch([pa.array([shard] * len(crc), pa.int32()), keys, pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, content): the files, numbered in their order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, shard_start) for each document in the files; no rows for no shards.

    start counts ids over all files before it: a running sum over one row for each shard.
    """
    rows = common.stored(shards(spark, path).mapInArrow(_scan, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-rows")
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(common.bounded(before), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", F.col("at").alias("shard_start"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-shards")
    write(common.read(spark, sf_dir, "documents"), path)
    return scan(spark, path)
