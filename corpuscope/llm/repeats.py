"""Substring dedup with suffix automata of reference passages.

Each word covered by a window of ``WINDOW`` words that a document with a smaller id has too is removed. Documents are dealt to
groups of bounded size. A group receives, as its reference shard, just the passages of other documents that it needs:
the first occurrences of windows it shares with them. It builds a suffix automaton over the shard and streams its
documents through it; where the matching statistic reaches the window's length and the automaton knows a smaller id,
the window is marked, and the maximal marked spans go.

Which passages a group needs is found from hashes, in two rounds that move few bytes: first short hashes of all
windows, sorted and stored as differences, tell which occur in several documents; then of those alone the full hashes
with the smallest id settle who has a window first, and this document's group sends the text. A false match of hashes
only sends a passage in vain: the automaton compares words.

Sending all automata to all tasks would grow with the corpus in both directions; here a reference passage travels only to
groups that have its text, so the work grows with the input.
"""

from __future__ import annotations

import math
import struct
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpuscope.llm.automaton import SuffixAutomaton
from corpuscope.llm.common import aside, give_back, plus, table

WINDOW = 13
#: Documents are dealt to groups of about so many bytes of text; a longer text fills a group of its own.
GROUP_BYTES = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(values: np.ndarray) -> bytes:
    """Integers in ascending order as differences, byte planes apart, compressed."""
    v = np.ascontiguousarray(values).astype(np.uint64)
    steps = np.diff(v, prepend=np.uint64(0))
    return struct.pack("<Q", len(v)) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<Q", data)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=8 * n or 1), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).reshape(n), dtype=np.uint64)


def pack_loose(values: np.ndarray) -> bytes:
    """Integers in any order."""
    v = np.ascontiguousarray(values.astype(np.int64))
    return struct.pack("<Q", len(v)) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_loose(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<Q", data)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=8 * n or 1), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).reshape(n)


class Windows:
    """The windows of a group's documents that have an id: hash, document and place of each."""

    def __init__(self, group: pa.Table, size: int):
        ids = group.column("doc_id").to_pylist()
        self.words = [w if i is not None else [] for i, w in zip(ids, _words(group), strict=True)]
        self.ids = np.array([-1 if i is None else i for i in ids], np.int64)
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.fromiter((xxh64_intdigest(w) for x in self.words for w in x), np.uint64, int(self.begin[-1]))
        n = len(flat) - size + 1
        if n < 1:
            self.hash, self.doc, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x100000001B3) + flat[k : k + n]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        at = np.flatnonzero(doc[:n] == doc[size - 1 :])
        self.hash, self.doc, self.at = h[at], doc[at], at

    def first(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen windows: distinct hashes ascending, for each the row of its first occurrence in the document
        with the smallest id, and whether another id has it."""
        ids = self.ids[self.doc[chosen]]
        order = chosen[np.lexsort((self.at[chosen], ids, self.hash[chosen]))]
        if not len(order):
            return np.zeros(0, np.uint64), order, np.zeros(0, bool)
        h, ids = self.hash[order], self.ids[self.doc[order]]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[starts], order[starts], np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)


def _words(group: pa.Table) -> list[list[bytes]]:
    return [(t or "").encode().split() for t in group.column("text").to_pylist()]


def _slices(values: np.ndarray, bits: int, of: int):
    """Cuts ascending values of ``bits`` bits by their highest ``of`` bits: (slice number, begin, end)."""
    number = (values >> np.uint64(bits - of)).astype(np.int64) if of else np.zeros(len(values), np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(values)]])
    return [(int(number[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def strip_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, any others) with what is left as ``text``, its words joined by one space, and the
    columns ``n_words``, ``n_removed`` and ``kept_sha256`` (of the new text), which replace any of these names.

    Windows are judged on the texts as they come. A text shorter than a window stays; a null text has no words and
    becomes an empty one. A document without an id is never removed from and never a reference. Rows of equal ids do
    not count as repeats of each other. Rows with any text in common with a third of the corpus cost no more than
    others: a passage comes once to each group that has it. Empty tables give no rows.
    """
    docs, back = aside(docs.drop("n_words", "n_removed", "kept_sha256").withColumn("doc_id", F.col("doc_id").cast("long")), "_group")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    short = min(64, math.ceil(math.log2(total + 2)) + 11)  # bits of a short hash: one in some thousands matches by chance
    cut = max(0, math.ceil(math.log2(groups)) - 1)  # bits of a slice of the hashes' range
    texts = docs.withColumn("_group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    by_group = texts.groupBy("_group")
    shift = np.uint64(64 - short)

    def announce(key, group):
        give_back()
        own = Windows(group, window)
        low = own.hash >> shift
        order = np.lexsort((own.ids[own.doc], low))
        rows = []
        if len(order):
            v, ids = low[order], own.ids[own.doc][order]
            starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
            v = v[starts]
            rows = [(n, key[0].as_py(), pack(v[a:b]), np.packbits(several[a:b]).tobytes()) for n, a, b in _slices(v, short, cut)]
        return _table(rows, ["slice", "_group", "hashes", "several"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def compare(group):
        give_back()
        who, parts = group.column("_group").to_pylist(), [unpack(x) for x in group.column("hashes").to_pylist()]
        v = np.concatenate(parts)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).view(bool) for x, p in zip(group.column("several").to_pylist(), parts, strict=True)])
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(v, kind="stable")
        v, several, owner = v[order], several[order], owner[order]
        same = v[1:] == v[:-1]
        again = several | np.concatenate([[False], same]) | np.concatenate([same, [False]])
        v, owner = v[again], owner[again]
        rows = []
        for k, g in enumerate(who):
            mine = v[owner == k]
            if len(mine):
                rows.append((g, pack(mine)))
        return _table(rows, ["_group", "hashes"], [pa.int32(), pa.binary()])

    def claim(key, group, replies):
        give_back()
        rows = []
        if group.num_rows and replies.num_rows:
            own = Windows(group, window)
            wanted = np.sort(np.concatenate([unpack(x) for x in replies.column("hashes").to_pylist()]))
            low = own.hash >> shift
            at = np.minimum(np.searchsorted(wanted, low), len(wanted) - 1)
            h, first, several = own.first(np.flatnonzero(wanted[at] == low))
            ids = own.ids[own.doc[first]]
            rows = [(n, key[0].as_py(), pack(h[a:b]), pack_loose(ids[a:b]), np.packbits(several[a:b]).tobytes()) for n, a, b in _slices(h, 64, cut)]
        return _table(rows, ["slice", "_group", "hashes", "ids", "several"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])

    def settle(group):
        give_back()
        who, parts = np.array(group.column("_group").to_pylist(), np.int64), [unpack(x) for x in group.column("hashes").to_pylist()]
        sizes = [len(p) for p in parts]
        h, ids = np.concatenate(parts), np.concatenate([unpack_loose(x) for x in group.column("ids").to_pylist()])
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).view(bool) for x, n in zip(group.column("several").to_pylist(), sizes, strict=True)])
        of = np.repeat(who, sizes)
        order = np.lexsort((of, ids, h))
        h, ids, of, several = h[order], ids[order], of[order], several[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        owner = np.repeat(of[starts], np.diff(np.append(starts, len(h))))
        least = np.repeat(ids[starts], np.diff(np.append(starts, len(h))))
        need = several | (ids > least)
        h, of, owner = h[need], of[need], owner[need]
        order = np.lexsort((of, h, owner))
        h, of, owner = h[order], of[order], owner[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
        rows = [(int(owner[a]), pack(h[a:b]), pack_loose(of[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        return _table(rows, ["_group", "hashes", "takers"], [pa.int32(), pa.binary(), pa.binary()])

    def send(key, group, requests):
        give_back()
        rows = []
        if group.num_rows and requests.num_rows:
            own = Windows(group, window)
            h = np.concatenate([unpack(x) for x in requests.column("hashes").to_pylist()])
            takers = np.concatenate([unpack_loose(x) for x in requests.column("takers").to_pylist()])
            wanted = np.unique(h)
            at = np.minimum(np.searchsorted(wanted, own.hash), len(wanted) - 1)
            known, first, _ = own.first(np.flatnonzero(wanted[at] == own.hash))
            places = own.at[first][np.searchsorted(known, h)]
            order = np.lexsort((places, takers))
            places, takers = places[order], takers[order]
            doc = np.searchsorted(own.begin, places, side="right") - 1
            new = np.concatenate([[True], (np.diff(takers) != 0) | (np.diff(doc) != 0) | (np.diff(places) > window)])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(places)) - 1
            for taker, d, a, b in zip(takers[starts].tolist(), doc[starts].tolist(), places[starts].tolist(), places[ends].tolist(), strict=True):
                base = int(own.begin[d])
                rows.append((taker, int(own.ids[d]), b" ".join(own.words[d][a - base : b - base + window])))
        return _table(rows, ["_group", "owner", "passage"], [pa.int32(), pa.int64(), pa.binary()])

    columns = docs.columns

    def strip(key, group, passages):
        give_back()
        number: dict[bytes, int] = {}
        shard = []
        for owner, passage in zip(passages.column("owner").to_pylist(), passages.column("passage").to_pylist(), strict=True):
            shard.append((owner, [number.setdefault(w, len(number)) for w in passage.split()]))
        automaton = SuffixAutomaton(len(number))
        for owner, sequence in shard:
            automaton.add(sequence, owner)
        automaton.finish()
        n_words, n_removed, left = [], [], []
        for doc, words in zip(group.column("doc_id").to_pylist(), _words(group), strict=True):
            keep = words
            if doc is not None and number and len(words) >= window:
                ids = [number.get(w, -1) for w in words]
                keep = _without(words, ids, automaton, doc, window)
            n_words.append(len(words))
            n_removed.append(len(words) - len(keep))
            left.append(b" ".join(keep))
        arrays = [group.column(c) if c != "text" else pa.array([x.decode() for x in left], pa.string()) for c in columns]
        return pa.table([*arrays, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([sha256(x).hexdigest() for x in left], pa.string())], names=[*columns, "n_words", "n_removed", "kept_sha256"])

    announced = by_group.applyInArrow(announce, "slice int, _group int, hashes binary, several binary")
    replies = announced.groupBy("slice").applyInArrow(compare, "_group int, hashes binary")
    claims = by_group.cogroup(replies.groupBy("_group")).applyInArrow(claim, "slice int, _group int, hashes binary, ids binary, several binary")
    requests = claims.groupBy("slice").applyInArrow(settle, "_group int, hashes binary, takers binary")
    passages = by_group.cogroup(requests.groupBy("_group")).applyInArrow(send, "_group int, owner long, passage binary")
    out = by_group.cogroup(passages.groupBy("_group")).applyInArrow(strip, plus(docs.schema, "n_words long, n_removed long, kept_sha256 string"))
    return out.select(*back, "n_words", "n_removed", "kept_sha256")


def _without(words: list[bytes], ids: list[int], automaton: SuffixAutomaton, doc: int, window: int) -> list[bytes]:
    """The words outside marked windows. Only runs of words that the shard knows are streamed: others match nothing."""
    known = np.array(ids) >= 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
    steps = None
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a < window:
            continue
        for end in automaton.matches(ids[a:b], window, doc):
            if steps is None:
                steps = np.zeros(len(words) + 1, np.int64)
            steps[a + end - window] += 1
            steps[a + end] -= 1
    if steps is None:
        return words
    gone = np.cumsum(steps)[:-1] > 0
    return [w for w, x in zip(words, gone.tolist(), strict=True) if not x]


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with windows of 13 words."""
    out = strip_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
