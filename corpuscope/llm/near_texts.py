"""Near-duplicate texts by wide SimHash codes and exact shingle similarity.

The pair of documents to find share at least a given part of their word shingles. Such pairs differ in too many of 64 bits
for short codes, so codes are wider: segments of sign bits over the distinct shingles. Documents that
agree on a whole segment meet; a pigeonring filter over a 128-bit part of the code (a ring of eight segments, of which some
chain must keep all prefixes within proportional budgets) and then the Hamming distance prune the pairs; the
similarity of what is left is taken exactly over all shingles. Where a segment's group leaves many more pairs than rows, its rows'
shingles come together in parts of bounded size instead, and only links that join something leave.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpuscope.llm.common import drop, give_back, kept, lean, looked_up, sifted, small_batches
from corpuscope.llm.components import components
from corpuscope.llm.repeats import pack, unpack

#: How many of the pairs at the similarity may meet in no segment.
MISS = 1e-3
#: Documents whose 128-bit codes differ in more bits are not compared further.
RADIUS, RING = 36, 8
#: The first round only joins what is easily found: in so many segments, each document of a group is compared with so many that
#: follow it in order of code. The second round has no such bounds.
FIRST, AHEAD = 8, 96
#: A group with more than so many pairs for each row gives its rows instead, in parts of at most so many rows and shingles.
PAIRS_A_ROW, PART_ROWS, PART_SHINGLES = 2, 512, 1 << 20
_PRIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = h + np.uint64(salt * int(_PRIMES[0]) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * _PRIMES[1]
    h = (h ^ (h >> np.uint64(27))) * _PRIMES[2]
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of ``size`` words in a row from the words' hashes; fewer words are one shingle."""
    n = len(words) - size + 1
    if n < 1:
        size, n = len(words), min(1, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + words[k : k + n]
    return np.unique(mixed(h, size))


def wide_code(features: np.ndarray, width: int) -> np.ndarray:
    """``width`` times 64 sign bits over distinct features."""
    out = np.zeros(width, "<u8")
    for k in range(width):
        octets = np.ascontiguousarray(mixed(features, k + 1).view(np.uint8).reshape(-1, 8).T)
        if len(features) < 64:
            ones = np.unpackbits(octets.T, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            ones = np.concatenate([np.bincount(x, minlength=256) @ _BITS for x in octets])
        out[k] = np.packbits(ones * 2 > len(features), bitorder="little").view("<u8")[0]
    return out


def differing(similarity: float) -> float:
    """The share of bits that differ between documents at the similarity, at worst: two sets of one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def segment_plan(rows: int, similarity: float = 0.8) -> tuple[int, int]:
    """Bits of a segment and number of segments: a bit more whenever the table doubles, so groups keep their size."""
    bits = min(31, max(8, math.ceil(math.log2(max(2, rows))) - 4))
    agree = (1 - differing(similarity)) ** bits
    return bits, 1 if agree == 1 else math.ceil(math.log(MISS) / math.log(1 - agree))


def segment_keys(code: np.ndarray, bits: int, segments: int) -> np.ndarray:
    flat = np.unpackbits(code.view(np.uint8), bitorder="little")[: bits * segments].reshape(segments, bits)
    return (flat @ (np.int64(1) << np.arange(bits, dtype=np.int64))).astype(np.int32)


def ring_viable(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of 128-bit codes (n by 2 words): whether some chain of the ring's segments keeps all prefixes, up to
    the whole ring, within length * RADIUS / RING differing bits."""
    d = np.bitwise_count((a ^ b).view(np.uint16)).astype(np.int64)
    excess = np.concatenate([np.zeros((len(d), 1), np.int64), np.cumsum(np.hstack([d, d]) * RING - RADIUS, axis=1)], axis=1)
    viable = np.zeros(len(d), bool)
    for start in range(RING):
        viable |= excess[:, start + 1 : start + RING + 1].max(axis=1) <= excess[:, start]
    return viable


def close_in_runs(run: np.ndarray, codes: np.ndarray, ahead: int = AHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of equal ``run`` (ascending), at most ``ahead`` apart, within the radius: (i, j, distance)."""
    found = []
    for step in range(1, min(ahead, len(run) - 1) + 1):
        i = np.flatnonzero(run[step:] == run[:-step])
        if not len(i):
            break
        i = i[ring_viable(codes[i], codes[i + step])]
        far = np.bitwise_count(codes[i] ^ codes[i + step]).sum(axis=1, dtype=np.int64)
        i, far = i[far <= RADIUS], far[far <= RADIUS]
        if len(i):
            found.append((i, i + step, far))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def across_in_runs(run: np.ndarray, codes: np.ndarray, joined: np.ndarray, size: np.ndarray, similarity: float, rows: int = 32_768):
    """All pairs of rows of equal ``run`` but not equal ``joined`` (both in order) within the radius whose sets' sizes allow the
    similarity, in parts (i, j)."""
    n = len(run)

    def ends(new):
        starts = np.flatnonzero(np.concatenate([[True], new]))
        return np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))

    other = run[1:] != run[:-1]
    of_run, of_joined = ends(other), ends(other | (joined[1:] != joined[:-1]))
    for k in range(0, n, rows):
        i, j = np.arange(k, min(k + rows, n)), of_joined[k : k + rows]
        while True:
            inside = j < of_run[i]
            i, j = i[inside], j[inside]
            if not len(i):
                break
            near = np.flatnonzero(np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
            near = near[ring_viable(codes[i[near]], codes[j[near]])]
            near = near[np.bitwise_count(codes[i[near]] ^ codes[j[near]]).sum(axis=1, dtype=np.int64) <= RADIUS]
            if len(near):
                yield i[near], j[near]
            j = j + 1


def forest(i: np.ndarray, j: np.ndarray, far: np.ndarray) -> list[int]:
    """Of the pairs those of a minimum spanning forest: a group of many copies gives no more pairs than rows."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for k in np.argsort(far, kind="stable").tolist():
        x, y = root(int(i[k])), root(int(j[k]))
        if x != y:
            parent[x] = y
            out.append(k)
    return out


def dealt(codes: DataFrame, bits: int, segments: int) -> DataFrame:
    """Each row of ``doc_id``, ``code``, ``joined`` and ``n`` (its shingles) once for each segment, with the segment's ``key`` and the
    code's first 128 bits."""

    def cut(batches):
        for batch in lean(batches):
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(batch.num_rows, -1)
            keys = np.concatenate([segment_keys(c, bits, segments) for c in code]) if batch.num_rows else np.zeros(0, np.int32)
            short = pa.array([c[:2].tobytes() for c in code], pa.binary())
            for k in range(0, batch.num_rows, 1024):
                part = slice(k, min(k + 1024, batch.num_rows))
                n = part.stop - part.start
                at = pa.array(np.repeat(np.arange(part.start, part.stop), segments))
                cells = [pa.array(np.tile(np.arange(segments, dtype=np.int32), n)), pa.array(keys[part.start * segments : part.stop * segments])]
                yield pa.RecordBatch.from_arrays([*cells, batch.column(0).take(at), short.take(at), batch.column(2).take(at), batch.column(3).take(at)], names=["segment", "key", "doc_id", "code", "joined", "n"])

    return codes.select("doc_id", "code", "joined", "n").mapInArrow(cut, "segment int, key int, doc_id long, code binary, joined long, n int").repartition("segment", "key")


def gathered(batches, rows=8_192):
    """The batches of ``dealt`` in parts of some thousand rows: (run, ids, codes, joined, n)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield _arrays(held)
            held, size = [], 0
    if size:
        yield _arrays(held)


def _arrays(held):
    t = pa.Table.from_batches(held).combine_chunks()
    run = t.column(0).to_numpy().astype(np.int64) << 32 | t.column(1).to_numpy().astype(np.int64)
    return run, t.column(2).to_numpy(), np.frombuffer(b"".join(t.column(3).to_pylist()), "<u8").reshape(-1, 2), t.column(4).to_numpy(), t.column(5).to_numpy()


def _pairs(i, j):
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])


def easy_pairs(codes: DataFrame, bits: int, segments: int) -> DataFrame:
    """From ``doc_id``, ``code``, ``joined`` and ``n`` to distinct pairs (``a``, ``b``) that meet in a segment, next to each other, and are close: a
    forest of each group's. This is a start: the similarity may refuse a pair of the forest and hold for one outside."""

    def meet(batches):
        held = None
        for part in gathered(lean(batches)):
            run, ids, code, joined, n = part if held is None else (np.concatenate(x) for x in zip(held, part, strict=True))
            i, j, far = close_in_runs(run, code)
            pick = forest(i, j, far)
            yield _pairs(ids[i[pick]], ids[j[pick]])
            last = np.flatnonzero(run == run[-1])[-AHEAD:]
            held = run[last], ids[last], code[last], joined[last], n[last]

    met = dealt(codes, bits, segments).sortWithinPartitions("segment", "key", "code", "doc_id")
    return met.mapInArrow(meet, "a long, b long").where("a <> b").distinct()


def parts_of(sizes: np.ndarray) -> np.ndarray:
    """Numbers rows in order: a part has at most ``PART_ROWS`` rows and, unless it is one row, ``PART_SHINGLES`` shingles."""
    out, part, rows, held = np.zeros(len(sizes), np.int32), 0, 0, 0
    for k, size in enumerate(sizes.tolist()):
        if rows and (rows >= PART_ROWS or held + size > PART_SHINGLES):
            part, rows, held = part + 1, 0, 0
        out[k], rows, held = part, rows + 1, held + size
    return out


def other_pairs(codes: DataFrame, bits: int, segments: int, similarity: float) -> DataFrame:
    """From ``doc_id``, ``code``, ``joined`` and ``n`` to what meets in a segment, is close and not yet joined.

    All such pairs (``a``, ``b``) of a group, or, where these are many more than its rows, the rows ``a`` of them: once for each two parts
    (``p``, ``q``) of the group that a row is in, so every two rows are together in some ``segment``, ``key``, ``p``, ``q``. A group is held as numbers,
    44 bytes a row.
    """

    def whole_runs(parts):
        held = []
        for part in parts:
            if held and part[0][-1] == held[0][0][0]:
                held.append(part)
                continue
            cut = int(np.searchsorted(part[0], part[0][-1])) if part[0][0] != part[0][-1] else 0
            if held:
                done = tuple(np.concatenate([*x, y[:cut]]) for *x, y in zip(*held, part, strict=True))
            else:
                done = tuple(x[:cut] for x in part)
            if len(done[0]):
                yield done
            held = [tuple(x[cut:] for x in part)]
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def rows(segment=-1, key=-1, p=-1, q=-1, a=(), b=None):
        n = len(a)
        fixed = [pa.array(np.full(n, x, np.int32)) for x in (segment, key, p, q)]
        return pa.RecordBatch.from_arrays([*fixed, pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64())], names=["segment", "key", "p", "q", "a", "b"])

    def meet(batches):
        for run, ids, code, joined, n in whole_runs(gathered(lean(batches))):
            of = np.cumsum(np.concatenate([[0], run[1:] != run[:-1]]))
            most, count = PAIRS_A_ROW * np.bincount(of), np.zeros(of[-1] + 1, np.int64)
            met, held = np.zeros(len(run), bool), []
            for i, j in across_in_runs(run, code, joined, n, similarity):
                count += np.bincount(of[i], minlength=len(count))
                met[i] = met[j] = True
                few = count[of[i]] <= most[of[i]]
                held.append((i[few], j[few]))
            if held:
                i, j = (np.concatenate(x) for x in zip(*held, strict=True))
                few = count[of[i]] <= most[of[i]]
                yield rows(a=np.minimum(ids[i[few]], ids[j[few]]), b=np.maximum(ids[i[few]], ids[j[few]]))
            for k in np.flatnonzero(count > most).tolist():
                own = np.flatnonzero(met & (of == k))
                segment, key = int(run[own[0]] >> 32), int(run[own[0]] & 0xFFFFFFFF)
                part = parts_of(n[own])
                for p in range(part[-1] + 1):
                    for q in range(p, part[-1] + 1):
                        if p < q or p == q == part[-1] == 0:
                            yield rows(segment, key, p, q, a=ids[own[(part == p) | (part == q)]])

    met = dealt(codes, bits, segments).sortWithinPartitions("segment", "key", "joined", "doc_id")
    return met.mapInArrow(meet, "segment int, key int, p int, q int, a long, b long")


def roots_of(sets: list[np.ndarray], similarity: float, columns: int = 4_096) -> np.ndarray:
    """For each set of shingles the first one it reaches over pairs of at least the similarity, all pairs compared.

    Only shingles of several sets count for what two have in common; products of the sets' rows of zeros and ones give it for all pairs.
    """
    size, n = np.array([len(x) for x in sets], np.float64), len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size.astype(int))
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    again = times > 1
    column, owner = (np.cumsum(again) - 1)[column[again[column]]], owner[again[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((n, n), np.float32)
    for begin in range(0, int(again.sum()), columns):
        a, b = np.searchsorted(column, [begin, begin + columns])
        x = np.zeros((n, columns), np.float32)
        x[owner[a:b], column[a:b] - begin] = 1
        both += x @ x.T
    near = both >= similarity * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(near, True)
    root = np.arange(n)
    while True:
        low = np.where(near, root[None, :], n).min(axis=1)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """Documents with a component of more than themselves: ``doc_id``, ``component_id`` (the smallest id reachable).

    Two documents link if their texts are equal or the Jaccard similarity of their sets of ``shingle``-word shingles
    (ASCII capitals as small letters) is at least ``similarity``. Texts without words are alike. Rows without an id
    take no part; a null text is an empty one. Whole texts count, however long: a text gives 8 bytes a shingle. Of equal texts one is
    compared. Other columns are ignored; empty tables give no rows.

    Of each segment's group all pairs are compared, but those that the first round's verified links have joined. Links are
    lost only where two documents meet in no segment, see ``MISS``.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    digest = F.sha2("text", 256)
    paths = []

    def put(df, name):
        df, path = kept(df, f"text-{name}")
        paths.append(path)
        return df

    named = put(texts.select("doc_id", digest.alias("digest")), "digests")
    firsts = put(named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "firsts")
    bits, segments = segment_plan(named.count(), similarity)
    width = max(2, -(-bits * segments // 64))

    def code(batches):
        for batch in lean(batches):
            codes, sets, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                words = text.lower().split()
                h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
                h = shingle_hashes(h, shingle)
                codes.append(wide_code(h, width).tobytes())
                h = np.unique(h >> np.uint64(24))
                sets.append(pack(h))
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32())], names=["doc_id", "code", "shingles", "n"])

    coded = put(texts.select("doc_id", F.col("text").cast("binary")).mapInArrow(code, "doc_id long, code binary, shingles binary, n int"), "codes")
    copies = put(looked_up(named, firsts, "digest").select("doc_id", "first"), "copies")
    alone = firsts.select(F.col("first").alias("doc_id")).distinct()

    def verify(batches):
        for batch in lean(batches):
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = unpack(x), unpack(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= similarity * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def sets_of(ids, name):
        """The shingles of these documents and few others; only these move on to where pairs meet."""
        return put(sifted(coded.select("doc_id", "shingles"), "doc_id", ids), f"sets-{name}")

    def linked(pairs, sets, name):
        for c in "ab":
            pairs = pairs.join(sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}")), c)
        return put(pairs.select("a", "b", "set_a", "set_b").mapInArrow(verify, "a long, b long"), f"links-{name}")

    def within(group):
        give_back()
        sets, ids = [unpack(x) for x in group.column("shingles").to_pylist()], group.column("a").to_numpy()
        root = roots_of(sets, similarity)
        other = np.flatnonzero(ids[root] != ids)
        return pa.table([pa.array(ids[root[other]]), pa.array(ids[other])], names=["a", "b"])

    # a first round joins the many copies of groups; the second takes every pair whose ends true links have not joined
    codes = coded.select("doc_id", "code", "n").join(alone, "doc_id", "left_semi").withColumn("joined", F.col("doc_id"))
    easy = put(easy_pairs(codes, bits, min(FIRST, segments)), "pairs")
    first = linked(easy, sets_of(easy.select("a").union(easy.select("b")), "first"), "first")
    joined = components(first).select(F.col("node").alias("doc_id"), "root")
    codes = codes.join(joined, "doc_id", "left").select("doc_id", "code", "n", F.coalesce("root", "doc_id").alias("joined"))
    met = put(other_pairs(codes, bits, segments, similarity), "met")
    sets = sets_of(met.select("a").union(met.where("p < 0").select("b")), "rest")
    rest = linked(met.where("p < 0 AND a <> b").select("a", "b").distinct(), sets, "rest")
    full = met.where("p >= 0").drop("b").join(sets.withColumnRenamed("doc_id", "a"), "a")
    full = put(full.groupBy("segment", "key", "p", "q").applyInArrow(within, "a long, b long").distinct(), "links-full")
    edges = first.union(rest).union(full).union(copies.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    out = components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
    drop(docs.sparkSession, *paths)
    return out


def without_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with only the smallest id of each component; rows without an id stay, rows of equal ids share their fate."""
    gone = near_duplicates(docs, similarity, shingle).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
