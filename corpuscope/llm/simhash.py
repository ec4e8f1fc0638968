"""SimHash near-duplicates, candidates by pigeonring filtering.

A fingerprint's 64 bits form a ring of four segments. If two fingerprints differ in at most two bits, then by the
pigeonring principle some chain of consecutive segments keeps every one of its prefixes within a proportional budget:
one segment differs in at most 2/4 bits, that is in none, two in at most one, three in at most one, four in at most two.
So a chain's first segment and one of the next two are equal: fingerprints that agree on such a pair of segments share a
bucket, chains then prune the bucket's pairs, and the full Hamming distance is taken for what is left.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpuscope.llm.common import drop, kept, looked_up, small_batches, table
from corpuscope.llm.components import components

RADIUS, SEGMENTS, WIDTH = 2, 4, 16
#: Buckets of up to so many fingerprints are compared pair by pair; larger ones meet at shared neighbours, which needs
#: no pairs and finds the same components.
PAIRWISE = 32

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Of ASCII-lower-cased UTF-8: bit i is set if more than half of all shingle hashes have it; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if n > 0 else [b" ".join(words)]
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), dtype="<u8", count=max(n, 1))
    if len(h) < 64:
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        octets = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8).T)
        ones = np.concatenate([np.bincount(x, minlength=256) @ _BITS for x in octets])
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long. A null text is an empty one."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _segment(x: str, i: int) -> str:
    return f"(shiftrightunsigned({x}, {WIDTH * i}) & {(1 << WIDTH) - 1})"


def chain_condition(x: str, y: str) -> str:
    """SQL: some chain of segments of the ring keeps all its prefixes within budget."""
    d = [f"bit_count({_segment(f'({x} ^ {y})', i)})" for i in range(SEGMENTS)]

    def viable(i: int) -> str:
        sums = [" + ".join(d[(i + k) % SEGMENTS] for k in range(n)) for n in range(1, SEGMENTS + 1)]
        return "(" + " AND ".join(f"({s}) * {SEGMENTS} <= {n * RADIUS}" for n, s in enumerate(sums, 1)) + ")"

    return "(" + " OR ".join(viable(i) for i in range(SEGMENTS)) + ")"


def links(fps: DataFrame) -> DataFrame:
    """From distinct fingerprints ``fp`` to edges (``a``, ``b``) whose components are those of all links.

    A bucket of one pair of equal segments with more than ``PAIRWISE`` fingerprints has its members emit themselves
    and their 32 neighbours in the other two segments: two fingerprints differ in at most two bits exactly if they
    have a neighbour in common, and each hangs on the smallest fingerprint that shares one. The work is linear. The
    pairs of either kind pass the ring's chains before their Hamming distance is taken.
    """
    pairs = list(combinations(range(SEGMENTS), 2))
    keys = ", ".join(f"struct({k} AS k, ({_segment('fp', i)} << {WIDTH}) | {_segment('fp', j)} AS v)" for k, (i, j) in enumerate(pairs))
    keyed = fps.select("fp", F.explode(F.expr(f"array({keys})")).alias("key")).select("fp", "key.k", "key.v")
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared, _ = kept(keyed.join(sizes, ["k", "v"]), "simhash-buckets")

    cold = shared.where(F.col("n") <= PAIRWISE).groupBy("k", "v").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    cold = cold.select("fps", F.posexplode("fps").alias("i", "a")).select("a", F.explode(F.expr("filter(slice(fps, i + 2, size(fps)), b -> " + chain_condition("a", "b") + ")")).alias("b"))

    others = [[b for s in range(SEGMENTS) if s not in p for b in range(WIDTH * s, WIDTH * s + WIDTH)] for p in pairs]
    masks = "array(" + ", ".join("array(0L, " + ", ".join(f"shiftleft(1L, {b})" for b in bits) + ")" for bits in others) + ")"
    near = shared.where(F.col("n") > PAIRWISE).select("k", "fp", F.explode(F.expr(f"transform({masks}[k], m -> fp ^ m)")).alias("x"))
    least = near.groupBy("k", "x").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    hot = near.join(least, ["k", "x"]).where("fp != a").select("a", F.col("fp").alias("b")).where(chain_condition("a", "b"))
    return cold.select("a", "b").union(hot).where(f"bit_count(a ^ b) <= {RADIUS}")


def near_copies(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``fp`` and ``component_id``, the smallest
    ``doc_id`` reachable over fingerprints that differ in at most two bits.

    Texts without words, null ones included, have fingerprint 0 and link like any other. Rows with a null id have a
    component as well; it is null only if no row of it has an id. Empty tables give no rows; other columns are ignored.
    Any share of the rows may have one fingerprint, as empty texts do: see ``looked_up``.
    """
    marked, _ = kept(fingerprints(docs, shingle), "simhash")
    distinct, path = kept(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    found = components(links(distinct.select("fp")))
    roots = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    named = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    classes, _ = kept(roots.join(named, "root").select("fp", "component_id", "n"), "simhash-classes")
    drop(docs.sparkSession, path)
    return looked_up(marked, classes, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 3-word shingles."""
    out = near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
