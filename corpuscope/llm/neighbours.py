"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after rotations learned so that the signs lose little (iterative quantisation). A code
is split into m substrings of about as many bits as the logarithm of the rows, and each substring has an index from its value to rows.
With a Hamming radius r = q * m + a, two codes within it differ by at most q bits in one of the first a + 1 substrings or by
at most q - 1 in one of the others, or the differences would add up to more; so probing each index with all values that
close finds every code within the radius. Those are reranked by the cosine of the vectors themselves.

Rows lie in blocks, each with its own indexes; queries come to the blocks in sets of bounded size. The radius is chosen
on a sample so that it holds the nearest neighbours there; a block with too few codes in it widens the radius. How much of a
block the probes reach follows from the data: little where neighbours are much closer than other vectors, most of it where they are not.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscope.llm.common import table
from corpuscope.llm.vectors import matrix, norms, rotation, usable

#: The rotations and the radius are learned on at most so many vectors, those with the smallest hashed ids.
SAMPLE = 12_000
#: Share of true neighbours of the sample that the radius must hold.
HELD = 0.99
ROWS_A_BLOCK, QUERIES_A_SET = 8_192, 8_192
#: Substrings have at least and at most so many bits.
LEAST_BITS, MOST_BITS = 8, 16
_POP = np.array([bin(x).count("1") for x in range(256)], np.int64)


@lru_cache(maxsize=None)
def flips(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All differences of values of ``bits`` bits, those with few bits first, and how many have at most k bits."""
    values = np.arange(1 << bits, dtype=np.int64)
    ones = np.bitwise_count(values).astype(np.int64)
    return values[np.argsort(ones, kind="stable")], np.cumsum(np.bincount(ones, minlength=bits + 1))


def learned_rotation(x: np.ndarray, seed: int, steps: int = 30) -> np.ndarray:
    """Iterative quantisation on unit vectors: principal axes, then by turns the nearest signs and the rotation that
    brings the vectors nearest to them."""
    _, axes = np.linalg.eigh(x.T @ x)
    v = x @ axes
    turn = rotation(x.shape[1], seed)
    for _ in range(steps):
        u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
        turn = (u @ w).T
    return axes @ turn


class Coder:
    """Codes of vectors of one dimension: ``tables`` rotations, each giving a sign for every dimension."""

    def __init__(self, turns: np.ndarray, radius: int):
        self.turns, self.radius = turns, radius

    @classmethod
    def fit(cls, x: np.ndarray, k: int, tables: int = 2, seed: int = 7) -> Coder:
        unit = x / norms(x)[:, None]
        turns = np.hstack([learned_rotation(unit, seed + t) for t in range(tables)])
        out = cls(turns, turns.shape[1])
        if len(x) > k:
            codes, asked = out.codes(x), np.arange(0, len(x), max(1, len(x) // 400))
            far = []
            for q in asked:
                near = unit @ unit[q]
                near[q] = -2.0
                best = np.argpartition(-near, k - 1)[:k]
                far.append(_POP[codes[best] ^ codes[q]].sum(axis=1))
            out.radius = int(np.quantile(np.concatenate(far), HELD))
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.turns > 0, axis=1)


class Index:
    """A block's rows by the value of each substring of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        width = 8 * codes.shape[1]
        wanted = min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(2, len(codes))))))
        self.cuts = np.linspace(0, width, max(1, round(width / wanted)) + 1).astype(int)
        self.rows, self.starts = [], []
        for value, bits in zip(self.values(codes), np.diff(self.cuts).tolist(), strict=True):
            order = np.argsort(value, kind="stable")
            self.rows.append(order)
            self.starts.append(np.searchsorted(value[order], np.arange((1 << bits) + 1)))

    def values(self, codes: np.ndarray) -> list[np.ndarray]:
        """The substrings of each code as numbers."""
        signs = np.unpackbits(codes, axis=1).astype(np.int64)
        return [signs[:, a:b] @ (np.int64(1) << np.arange(b - a, dtype=np.int64)) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Marks the rows that the substrings' indexes give for a radius: all within it, and others."""
        mark, m = np.zeros(len(self.codes), bool), len(self.rows)
        whole, rest = divmod(radius, m)
        for k, (rows, starts, value) in enumerate(zip(self.rows, self.starts, self.values(code[None, :]), strict=True)):
            reach = whole if k <= rest else whole - 1
            if reach < 0:
                break
            values, within = flips(int(self.cuts[k + 1] - self.cuts[k]))
            near = values[: within[min(reach, len(within) - 1)]] ^ value[0]
            begin, count = starts[near], starts[near + 1] - starts[near]
            full = np.flatnonzero(count)
            begin, count = begin[full], count[full]
            total = int(count.sum())
            if total:
                ends = np.cumsum(count)
                mark[rows[np.arange(total) + np.repeat(begin - ends + count, count)]] = True
        return mark

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose codes differ from ``code`` in at most ``radius`` bits."""
        found = np.flatnonzero(self.probed(code, radius))
        return found[_POP[self.codes[found] ^ code].sum(axis=1) <= radius]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row of ``queries`` its ``k`` nearest rows of ``vectors`` (both with an id and an array of numbers) by
    cosine: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``. Equal scores go to the smaller id.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do rows with a null
    id; a query is compared with vectors of its length only, never with rows of its own id; fewer than ``k`` give all.
    Of queries with equal ids one is answered. Rows of ``vectors`` with equal ids are separate candidates. Other
    columns are ignored; empty tables give no rows.

    Every row is indexed, in blocks of about ``ROWS_A_BLOCK``; queries meet a block in sets of about
    ``QUERIES_A_SET``, and of each set and block only ``k`` rows a query go on.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    rows, asked = clean(vectors), clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sizes = Counter(len(x) for x in sample.column("v"))
    coders = {}
    for size in sizes:
        at = [i for i, x in enumerate(sample.column("v")) if len(x) == size]
        coders[size] = Coder.fit(matrix(sample.column("v").take(pa.array(at))), k)
    shared = spark.sparkContext.broadcast({size: (c.turns, c.radius) for size, c in coders.items()})
    blocks = max(1, -(-rows.count() // ROWS_A_BLOCK))
    sets = max(1, -(-asked.count() // QUERIES_A_SET))

    slot = lambda df, n: df.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = slot(rows, blocks).select(F.size("v").alias("d"), F.col("slot").alias("block"), spread(sets).alias("part"), F.lit(False).alias("asks"), "id", "v")
    asking = slot(asked, sets).select(F.size("v").alias("d"), spread(blocks).alias("block"), F.col("slot").alias("part"), F.lit(True).alias("asks"), "id", "v")

    def search(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        ids, x = group.column("id").to_numpy(), matrix(group.column("v"))
        own, own_ids, q, q_ids = x[~asks], ids[~asks], x[asks], ids[asks]
        found: tuple[list, list, list] = ([], [], [])
        if len(own) and len(q):
            turns, radius = shared.value.get(x.shape[1], (rotation(x.shape[1], 0), x.shape[1]))
            coder = Coder(turns, radius)
            index, own_norms = Index(coder.codes(own)), norms(own)
            for v, code, size, q_id in zip(q, coder.codes(q), norms(q), q_ids.tolist(), strict=True):
                reach = radius
                while True:
                    at = index.within(code, reach)
                    at = at[own_ids[at] != q_id]
                    if len(at) >= k or reach >= turns.shape[1]:
                        break
                    reach = min(turns.shape[1], reach + max(1, reach // 8))
                score = (own[at] * v).sum(axis=1) / (own_norms[at] * size)
                best = np.lexsort((own_ids[at], -score))[:k]
                found[0].extend([q_id] * len(best))
                found[1].extend(own_ids[at][best].tolist())
                found[2].extend(score[best].tolist())
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    near = stored.unionByName(asking).groupBy("d", "block", "part").applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector against all."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)
