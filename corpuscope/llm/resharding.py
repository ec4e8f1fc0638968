"""Sharding: minimum-cost-flow resharding.

Documents lie in old shards, each cut into blocks by a hash of the document id. From the bytes in each old shard and
the capacities of the new shards, a minimum-cost flow says how many bytes move from where to where; whole blocks carry
the flow out; then the files of the shards that gain or lose blocks are written anew.

The flow and the blocks are decided on the driver, over ``old_shards * blocks`` pairs of numbers: ``BLOCKS`` for each old shard, or
one for each ``BLOCK_BYTES`` where that is more, so a block is never more than a few files. Rows move once, straight into their file.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuscope.llm.common import aside, fresh_path, table

INFINITE = float("inf")
#: An old shard has at least so many blocks, and as many as it takes for blocks of about so many bytes.
BLOCKS, BLOCK_BYTES = 512, 256 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost=None) -> dict[tuple[int, int], int]:
    """The cheapest way to carry every unit of ``supply`` to places with ``capacity``: {(from, to): units}.

    ``cost(i, j)`` is per unit, by default 0 where i == j and 1 elsewhere. Successive shortest paths with potentials,
    so costs may be any non-negative numbers. Raises ValueError if the supply does not fit.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards cannot hold all bytes")
    cost = cost or (lambda i, j: 0 if i == j else 1)
    n, m = len(supply), len(capacity)
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    potential = [0.0] * (n + m)
    while any(left):
        far = [0.0 if i < n and left[i] else INFINITE for i in range(n + m)]
        came: list[int | None] = [None] * (n + m)
        heap = [(0.0, i) for i in range(n) if left[i]]
        done = [False] * (n + m)
        end = None
        while heap:
            d, v = heapq.heappop(heap)
            if done[v]:
                continue
            done[v] = True
            if v >= n and room[v - n]:
                end = v
                break
            edges = ((n + j, price[v][j]) for j in range(m)) if v < n else ((i, -price[i][v - n]) for i in range(n) if flow.get((i, v - n)))
            for w, c in edges:
                new = d + c + potential[v] - potential[w]
                if not done[w] and new < far[w] - 1e-12:
                    far[w], came[w] = new, v
                    heapq.heappush(heap, (new, w))
        reach = far[end]
        for v in range(n + m):
            potential[v] += min(far[v], reach)
        path, v = [], end
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        amount = min(left[v], room[end - n], *(flow[w, x - n] for x, w in path if x >= n))
        for x, w in path:
            if x < n:
                flow[x, w - n] = flow.get((x, w - n), 0) + amount
            else:
                flow[w, x - n] -= amount
        left[v] -= amount
        room[end - n] -= amount
    return {k: v for k, v in flow.items() if v}


@dataclass
class Plan:
    """blocks: (old shard, block, rows, bytes, new shard, slot of the block's first row)."""

    blocks: list[tuple[int, int, int, int, int, int]]
    flow: dict[tuple[int, int], int]
    shards: int

    @property
    def affected(self) -> set[int]:
        """Shards that gain or lose a block: the files to write anew."""
        return {x for old, _, _, _, new, _ in self.blocks if old != new for x in (old, new)}

    @property
    def moved(self) -> int:
        return sum(size for old, _, _, size, new, _ in self.blocks if old != new)


def plan_moves(sizes: list[tuple[int, int, int, int]], shards: int, capacity: list[int] | None = None, cost=None) -> Plan:
    """From (old shard, block, rows, bytes) to a plan. Without ``capacity`` the new shards get equal bytes.

    The flow is in bytes and blocks are whole, so each old shard deals its largest blocks first, each to the target
    that still lacks most; then single blocks move while that brings the fullest and the emptiest
    shard closer to their shares. Ties go to smaller numbers, so the plan depends on nothing but its arguments.
    """
    total = sum(x[3] for x in sizes)
    olds = 1 + max((x[0] for x in sizes), default=0)
    want = list(capacity) if capacity else [total // shards + (i < total % shards) for i in range(shards)]
    supply = [0] * olds
    of: dict[int, list[tuple[int, int, int]]] = {}
    for old, block, rows, size in sizes:
        supply[old] += size
        of.setdefault(old, []).append((size, block, rows))
    flow = min_cost_flow(supply, want, cost)
    share = want
    if capacity:  # what the flow brings, where there is more room than bytes
        share = [sum(v for (_, j), v in flow.items() if j == x) for x in range(shards)]
    load = [0] * shards
    owned: list[list[tuple[int, int, int, int]]] = [[] for _ in range(shards)]  # bytes, old, block, rows
    for old in sorted(of):
        lacks = [(-v, j) for (i, j), v in sorted(flow.items()) if i == old]
        heapq.heapify(lacks)
        for size, block, rows in sorted(of[old], key=lambda x: (-x[0], x[1])):
            lack, j = heapq.heappop(lacks) if lacks else (0, old % shards)
            owned[j].append((size, old, block, rows))
            load[j] += size
            heapq.heappush(lacks, (lack + size, j))
    for x in owned:
        x.sort()
    for _ in range(50 * shards):
        over = max(range(shards), key=lambda j: (load[j] - share[j], -j))
        under = min(range(shards), key=lambda j: (load[j] - share[j], j))
        gap = (load[over] - share[over]) - (load[under] - share[under])
        best = min(((abs(gap - 2 * x[0]), x[0], x) for x in owned[over] if 0 < x[0] < gap), default=None)
        if best is None:
            break
        x = best[2]
        owned[over].remove(x)
        owned[under].append(x)
        load[over] -= x[0]
        load[under] += x[0]
    blocks = []
    for j, own in enumerate(owned):
        slot = 0
        for size, old, block, rows in sorted(own, key=lambda x: (x[1], x[2])):
            blocks.append((old, block, rows, size, j, slot))
            slot += rows
    return Plan(blocks, flow, shards)


def text_size(text) -> F.Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def placed(docs: DataFrame, old_shards: int, blocks: int, id_col: str = "doc_id") -> DataFrame:
    """Adds ``_old_shard`` and ``_block``, from hashes of the id; the block's also counts ``size``, so rows without an id, or of one
    id, lie in many blocks."""
    h = F.xxhash64(id_col)
    own = F.xxhash64(id_col, "size")
    return docs.withColumn("_old_shard", F.pmod(h, F.lit(old_shards)).cast("int")).withColumn("_block", F.pmod(own, F.lit(blocks)).cast("int"))


def block_sizes(docs: DataFrame) -> list[tuple[int, int, int, int]]:
    rows = docs.groupBy("_old_shard", "_block").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
    return sorted(tuple(r) for r in rows)


def rewrite(docs: DataFrame, plan: Plan, path: str, file_bytes: int = 128 << 20, only: set[int] | None = None) -> DataFrame:
    """Writes the rows of new shards under ``path`` (one folder a shard, files of about ``file_bytes``) and reads
    them back, with columns ``shard`` and ``slot``.

    ``docs`` has ``_old_shard``, ``_block`` and ``size``. With ``only`` (say ``plan.affected``) just those shards'
    folders are replaced, and only rows of blocks that end there are read. Rows of a shard are in order of block and
    ``doc_id``; a slot is the row's place in that order.
    """
    spark = docs.sparkSession
    schema = "_old_shard int, _block int, shard int, _first_slot long, _file int"
    rows, filled, files = [], {}, {}
    for old, block, _, size, shard, slot in plan.blocks:
        if only is None or shard in only:
            rows.append((old, block, shard, slot, files.setdefault((shard, filled.get(shard, 0) // file_bytes), len(files))))
            filled[shard] = filled.get(shard, 0) + size
    frame = pd.DataFrame(rows, columns=["_old_shard", "_block", "shard", "_first_slot", "_file"])
    # one row a block
    moves = spark.createDataFrame(frame, schema) if rows else spark.createDataFrame([], schema)
    order = [c for c in ("doc_id", "size", "text_crc32") if c in docs.columns]
    # a task for each file
    out = docs.join(F.broadcast(moves), ["_old_shard", "_block"]).repartitionById(max(1, len(files)), "_file")
    out = out.withColumn("slot", F.col("_first_slot") + F.row_number().over(Window.partitionBy("_file", "_block", "_old_shard").orderBy(*order)) - 1).drop("_first_slot", "_file", "_block", "_old_shard")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(T.StructType(out.schema.fields)).parquet(path)


def reshard(docs: DataFrame, path: str, old_shards: int, shards: int, blocks: int | None = None, **more) -> tuple[DataFrame, Plan]:
    """Deals ``docs`` (``doc_id``, ``text``, any others) from ``old_shards`` to ``shards`` files of near equal bytes.

    A document's size is the UTF-8 bytes of its text plus 16; a null text has no bytes. Nulls and repeats in any
    column are kept as they are; a null id hashes like any other. A text of any length stays whole, in one file. An empty
    table gives no rows. Columns of ``docs`` named ``size``, ``shard`` or ``slot`` are replaced.
    """
    docs, back = aside(docs.drop("size", "shard", "slot"), "_old_shard", "_block", "_first_slot", "_file")
    sized = docs.withColumn("size", text_size(F.col("text")))
    if blocks is None:
        total = sized.agg(F.sum("size")).first()[0] or 0
        blocks = max(BLOCKS, -(-total // (old_shards * BLOCK_BYTES)))
    laid = placed(sized, old_shards, blocks)
    plan = plan_moves(block_sizes(laid), shards)
    return rewrite(laid, plan, path, **more).select(*back, "size", "shard", "slot"), plan


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, from 32 old shards into 40."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards, _ = reshard(docs, fresh_path(spark, "shards"), old_shards=32, shards=40)
    return shards.select(
        "doc_id",
        F.col("size").cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
