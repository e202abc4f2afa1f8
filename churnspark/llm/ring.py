"""Operator 13: sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` places.  Each shard stands on it with ``vnodes`` virtual nodes; a row's
place is the hash of its text, and its home is the first virtual node at or clockwise of that
place.  A shard takes at most its capacity: the rows of its home that come last on the ring beyond
it overflow and continue clockwise, past full shards, to the first one with room.  With
``slack`` 0 the capacities add up to the number of rows exactly (``rows // n`` each, one more for
the first ``rows % n`` shards), so counts are at most one apart: law ``rows``.  A slack of e leaves
each shard room for (1 + e) times its share, and fewer rows leave their home.

Only the counts of the cells, a table of fixed size, decide where rows go, so a cell is cut into
runs of consecutive rows, each for one shard.  Rows are numbered once in ring order over many
range partitions (copies of one text by id, rows equal in both by their place in the input), and
the run that holds a row's number gives its shard and its slot.  A group of copies, of whatever
size, stays together until its shard is full and then fills the next ones clockwise; it never
meets in one task.

Null texts count as empty (size 1, one group); null ids come first within their text; equal rows
get slots of their own; very long texts are one row each; an empty table gives no rows.  Extra
columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.llm._shared import col, staged, table, text_or_empty
from churnspark.operators.rows import positions

N_SHARDS = 8
VNODES = 64
#: Places of the ring, a power of two; also the bound of what reaches the driver.
CELLS = 1 << 14


def cell_of(key: Column, cells: int = CELLS) -> Column:
    """The place of a 64-bit hash: its highest bits."""
    return F.shiftrightunsigned(key, 64 - (cells.bit_length() - 1)).cast("int")


def ring_nodes(spark: SparkSession, n_shards: int, vnodes: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in ring order.  The first of two nodes that meet in a cell
    keeps it; a shard's nodes depend on its own number alone."""
    nodes = spark.range(n_shards * vnodes).select(
        F.expr(f"cast(id % {n_shards} as int)").alias("shard"), F.expr(f"id div {n_shards}").alias("node"))
    h = F.xxhash64(F.lit("shard"), F.col("shard"), F.col("node"))
    held = nodes.select(cell_of(h, cells).alias("cell"), h.alias("h"), "shard").groupBy("cell").agg(
        F.min_by("shard", F.struct("h", "shard")).alias("shard"))
    return sorted((r.cell, r.shard) for r in held.collect())


def homes(nodes: list[tuple[int, int]], cells: int) -> list[int]:
    """The node (its number in ring order) that each cell belongs to: the first at or after it."""
    out, k = [], 0
    for c in range(cells):
        while k < len(nodes) and nodes[k][0] < c:
            k += 1
        out.append(k % len(nodes))
    return out


def place(counts: dict[int, int], nodes: list[tuple[int, int]], n_shards: int, cells: int = CELLS,
          slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first, last, shard, slot of the first): which rows, by their number within their
    cell from 0, go where.  First every shard keeps rows of its own cells up to its capacity, then
    the others continue clockwise in ring order."""
    total = sum(counts.values())
    if slack > 0:
        most = -(-int(total * (1 + slack)) // n_shards) + 1
        capacity = [most] * n_shards
    else:
        capacity = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    home = homes(nodes, cells)
    used, runs, left = [0] * n_shards, [], []

    def give(cell: int, start: int, n: int, shard: int) -> None:
        runs.append((cell, start, start + n - 1, shard, used[shard]))
        used[shard] += n

    for cell in sorted(counts):
        n, shard = counts[cell], nodes[home[cell]][1]
        kept = min(n, capacity[shard] - used[shard])
        if kept:
            give(cell, 0, kept, shard)
        if kept < n:
            left.append((cell, kept, n - kept))
    for cell, start, n in left:
        k = home[cell]
        while n:
            shard = nodes[k % len(nodes)][1]
            kept = min(n, capacity[shard] - used[shard])
            if kept:
                give(cell, start, kept, shard)
                start, n = start + kept, n - kept
            k += 1
    return runs


def ring_shards(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text",
                vnodes: int = VNODES, cells: int = CELLS, slack: float = 0.0) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size`` (UTF-8 bytes of the text and one more),
    ``text_crc32``, ``home`` (the shard the ring alone names), ``shard`` and ``slot`` (gapless from 0
    within a shard)."""
    spark = docs.sparkSession
    raw = text_or_empty(text_col).cast("binary")
    rows = docs.select(col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"), F.xxhash64(F.lit("ring"), text_or_empty(text_col)).alias("key"))
    rows = staged(rows.withColumn("cell", cell_of(F.col("key"), cells)), "ring")
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    nodes = ring_nodes(spark, n_shards, vnodes, cells)
    home = homes(nodes, cells)
    starts, at = {}, 0
    for c in sorted(counts):
        starts[c] = at
        at += counts[c]
    # numbers over the whole ring; at most one run a cell and a few more where shards get full
    runs = [{"cell": c, "first": starts[c] + a + 1, "last": starts[c] + b + 1, "shard": s, "base": base,
             "home": nodes[home[c]][1]} for c, a, b, s, base in place(counts, nodes, n_shards, cells, slack)]
    listed = spark.range(1).select(F.inline(F.from_json(
        F.lit(json.dumps(runs)), "array<struct<cell int, first bigint, last bigint, shard int, base bigint, home int>>")))
    numbered = positions(rows.withColumn("_seq", F.monotonically_increasing_id()), ["cell", "key", "doc_id", "_seq"], name="pos")
    inside = F.col("pos").between(F.col("first"), F.col("last"))
    return numbered.join(F.broadcast(listed), (numbered["cell"] == listed["cell"]) & inside).select(
        "doc_id", "size", "text_crc32", "home", "shard", (F.col("base") + F.col("pos") - F.col("first")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ring_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "home")
