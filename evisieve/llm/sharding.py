"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS cells, or more where the shards need them; each shard owns VNODES of them as virtual nodes. A row starts at the cell of its
text's hash, so equal texts start together, and goes to the first virtual node clockwise; where that shard is
full it continues clockwise to the next shard with room. Capacities add up to the number of rows and differ
by one at most, so the law is `rows`: counts at most one apart.

Only counts decide: rows are counted by (cell, spread), where `spread` hashes the id so that one hot text is
many small groups; the walk runs over these counts (CELLS * spreads at most, whatever the number of rows) and
says which ranks within a group go to which shard and slot. Texts are read once and never shuffled.

Defined results: a null text has no bytes and hashes as the empty one; repeated rows are placed one by one,
and which of two identical rows gets which slot doesn't matter, as they are equal; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

CELLS, VNODES = 4096, 128
ROWS_A_SPREAD, SPREADS_MOST = 1_000_000, 256


def cells_for(shards: int, vnodes: int = VNODES) -> int:
    """Cells of a ring: CELLS, or for more shards than fit the next power of two with room for all virtual nodes."""
    return max(CELLS, 1 << (shards * vnodes - 1).bit_length())


def ring(shards: int, cells: int = CELLS, vnodes: int = VNODES) -> dict[int, int]:
    """Cell -> shard for all virtual nodes; a shard's cells don't depend on later shards."""
    from hashlib import sha256

    if shards * vnodes > cells:
        raise ValueError("the ring has too few cells for so many virtual nodes")
    owner: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(sha256(f"shard {shard} node {v}".encode()).digest()[:8], "big") % cells
            while at in owner:
                at = (at + 1) % cells
            owner[at] = shard
    return owner


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[tuple[int, int], int], shards: int, cells: int = CELLS, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, spread, first rank, rank past the last, shard, slot of the first): where each group's rows go."""
    owner = ring(shards, cells, vnodes)
    nodes = sorted(owner)
    room = capacities(sum(counts.values()), shards)
    filled = [0] * shards
    out, node = [], 0
    for cell, spread in sorted(counts):
        while node < len(nodes) and nodes[node] < cell:
            node += 1
        left, rank, step = counts[cell, spread], 0, 0
        while left:
            shard = owner[nodes[(node + step) % len(nodes)]]
            take = min(left, room[shard] - filled[shard])
            if take:
                out.append((cell, spread, rank, rank + take, shard, filled[shard]))
                filled[shard] += take
                rank += take
                left -= take
            step += 1
    return out


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None) -> DataFrame:
    """id, size (UTF-8 bytes plus 1), text_crc32, shard and slot of each row.

    cells: of the ring; a number to keep where shards will be added, as few rows move only on the same ring.
    """
    spark, cells = docs.sparkSession, cells or cells_for(shards)
    shared_dir(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(F.xxhash64(text), F.lit(cells)).cast("int").alias("cell"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    base = stored(base, "shards")  # five numbers a row
    rows = base.count()
    spreads = min(SPREADS_MOST, max(16, rows // ROWS_A_SPREAD))
    base = base.select("id", "size", "text_crc32", "cell", F.pmod("h", F.lit(spreads)).cast("int").alias("spread"))
    counts = {(r[0], r[1]): r[2] for r in base.groupBy("cell", "spread").count().collect()}  # cells * spreads at most
    plan = spark.createDataFrame(walk(counts, shards, cells), "cell int, spread int, lo int, hi int, shard int, slot0 long")
    ranked = base.withColumn("rank", F.row_number().over(Window.partitionBy("cell", "spread").orderBy("id", "text_crc32", "size")) - 1)
    placed = ranked.join(F.broadcast(plan), ["cell", "spread"]).where("rank >= lo and rank < hi")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard"), (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))
