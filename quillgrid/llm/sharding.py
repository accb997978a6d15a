"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.llm.util import stored

#: The ring is cut into this many cells of equal hash range; what reaches the driver is two numbers a cell.
CELLS = 8192
VIRTUAL_NODES = 128
#: A shard takes at most (1 + SLACK) times the mean load before keys continue clockwise.
SLACK = 0.002


@dataclass(frozen=True)
class Ring:
    """Virtual nodes of ``shards`` shards on a ring of ``cells`` cells."""

    shards: int
    virtual_nodes: int = VIRTUAL_NODES
    cells: int = CELLS

    def points(self) -> list[tuple[int, int]]:
        def at(shard: int, k: int) -> int:
            return int.from_bytes(hashlib.sha256(f"{shard}/{k}".encode()).digest()[:8], "big") % self.cells

        return sorted((at(s, k), s) for s in range(self.shards) for k in range(self.virtual_nodes))

    def clockwise(self) -> list[list[int]]:
        """For each cell its shards in the order in which a key of the cell meets them."""
        points = self.points()
        places = [p for p, _ in points]
        out = []
        for cell in range(self.cells):
            i, order = bisect_left(places, cell), []
            for j in range(len(points)):
                s = points[(i + j) % len(points)][1]
                if s not in order:
                    order.append(s)
                    if len(order) == self.shards:
                        break
            out.append(order)
        return out


def fill(ring: Ring, loads: dict[int, int], slack: float = SLACK) -> list[tuple[int, int, int]]:
    """Walk the ring once: (cell, first load unit, shard) for each piece of each cell.

    A cell goes to the first shard clockwise that has room; what does not fit continues clockwise, so a
    cell is cut only where a shard fills up, and no shard is given more than its bound.
    """
    total = sum(loads.values())
    bound = math.ceil(total * (1 + slack) / ring.shards)
    room = [bound] * ring.shards
    pieces = []
    for cell, order in enumerate(ring.clockwise()):
        left, start = loads.get(cell, 0), 0
        for s in order:
            if left and room[s]:
                take = min(left, room[s])
                pieces.append((cell, start, s))
                room[s] -= take
                left -= take
                start += take
    return pieces


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK, cells: int = CELLS) -> DataFrame:
    """Put every row into a shard; sizes in bytes are near equal.

    A row's key is the hash of its id and text.  Its place on the ring is that hash; it belongs to the next
    virtual node clockwise unless that shard is full, and then to the next shard clockwise with room.  Rows
    arrive in ring order, so the result depends on the rows alone, not on partitions.  A row that straddles
    a shard's bound stays where it begins: a shard exceeds its bound by less than one row for each time it
    fills up.

    Scale: one scan writes (id, size, crc32, hash) to the shared folder; sums per cell (a fixed number of
    cells) reach the driver; the running sums are windows over cells, none over a shard.

    Returns id, size (UTF-8 bytes + 1; null text: 1), text_crc32, shard, slot (gapless from 0 in each shard,
    in ring order).  Null ids hash like a value of their own; repeated rows get a slot each; an empty table
    gives no rows; very long texts are only measured; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.col(id_col), text)
    compact = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        key.alias("key"),
    )
    compact = compact.withColumn("cell", F.pmod(F.shiftrightunsigned("key", 20), F.lit(cells)).cast("int"))
    compact = stored(compact, "shard-keys")
    loads = {r["cell"]: r["load"] for r in compact.groupBy("cell").agg(F.sum("size").alias("load")).collect()}
    pieces = fill(Ring(shards, virtual_nodes, cells), loads, slack)
    spark = docs.sparkSession
    #: One row a cell, its pieces as an array: at most ``cells`` rows, cut at most once a shard and cell.
    by_cell: dict[int, list[tuple[int, int]]] = {}
    for cell, start, s in pieces:
        by_cell.setdefault(cell, []).append((start, s))
    plan = spark.createDataFrame([(c, p) for c, p in by_cell.items()], "cell int, pieces array<struct<start:long,shard:int>>")
    in_cell = Window.partitionBy("cell").orderBy("key", "id", "size", "text_crc32")
    before = (F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before")
    placed = compact.select("*", before).join(F.broadcast(plan), "cell")
    piece = F.element_at(F.filter("pieces", lambda p: p["start"] <= F.col("before")), -1)
    placed = placed.select("id", "size", "text_crc32", "key", "cell", piece["shard"].alias("shard"))
    placed = stored(placed, "shard-rows")
    counts = {(r["shard"], r["cell"]): r["n"] for r in placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).collect()}
    offsets, at = [], dict.fromkeys(range(shards), 0)
    for s, cell in sorted(counts):
        offsets.append((s, cell, at[s]))
        at[s] += counts[s, cell]
    offsets_df = spark.createDataFrame(offsets, "shard int, cell int, first_slot long")
    in_piece = Window.partitionBy("cell", "shard").orderBy("key", "id", "size", "text_crc32")
    out = placed.withColumn("n", F.row_number().over(in_piece)).join(F.broadcast(offsets_df), ["shard", "cell"])
    return out.select("id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("n") - 1).alias("slot"))
