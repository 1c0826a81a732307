"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**ring_bits cells. Each shard owns the cells up to its virtual nodes; a
document's cell is a hash of its id. A shard takes its own cells' documents first, in
ring order; what is beyond its bound continues clockwise to the next shard with room.
With bounds that differ by one at most and add up to the number of documents, balance is
guaranteed, and only overflow leaves the shard that the ring names.

Documents within a cell are interchangeable, so the walk around the ring needs nothing
but the count of each cell: at most 2**ring_bits numbers, however many documents there
are. The documents themselves are ranked within their cells (one narrow shuffle) and take
shard and slot from the cell's intervals of ranks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

SHARDS = 40
VIRTUAL_NODES = 64
RING_BITS = 16


def ring_owners(shards: int, virtual_nodes: int, ring_bits: int) -> np.ndarray:
    """Shard of each cell: that of the first virtual node at or after it, clockwise.

    Two nodes on one cell are told apart by a second hash, so the order of the shards' numbers never decides.
    """
    nodes = np.arange(shards * virtual_nodes, dtype=np.uint64)
    shard, replica = nodes // np.uint64(virtual_nodes), nodes % np.uint64(virtual_nodes)
    x = shard * np.uint64(0x9E3779B97F4A7C15) + replica * np.uint64(0xD1B54A32D192ED03) + np.uint64(1)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    order = np.argsort(x, kind="stable")
    at = np.searchsorted((x[order] >> np.uint64(64 - ring_bits)).astype(np.int64), np.arange(1 << ring_bits))
    return shard[order].astype(np.int64)[at % len(order)]


def bounded_walk(counts: np.ndarray, owners: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) of every interval; counts is by cell."""
    total = int(counts.sum())
    own = np.bincount(owners, weights=counts, minlength=shards).astype(np.int64)
    bound = np.full(shards, total // shards, dtype=np.int64)
    bound[np.lexsort((np.arange(shards), -own))[: total % shards]] += 1
    used = np.zeros(shards, dtype=np.int64)
    out, left = [], []
    for cell in np.flatnonzero(counts).tolist():
        s, n = int(owners[cell]), int(counts[cell])
        take = min(n, int(bound[s] - used[s]))
        if take:
            out.append((cell, 0, take, s, int(used[s])))
            used[s] += take
        if take < n:
            left.append((cell, take, n))
    # overflow goes on clockwise; a shard that is full stays full, so each run of cells of one owner is passed once a lap
    turns = np.flatnonzero(owners != np.roll(owners, 1)).tolist() or [0]
    onward = list(range(len(turns)))

    def with_room(k: int) -> int:
        """The first turn at or after k whose shard has room; what is passed points ahead from then on."""
        passed = []
        while used[s := int(owners[turns[k]])] == bound[s] or onward[k] != k:
            passed.append(k)
            k = onward[k] if onward[k] != k else (k + 1) % len(turns)
        for p in passed:
            onward[p] = k
        return k

    for cell, begin, end in left:
        k = int(np.searchsorted(turns, cell, side="right")) % len(turns)
        while begin < end:
            k = with_room(k)
            s = int(owners[turns[k]])
            take = min(end - begin, int(bound[s] - used[s]))
            out.append((cell, begin, begin + take, s, int(used[s])))
            used[s] += take
            begin += take
    return out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, ring_bits: int = RING_BITS, keep: list[str] | None = None, order: tuple[Column, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, cell, shard, slot``.

    Shards hold equally many rows, to one row; slots count from 0 in each without a gap.
    Size is the text's UTF-8 bytes plus 16, and the CRC that of those bytes; a null text has
    none. The cell of a row without an id is a hash of its text; rows that repeat an id are told apart by
    their texts' CRC and size, and identical ones are interchangeable. An empty table gives
    an empty one. Other columns are ignored, or carried along as the struct ``row`` if
    named in ``keep``.

    ``order`` is a number of the stretch and a number within it, distinct for each row and
    the same whenever ``docs`` is read: slots then follow it within their shard, and of a
    cell's documents the last ones overflow.
    """
    spark = docs.sparkSession
    cell = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(""))), 64 - ring_bits).cast("int")
    counts = np.zeros(1 << ring_bits, dtype=np.int64)
    for at, n in docs.select(cell.alias("cell")).groupBy("cell").count().collect():
        counts[at] = n
    spans = bounded_walk(counts, ring_owners(shards, virtual_nodes, ring_bits), shards)
    plan = spark.createDataFrame(spans, "cell int, begin long, end long, shard int, base long")
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows_of = [F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), cell.alias("cell"), *([F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")] if keep else [])]
    if order:
        slots = _slots_in_order(docs.select(cell.alias("cell"), order[0].alias("stretch"), order[1].alias("within")), plan)
        return docs.select(order[0].alias("stretch"), order[1].alias("within"), *rows_of).join(slots, ["stretch", "within"]).select("doc_id", "size", "text_crc32", *(["row"] if keep else []), "cell", "shard", "slot")
    rows = docs.select(*rows_of)
    in_cell = Window.partitionBy("cell").orderBy(F.xxhash64("doc_id"), "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(in_cell).cast("long") - 1)
    # 2**ring_bits cells at most, each with one interval but for the few that overflow
    placed = ranked.join(F.broadcast(plan), "cell").filter("rank >= begin and rank < end")
    return placed.select("doc_id", "size", "text_crc32", *(["row"] if keep else []), "cell", "shard", (F.col("base") + F.col("rank") - F.col("begin")).alias("slot"))


def _slots_in_order(keys: DataFrame, plan: DataFrame) -> DataFrame:
    """``stretch, within, shard, slot`` of ``keys(cell, stretch, within)``: narrow rows, numbered a stretch at a time."""
    ranked = keys.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("stretch", "within")).cast("long") - 1)
    placed = materialize(ranked.join(F.broadcast(plan), "cell").filter("rank >= begin and rank < end").select("stretch", "within", "shard"), "shard-order")
    before = Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "stretch").count().select("shard", "stretch", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("shard", "stretch").orderBy("within")).cast("long") - 1
    return placed.withColumn("nth", nth).join(offsets, ["shard", "stretch"]).select("stretch", "within", "shard", (F.col("offset") + F.col("nth")).alias("slot"))
