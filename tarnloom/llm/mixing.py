"""Mixing sources to target weights by Pfair scheduling. DataFrame and SQL functions; the driver deals blocks.

Each source's documents, in a keyed shuffle of their own, are cut into blocks. Of a source
with the share w of the weights block k has the release time floor(k / w) and the deadline
ceil((k + 1) / w), from the exact weights, and each slot goes to the released block with
the earliest deadline. On one processor this earliest-deadline-first order meets every
deadline, so at every slot each source has received its share to within less than one
block. When a source is used up the others share its slots in proportion: time then runs
by the sum of the weights that are left, and the bound holds across it.

The driver deals blocks, from nothing but each source's count. As soon as the state of all
sources recurs after a round of exact quotas, rounds repeat until the next source ends, and
are written once; weights without a short common round are dealt to the end. Documents are
counted and numbered in buckets of bounded size, so a source with a third of all rows is
spread over as many tasks as its rows need.
"""

from __future__ import annotations

import array
import bisect
import collections
import heapq
import itertools
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import new_path
from .store import materialize

BLOCK_ROWS = 8
#: Rows that are numbered together.
BUCKET_ROWS = 5_000
#: Slots of a schedule that is broadcast; larger ones are joined as Spark sees fit.
BROADCAST_SLOTS = 500_000
#: Rows that the driver collects before it writes them.
PIECE_ROWS = 500_000


def quotas(weighted: DataFrame, slots: int) -> DataFrame:
    """``weighted(source, rows, weight)`` with ``quota``: at least one slot for each source, the rest by largest remainder."""
    everything = Window.partitionBy(F.lit(0))
    exact = F.col("weight") * F.greatest(F.lit(slots) - F.col("n_sources"), F.lit(0)) / F.col("total")
    shared = weighted.withColumn("n_sources", F.count("*").over(everything)).withColumn("total", F.sum("weight").over(everything))
    floored = shared.withColumn("exact", exact).withColumn("base", F.floor("exact"))
    spare = F.greatest(F.lit(slots) - F.col("n_sources"), F.lit(0)) - F.sum("base").over(everything)
    nth = F.row_number().over(everything.orderBy(F.round(F.col("exact") - F.col("base"), 9).desc(), F.col("source").asc_nulls_last()))
    return floored.withColumn("quota", (1 + F.col("base") + F.when(nth <= spare, 1).otherwise(0)).cast("long")).select("source", "rows", "weight", "quota")


def exact_weights(weights: list[float]) -> list[int]:
    """Integers in the exact proportions of ``weights``, each the decimal number that it prints as; 0 if it is not positive."""
    exact = [max(Fraction(str(w)), Fraction(0)) for w in weights]
    common = math.lcm(*(w.denominator for w in exact))
    return [int(w * common) for w in exact]


class Stretch(NamedTuple):
    """``slots`` of a stretch of the mix, (member, block, release, deadline) in order, and how often they come, each time with the next blocks."""

    start: int
    times: int
    slots: list[tuple[int, int, int, int]]


def edf_stretches(weights: list[int], blocks: list[int], most: int = 65_536) -> Iterator[Stretch]:
    """The earliest-deadline-first schedule of all ``blocks`` at positive ``weights``.

    By virtual time v a member has received min(weight * v, blocks) in the fluid schedule;
    their sum is the slot that v falls on, so every window is in closed form. Where the
    members are in the same state again after a round of exact quotas, the round is
    repeated for as long as no window reaches the end of a source.
    """
    n, everything = len(blocks), sum(blocks)
    # the members in the order in which they end, with the blocks of those that have ended and the weight of the others
    order = sorted(range(n), key=lambda i: Fraction(blocks[i], weights[i]))
    ended = [0, *itertools.accumulate(blocks[i] for i in order)]
    active = [*itertools.accumulate((weights[i] for i in reversed(order)), initial=0)][::-1]
    divisor = [*itertools.accumulate((weights[i] for i in reversed(order)), math.gcd, initial=0)][::-1]
    last = [0] * n

    def slot_of(i: int, k: int, up: bool) -> int:
        """The slot at which member i has received k blocks in the fluid schedule."""
        e, w = last[i], weights[i]
        if e < n and k * weights[order[e]] >= blocks[order[e]] * w:
            e = last[i] = bisect.bisect_left(range(n), True, lo=e, key=lambda x: k * weights[order[x]] < blocks[order[x]] * w)
        return ended[e] + (-(-active[e] * k // w) if up else active[e] * k // w)

    received, pending, ready = [0] * n, [(0, i) for i in range(n) if blocks[i]], []
    out, t, check, epoch, begun, before = [], 0, 0, 0, 0, None
    while t < everything:
        if t == check:
            if len(out) >= most:
                yield Stretch(t - len(out), 1, out)
                out, before = [], None
            end_of = lambda e: ended[e] + active[e] * blocks[order[e]] // weights[order[e]]
            while end_of(epoch) <= t:
                epoch, before = epoch + 1, None
            end, length = end_of(epoch), active[epoch] // divisor[epoch]
            times = (end - t) // length - 2
            if before and times > 0 and all(received[i] - before[i] == weights[i] // divisor[epoch] for i in order[epoch:]):
                if len(out) > length:
                    yield Stretch(t - len(out), 1, out[:-length])
                yield Stretch(t - length, times + 1, out[-length:])
                out, before, t = [], None, t + times * length
                for i in order[epoch:]:
                    received[i] += times * (weights[i] // divisor[epoch])
                pending, ready = [(slot_of(i, received[i], False), i) for i in order[epoch:] if received[i] < blocks[i]], []
                heapq.heapify(pending)
            # an end that is within a slot leaves its member's last block to be dealt yet
            before = list(received) if times > 2 and length <= most else None
            check = t + length if before else min(max(end, t + 1), t + most)
        while pending and pending[0][0] <= t:
            release, i = heapq.heappop(pending)
            heapq.heappush(ready, (slot_of(i, received[i] + 1, True), i, release))
        deadline, i, release = heapq.heappop(ready)
        out.append((i, received[i], release, deadline))
        received[i] += 1
        t += 1
        if received[i] < blocks[i]:
            heapq.heappush(pending, (slot_of(i, received[i], False), i))
    if out:
        yield Stretch(t - len(out), 1, out)


def by_weight(weights: list[int], blocks: list[int]) -> Iterator[Stretch]:
    """The whole mix at exact weights. Members of weight 0 follow, in equal shares, when the others are used up."""
    start = 0
    for members, w in (([i for i, w in enumerate(weights) if w > 0], weights), ([i for i, w in enumerate(weights) if w <= 0], [1] * len(weights))):
        for s in edf_stretches([w[i] for i in members], [blocks[i] for i in members]):
            yield Stretch(start + s.start, s.times, [(members[i], k, start + r, start + d) for i, k, r, d in s.slots])
        start += sum(blocks[i] for i in members)


def by_quota(quota: list[int], blocks: list[int]) -> Iterator[Stretch]:
    """The whole mix in rounds of each member's next ``quota`` blocks, as far as it has any; last blocks are in rounds that are not repeated."""
    edges = sorted({0, *(x for q, b in zip(quota, blocks, strict=True) for x in (-(-b // q) - 1, -(-b // q)))})
    start = 0
    for edge, following in itertools.pairwise(edges):
        taken = [max(min(q, b - edge * q), 0) for q, b in zip(quota, blocks, strict=True)]
        members = [i for i, m in enumerate(taken) if m]
        slots = [x for s in edf_stretches([taken[i] for i in members], [taken[i] for i in members], 1 << 62) for x in _told(s)]
        yield Stretch(start, following - edge, [(members[i], edge * quota[members[i]] + k, start + r, start + d) for i, k, r, d in slots])
        start += (following - edge) * len(slots)


def _told(s: Stretch) -> Iterator[tuple[int, int, int, int]]:
    """The slots of a stretch with its repetitions."""
    each = collections.Counter(i for i, *_ in s.slots)
    for x in range(s.times):
        for i, k, r, d in s.slots:
            yield i, k + x * each[i], r + x * len(s.slots), d + x * len(s.slots)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = "text", slots: int | None = None, block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, block, round, release, deadline, block_position, position``.

    ``position`` counts from 0 without a gap and is the document's place in the mix; times
    are slots (blocks) from the start; ``round`` counts the source's exact shares of a round.
    A null source is a source of its own. A source without a stated weight has
    ``default_weight``; sources whose weights are not positive follow when all others are
    used up. There may be any number of sources, each with its weight. Null ids and rows
    that repeat an id are placed like all others, told apart by their texts' hash; identical
    rows are interchangeable. An empty table gives an empty one. Other columns are ignored,
    or carried along as the struct ``row`` if named in ``keep``.

    ``slots`` asks for rounds of that many slots with rounded quotas instead, at least one
    for each source: the weights are then kept to that precision only.
    """
    by_text = F.xxhash64(F.col(text_col)) if text_col else F.lit(0).cast("long")
    row = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("int")
    doc = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), by_text.alias("text_hash"), row.alias("row"))
    doc = doc.withColumn("source_key", source_key()).withColumn("shuffled", F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")))
    # buckets are runs of the shuffled order; their number, a power of two, follows the rows
    n_bits = max(0, (docs.count() // bucket_rows).bit_length())
    doc = doc.withColumn("bucket", (F.shiftright("shuffled", 64 - n_bits) if n_bits else F.lit(0)).cast("long"))
    counts = materialize(doc.groupBy("source_key", "source", "bucket").agg(F.count("*").alias("n")), "mix-counts")

    stated = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("source")) if weights else F.lit(None)
    weight = F.greatest(F.coalesce(stated.cast("double"), F.lit(float(default_weight))), F.lit(0.0))
    members, ranges, timetable, n_slots = _schedule(counts.groupBy("source").agg(F.sum("n").alias("rows")).withColumn("weight", weight), slots, block_rows)

    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source_key", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).join(members, "source_key")
    # the stretches that a bucket's blocks are in: few, however many there are
    touched = (F.col("first") * block_rows < F.col("offset") + F.col("n")) & (F.col("end") * block_rows > F.col("offset"))
    offsets = offsets.join(ranges, "member").filter(touched).groupBy("source_key", "bucket", "offset", "member", "quota").agg(F.collect_list(F.struct("first", "end", "stretch", "each", "length")).alias("stretches"))
    nth = Window.partitionBy("source_key", "bucket").orderBy("shuffled", "doc_id", "text_hash")
    numbered = doc.withColumn("nth", F.row_number().over(nth) - 1).join(offsets, ["source_key", "bucket"]).withColumn("rank", F.col("offset") + F.col("nth"))

    blocks = numbered.withColumn("block", F.floor(F.col("rank") / block_rows))
    blocks = blocks.withColumn("of", F.filter("stretches", lambda x: (x["first"] <= F.col("block")) & (F.col("block") < x["end"]))[0])
    within = F.col("block") - F.col("of.first")
    blocks = blocks.select("doc_id", "source", "row", "rank", "block", "quota", "member", "of.stretch", F.floor(within / F.col("of.each")).alias("again"), (within % F.col("of.each")).alias("nth_block"), "of.length")
    timed = blocks.join(F.broadcast(timetable) if n_slots <= BROADCAST_SLOTS else timetable, ["stretch", "member", "nth_block"]).withColumn("later", F.col("again") * F.col("length"))
    return timed.select(
        "doc_id", "source", *(["row"] if keep else []), "block", F.floor(F.col("block") / F.col("quota")).alias("round"),
        (F.col("release") + F.col("later")).alias("release"),
        (F.col("deadline") + F.col("later")).alias("deadline"),
        (F.col("slot") + F.col("later")).alias("block_position"),
        (F.col("first_row") + F.col("later") * block_rows + F.col("rank") % block_rows).cast("long").alias("position"),
    )


def source_key() -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def in_mix_order(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0) -> DataFrame:
    """The rows of ``docs`` in the order of their mix: written out, each file is a stretch of it."""
    mixed = mix_sources(docs, weights, default_weight, keep=docs.columns)
    return mixed.select("position", "row").orderBy("position").select("row.*")


def written_order(docs: DataFrame) -> tuple[DataFrame, tuple[Column, Column]]:
    """``docs`` and the place of each row in the order that it was written in: a number of its stretch, and one within.

    The order is that of the numbers in the names of Spark's Parquet files, then of the rows
    in a file: of ``in_mix_order``, the mix. Rows that are not read from such files are
    written first.
    """
    names = [re.search(r"/part-([0-9]+)-[^/]*[.-]c([0-9]+)[.][^/]*$", f) for f in docs.inputFiles()]
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
        as_written = bool(names) and all(names) and len({m.groups() for m in names}) == len(names)
    except AnalysisException:
        as_written = False
    if not as_written:
        docs = materialize(docs, "in-order")
    number = lambda pattern, bits: F.shiftleft(F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("long"), bits)
    stretch = number("^part-([0-9]+)", 40) + number("[.-]c([0-9]+)[.]", 24) + F.floor(F.col("_metadata.row_index") / BUCKET_ROWS)
    return docs, (stretch, F.col("_metadata.row_index"))


def _schedule(of_source: DataFrame, slots: int | None, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """From ``of_source(source, rows, weight)``: members, their blocks in each stretch, the stretches' slots, and the number of these.

    The slots are those of a few rounds for each source that ends where the weights have a
    short common round; in the worst case they are the blocks of the table, written as they
    are dealt.
    """
    spark = of_source.sparkSession
    if slots is not None:
        of_source = quotas(of_source, slots)
    shares = sorted(of_source.collect(), key=lambda r: (r.source is None, (r.source or "").encode()))
    blocks = [-(-r.rows // block_rows) for r in shares]
    if slots is not None:
        quota = [r.quota for r in shares]
        stretches = by_quota(quota, blocks)
    else:
        weights = exact_weights([r.weight for r in shares])
        common = math.gcd(*weights) or 1
        quota = [max(w // common, 1) for w in weights]
        stretches = by_weight(weights, blocks)

    timetable, ranges = (_Table(spark, f"mix-{name}", columns) for name, columns in (("slots", ["stretch", "member", "nth_block", "slot", "release", "deadline", "first_row"]), ("ranges", ["stretch", "member", "first", "end", "each", "length"])))
    lacking = 0
    for at, s in enumerate(stretches):
        first, each = {}, collections.Counter()
        for slot, (i, k, release, deadline) in enumerate(s.slots, s.start):
            first.setdefault(i, k)
            timetable.add(at, i, each[i], slot, release, deadline, slot * block_rows - lacking)
            each[i] += 1
            # the last block of a source may be short: positions after it move up by what it lacks
            if k == blocks[i] - 1:
                lacking += blocks[i] * block_rows - shares[i].rows
        for i, k in first.items():
            ranges.add(at, i, k, k + each[i] * s.times, each[i], len(s.slots))
    members = spark.createDataFrame(pa.table({"source_key": pa.array([""  if r.source is None else f"={r.source}" for r in shares], pa.string()), "member": pa.array(range(len(shares)), pa.int64()), "quota": pa.array(quota, pa.int64())}))
    return materialize(members, "mix-members"), ranges.written(), timetable.written(), timetable.rows


class _Table:
    """A table of whole numbers that the driver writes in pieces, so that it never holds all of it."""

    def __init__(self, spark: SparkSession, name: str, columns: list[str]):
        self.spark, self.columns, self.path = spark, columns, new_path(spark, name)
        self.pieces, self.rows = [array.array("q") for _ in columns], 0

    def add(self, *values: int) -> None:
        for piece, value in zip(self.pieces, values, strict=True):
            piece.append(value)
        self.rows += 1
        if len(self.pieces[0]) >= PIECE_ROWS:
            self._write()

    def _write(self) -> None:
        rows = pa.table({c: pa.array(p, pa.int64()) for c, p in zip(self.columns, self.pieces, strict=True)})
        self.spark.createDataFrame(rows).write.mode("append").parquet(self.path)
        self.pieces = [array.array("q") for _ in self.columns]

    def written(self) -> DataFrame:
        if self.pieces[0] or not self.rows:
            self._write()
        return self.spark.read.schema(", ".join(f"`{c}` long" for c in self.columns)).parquet(self.path)
