import collections
import gzip
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnloom.llm import mixing, quality, sharding, warc


def numbered(spark, n, sources=lambda k: f"s{k % 3}"):
    return spark.createDataFrame([(k, f"text {k}", sources(k)) for k in range(n)], "doc_id long, text string, source string")


@pytest.mark.parametrize(("n", "shards"), [(0, 5), (3, 5), (101, 5), (1000, 40)])
def test_shards_are_level_and_slots_gapless(spark, n, shards):
    rows = sharding.shard_documents(numbered(spark, n), shards=shards, ring_bits=10).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.size == len(f"text {r.doc_id}") + 16 and r.text_crc32 == zlib.crc32(f"text {r.doc_id}".encode())
    assert sum(map(len, by.values())) == n and all(sorted(s) == [*range(len(s))] for s in by.values())
    assert max((len(by[k]) for k in range(shards)), default=0) - min((len(by[k]) for k in range(shards)), default=0) <= 1


def test_walk_equals_one_by_one():
    """Rows taken in ring order, each to the first shard with room clockwise, after all own ones."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        shards, bits = int(rng.integers(1, 7)), 5
        owners, counts = sharding.ring_owners(shards, 3, bits), rng.integers(0, 6, 1 << bits)
        plan = sharding.bounded_walk(counts, owners, shards)
        total = int(counts.sum())
        own = np.bincount(owners, weights=counts, minlength=shards)
        bound = np.full(shards, total // shards)
        bound[np.lexsort((np.arange(shards), -own))[: total % shards]] += 1
        used, expected, waiting = np.zeros(shards, dtype=int), {}, []
        for cell in range(1 << bits):
            for rank in range(counts[cell]):
                if used[owners[cell]] < bound[owners[cell]]:
                    expected[cell, rank] = int(owners[cell])
                    used[owners[cell]] += 1
                else:
                    waiting.append((cell, rank))
        for cell, rank in waiting:
            at = cell
            while used[owners[at % (1 << bits)]] >= bound[owners[at % (1 << bits)]]:
                at += 1
            expected[cell, rank] = int(owners[at % (1 << bits)])
            used[expected[cell, rank]] += 1
        got = {(cell, k): s for cell, begin, end, s, _ in plan for k in range(begin, end)}
        assert got == expected


def test_a_new_shard_moves_little(spark):
    docs = numbered(spark, 4000)
    at = lambda n: {r.doc_id: r.shard for r in sharding.shard_documents(docs, shards=n).collect()}
    before, after = at(20), at(21)
    assert sum(before[k] != after[k] for k in before) < 0.3 * len(before)


def test_shards_on_odd_rows(spark, odd, none):
    rows = sharding.shard_documents(odd, shards=2, keep=odd.columns).select("row.*", "shard", "slot").collect()
    assert len(rows) == odd.count() and {r.slot for r in rows if r.shard == 0} in ({*range(5)}, {*range(6)})
    assert sharding.shard_documents(none).count() == 0


def simulated(counts, quota, block_rows):
    """Slot by slot: the order of (source, block) for sources in order of name."""
    names = sorted(counts, key=lambda s: (s is None, s or ""))
    left = {s: -(-counts[s] // block_rows) for s in names}
    done, order, start = dict.fromkeys(names, 0), [], 0
    while sum(left.values()):
        m = {s: min(quota[s], left[s]) for s in names}
        total, taken = sum(m.values()), dict.fromkeys(names, 0)
        for t in range(total):
            ready = [(-(-(taken[s] + 1) * total // m[s]), k, s) for k, s in enumerate(names) if taken[s] < m[s] and taken[s] * total // m[s] <= t]
            deadline, _, s = min(ready)
            assert t < deadline
            taken[s] += 1
            order.append((s, done[s]))
            done[s] += 1
            assert all(abs(taken[x] - m[x] * (t + 1) / total) < 1 for x in names)
        start += total
        for s in names:
            left[s] -= m[s]
    return order


@pytest.mark.parametrize(("weights", "slots", "block_rows", "sources"), [({"s0": 3.0, "s1": 2.0}, 12, 1, lambda k: f"s{k % 3}"), ({"a": 7.0}, 10, 4, lambda k: "a" if k % 3 else None if k % 2 else "b"), ({}, 2, 3, lambda k: f"t{k % 5}"), ({"s0": 0.0, "s1": 1e6}, 30, 2, lambda k: f"s{(k * k) % 4}")])
def test_mix_follows_the_schedule(spark, weights, slots, block_rows, sources):
    docs = numbered(spark, 300, sources)
    rows = mixing.mix_sources(docs, weights, slots=slots, block_rows=block_rows, bucket_rows=20).orderBy("position").collect()
    assert [r.position for r in rows] == [*range(300)] and len({r.doc_id for r in rows}) == 300
    counts = collections.Counter(r.source for r in rows)
    of = docs.groupBy("source").agg(F.count("*").alias("rows")).withColumn("weight", F.coalesce(*([F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("source"))] if weights else []), F.lit(1.0)))
    quota = {r.source: r.quota for r in mixing.quotas(of, slots).collect()}
    assert min(quota.values()) >= 1 and sum(quota.values()) == max(slots, len(quota))
    order = list(dict.fromkeys((r.source, r.block) for r in rows))
    assert order == simulated(counts, quota, block_rows)
    assert all(r.release <= r.block_position < r.deadline for r in rows)


@pytest.mark.parametrize(("weights", "default"), [({"s00": 4.0, "s01": 2.0, "s02": 2.0, "s03": 0.5}, 1.0), ({"s00": 0.37, "s01": 0.0, "s02": 1e-3}, 0.1), ({"s00": 1 / 3}, 0.7)])
def test_mix_keeps_the_stated_weights(spark, weights, default):
    """Until a source is used up each has received its share to within a block, over many rounds."""
    docs = numbered(spark, 12_000, lambda k: f"s{k % 20:02d}")
    rows = mixing.mix_sources(docs, weights, default, block_rows=1, bucket_rows=500).orderBy("position").collect()
    assert [r.position for r in rows] == [*range(12_000)] and len({r.doc_id for r in rows}) == 12_000
    w = {s: weights.get(s, default) for s in {r.source for r in rows}}
    total, received, t = sum(w.values()), collections.Counter(), 0
    while max(received.values(), default=0) < 600:
        received[rows[t].source] += 1
        t += 1
        assert all(abs(received[s] - w[s] * t / total) < 1 + 1e-9 for s in w), t
    assert t > 500 and all(r.release <= r.block_position < r.deadline for r in rows)
    if "s01" in w and not w["s01"]:
        assert {r.source for r in rows[-600:]} == {"s01"}


def test_any_number_of_sources_keeps_its_weights(spark):
    docs = numbered(spark, 4200, lambda k: "big" if k % 3 == 0 else f"s{k % 700}")
    rows = mixing.mix_sources(docs, {"big": 350.0}, 0.5, block_rows=1, bucket_rows=500).orderBy("position").collect()
    others = {r.source for r in rows} - {"big"}
    assert len(others) > 600 and [r.position for r in rows] == [*range(4200)] and len({r.doc_id for r in rows}) == 4200
    share, n = 350 / (350 + len(others) / 2), 0
    for t, r in enumerate(rows[:1400], 1):
        n += r.source == "big"
        assert abs(n - share * t) < 1 + 1e-9


def test_dealt_blocks_keep_to_the_fluid_schedule():
    """Across the ends of sources too; rounds that are repeated are as if dealt."""
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randrange(1, 7)
        weights, blocks = [rng.choice([1, 2, 3, 5, 8, 40]) for _ in range(n)], [rng.randrange(1, 200) for _ in range(n)]
        received, fluid = [0] * n, [Fraction(0)] * n
        for t, (i, k, release, deadline) in enumerate(x for s in mixing.by_weight(weights, blocks) for x in mixing._told(s)):
            assert k == received[i] and release <= t < deadline
            received[i] += 1
            left = Fraction(1)
            while left:
                going = [j for j in range(n) if fluid[j] < blocks[j]]
                total = sum(weights[j] for j in going)
                step = min(left, *((blocks[j] - fluid[j]) * total / weights[j] for j in going))
                left -= step
                for j in going:
                    fluid[j] += step * weights[j] / total
            assert all(abs(a - b) < 1 for a, b in zip(received, fluid, strict=True))
        assert received == blocks


def test_mix_is_native_and_carries_rows(spark, odd, none):
    assert not re.search("Python|Pandas|Arrow", mixing.mix_sources(odd)._jdf.queryExecution().executedPlan().toString())
    assert mixing.mix_sources(none).count() == 0 and mixing.in_mix_order(none).count() == 0
    mixed = mixing.in_mix_order(odd, {"x": 2.0})
    assert mixed.columns == odd.columns and sorted(map(str, mixed.collect())) == sorted(map(str, odd.collect()))


def test_statistics_of_odd_texts():
    s = quality.statistics([b"", b" \n", b"Hello hello\nHello hello\n!!", "ñ".encode() * 10, b"x" * 3_000_000])
    assert s.shape == (5, len(quality.NAMES)) and np.isfinite(s).all() and not s[0].any()
    assert s[2][quality.NAMES.index("distinct_lines")] == pytest.approx(2 / 3) and s[3][quality.NAMES.index("non_ascii")] == 1


def test_isotonic():
    knots, values = quality.pooled([(0.0, 2, 0), (1.0, 2, 2), (2.0, 2, 0), (3.0, 1, 1)])
    assert values.tolist() == [0.0, 0.5, 1.0] and knots.tolist() == [0.0, 1.5, 3.0]


def test_normal_equations_do_not_depend_on_partitions(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one, many = (quality.score_documents(docs.repartition(n), labels).orderBy("doc_id").collect() for n in (1, 7))
    assert max(abs(a.score - b.score) for a, b in zip(one, many, strict=True)) < 1e-3
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in one)


def test_scores_equal_a_direct_ridge(spark, sf):
    """The same features of all labelled rows at once, least squares by another solver, and isotonic means by their max-min formula."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").collect(), {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stats = quality.statistics([(r.text or "").encode() for r in docs])
    fold = np.array([zlib.crc32(str(r.doc_id).encode()) % 4 for r in docs])
    y = np.array([labels.get(r.doc_id, -1) for r in docs])
    train, check = (y >= 0) & (fold <= 1), (y >= 0) & (fold == 3)
    mean, std = stats[train].astype(float).mean(axis=0), np.maximum(stats[train].astype(float).std(axis=0), 1e-6)
    rng = np.random.Generator(np.random.PCG64(quality.SEED))
    w, b = rng.normal(size=(stats.shape[1], quality.FEATURES)) / quality.KERNEL_WIDTH, rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.array([[*(np.sqrt(2 / quality.FEATURES) * np.cos(x @ w + b)), 1.0] for x in np.clip((stats - mean) / std, -8, 8)])
    n = int(train.sum())
    penalty = np.sqrt(np.diag([quality.RIDGE * n + 1e-9] * quality.FEATURES + [1e-9]))
    weights = np.linalg.lstsq(np.vstack([z[train], penalty]), np.concatenate([y[train], np.zeros(quality.FEATURES + 1)]), rcond=None)[0]
    raw = z @ weights
    bins = np.clip(np.round(raw[check] * quality.BINS / 2), -quality.BINS, quality.BINS) * 2 / quality.BINS
    at = np.unique(bins)
    count, positive = np.array([(bins == x).sum() for x in at]), np.array([y[check][bins == x].sum() for x in at])
    share = lambda i, j: positive[i : j + 1].sum() / count[i : j + 1].sum()
    level = [max(min(share(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    knots = [(np.average(at[sel], weights=count[sel]), v) for v in np.unique(level) for sel in [np.array(level) == v]]
    step = np.interp(raw, *zip(*knots, strict=True))
    expected = step * (1 - 1e-6) + 1e-6 / (1 + np.exp(-raw))
    got = {r.doc_id: r.score for r in quality.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    off = [abs(got[r.doc_id] - e) for r, e in zip(docs, expected, strict=True)]
    assert sorted(off)[int(0.98 * len(off))] < 1e-6 and max(off) < 0.05  # a row at a bin's edge may fall on either side


def test_held_out_accuracy_and_no_leak(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.fold() == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = quality.score_documents(docs, labels)
    rows = scores.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows)
    assert sorted(map(str, scores.collect())) == sorted(map(str, quality.score_documents(docs, flipped).collect()))


def test_quality_without_labels(spark, odd, none, sf):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_documents(odd, labels).collect()} == {0.5}
    assert quality.score_documents(none, labels).count() == 0
    known = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(1, None), (None, 1), (77, 5)], "doc_id long, quality int")
    assert quality.score_documents(odd, known).count() == odd.count()
    assert quality.accepted(odd, spark.read.parquet(f"{sf}/labels.parquet")).columns == odd.columns


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://h/é b\r\nx", "<p>WARC/1.1\r\n\x1f same</p>", "z"), (1, "http://h/1", "<p>WARC/1.1\r\n\x1f same</p>", "z"), (2, None, None, None), (4, "u", "", "z"), (None, "n", "<p>WARC/1.1\r\n\x1f same</p>", None), (5, "v", "long " * 100_000, "z"), (6, "w", "\r\n\r\n", "z"), (1, "http://h/1", "<p>WARC/1.1\r\n\x1f same</p>", "z")]
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages(spark, rows), path, records_per_file=2)
    got = sorted(((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, path).collect()), key=repr)
    expected = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        first = min(j for j, _, h, _ in rows if (h or "").encode() == data and j is not None)
        expected.append((i is None, i or 0, "response" if i == first else "revisit", None if i == first else first, len(data), warc.base32_sha1(data)))
    assert got == sorted(expected, key=repr) and warc.read_gaps(spark, path).count() == 0
    least = f"file://{tmp_path}/least"
    warc.write_warc(pages(spark, rows), least, least_bytes=10)
    assert {r.record_type for r in warc.read_warc(spark, least).filter("payload_bytes < 10").collect()} == {"response"}
    for f in (tmp_path / "w").rglob("part-*"):
        assert b"WARC/1.1" in gzip.decompress(f.read_bytes())
    empty = f"file://{tmp_path}/empty"
    warc.write_warc(pages(spark, []), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_files_are_cut_by_bytes(spark, tmp_path):
    """Payloads larger than a file and than a batch; rows of one task."""
    rng = random.Random(2)
    rows = [(k, "u", "%x" % rng.getrandbits(4 * n), "z") for k, n in enumerate([900_000, 10, 400_000, 400_000, 400_000, 20, 2_000_000, 30])]
    path = f"file://{tmp_path}/w"
    docs = pages(spark, rows).coalesce(1).unionAll(spark.range(1).selectExpr("99L", "'v'", "repeat('long', 20000000)", "'z'").coalesce(1))
    warc.write_warc(docs, path, file_bytes=500_000)
    assert max(f.stat().st_size for f in (tmp_path / "w").rglob("part-*")) < 1_200_000 and len(list((tmp_path / "w").rglob("part-*"))) >= 5
    got = {r.page_id: (r.n, r.payload_digest) for r in warc.read_warc(spark, path).select("page_id", F.length("payload").alias("n"), "payload_digest").collect()}
    assert got == {i: (len(h), warc.base32_sha1(h.encode())) for i, _, h, _ in rows} | {99: (80_000_000, warc.base32_sha1(b"long" * 20_000_000))}


def test_salvage():
    records = [warc.record_bytes(k, f"u{k}", b"payload %d " % k * 50, None, False) for k in range(6)]
    members = [warc.gzip_member(r) for r in records]
    for parts, zipped in ((records, False), (members, True)):
        whole = b"".join(parts)
        good = [x for x in warc.salvage(whole)]
        assert [x["page_id"] for x in good] == [*range(6)]
        starts = [sum(map(len, parts[:k])) for k in range(7)]
        for damage in range(6):
            broken = bytearray(whole)
            broken[starts[damage] + len(parts[damage]) // 2] ^= 0xFF
            got = list(warc.salvage(bytes(broken)))
            assert [x["page_id"] for x in got if isinstance(x, dict)] == [k for k in range(6) if k != damage], (zipped, damage)
            gaps = [x for x in got if isinstance(x, warc.Gap)]
            assert [(g.at, g.length) for g in gaps] == [(starts[damage], len(parts[damage]))]
        cut = list(warc.salvage(whole[: starts[5] + 10]))
        assert [x["page_id"] for x in cut if isinstance(x, dict)] == [0, 1, 2, 3, 4] and cut[-1].length == 10
        junk = list(warc.salvage(b"junk " * 9 + whole))
        assert isinstance(junk[0], warc.Gap) and len(junk) == 7
    assert list(warc.salvage(b"")) == [] and isinstance(next(warc.salvage(b"nothing here")), warc.Gap)


def test_salvage_of_random_damage():
    rng = random.Random(8)
    members = [warc.gzip_member(warc.record_bytes(k, "u", bytes(rng.randrange(256) for _ in range(200)), None, False)) for k in range(8)]
    whole = b"".join(members)
    for _ in range(60):
        broken = bytearray(whole)
        for _ in range(rng.randrange(1, 4)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        got = list(warc.salvage(bytes(broken)))
        ids = [x["page_id"] for x in got if isinstance(x, dict)]
        intact = [k for k in range(8) if bytes(broken).find(members[k]) >= 0]
        assert set(intact) <= set(ids) and ids == sorted(ids)
