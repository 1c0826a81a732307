import collections
import datetime
import hashlib
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarnloom.llm import components, exact_dedup, jaccard_join


def exact_brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(map(repr, out))


def test_exact_on_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(repr(tuple(r)) for r in exact_dedup.exact_duplicates(odd).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == exact_brute(rows)
    assert exact_dedup.exact_duplicates(none).count() == 0


@pytest.mark.parametrize("kind", ["string", "decimal(38,2)", "date", "double", "struct<a:string>"])
def test_ids_of_any_type(spark, kind):
    ids = {"string": ["b", "a", "10", "9", "é"], "struct<a:string>": [("b",), ("a",), ("10",), ("9",), ("é",)], "date": [datetime.date(2020, 1, d) for d in (5, 3, 4, 2, 1)]}.get(kind) or [Decimal(x) if "decimal" in kind else float(x) for x in (7, 3, 5, 4, 1)]
    docs = spark.createDataFrame([(ids[0], "x y"), (ids[1], "xy"), (ids[2], "x y"), (None, "x y"), (None, "z  "), (ids[3], "z"), (ids[4], None), (None, "")], f"doc_id {kind}, text string")
    plain = lambda x: tuple(x) if isinstance(x, tuple) else x
    got = [(plain(r.doc_id), plain(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()]
    first = min(ids[0], ids[2])
    assert sorted(got, key=repr) == sorted([(ids[0], first, 3 + 1, ids[0] == first), (ids[1], first, 4, False), (ids[2], first, 4, ids[2] == first), (None, first, 4, False), (None, None, 2, True), (ids[3], None, 2, False), (ids[4], ids[4], 2, True), (None, ids[4], 2, False)], key=repr)


def test_hash_collisions_are_told_apart(spark):
    rows = [(k, f"{'ab'[k % 2]} {k // 4}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs, content_hash=lambda c: F.substring(F.md5(c), 1, 1))
    assert sorted(repr(tuple(r)) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == exact_brute(rows)


def test_exact_is_native(spark, odd):
    plan = exact_dedup.exact_duplicates(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def near_brute(rows, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = [*range(len(rows))]

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(repr((i, len(s), (least.get(root(k)) if s else i))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_got(df):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in df.collect())


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def crowd(seed=1, n_groups=6, size=14, length=60):
    """Groups of copies with few to many edits, chains of edits, and a passage that all share."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(25)]
    texts = []
    for g in range(n_groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(length + 7 * g)] + (passage if g % 2 else [])
        for k in range(size):
            texts.append(edited(rng, texts[-1] if g == 2 and k else base, rng.choice([0, 1, 1, 2, 3])))
    texts += [[f"s{k}q{j}" for j in range(k % 9)] for k in range(30)] + [passage + [f"u{k}v{j}" for j in range(30)] for k in range(30)]
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("hot", "block"), [(64, 2048), (1, 3), (3, 4)])
def test_near_duplicates_of_a_crowd(spark, monkeypatch, hot, block):
    monkeypatch.setattr(jaccard_join, "HOT_CLASSES", hot)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    rows = crowd()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert near_got(jaccard_join.near_duplicates(docs)) == near_brute(rows)


@pytest.mark.parametrize(("least", "broadcast", "block"), [(2, 500_000, 2048), (3, 0, 4)])
def test_very_common_parts_are_dealt_out(spark, monkeypatch, least, broadcast, block):
    """All parts that several classes share, or many of them, go the way of the very common ones; one group is joined by its largest component."""
    for name, value in {"SAMPLE_ONE_IN": 1, "BUSY_LEAST": least, "BUSY_ONE_IN": 10**9, "SALTS": 3, "MOST_BROADCAST": broadcast, "BLOCK_ROWS": block}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rows = crowd(seed=5, n_groups=4, size=30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert jaccard_join._busy(docs.select("doc_id", "text"), 5, 80).count() > 100
    assert near_got(jaccard_join.near_duplicates(docs)) == near_brute(rows)


def test_names_of_sets():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in [*range(1, 300)] * 3]
    for seed in (0, 1):
        assert len({jaccard_join.set_class(s, seed) for s in sets}) == len({jaccard_join.set_check(s) for s in sets}) == len(sets)
    assert all(jaccard_join.set_class(s) == jaccard_join.set_class(s.copy()) != jaccard_join.set_class(s, 1) for s in sets)


def test_every_link_shares_a_key():
    """Without stars or blocks: sets at the very threshold share an emitted part, for all sizes and in both roles."""
    import numpy as np

    bands, rng = jaccard_join.Bands(80), np.random.default_rng(5)
    for n in [*range(1, 60), 100, 500, 3000]:
        shared = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        for extra_a in {0, n // 9, n // 4}:
            extra_b = n // 4 - extra_a
            a = np.unique(np.concatenate([shared, rng.integers(0, 2**63, extra_a, dtype=np.uint64)]))
            b = np.unique(np.concatenate([shared, rng.integers(0, 2**63, extra_b, dtype=np.uint64)]))
            if 100 * n >= 80 * (len(a) + len(b) - n):
                ka, kb = jaccard_join.part_keys(a, bands)[0], jaccard_join.part_keys(b, bands)[0]
                assert np.isin(ka, kb).any(), (n, extra_a, extra_b)
                small, large = sorted((a, b), key=len)
                sa, sb = jaccard_join.parity_sketch(small), jaccard_join.parity_sketch(large)
                while len(sb) > len(sa):
                    sb = sb[: len(sb) // 2] ^ sb[len(sb) // 2 :]
                assert int(np.bitwise_count((sa ^ sb).view(np.uint64)).sum()) <= len(a) + len(b) - 2 * n


def test_near_on_odd_rows(spark, odd, none):
    got = near_got(jaccard_join.near_duplicates(odd))
    assert got == near_brute([(r.doc_id, r.text) for r in odd.collect()])
    assert jaccard_join.near_duplicates(none).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "3", "4", "6", "7", "None", "None"]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 600)] + [(7, 7), (None, 3)]
    up = {}

    def root(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: root(k) for k in up}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
