"""The pipeline against each stage done plainly, and the registered queries against their SQL."""

import functools
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tarnloom.llm import mixing, quality, queries

from .test_dedup import near_brute
from .test_scans import contamination_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        rows = docs.collect()
        kept[name] = (before.collect(), rows)
        docs = spark.createDataFrame(rows, docs.schema)
        if name != "sharding":
            assert docs.columns == COLUMNS
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]

    before, after = kept["quality_classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r.doc_id for r in after}
    known = [r.doc_id for r in before if r.doc_id in labels]
    assert sum((i in ids) == bool(labels[i]) for i in known) > 0.95 * len(known)

    before, after = kept["ngram_jaccard_join"]
    firsts = {c for _, _, c in map(eval, near_brute([(r.doc_id, r.text) for r in before]))}  # noqa: S307  our own tuples
    assert sorted(r.doc_id for r in after) == sorted(firsts)

    before, after = kept["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, n, hit, _ in map(eval, contamination_brute([(r.doc_id, r.text) for r in before], items)) if not (hit and 20 * hit >= n)}  # noqa: S307
    assert {r.doc_id for r in after} == clean

    before, after = kept["source_mixing"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    assert len({r.source for r in after[:400]}) > 10

    before, after = kept["sharding"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after) and {"shard", "slot"} <= set(after[0].asDict())


def test_run(spark, sf):
    """The stages one after the other, and slots in the order of the mix."""
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-2]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    place = {r.doc_id: r.position for r in mixing.mix_sources(docs, queries.MIX_WEIGHTS).collect()}
    assert sorted(r.doc_id for r in rows) == sorted(place)
    by = {}
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        by.setdefault(r.shard, []).append((r.slot, place[r.doc_id]))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all([s for s, _ in x] == [*range(len(x))] and [p for _, p in x] == sorted(p for _, p in x) for x in by.values())


def test_odd_rows_through_all_stages(spark, odd, none, sf, monkeypatch):
    """Nulls, repeated rows and ids, long texts, clashing names and an empty table; what the classifier would reject stays here."""
    monkeypatch.setattr(corpus_pipeline.quality, "accepted", functools.partial(quality.accepted, threshold=0.0))
    docs = odd.withColumns({"lang": F.lit("en"), "n_chars": F.lit(1).cast("long")})
    for table in (docs, docs.limit(0), docs.unionAll(docs)):
        out, seen = table, []
        for name, stage in corpus_pipeline.STAGES:
            columns, out = out.columns, stage(spark, out, sf)
            out = spark.createDataFrame(out.collect(), out.schema)
            seen.append(out.count())
            assert out.columns == (columns if name != "sharding" else [*columns, "size", "text_crc32", "shard", "slot"])
        if not seen[0]:
            assert seen == [0] * 5
            continue
        # one of each group of texts, each unrelated text of an id, and all rows without an id
        ids = sorted(str(r.doc_id) for r in out.collect())
        assert ids == sorted(["1", "1", "2", "3", "4", "6", "7", *["None"] * (2 if table is docs else 4)]), ids
        assert seen[1:] == [len(ids)] * 4


def test_the_mix_reaches_the_shards(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}", "en", f"src{k % 4}", 9) for k in range(2000)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    stages, got = dict(corpus_pipeline.STAGES), []
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    for n, weights in enumerate(({"src0": 4.0}, {"src0": 4.0}, {"src3": 4.0})):
        monkeypatch.setattr(corpus_pipeline, "MIX_WEIGHTS", weights)
        path = f"file://{tmp_path}/{n}"
        stages["source_mixing"](spark, docs, "").write.parquet(path)
        rows = stages["sharding"](spark, spark.read.parquet(path), "").collect()
        place = {r.doc_id: r.position for r in mixing.mix_sources(docs, weights).collect()}
        by = {}
        for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
            by.setdefault(r.shard, []).append((r.slot, place[r.doc_id]))
        assert len(rows) == len({r.doc_id for r in rows}) == 2000 and {len(x) for x in by.values()} == {50}
        assert all([s for s, _ in x] == [*range(50)] and [p for _, p in x] == sorted(p for _, p in x) for x in by.values())
        got.append({(r.doc_id, r.shard, r.slot) for r in rows})
    assert got[0] == got[1] != got[2]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in columns]) for r in result.fetchall())


def test_contract_columns(spark, sf):
    contract = {
        "op1_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
        "op2_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
        "op3_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op4_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
        "op6_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op7_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op9_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    }
    for name, columns in contract.items():
        assert columns.items() <= dict(entry.queries()[name](spark, sf).dtypes).items(), name
