import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tarnloom import schemas
from tarnloom.operators import agentlog as ag
from tarnloom.operators import cache as ca
from tarnloom.operators import jobs as jb
from tarnloom.operators import language as la
from tarnloom.operators import retrieval as vs
from tarnloom.operators import selections as se
from tarnloom.operators import upsert as up
from tarnloom.plans import ingest as pi
from tarnloom.plans.queries import hashed_vectors
from tarnloom.sources import files as fi
from tarnloom.streaming import ingest as st


def test_schemas_parse(spark):
    for name, ddl in schemas.TABLES.items():
        assert spark.createDataFrame([], ddl).columns[0] == "id", name


def test_topk_counts_matching_rows(spark):
    rows = [(i, i % 3, [1.0, float(i)], {"language": '"es"' if i % 2 else '"en"'}) for i in range(30)] + [(98, 1, [0.0, 0.0], {}), (99, 1, [1.0], {}), (100, 1, None, None)]
    chunks = spark.createDataFrame(rows, "id int, owner_id int, embedding array<float>, metadata map<string,string>")
    got = vs.topk(chunks, [1.0, 0.0], 4, owner=1, filters={"language": "es"}).collect()
    assert [(r.rank, r.id) for r in got] == [(1, 1), (2, 7), (3, 13), (4, 19)]
    assert vs.topk(chunks, [1.0, 0.0], 50, owner=2).count() == 10
    with pytest.raises(ValueError):
        vs.topk(chunks, [1.0], 0)


def test_topk_plan_has_no_join_and_prunes_columns(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = vs.topk(e, [0.1] * 64, 5, owner=3, owner_col="label", id_col="vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Join" not in plan and "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan


def test_topk_of_many_equals_one_by_one(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = e.filter("vec_id in (3, 7)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    many = {(r.query_id, r.rank): r.id for r in vs.topk_of_many(e, queries, 5, id_col="vec_id", queries_at_once=1).collect()}
    for q in queries.collect():
        one = vs.topk(e, list(q.vector), 5, id_col="vec_id").collect()
        assert [many[q.query_id, r.rank] for r in one] == [r.vec_id for r in one] and one[0].vec_id == q.query_id


def test_lsh_recall(spark):
    """Against the exact search, for every id divisible by 100; wider probes find no less."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = {(r.query_id, r.id) for r in vs.topk_of_many(e, queries, 10, id_col="vec_id").collect()}
    near = {(r.query_id, r.id): r.rank for r in vs.lsh_topk_of_many(e, queries, 10, id_col="vec_id").collect()}
    assert len(exact) == 200 and len(exact & set(near)) >= 0.9 * 200 and all(near[q, q] == 1 for q, _ in exact)
    narrow = [len(exact & {(r.query_id, r.id) for r in vs.lsh_topk_of_many(e, queries, 10, id_col="vec_id", width=0.5, widen=w).collect()}) for w in (0, 2)]
    assert narrow[0] < narrow[1]


def test_many_queries_on_odd_rows(spark):
    """Odd vectors, copies beyond k and ids of words: to the last bit what one query at a time finds, in one pass over the rows."""
    rng = random.Random(3)
    rows = [(f"r{i}", [rng.gauss(0, 1) for _ in range(5)]) for i in range(300)] + [(f"c{i}", [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(40)] + [(f"d{i}", [2.0, 4.0, 6.0, 8.0, 10.0]) for i in range(9)]
    rows += [("null", None), ("short", [1.0]), ("none", []), ("zero", [0.0] * 5), ("hole", [1.0, None, 1.0, 1.0, 1.0]), ("nan", [float("nan")] * 5), (None, [5.0, 4.0, 3.0, 2.0, 1.0])]
    chunks = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)
    queries = chunks.filter("id in ('c1', 'd1', 'nan', 'null', 'short', 'zero') or id like 'r_' or id like 'r1__'").selectExpr("id as query_id", "embedding as vector")
    plan = vs.topk_of_many(chunks, queries.filter("query_id <> 'short'"), 7)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("MapInArrow") == 1
    for k in (7, 400):
        got = {}
        for r in vs.topk_of_many(chunks, queries, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, repr(r.distance)))
        assert set(got) == {r.query_id for r in queries.collect()} - {"null", "zero"} and len(got) == 114
        for q in queries.filter("query_id in ('c1', 'd1', 'r3', 'r150', 'nan', 'short')").collect():
            one = vs.topk(chunks.filter("id is null or id <> 'zero'"), list(q.vector), k).orderBy("rank").collect()
            assert got[q.query_id] == [(r.id, repr(r.distance)) for r in one]
    assert vs.topk_of_many(chunks, queries.limit(0), 7).count() == 0


@pytest.mark.parametrize(("width", "widen"), [(2.4, 0), (0.5, 0), (0.5, 1)])
def test_lsh_ranks_all_rows_that_share_a_bucket(spark, width, widen):
    """Against buckets that are made one by one, for more queries than a block holds and in one pass over the rows."""
    rng, draw = random.Random(11), random.Random(4)
    planes = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4 * 3)]
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(400)] + [(400 + i, [1.0, 0.0, 2.0, 0.0, 3.0, 0.0]) for i in range(30)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    length = {i: math.sqrt(sum(x * x for x in v)) for i, v in rows}
    cells = {i: [math.floor(sum(x * y for x, y in zip(v, p)) / length[i] / width) for p in planes] for i, v in rows}
    near = lambda a, b: any(all(abs(x - y) <= widen for x, y in zip(a[t : t + 3], b[t : t + 3])) for t in range(0, 12, 3))
    stated = [r for r in rows if r[0] % 4 == 0]
    found = vs.lsh_topk_of_many(chunks, spark.createDataFrame(stated, "query_id long, vector array<double>"), 10, tables=4, projections=3, width=width, widen=widen)
    assert "Union" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q, v in stated:
        sums = [(sum_in_order(x * y for x, y in zip(w, v)), i) for i, w in rows if near(cells[i], cells[q])]
        assert got[q] == [i for _, i in sorted((1 - s / (length[i] * length[q]), i) for s, i in sums)][:10]


def sum_in_order(numbers):
    total = 0.0
    for x in numbers:
        total += x
    return total


def test_retrieve_refuses_blank_questions(spark):
    chunks = spark.createDataFrame([("a", "o", "T", "content", hashed_vectors(["find me"])[0])], "id string, owner_id string, document_title string, content string, embedding array<float>")
    embed = lambda s: hashed_vectors([s])[0]
    got = vs.retrieve(chunks, "find​  me ", embed, owner="o", normalize=vs.normalised_question).first()
    assert got.distance < 1e-6
    assert vs.context(vs.retrieve(chunks, "find me", embed)).first()[0] == "[Source 1: T]\ncontent"
    for bad in ("", "  ​ ", "x" * 2001):
        with pytest.raises(ValueError):
            vs.retrieve(chunks, bad, embed, normalize=vs.normalised_question)


def test_gate_and_upsert(spark):
    ddl = "id string, user_id string, source string, content_hash string, normalizer_version string, chunker_version string, embedding_model string, metadata_version string, created_at string"
    stored = spark.createDataFrame([(f"s{k}", "u", str(k), "h", "n", "c", "m", "v2" if k != 2 else None, "old") for k in range(5)], ddl)
    rows = [("i0", "u", "0", "h", "n", "c", "m", "v2", "new", False), ("i1", "u", "1", "h2", "n", "c", "m", "v2", "new", False), ("i2", "u", "2", "h", "n", "c", "m", "v2", "new", False), ("i3", "u", "3", "h", "n", "c", "m", "v2", "new", True), ("i9", "u", "9", "h", "n", "c", "m", "v2", "new", None), ("i4", "other", "4", None, "n", "c", "m", "v2", "new", False)]
    incoming = spark.createDataFrame(rows, ddl + ", resuming boolean")
    assert {r.id: r.action for r in up.gate(incoming, stored).collect()} == {"i0": "skip", "i1": "replace", "i2": "refresh", "i3": "replace", "i9": "new", "i4": "new"}
    after = {(r.user_id, r.source): (r.id, r.created_at, r.content_hash) for r in up.upsert_documents(stored, incoming.drop("resuming")).collect()}
    assert after["u", "1"] == ("s1", "old", "h2") and after["u", "9"] == ("i9", "new", "h") and len(after) == 7


def test_ingest_twice_changes_nothing_and_edits_replace(spark):
    documents, chunks = spark.createDataFrame([], schemas.DOCUMENTS + ", metadata_version string"), spark.createDataFrame([], schemas.DOCUMENT_CHUNKS)
    make = lambda edit: fi.extract_local(spark.createDataFrame([("u", "https://h/a.md", b"# T\n" + b"Some prose of the first file. " * 80 + edit, "a.md", None), ("u", "https://h/b.txt", b" ", "b.txt", None)], "user_id string, source string, content binary, filename string, content_type string"))
    first = pi.ingest(make(b""), documents, chunks, hashed_vectors, "m1")
    documents, chunks = (spark.createDataFrame(x.collect(), x.schema) for x in (first.documents, first.chunks))
    assert documents.count() == 1 and documents.first().chunk_count == chunks.count() > 1 and [r.source for r in first.rejected.collect()] == ["https://h/b.txt"]
    again = pi.ingest(make(b""), documents, chunks, hashed_vectors, "m1")
    assert [r.action for r in again.actions.collect()] == ["skip"] and sorted(r.id for r in again.chunks.collect()) == sorted(r.id for r in chunks.collect())
    edited = pi.ingest(make(b" Edited."), documents, chunks, hashed_vectors, "m1")
    assert [r.action for r in edited.actions.collect()] == ["replace"] and edited.documents.first().id == documents.first().id
    assert edited.chunks.orderBy("chunk_index").collect()[-1].content.endswith("Edited.")


def test_embedding_goes_on_where_it_stopped(spark, tmp_path):
    """After a crash only batches that were not written are embedded, and the cursor is what is there."""
    chunks = spark.createDataFrame([(d, k, k // 10, f"{d}{k}") for d, n in (("a", 75), ("b", 12)) for k in range(n)], "document_id string, chunk_index int, batch int, content string")
    log, path = tmp_path / "calls", f"file://{tmp_path}/embedded"

    def embed(texts, fail=None):
        if fail and fail in texts:
            raise RuntimeError("crash")
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [[float(len(t))] for t in texts]

    with pytest.raises(Exception, match="crash"):
        pi.embed_onwards(chunks, lambda texts: embed(texts, "a45"), path, batches=2)
    done = {r.document_id: r.processed_chunks for r in pi.cursors(spark.read.parquet(path)).collect()}
    assert done == {"a": 40, "b": 12}
    first = set(log.read_text().split())
    log.unlink()
    out = pi.embed_onwards(chunks, embed, path, batches=2).collect()
    assert sorted((r.document_id, r.chunk_index) for r in out) == sorted((r.document_id, r.chunk_index) for r in chunks.collect())
    assert set(log.read_text().split()) == {f"a{k}" for k in range(40, 75)} and {"a0", "b11"} <= first
    assert pi.embed_onwards(chunks, None, path).count() == 87 and {r.processed_chunks for r in pi.cursors(spark.read.parquet(path)).collect()} == {75, 12}


def test_cascade_and_set_null(spark):
    parents, children = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1, 1), (2, 2), (3, None)], "c int, p int")
    assert [r.c for r in up.cascade(children, parents, "p").orderBy("c").collect()] == [2, 3]
    assert [r.p for r in up.set_null(children, parents, "p").orderBy("c").collect()] == [None, 2, None]


def test_jobs(spark):
    got = {r.e: r.c for r in spark.createDataFrame([(x,) for x in ("SourceFetchError", "LowTextYieldError", "nonsense", None)], "e string").select("e", jb.classify(F.col("e")).alias("c")).collect()}
    assert got["SourceFetchError"].retryable and got["LowTextYieldError"].stage == "quality_gate" and got["nonsense"].reason == got[None].reason == "internal"
    events = spark.createDataFrame([("j", 1, "pending", None), ("j", 2, "running", 5), ("j", 3, "failed", None), ("j", 4, "running", None), ("k", 1, "pending", None)], "job_id string, seq int, status string, done int")
    state = {r.job_id: r for r in jb.fold_jobs(events, ["done"]).collect()}
    assert (state["j"].status, state["j"].done, state["j"].attempts) == ("failed", 5, 2) and (state["k"].status, state["k"].attempts) == ("pending", 0)
    later = [("j", 5, "requeue", None), ("k", 2, "running", 1), ("k", 3, "succeeded", None), ("k", 4, "failed", None), ("l", 1, "requeue", None), ("l", 2, "running", 2), ("l", 3, "running", 3)]
    state = {r.job_id: r for r in jb.fold_jobs(events.unionAll(spark.createDataFrame(later, events.schema)), ["done"]).collect()}
    assert [(state[k].status, state[k].done, state[k].attempts, state[k].last_seq) for k in "jkl"] == [("pending", 5, 0, 5), ("succeeded", 1, 1, 4), ("running", 3, 2, 3)]
    letters = jb.dead_letters(spark.createDataFrame([("j", k, "SourceFetchError", "e" * 3000) for k in range(3)], "job_id string, seq int, error_class string, error string")).orderBy("seq").collect()
    assert [x.is_terminal for x in letters] == [False, False, True] and len(letters[0].error) == 2000


def test_stale_jobs(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [("a", "running", now - dt.timedelta(seconds=301), 1, now), ("b", "running", None, 3, now), ("c", "running", now - dt.timedelta(seconds=300), 1, now), ("d", "failed", None, 1, now)]
    jobs = spark.createDataFrame(rows, "id string, status string, heartbeat_at timestamp, attempts int, created_at timestamp")
    assert [(r.id, r.action) for r in jb.sweep(jobs, F.lit(now)).collect()] == [("a", "requeue"), ("b", "fail")]


def test_cache(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    ddl = "id int, idempotency_key string, user_id string, response_json string, created_at timestamp, expires_at timestamp"
    cache = spark.createDataFrame([(1, "live", "u", "a", t(0), t(20)), (2, "old", "u", "b", t(0), t(10))], ddl)
    new = spark.createDataFrame([(3, "live", "u", "c", t(10), t(99)), (4, "old", "v", "d", t(10), t(99)), (5, "old", "v", "e", t(11), t(99))], ddl)
    after = {r.idempotency_key: r.id for r in ca.put(cache, new, F.lit(t(10)), [F.col("created_at")]).collect()}
    assert after == {"live": 1, "old": 4}
    assert ca.invalidate(cache, spark.createDataFrame([("u",)], "user_id string")).count() == 0


def test_agent_log(spark):
    calls = spark.createDataFrame([("t", 1, 0, "c1", "search", "q"), ("t", 1, 1, "c2", "open", ""), ("t", 3, 0, "c2", "open", None), ("t", 5, 0, None, "x", None)], "thread string, turn int, position int, call_id string, name string, detail string")
    results = spark.createDataFrame([("t", "c1")], "thread string, call_id string")
    assert [(r.call_id, r.name) for r in ag.dangling_calls(calls, results).collect()] == [("c2", "open")]
    assert ag.tool_trace(calls, length=3).first().trace == ["open", "open", "x"]
    messages = spark.createDataFrame([("t", 0, "user", "snapshot", "s0", 0.4), ("t", 1, "assistant", None, "hi", 0.4), ("t", 2, "user", "snapshot", "s2", 0.4), ("t", 3, "assistant", None, "", 0.0)], "thread string, turn int, role string, kind string, content string, cost double")
    assert ag.final_answer(messages).first().answer == "hi"
    assert [r.content for r in ag.prune(messages).orderBy("turn").collect()] == [ag.STALE_SNAPSHOT, "hi", "s2", ""]
    assert ag.budget_stop(messages, 1.0).first().turn == 2 and ag.step_limit(10) == 20


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = la.detect_language(docs, la.train(docs)).select("lang", "language").collect()
    known = [r for r in rows if r.language]
    assert len(known) > 0.9 * len(rows) and sum(r.lang == r.language for r in known) > 0.97 * len(known)
    none = spark.createDataFrame([("short",), ("1234567890 " * 20,), (None,)], "text string")
    assert [r.language for r in la.detect_language(none, la.train(docs)).collect()] == [None] * 3


def test_selections(spark):
    rows = spark.createDataFrame([(k, k % 2 == 0, f"u{k % 3}", k) for k in range(9)], "id int, is_terminal boolean, user_id string, created_at int")
    assert [r.id for r in se.failures_of(rows, "u0", None, 2).collect()] == [6, 3] and [r.id for r in se.page(rows, "created_at", 2, 3).collect()] == [6, 5, 4]
    assert se.newest(rows, "created_at", 500, most=4).count() == 4 and se.by_id(rows, 3, "u1").count() == 0


def test_stream_resumes_without_repeats(spark, tmp_path):
    root = f"file://{tmp_path}"
    to_chunks = lambda b: b.select("document_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_index"))
    run = lambda: st.start_ingest(spark, f"{root}/jobs", "document_id string, n int", to_chunks, f"{root}/out", f"{root}/cp").awaitTermination()
    st.enqueue(spark.createDataFrame([("a", 3), ("b", 2)], "document_id string, n int"), f"{root}/jobs")
    run()
    st.enqueue(spark.createDataFrame([("a", 1)], "document_id string, n int"), f"{root}/jobs")
    run()
    run()
    now = st.current_chunks(spark, f"{root}/out")
    assert sorted((r.document_id, r.chunk_index) for r in now.select("document_id", "chunk_index").collect()) == [("a", 0), ("b", 0), ("b", 1)]
    batch = spark.createDataFrame([("a", 0)], "document_id string, chunk_index int")
    st.write_chunks(batch, f"{root}/out", 1)
    assert st.current_chunks(spark, f"{root}/out").filter("document_id = 'a'").count() == 1


def test_accounts(spark):
    from tarnloom.operators import accounts as ac

    users = spark.createDataFrame([(1, "a@x", "A", "user", "old")], "id int, email string, name string, role string, updated_at string")
    new = spark.createDataFrame([(2, "a@x", 1), (3, "b@x", 2), (4, "b@x", 1)], "id int, email string, created_at int")
    assert {r.id: r.created for r in ac.create_users(users, new).collect()} == {2: False, 3: False, 4: True}
    assert ac.set_role(users, 1, "admin").first().role == "admin" and ac.by_email(users, "a@x").count() == 1
    with pytest.raises(ValueError):
        ac.set_role(users, 1, "root")
    tokens = spark.createDataFrame([("t", False), ("s", False)], "token string, revoked boolean")
    assert [r.revoked for r in ac.revoke(tokens, "t").orderBy("token").collect()] == [False, True]


def test_worker_pass(spark):
    from tarnloom.plans import worker as wo

    jobs = spark.createDataFrame([("ok", "u", "s", 0), ("again", "u", "s", 1), ("out", "u", "s", 2), ("bad", "u", "s", 0), ("lost", "u", "s", 0)], "job_id string, user_id string, source string, attempts int")
    results = spark.createDataFrame([("ok", None, None), ("again", "SourceFetchError", "e"), ("out", "SourceFetchError", "e" * 3000), ("bad", "LowTextYieldError", None)], "job_id string, error_class string, error string")
    done = wo.outcomes(jobs, results, F.to_timestamp(F.lit("2024-01-01")))
    assert {r.job_id: r.status for r in done.events.collect()} == {"ok": "succeeded", "again": "running", "out": "failed", "bad": "failed"}
    assert {r.job_id: (r.is_terminal, len(r.error or "")) for r in done.dead_letters.collect()} == {"again": (False, 1), "out": (True, 2000), "bad": (True, 0)}
    assert [(r.job_id, r.attempts) for r in done.again.collect()] == [("again", 2)]
    table = spark.createDataFrame([("a", "running", b"x", None), ("b", "running", b"y", None)], "id string, status string, payload binary, document_id string")
    after = {r.id: (r.status, r.payload, r.document_id) for r in wo.finish(table, spark.createDataFrame([("a", "d")], "id string, document_id string")).collect()}
    assert after == {"a": ("succeeded", None, "d"), "b": ("running", bytearray(b"y"), None)}
