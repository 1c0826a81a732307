"""More registered queries: single selections, projections, and guards of the ingestion path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as md
from ..operators import accounts as ac
from ..operators import agentlog as ag
from ..operators import jobs as jb
from ..operators import language as la
from ..operators import quality_gate as qg
from ..operators import retrieval as vs
from ..operators import selections as se
from ..sources import files as fi
from ..sources import layout as ly
from . import ingest as pi
from .queries import _GATE, _empty, _gated, first_vector, hashed_vectors, query, rounded, t

# ── selections by key ──


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderpriority = '1-URGENT'")
def flt_identity(spark, sf_dir):
    documents = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("source"))
    return se.by_identity(documents, 7, "1-URGENT").select("o_orderkey")


@query("""SELECT k AS id, d.doc_id IS NOT NULL AS found FROM (VALUES (0), (1), (2), (3)) q(k) LEFT JOIN documents d ON d.doc_id = k AND d.source = 'src' || (k % 2)""")
def flt_by_id(spark, sf_dir):
    """A row by id is found by its owner only."""
    documents = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("user_id"))
    asked = [se.by_id(documents, k, f"src{k % 2}").agg(F.lit(k).alias("id"), (F.count("*") > 0).alias("found")) for k in range(4)]
    return asked[0].unionAll(asked[1]).unionAll(asked[2]).unionAll(asked[3])


@query("SELECT event_id FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 100")
def flt_jobs_newest(spark, sf_dir):
    jobs = t(spark, sf_dir, "events").filter("user_id = 7").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return se.newest(jobs, "created_at", 500, most=se.MOST_JOBS).select(F.col("id").alias("event_id"))


@query("SELECT event_id, event_type FROM events WHERE event_id = 11 AND user_id = (SELECT user_id FROM events WHERE event_id = 11)")
def flt_failure_by_id(spark, sf_dir):
    failures = t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    owner = failures.filter("id = 11").first()["user_id"]
    return se.by_id(failures, 11, owner).unionAll(se.by_id(failures, 11, owner + 1)).select(F.col("id").alias("event_id"), "event_type")


@query("SELECT c_custkey AS id FROM customer WHERE c_name = 'Customer#000000042' OR c_custkey = 17")
def flt_users(spark, sf_dir):
    users = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"))
    by_id = se.by_id(users, 17, 17, owner_col="id")
    return ac.by_email(users, "Customer#000000042").unionAll(by_id).distinct().select("id")


# ── projections ──

_STATE = "CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END"


def _jobs_of(orders: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"), F.col("o_orderpriority").alias("source"), F.lit("me").alias("user_id"),
        (F.col("o_orderkey") % 4).cast("int").alias("processed_chunks"), (F.col("o_orderkey") % 8).cast("int").alias("total_chunks"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("document_id"), null.alias("error"), null.alias("failure_reason"),
        F.lit(1).alias("attempts"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("started_at"), null.alias("finished_at"), null.cast("binary").alias("payload"),
    )


@query(f"SELECT o_orderkey AS job_id, {_STATE} AS status, o_orderpriority AS source FROM orders")
def prj_job_accepted(spark, sf_dir):
    return se.job_accepted(_jobs_of(t(spark, sf_dir, "orders")))


@query(f"""SELECT o_orderkey AS job_id, {_STATE} AS status, CAST(o_orderkey % 4 AS INTEGER) AS processed_chunks, CAST(o_orderkey % 8 AS INTEGER) AS total_chunks,
                  CASE WHEN o_orderkey % 8 > 0 THEN round((o_orderkey % 4) / (o_orderkey % 8), 4) + 0.0 END AS progress, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS document_id FROM orders""")
def prj_job_status(spark, sf_dir):
    return se.job_status(_jobs_of(t(spark, sf_dir, "orders"))).withColumn("progress", F.col("progress") + 0.0).select("job_id", "status", "processed_chunks", "total_chunks", "progress", "document_id")


@query("SELECT event_id AS failure_id, user_id AS job_id, event_type AS reason FROM events")
def prj_failures(spark, sf_dir):
    letters = t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.lit("owner").alias("user_id"), F.col("event_type").alias("reason"))
    return se.failure_view(letters)


@query("""SELECT doc_id AS id, source AS title, CAST(n_chars AS INTEGER) AS chunk_count, CASE WHEN doc_id % 2 = 0 THEN '{"language":"' || lang || '"}' ELSE '{}' END AS metadata FROM documents""")
def prj_documents(spark, sf_dir):
    stored = t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("n_chars").cast("int").alias("chunk_count"), F.lit("2024-01-01").alias("created_at"), "source", F.col("text").alias("content"),
        F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("language"), md.json_string(F.col("lang")))).alias("metadata"),
    )
    return se.document_view(stored).select("id", "title", "chunk_count", md.canonical_map(F.col("metadata")).alias("metadata"))


# ── filters and retrieval ──

_FILTERS = [({"language": "en"}, True), ({}, True), ({"n": 1, "b": True, "f": 1.5}, True), ({"x": None}, False), ({"x": [1]}, False), ({"": 1}, False), ({"x": "y" * 257}, False), ({f"k{i}": i for i in range(11)}, False), ({"x": float("inf")}, False)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {str(ok).lower()})" for k, (_, ok) in enumerate(_FILTERS)) + ") f(filter, valid)")
def mf_validate(spark, sf_dir):
    def is_valid(f: dict) -> bool:
        try:
            md.validate_filter(f)
        except md.InvalidFilter:
            return False
        return True

    return spark.createDataFrame([(k, is_valid(f)) for k, (f, _) in enumerate(_FILTERS)], "filter int, valid boolean")


@query("""SELECT CAST(row_number() OVER (ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, source AS document_title, sha256(text) AS content, round(distance, 6) + 0.0 AS distance
          FROM (SELECT vec_id, list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)) AS distance FROM embeddings WHERE label = 3)
          JOIN documents ON doc_id = vec_id ORDER BY distance, vec_id LIMIT 8""")
def vs_retrieve(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    vector = first_vector(e)
    chunks = e.join(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("document_title"), F.col("text").alias("content")), "vec_id")
    found = vs.retrieve(chunks, "  what is this? ", lambda q: vector if q == "what is this?" else [], 8, owner=3, owner_col="label", id_col="vec_id", normalize=vs.normalised_question)
    return found.select("rank", "vec_id", "document_title", F.sha2("content", 256).alias("content"), rounded("distance"))


# ── guards of the ingestion path ──


@query("""WITH f AS (SELECT doc_id, doc_id % 5 AS k FROM documents)
          SELECT doc_id, CASE WHEN k IN (1, 2, 4) THEN 'docai-layout-v1' ELSE 'local' END AS method, CASE WHEN k IN (1, 2, 4) THEN 1 + (doc_id % 40) // 15 WHEN k = 0 THEN 1 ELSE 0 END AS n_segments, CAST(CASE WHEN k IN (1, 2, 4) THEN 1 + 15 * ((doc_id % 40) // 15) WHEN k = 0 THEN 1 END AS INTEGER) AS last_page, k = 3 AS failed FROM f""")
def qg_escalation(spark, sf_dir):
    """Readable PDFs stay, thin and empty ones and sheets are read by OCR in parts of 15 pages, and ones over the budget fail."""
    k, pages = F.col("doc_id") % 5, (F.col("doc_id") % 40 + 1).cast("int")
    segment = lambda text: F.array(F.struct(text.alias("text"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("section")))
    local = t(spark, sf_dir, "documents").select(
        "doc_id", F.lit("x").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"), F.when(k == 3, 501).otherwise(pages).alias("page_count"), F.lit("application/pdf").alias("mime"),
        F.when(k == 0, segment(F.concat("text", F.repeat(F.lit("x"), 50 * pages)))).when(k == 1, segment(F.lit("t"))).otherwise(F.slice(segment(F.lit("t")), 1, 0)).alias("segments"),
    )
    read = ly.extract_with_escalation(local, lambda content, kind: {"blocks": [{"text": "z" * 2000, "page": 1}]}, True, cutter=lambda content, first, n: content)
    return read.select("doc_id", "method", F.size("segments").cast("long").alias("n_segments"), F.get(F.col("segments"), F.size("segments") - 1)["page"].alias("last_page"), F.col("error").isNotNull().alias("failed"))


@query("SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 1000 > 500 AS over FROM documents")
def qg_budget(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", ly.over_budget(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 1000)).alias("over"))


@query(_GATE + """SELECT source, '{"char_count":' || char_count || ',"chars_per_page":' || CAST(round(char_count / page_count, 2) AS VARCHAR) || ',"extraction_method":"local","page_count":' || page_count || ',"pages_with_text":' || pages_with_text || ',"segment_count":' || pages_with_text || '}' AS diagnostics FROM g""")
def jb_diagnostics(spark, sf_dir):
    return _gated(t(spark, sf_dir, "documents")).select("source", md.canonical_map(qg.diagnostics(F.col("r"), F.lit("local"))).alias("diagnostics"))


@query("""SELECT user_id AS job_id, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'succeeded' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'failed' ELSE 'running' END AS status FROM (
            SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type IN ('purchase', 'error') ORDER BY event_id) AS n FROM events) WHERE event_type NOT IN ('purchase', 'error') OR n = 1) GROUP BY user_id""")
def jb_status_machine(spark, sf_dir):
    """The first terminal status stays, whatever comes later."""
    status = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("running")
    events = t(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"))
    return jb.fold_jobs(events, []).select("job_id", "status")


@query("SELECT CAST(i AS INTEGER) AS iterations, CAST(2 * i AS INTEGER) AS steps FROM range(1, 11) r(i)")
def ag_step_limit(spark, sf_dir):
    return spark.createDataFrame([(n, ag.step_limit(n)) for n in range(1, 11)], "iterations int, steps int")


# ── what readers and models keep to, where their very results are their own ──


@query(r"""SELECT url AS source, sha256(string_agg(letters, '')) AS letters FROM (
             SELECT url, html, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>?', ' ', 'g'), '&(amp|copy|middot|quot);?|\P{L}', '', 'g') AS letters FROM pages) GROUP BY url""")
def src_html_letters(spark, sf_dir):
    """All letters that an address shows, in order, whatever the marks around them; its pages follow each other by id."""
    read = fi.extract_local(fi.read_pages(t(spark, sf_dir, "pages"), "page_id"))
    shown = F.array_join(F.transform("segments", lambda s: s["text"]), " ")
    letters = F.when(F.col("content").isNotNull(), F.regexp_replace(F.regexp_replace(shown, r"\]\([^)\n]*\)", ""), r"\P{L}", ""))
    of_page = read.select("source", "page_id", letters.alias("letters"))
    pages = F.array_sort(F.collect_list(F.when(F.col("letters").isNotNull(), F.struct("page_id", "letters"))))
    whole = of_page.groupBy("source").agg(pages.alias("pages"))
    return whole.select("source", F.when(F.size("pages") > 0, F.sha2(F.array_join(F.col("pages.letters"), ""), 256)).alias("letters"))


@query("SELECT 0::BIGINT AS bad_offsets, 0::BIGINT AS bad_counts, 0::BIGINT AS too_long, true AS some")
def ingest_violations(spark, sf_dir):
    """Chunks of the whole path against their documents: offsets, gapless numbers and counts, lengths."""
    files = fi.extract_local(fi.read_pages(t(spark, sf_dir, "pages"))).withColumn("user_id", F.regexp_extract("source", "^[a-z]+://([^/]*)", 1))
    documents, chunks = _empty(spark)
    done = pi.ingest(files, documents, chunks, hashed_vectors, "hashed-16")
    joined = done.chunks.join(done.documents.select(F.col("id").alias("document_id"), F.col("content").alias("body"), "chunk_count"), "document_id")
    checked = joined.select("document_id", "chunk_index", "chunk_count", (F.substring(F.col("body"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) != F.col("content")).cast("long").alias("off"), (F.length("content") > 1000).cast("long").alias("long"))
    of_doc = checked.groupBy("document_id").agg(F.sum("off").alias("off"), F.sum("long").alias("long"), ((F.count("*") != F.max("chunk_count")) | (F.countDistinct("chunk_index") != F.max("chunk_count")) | (F.max("chunk_index") != F.max("chunk_count") - 1)).cast("long").alias("counts"))
    return of_doc.agg(F.sum("off").alias("bad_offsets"), F.sum("counts").alias("bad_counts"), F.sum("long").alias("too_long"), (F.count("*") > 0).alias("some"))


@query("SELECT true AS most_are_clear, true AS clear_ones_are_right, 0::BIGINT AS unguarded")
def md_language_accuracy(spark, sf_dir):
    """Over all documents: nine in ten have a clear language, 97 in 100 of those their own, and none that fails a guard has one."""
    docs = t(spark, sf_dir, "documents")
    judged = la.detect_language(docs, la.train(docs)).withColumn("fit", F.coalesce(md.can_detect_language(F.col("text")), F.lit(False)))
    clear, right = F.count_if(F.col("language").isNotNull()), F.count_if(F.col("language") == F.col("lang"))
    return judged.agg((clear >= F.count_if(F.col("fit")) * 0.9).alias("most_are_clear"), (right >= clear * 0.97).alias("clear_ones_are_right"), F.count_if(~F.col("fit") & F.col("language").isNotNull()).alias("unguarded"))
