"""Registered queries of the ingestion and retrieval operators, each with DuckDB's SQL where SQL can say it.

The test tables' texts are clean, so noise, headings, dates and markers are put in by the
document's number, in the query and in its SQL alike. Every query reads its whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as md
from ..functions import mime as mm
from ..functions import text as tx
from ..functions import uri as ur
from ..operators import accounts as ac
from ..operators import agentlog as ag
from ..operators import cache as ca
from ..operators import chunking as ch
from ..operators import headings as hd
from ..operators import jobs as jb
from ..operators import language as la
from ..operators import quality_gate as qg
from ..operators import retrieval as vs
from ..operators import selections as se
from ..operators import upsert as up
from ..sources import files as fi
from ..sources import layout as ly
from ..storage import shared_dir
from ..streaming import ingest as st
from ..streaming import sweeper as sw
from . import ingest as pi
from . import worker as wo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OWNER = 3
AS_OF = "2024-01-20 00:00:00"
SEGMENT = "struct<text:string,page:int,section:string>"


def query(sql: str | None = None):
    """Register a query, and its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: str) -> Column:
    return (F.round(c, 6) + 0.0).alias(c)


# ── vector search ──


def first_vector(embeddings: DataFrame) -> list[float]:
    """The query vector: that of the smallest id."""
    return [float(x) for x in embeddings.orderBy("vec_id").select("embedding").first()[0]]


_TOPK = """SELECT CAST(row_number() OVER (ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, round(distance, 6) + 0.0 AS distance, round(1 - distance, 6) + 0.0 AS similarity
           FROM (SELECT vec_id, list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)) AS distance FROM {0}) ORDER BY distance, vec_id LIMIT 5"""


@query(_TOPK.format("embeddings"))
def vs_topk(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return vs.topk(e, first_vector(e), 5, id_col="vec_id").select("rank", "vec_id", rounded("distance"), rounded("similarity"))


@query(_TOPK.format(f"embeddings WHERE label = {OWNER}"))
def vs_topk_owner(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return vs.topk(e, first_vector(e), 5, owner=OWNER, owner_col="label", id_col="vec_id").select("rank", "vec_id", rounded("distance"), rounded("similarity"))


@query(_TOPK.format("embeddings JOIN documents ON vec_id = doc_id WHERE lang = 'en'"))
def vs_topk_filtered(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    chunks = e.join(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.create_map(F.lit("language"), md.json_string(F.col("lang"))).alias("metadata")), "vec_id")
    return vs.topk(chunks, first_vector(e), 5, filters={"language": "en"}, id_col="vec_id").select("rank", "vec_id", rounded("distance"), rounded("similarity"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
          d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_distance(e.v, q.v) AS distance FROM e, e q WHERE q.vec_id % 100 = 0)
          SELECT query_id, id, round(distance, 6) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank
          FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id) AS rank FROM d) WHERE rank <= 10""")
def vs_topk_multi(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vs.topk_of_many(e, queries, 10, id_col="vec_id").select("query_id", "id", rounded("distance"), "rank")


@query()
def vs_lsh(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vs.lsh_topk_of_many(e, queries, 10, id_col="vec_id").select("query_id", "id", rounded("distance"), "rank")


@query("SELECT query.vec_id AS query_id, true AS found_most FROM embeddings query WHERE query.vec_id = 0")
def vs_lsh_recall(spark, sf_dir):
    """Nine in ten of the exact neighbours, over all queries."""
    exact, near = (q(spark, sf_dir).select("query_id", "id") for q in (vs_topk_multi, vs_lsh))
    share = exact.join(near.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").agg((F.count("hit") / F.count("*")).alias("recall"))
    return share.select(F.lit(0).cast("long").alias("query_id"), (F.col("recall") >= 0.9).alias("found_most"))


# ── metadata filters ──


def _typed(docs: DataFrame) -> DataFrame:
    number = (F.col("doc_id") % 5).cast("string")
    value = F.when(F.col("doc_id") % 2 == 0, number).otherwise(md.json_string(number))
    return docs.withColumn("metadata", F.map_filter(F.create_map(F.lit("n"), value, F.lit("language"), F.when(F.col("doc_id") % 7 != 0, md.json_string(F.col("lang")))), lambda k, v: v.isNotNull()))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 = 3 AND doc_id % 2 = 0 AND doc_id % 7 <> 0 AND lang = 'en'")
def mf_contains_types(spark, sf_dir):
    return _typed(t(spark, sf_dir, "documents")).filter(md.contains(F.col("metadata"), {"n": 3, "language": "en"})).select("doc_id")


@query("""SELECT doc_id, '{' || CASE WHEN doc_id % 7 <> 0 THEN '"language":"' || lang || '",' ELSE '' END || '"n":' || CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 5 AS VARCHAR) ELSE '"' || (doc_id % 5) || '"' END || '}' AS canonical FROM documents""")
def mf_canonical(spark, sf_dir):
    return _typed(t(spark, sf_dir, "documents")).select("doc_id", md.canonical_map(F.col("metadata")).alias("canonical"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 3 = 1")
def flt_distinct_from(spark, sf_dir):
    version = F.when(F.col("doc_id") % 3 == 0, F.lit('"extractive-v1"')).when(F.col("doc_id") % 3 == 2, F.lit('"extractive-v2"'))
    stored = t(spark, sf_dir, "documents").withColumn("metadata", F.map_filter(F.create_map(F.lit("extractor_version"), version), lambda k, v: v.isNotNull()))
    return stored.filter(md.needs_refresh(F.col("metadata"))).select("doc_id")


# ── text functions ──


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def tx_content_hash(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query("""SELECT doc_id, sha256(source || '|' || text || '|{"language":"' || lang || '"}|' || (doc_id % 20 + 1) || '|n1|c1|m1') AS query_key FROM documents""")
def tx_query_key(spark, sf_dir):
    filters = F.concat(F.lit('{"language":"'), "lang", F.lit('"}'))
    return t(spark, sf_dir, "documents").select("doc_id", tx.query_key(F.col("source"), F.col("text"), filters, F.col("doc_id") % 20 + 1, F.lit("n1"), F.lit("c1"), F.lit("m1")).alias("query_key"))


#: What stands in for sentence ends, and what surrounds the text.
NOISE = (".\t  ", ".\u200b\u00ad\u00a0 ", ".\r\n\r\n\n\n", ".\x0c\x0b  ")
BEFORE, AFTER = "  \n\ufeff", " \n\t "


def _noisy() -> Column:
    """Line ends, tabs, no-break and zero-width spaces, blank lines and outer white space, by number."""
    body = F.replace(F.col("text"), F.lit(". "), F.element_at(F.array(*map(F.lit, NOISE)), (F.col("doc_id") % 4 + 1).cast("int")))
    return F.concat(F.lit(BEFORE), body, F.lit(AFTER))


_NOISY = f"('{BEFORE}' || replace(text, '. ', CASE doc_id % 4 WHEN 0 THEN '{NOISE[0]}' WHEN 1 THEN '{NOISE[1]}' WHEN 2 THEN '{NOISE[2]}' ELSE '{NOISE[3]}' END) || '{AFTER}')"
_BLANK = r"[\t\x0b\x0c \x{a0}\x{2003}]"
_LAYOUT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(<text>, '\r\n?', E'\n', 'g'), '[\x{200b}\x{ad}\x{feff}\x0b\x0c]', '', 'g'),
             '<blank>+', ' ', 'g'), ' *\n *', E'\n', 'g'), '\n{3,}', E'\n\n', 'g'), '^[ \n]+|[ \n]+$', '', 'g')"""


@query("SELECT doc_id, sha256(" + _LAYOUT.replace("<text>", _NOISY).replace("<blank>", _BLANK) + ") AS normalised FROM documents")
def tx_normalize_ws(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.normalize_layout(_noisy()), 256).alias("normalised"))


@query(r"""SELECT doc_id, sha256(replace(replace(text, 'e', 'fi'), 'a', '1A')) AS normalised FROM documents""")
def tx_normalize_nfkc(spark, sf_dir):
    marked = F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("ﬁ")), F.lit("a"), F.lit("①Ａ"))
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.normalize_text(marked), 256).alias("normalised"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a.tar' WHEN 1 THEN '.bashrc' WHEN 2 THEN 'report ' || doc_id ELSE 'document' END AS title FROM documents""")
def tx_fallback_title(spark, sf_dir):
    n = F.col("doc_id") % 4
    name = F.when(n == 0, "a.tar.gz").when(n == 1, ".bashrc").when(n == 2, "")
    source = F.when(n == 2, F.concat(F.lit("https://example.com/x/report "), "doc_id", F.lit(".md"))).otherwise("")
    return t(spark, sf_dir, "documents").select("doc_id", tx.fallback_title(name, source).alias("title"))


@query("""SELECT doc_id, CASE WHEN length(text) > 5000 THEN left(text, 5000) || E'\\n\\n[...truncated, ' || length(text) || ' total chars]' ELSE text END AS content FROM documents""")
def tx_truncate(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tx.truncate_content(F.col("text")).alias("content"))


@query("""SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS n_tokens, '- ' || source || ' (ID: ' || doc_id || ', ' || length(text) // 1000 || ' chunks)' AS line, [source for i in range(doc_id % 3)] AS echoed FROM documents""")
def tx_renderings(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tx.count_tokens(F.col("text")).alias("n_tokens"), tx.document_line(F.col("source"), F.col("doc_id"), F.floor(F.length("text") / 1000)).alias("line"), tx.echo(F.col("source"), F.col("doc_id") % 3).alias("echoed"))


@query("""SELECT doc_id, 'postgresql://' || source || ':***@db:5432/x' AS masked, CASE doc_id % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'google' WHEN 3 THEN 'aws_bedrock' ELSE 'unknown' END AS provider FROM documents""")
def tx_masks(spark, sf_dir):
    model = F.element_at(F.array(*(F.lit(x) for x in ("gpt-4o-mini", "claude-x", "gemini-x", "bedrock/claude", "llama"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return t(spark, sf_dir, "documents").select("doc_id", tx.mask_password(F.concat(F.lit("postgresql://"), "source", F.lit(":s3cret@db:5432/x"))).alias("masked"), tx.provider(model).alias("provider"))


_MIME = ("report.PDF", "notes.md", "sheet.xlsx", "page", "archive.zip")


@query("""WITH m AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 3 THEN 'text/html' END AS mime FROM documents)
          SELECT doc_id, mime, mime IS NOT NULL AND doc_id % 5 <> 2 AS has_loader, mime IS NOT NULL AS with_ocr FROM m""")
def tx_mime(spark, sf_dir):
    k = (F.col("doc_id") % 5 + 1).cast("int")
    name = F.element_at(F.array(*map(F.lit, _MIME)), k)
    declared = F.when(F.col("doc_id") % 5 == 3, " Text/HTML ; charset=utf-8")
    kind = t(spark, sf_dir, "documents").select("doc_id", mm.resolve_mime(name, declared).alias("mime"))
    return kind.select("doc_id", "mime", mm.has_loader(F.col("mime")).alias("has_loader"), mm.is_ingestible(F.col("mime"), True).alias("with_ocr"))


@query("""SELECT doc_id, 'Unsupported file type for ''' || source || '''. Supported: PDF, DOCX, HTML, TXT, Markdown' || CASE WHEN doc_id % 2 = 0 THEN ', XLSX, XLSM, PPTX.' ELSE '. XLSX, XLSM, PPTX require Document AI OCR — set OCR_ENABLED=true and DOCUMENTAI_PROCESSOR_ID to enable them.' END AS message FROM documents""")
def tx_unsupported(spark, sf_dir):
    message = F.when(F.col("doc_id") % 2 == 0, mm.unsupported_message(F.col("source"), True)).otherwise(mm.unsupported_message(F.col("source"), False))
    return t(spark, sf_dir, "documents").select("doc_id", message.alias("message"))


_URI = """CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'ftp://x/y' WHEN 2 THEN 'report.pdf' WHEN 3 THEN 'https://host.example' WHEN 4 THEN '  gdrive://abc' || page_id || '  ' ELSE url END"""


@query(rf"""WITH u AS (SELECT page_id, trim({_URI}) AS uri FROM pages),
            p AS (SELECT page_id, uri, lower(regexp_extract(uri, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(uri, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority,
                         regexp_replace(regexp_extract(uri, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+', '') AS path FROM u)
            SELECT page_id, scheme, authority, path, CASE WHEN uri = '' THEN 'empty' WHEN length(uri) > 1024 THEN 'too_long' WHEN scheme = '' THEN 'no_scheme' WHEN scheme NOT IN ('upload', 'gdrive', 'http', 'https') THEN 'unknown_scheme'
                   WHEN authority = '' THEN 'no_authority' WHEN scheme IN ('http', 'https') AND path = '' THEN 'no_path' END AS error FROM p""")
def tx_parse_uri(spark, sf_dir):
    n = F.col("page_id") % 8
    raw = F.when(n == 0, "").when(n == 1, "ftp://x/y").when(n == 2, "report.pdf").when(n == 3, "https://host.example").when(n == 4, F.concat(F.lit("  gdrive://abc"), "page_id", F.lit("  "))).otherwise(F.col("url"))
    return t(spark, sf_dir, "pages").withColumn("p", ur.parse_source_uri(raw)).select("page_id", "p.scheme", "p.authority", F.col("p.raw_path").alias("path"), "p.error")


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1), ''), regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS name,
                  CASE WHEN url LIKE 'http%' THEN 'http' END AS connector, true AS fetchable FROM pages""")
def tx_display_name(spark, sf_dir):
    parsed = t(spark, sf_dir, "pages").withColumn("p", ur.parse_source_uri(F.col("url")))
    return parsed.select("page_id", ur.display_name(F.col("p.raw_path"), F.col("p.authority")).alias("name"), ur.connector(F.col("p.scheme")).alias("connector"), ur.is_fetchable(F.col("p.scheme")).alias("fetchable"))


@query("""SELECT doc_id, 'upload://' || source || '/' || url_encode('a/b ' || lang || ' ñ?' || doc_id || '.pdf') AS uri FROM documents""")
def tx_upload_uri(spark, sf_dir):
    name = F.concat(F.lit(" a/b "), "lang", F.lit(" ñ?"), "doc_id", F.lit(".pdf "))
    return t(spark, sf_dir, "documents").select("doc_id", ur.upload_uri(F.col("source"), name).alias("uri"))


@query(r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'file ' || page_id || '.pdf' ELSE coalesce(nullif(regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1), ''), 'document') END AS name FROM pages""")
def tx_response_filename(spark, sf_dir):
    header = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('attachment; filename="file '), "page_id", F.lit('.pdf"')))
    return t(spark, sf_dir, "pages").select("page_id", ur.filename_from_response(F.col("url"), header).alias("name"))


@query("""SELECT doc_id, doc_id % 6 IN (0, 5) AS public FROM documents WHERE doc_id % 6 <> 4 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 6 = 4""")
def src_public_guard(spark, sf_dir):
    address = F.element_at(F.array(*map(F.lit, ("8.8.8.8", "10.0.0.1", "127.0.0.1", "169.254.169.254", "not an address", "2606:4700::1111"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return t(spark, sf_dir, "documents").select("doc_id", ur.is_public_address(address).alias("public"))


def _headed() -> Column:
    """Every second sentence's end becomes a heading line."""
    return F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("# Top #\n")).otherwise(F.lit("")), F.replace(F.col("text"), F.lit(".\n"), F.concat(F.lit(".\n## Part "), "lang", F.lit(" ##\n"))))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 2 = 0 THEN E'# Top #\n' ELSE '' END || replace(text, E'.\n', E'.\n## Part ' || lang || E' ##\n'), E'\n')) AS line, unnest(range(0, len(string_split(CASE WHEN doc_id % 2 = 0 THEN E'# Top #\n' ELSE '' END || replace(text, E'.\n', E'.\n## Part ' || lang || E' ##\n'), E'\n')))) AS k FROM documents),
           m AS (SELECT doc_id, k, line, nullif(regexp_extract(line, '^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$', 1), '') AS heading FROM l),
           r AS (SELECT *, sum(CASE WHEN heading IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS region FROM m),
           g AS (SELECT doc_id, region, max(heading) AS section, trim(string_agg(line, E'\n' ORDER BY k), E' \n\t') AS text FROM r GROUP BY ALL)
           SELECT doc_id, section, sha256(text) AS text_sha256 FROM g WHERE text <> ''""")
def tx_heading_split(spark, sf_dir):
    split = t(spark, sf_dir, "documents").select("doc_id", F.explode(hd.heading_segments(_headed())).alias("s"))
    return split.select("doc_id", "s.section", F.sha2("s.text", 256).alias("text_sha256"))


@query(ORACLES["tx_heading_split"])
def tx_heading_rows(spark, sf_dir):
    rows = hd.heading_rows(t(spark, sf_dir, "documents").withColumn("headed", _headed()), "doc_id", "headed")
    return rows.select(F.col("id").alias("doc_id"), "section", F.sha2("text", 256).alias("text_sha256"))


@query(r"""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, lang AS title, text AS content FROM documents)
           SELECT source, string_agg('[Source ' || rank || ': ' || title || E']\n' || content, E'\n\n---\n\n' ORDER BY rank) AS context FROM r WHERE rank <= 5 GROUP BY source""")
def tx_context(spark, sf_dir):
    from pyspark.sql import Window

    ranked = t(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("rank <= 5")
    return ranked.groupBy("source").agg(tx.context_of(F.collect_list(F.struct("rank", F.col("lang").alias("title"), F.col("text").alias("content")))).alias("context"))


# ── sources ──


@query()
def src_html_segments(spark, sf_dir):
    read = fi.extract_local(fi.read_pages(t(spark, sf_dir, "pages")))
    return read.select("source", "mime", "error", F.posexplode("segments").alias("segment", "s")).select("source", "mime", "error", "segment", "s.section", "s.text")


@query(r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'text/plain' WHEN doc_id % 3 = 1 THEN 'text/markdown' END AS mime, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 1 END AS n_segments,
                  CASE WHEN doc_id % 3 = 2 THEN NULL ELSE sha256(trim(text, E' \n\t')) END AS text_sha256, doc_id % 3 = 2 AS failed FROM documents""")
def src_text_files(spark, sf_dir):
    n = F.col("doc_id") % 3
    files = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("\n "), "text", F.lit("\n")).cast("binary").alias("content"), F.when(n == 0, "a.txt").when(n == 1, "a.md").otherwise("a.bin").alias("filename"), F.lit(None).cast("string").alias("content_type"))
    return fi.load_strict(files).select("doc_id", "mime", F.size("segments").alias("n_segments"), F.sha2(F.get(F.col("segments"), F.lit(0))["text"], 256).alias("text_sha256"), F.col("error").isNotNull().alias("failed"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'payload' WHEN 1 THEN 'fetched' WHEN 2 THEN 'stored-body' END AS source_kind, CASE doc_id % 4 WHEN 3 THEN NULL ELSE length(text) END AS n FROM documents""")
def src_preference(spark, sf_dir):
    d = t(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 4).withColumn("uri", F.concat(F.lit("https://h/"), "doc_id"))
    jobs = d.select("doc_id", F.col("source").alias("user_id"), F.col("uri").alias("source"), F.when(F.col("k") == 0, F.col("text").cast("binary")).alias("payload"))
    fetched = d.filter("k <= 1").select(F.col("uri").alias("source"), F.col("text").cast("binary").alias("fetched"))
    stored = d.filter("k <= 2").select(F.col("source").alias("user_id"), F.col("uri").alias("source"), F.col("text").alias("body"))
    return fi.choose_source(jobs, fetched, stored).select("doc_id", "source_kind", F.length(F.col("content").cast("string")).alias("n"))


@query("""SELECT doc_id, doc_id % 3 = 0 AS hit FROM documents""")
def src_cached_extraction(spark, sf_dir):
    body = F.to_json(F.struct(F.lit("local").alias("method"), F.array(F.struct(F.col("text"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("section"))).alias("segments")))
    stored = F.when(F.col("doc_id") % 3 == 0, body).when(F.col("doc_id") % 3 == 1, F.lit('{"method": 1, "segments": [')).otherwise(F.lit('{"segments": []}'))
    return t(spark, sf_dir, "documents").select("doc_id", fi.cached_segments(stored).isNotNull().alias("hit"))


@query("""SELECT doc_id, CAST(s AS INTEGER) AS page_offset, CAST(least(15, doc_id % 50 + 1 - s) AS INTEGER) AS pages FROM (SELECT doc_id, unnest(range(0, doc_id % 50 + 1, 15)) AS s FROM documents)""")
def src_shards(spark, sf_dir):
    cut = t(spark, sf_dir, "documents").select("doc_id", F.explode(ly.shards((F.col("doc_id") % 50 + 1).cast("int"))).alias("s"))
    return cut.select("doc_id", F.col("s.offset").alias("page_offset"), F.col("s.pages").alias("pages"))


@query(r"""WITH d AS (SELECT doc_id, trim(text, E' \n') AS head, source FROM documents)
           SELECT doc_id, 0 AS segment, CAST(1 + doc_id % 10 AS INTEGER) AS page, source AS section, source || E'\n\n' || head AS text FROM d UNION ALL SELECT doc_id, 1, CAST(2 + doc_id % 10 AS INTEGER), source, E'| k | v |\n| --- | --- |\n| a | ' || doc_id || E' |\n\n- x\n- y' FROM d""")
def src_layout(spark, sf_dir):
    cell = lambda c: F.struct(F.array(F.struct(c.alias("text"))).alias("blocks"))
    head = F.regexp_replace("text", "^[ \\n]+|[ \\n]+$", "")
    blocks = [
        F.to_json(F.struct(F.lit(1).alias("page"), F.lit("heading-1").alias("type"), F.col("source").alias("text"))),
        F.to_json(F.struct(F.lit(1).alias("page"), F.lit("paragraph").alias("type"), head.alias("text"))),
        F.to_json(F.struct(F.lit(2).alias("page"), F.struct(F.array(F.array(cell(F.lit("k")), cell(F.lit("v")))).alias("header"), F.array(F.array(cell(F.lit("a")), cell(F.col("doc_id").cast("string")))).alias("rows")).alias("table"))),
        F.to_json(F.struct(F.lit(2).alias("page"), F.struct(F.array(cell(F.lit("x")), cell(F.lit(" y "))).alias("entries")).alias("list"))),
    ]
    tree = F.concat(F.lit('{"blocks":['), F.concat_ws(",", *blocks), F.lit("]}"))
    read = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(ly.layout_segments(tree, (F.col("doc_id") % 10).cast("int"))).alias("segment", "s"))
    return read.select("doc_id", "segment", "s.page", "s.section", "s.text")


# ── chunks ──


def _segmented(docs: DataFrame) -> DataFrame:
    return docs.withColumn("segments", hd.heading_segments(_headed()))


@query()
def ch_chunks(spark, sf_dir):
    return ch.build_chunks(_segmented(t(spark, sf_dir, "documents")).select("doc_id", "segments")).select("doc_id", "chunk_index", "char_start", "char_end", "section", "token_count", "batch", "content")


@query("SELECT CAST(0 AS BIGINT) AS wrong_offsets, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS gaps, count(*) AS documents FROM documents")
def ch_offset_violations(spark, sf_dir):
    docs = _segmented(t(spark, sf_dir, "documents")).select("doc_id", ch.body_of(F.col("segments")).alias("body"), "segments")
    chunks = ch.build_chunks(docs)
    wrong = F.substring(F.col("body"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) != F.col("content")
    per_doc = chunks.groupBy("doc_id").agg(F.count_if(wrong).alias("w"), F.count_if(F.length("content") > ch.CHUNK_SIZE).alias("l"), (F.max("chunk_index") + 1 != F.count("*")).cast("int").alias("g"))
    return per_doc.agg(F.sum("w").alias("wrong_offsets"), F.sum("l").alias("too_long"), F.sum("g").alias("gaps"), F.count("*").alias("documents"))


@query("""SELECT doc_id, CAST(b AS INTEGER) AS first, CAST(least(b + 100, n) AS INTEGER) AS last FROM (SELECT doc_id, n, unnest(range(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE least(n, 100) END, n, 100)) AS b FROM (SELECT doc_id, length(text) // 10 AS n FROM documents))""")
def id_batches(spark, sf_dir):
    n = F.floor(F.length("text") / 10).cast("int")
    done = up.resume_cursor(F.least(n, F.lit(100)), F.col("doc_id") % 3 != 0)
    return t(spark, sf_dir, "documents").select("doc_id", F.explode(ch.chunk_batches(n, done)).alias("b")).select("doc_id", "b.first", "b.last")


# ── metadata ──


@query(r"""SELECT doc_id, length(trim(s, E' \n')) >= 40 AND length(regexp_replace(trim(s, E' \n'), '\P{L}', '', 'g')) / length(trim(s, E' \n')) >= 0.5 AS detectable
           FROM (SELECT doc_id, left(CASE WHEN doc_id % 5 = 0 THEN regexp_replace(text, '[aeiou]', '1', 'g') || repeat('#', length(text)::INT) ELSE text END, 4000) AS s FROM documents)""")
def md_alpha_guard(spark, sf_dir):
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.regexp_replace("text", "[aeiou]", "1"), F.repeat(F.lit("#"), F.length("text")))).otherwise(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", md.can_detect_language(text).alias("detectable"))


@query()
def md_language(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    return la.detect_language(docs, la.train(docs)).select("doc_id", "lang", "language")


_DATES = ("Signed 2024-03-15 and 2023-01-01.", "Hecho el 5 de Marzo de 2021, antes 2020-01-01.", "On Sept. 9, 1999 or 2024-13-45.", "31 February 2024, then 1 March 2024.", "On 03/04/2024, in 2150-01-01.")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '2024-03-15' WHEN 1 THEN '2021-03-05' WHEN 2 THEN '1999-09-09' WHEN 3 THEN '2024-03-01' END AS document_date FROM documents")
def md_date(spark, sf_dir):
    dated = F.concat(F.element_at(F.array(*map(F.lit, _DATES)), (F.col("doc_id") % 5 + 1).cast("int")), F.lit(" "), "text")
    return t(spark, sf_dir, "documents").select("doc_id", md.document_date(dated).alias("document_date"))


_MARKED = ("INVOICE NUMBER 7", "The parties to this agreement", "subject: hello from: me", "step 1 troubleshooting requirements, executive summary", "resumen", "privacy policy scope")
_MARKER_ROWS = ", ".join(f"({k}, '{name}', {str(strong).lower()}, '{marker}')" for k, (name, strongs, weaks) in enumerate(md.DOC_TYPES) for strong, markers in ((True, strongs), (False, weaks)) for marker in markers)


@query(f"""WITH m(k, name, strong, marker) AS (VALUES {_MARKER_ROWS}),
           d AS (SELECT doc_id, lower(left(CASE doc_id % 7 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_MARKED))} ELSE '' END || ' ' || text, 4000)) AS s FROM documents),
           h AS (SELECT doc_id, k, name, CASE WHEN bool_or(strong) THEN 2 ELSE count(*) END AS score FROM d JOIN m ON contains(s, marker) GROUP BY doc_id, k, name),
           b AS (SELECT doc_id, first(name ORDER BY score DESC, k) AS name FROM h WHERE score >= 2 GROUP BY doc_id)
           SELECT d.doc_id, CASE WHEN length(trim(s, E' \\n')) < 40 THEN 'other' ELSE coalesce(b.name, 'other') END AS doc_type FROM d LEFT JOIN b ON b.doc_id = d.doc_id""")
def md_doc_type(spark, sf_dir):
    marked = F.concat(F.element_at(F.array(*map(F.lit, (*_MARKED, ""))), (F.col("doc_id") % 7 + 1).cast("int")), F.lit(" "), "text")
    return t(spark, sf_dir, "documents").select("doc_id", md.doc_type(marked).alias("doc_type"))


_ASSEMBLED = "'2024-03-1' || doc_id % 2 || ', invoice number 7, to be paid. ' || text"


@query(f"""WITH m(k, name, strong, marker) AS (VALUES {_MARKER_ROWS}),
           d AS (SELECT doc_id, lower(left({_ASSEMBLED}, 4000)) AS s FROM documents),
           h AS (SELECT doc_id, k, name, CASE WHEN bool_or(strong) THEN 2 ELSE count(*) END AS score FROM d JOIN m ON contains(s, marker) GROUP BY doc_id, k, name),
           b AS (SELECT doc_id, first(name ORDER BY score DESC, k) AS name FROM h GROUP BY doc_id)
           SELECT doc_id, '{{"doc_type":"' || name || '","document_date":"2024-03-1' || doc_id % 2 || '","extraction_method":"local","extractor_version":"extractive-v2"'
                  || CASE WHEN doc_id % 3 = 0 THEN ',"language":"' || lang || '"' ELSE '' END || ',"mime_type":"text/plain"}}' AS metadata FROM documents JOIN b USING (doc_id)""")
def md_assemble(spark, sf_dir):
    text = F.concat(F.lit("2024-03-1"), F.col("doc_id") % 2, F.lit(", invoice number 7, to be paid. "), F.col("text"))
    built = md.metadata_map(text, F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.lit("text/plain"), F.lit("local"))
    return t(spark, sf_dir, "documents").select("doc_id", md.canonical_map(built).alias("metadata"))


# ── quality gate ──


def _gated(docs: DataFrame) -> DataFrame:
    """A source is a file and each document a page; four of five pages of every third source are blank."""
    text = F.when((F.regexp_extract("source", "[0-9]+", 0).cast("int") % 3 == 0), F.when(F.col("doc_id") % 97 == 0, F.substring("text", 1, 300))).otherwise(F.col("text"))
    kept = docs.withColumn("t", text)
    pages = kept.groupBy("source").agg(F.count("*").cast("int").alias("page_count"), F.collect_list(F.when(F.col("t").isNotNull(), F.struct(F.col("t").alias("text"), F.col("doc_id").cast("int").alias("page"), F.lit(None).cast("string").alias("section")))).alias("segments"))
    return pages.select("source", qg.assess(F.col("segments"), F.col("page_count")).alias("r"))


_GATE = """WITH p AS (SELECT source, CASE WHEN CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 3 = 0 THEN CASE WHEN doc_id % 97 = 0 THEN left(text, 300) END ELSE text END AS t FROM documents),
           g AS (SELECT source, CAST(count(*) AS INTEGER) AS page_count, coalesce(sum(length(t)), 0)::BIGINT AS char_count, count(t)::INTEGER AS pages_with_text FROM p GROUP BY source)"""


@query(_GATE + "SELECT source, char_count, page_count, pages_with_text, round(char_count / page_count, 4) + 0.0 AS chars_per_page, char_count / page_count >= 50 AS passes FROM g")
def qg_density(spark, sf_dir):
    r = F.col("r")
    return _gated(t(spark, sf_dir, "documents")).select("source", r["char_count"].alias("char_count"), r["page_count"].alias("page_count"), r["pages_with_text"].alias("pages_with_text"), (F.round(r["chars_per_page"], 4) + 0.0).alias("chars_per_page"), qg.passes(r).alias("passes"))


@query(_GATE + f"""SELECT source, 'This document yielded ' || printf('%.0f', char_count / page_count) || ' characters per page across ' || page_count || ' pages, below the minimum of 50. Only ' || pages_with_text || ' of ' || page_count || ' pages produced any text. It appears to be scanned or image-only. {qg.REMEDY_DISABLED}' AS message FROM g WHERE char_count / page_count < 50""")
def qg_rejection(spark, sf_dir):
    return _gated(t(spark, sf_dir, "documents")).filter(~qg.passes(F.col("r"))).select("source", qg.rejection(F.col("r"), advice=qg.remedy(False, False)).alias("message"))


# ── identity, upsert, sinks ──

_STORED_SQL = """WITH s AS (SELECT doc_id, source AS user_id, doc_id AS source, sha256(text) AS content_hash, CASE WHEN doc_id % 7 = 0 THEN 'n0' ELSE 'n1' END AS normalizer_version, CASE WHEN doc_id % 5 = 0 THEN 'v1' ELSE 'v2' END AS metadata_version FROM documents WHERE doc_id % 4 <> 2)"""


def _tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored documents (a quarter is missing), and an incoming batch (a quarter is edited)."""
    base = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("user_id"), F.col("doc_id").alias("source"), "text", F.lit("c1").alias("chunker_version"), F.lit("m1").alias("embedding_model"))
    stored = base.filter("id % 4 <> 2").withColumn("content_hash", F.sha2("text", 256)).withColumn("normalizer_version", F.when(F.col("id") % 7 == 0, "n0").otherwise("n1")).withColumn("metadata_version", F.when(F.col("id") % 5 == 0, "v1").otherwise("v2")).withColumn("created_at", F.lit("old"))
    text = F.when(F.col("id") % 4 == 1, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    incoming = base.withColumn("text", text).withColumn("content_hash", F.sha2("text", 256)).withColumn("normalizer_version", F.lit("n1")).withColumn("metadata_version", F.lit("v2")).withColumn("created_at", F.lit("new"))
    return stored, incoming.withColumn("id", F.col("id") + 1_000_000_000)


@query("""SELECT doc_id + 1000000000 AS id, CASE WHEN doc_id % 4 = 2 THEN 'new' WHEN doc_id % 4 = 1 OR doc_id % 7 = 0 THEN 'replace' WHEN doc_id % 5 = 0 THEN 'refresh' ELSE 'skip' END AS action, CASE WHEN doc_id % 4 <> 2 THEN doc_id END AS stored_id FROM documents""")
def id_gate(spark, sf_dir):
    stored, incoming = _tables(t(spark, sf_dir, "documents"))
    return up.gate(incoming, stored).select("id", "action", "stored_id")


@query("""SELECT CASE WHEN doc_id % 4 = 2 THEN doc_id + 1000000000 ELSE doc_id END AS id, CASE WHEN doc_id % 4 = 2 THEN 'new' ELSE 'old' END AS created_at, sha256(CASE WHEN doc_id % 4 = 1 THEN text || ' edited' ELSE text END) AS content_hash FROM documents""")
def id_upsert(spark, sf_dir):
    stored, incoming = _tables(t(spark, sf_dir, "documents"))
    return up.upsert_documents(stored, incoming).select("id", "created_at", "content_hash")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1""")
def id_latest(spark, sf_dir):
    return up.latest(t(spark, sf_dir, "events"), [F.col("ts").desc(), F.col("event_id")], ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE CAST(doc_id % 50 AS INTEGER) END AS cursor FROM documents""")
def id_resume(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", up.resume_cursor((F.col("doc_id") % 50).cast("int"), F.when(F.col("doc_id") % 3 != 0, True)).alias("cursor"))


@query("""SELECT sha256('reindex|' || doc_id || '|n1|c1|m1') AS id, 'pending' AS status, source AS user_id FROM (SELECT * FROM documents WHERE doc_id % 6 = 0 OR doc_id % 10 = 1 ORDER BY n_chars, doc_id LIMIT 500)""")
def id_reindex(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("user_id"), "source", F.lit("t").alias("title"), F.col("n_chars").alias("created_at"), F.when(F.col("doc_id") % 6 == 0, "n0").otherwise("n1").alias("normalizer_version"), F.lit("c1").alias("chunker_version"), F.when(F.col("doc_id") % 10 == 1, "m0").otherwise("m1").alias("embedding_model"))
    return up.reindex_jobs(docs, "n1", "c1", "m1").select("id", "status", "user_id")


_PARENTS = "SELECT c_custkey FROM customer WHERE c_acctbal < 0"


@query(f"""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN ({_PARENTS}))""")
def snk_cascade(spark, sf_dir):
    gone = t(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")
    orders, lines = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    gone_orders = orders.join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return up.cascade(lines, gone_orders, "l_orderkey", "o_orderkey")


@query(f"""SELECT o_orderkey, CASE WHEN o_custkey IN ({_PARENTS}) THEN NULL ELSE o_custkey END AS o_custkey FROM orders""")
def snk_set_null(spark, sf_dir):
    return up.set_null(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), t(spark, sf_dir, "customer").filter("c_acctbal < 0"), "o_custkey", "c_custkey")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'plain' END AS metadata FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def snk_refresh(spark, sf_dir):
    fresh = t(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("large").alias("metadata"))
    return up.refresh_metadata(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("plain").alias("metadata")), fresh, "l_orderkey")


@query("""SELECT o_orderkey, o_custkey, c_name AS customer_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def snk_backfill(spark, sf_dir):
    return up.backfill(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), t(spark, sf_dir, "customer"), "o_custkey", {"c_name": "customer_name"}, "c_custkey")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 2 = 1 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_custkey % 2 = 0""")
def snk_replace_chunks(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = orders.filter("o_custkey % 2 = 0").withColumn("o_orderstatus", F.lit("X"))
    return up.replace_chunks(orders, new, "o_custkey").select("o_orderkey", "o_orderstatus")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Renamed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def flt_patch_null(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    fields = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("c_name"), F.lit("c_mktsegment"))).otherwise(F.array(F.lit("c_name")))
    changes = c.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("Renamed").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"), fields.alias("fields"))
    return up.patch(c, changes, "c_custkey", ["c_name", "c_mktsegment"], set_col="fields")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Renamed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 6 = 0 THEN 'BANKING' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def flt_patch(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = c.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("Renamed").alias("c_name"), F.when(F.col("c_custkey") % 3 == 0, "BANKING").alias("c_mktsegment"))
    return up.patch(c, changes, "c_custkey", ["c_name", "c_mktsegment"])


@query("""SELECT first(event_id ORDER BY event_id) AS event_id, user_id FROM events WHERE user_id % 3 <> 0 GROUP BY user_id""")
def snk_unique(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "user_id")
    return up.insert_unique(e.filter("user_id % 3 = 0"), e, ["user_id"], [F.col("event_id")]).select("event_id", "user_id")


# ── selections ──


@query("""SELECT doc_id FROM documents WHERE doc_id % 6 = 0 OR doc_id % 10 = 1 ORDER BY n_chars, doc_id LIMIT 500""")
def flt_stale_versions(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("created_at"), F.when(F.col("doc_id") % 6 == 0, "n0").otherwise("n1").alias("normalizer_version"), F.lit("c1").alias("chunker_version"), F.when(F.col("doc_id") % 10 == 1, "m0").otherwise("m1").alias("embedding_model"))
    return up.stale_documents(docs, "n1", "c1", "m1").select(F.col("id").alias("doc_id"))


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def flt_page_offset(spark, sf_dir):
    return se.page(t(spark, sf_dir, "customer"), "c_acctbal", 40, 20, tie="c_custkey").select("c_custkey")


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_linenumber > 5 OR l_returnflag = 'R'))""")
def flt_provenance(spark, sf_dir):
    chunks = t(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") > 5, 1).alias("page"), F.when(F.col("l_returnflag") == "R", "s").alias("section"))
    return se.has_provenance(chunks, t(spark, sf_dir, "orders").select("o_orderkey"), "l_orderkey", "o_orderkey")


@query("""SELECT event_id, user_id FROM events WHERE user_id = 7 AND event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20""")
def flt_failures(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), (F.col("event_type") == "error").alias("is_terminal"))
    return se.failures_of(rows, 7, True, 20).select(F.col("id").alias("event_id"), "user_id")


@query(f"""SELECT event_id FROM events WHERE event_type <> 'error' AND ts > TIMESTAMP '{AS_OF}' AND user_id = 7""")
def flt_valid_tokens(spark, sf_dir):
    tokens = t(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("token"), "user_id", (F.col("event_type") == "error").alias("revoked"), F.col("ts").cast("timestamp").alias("expires_at"))
    return se.valid_tokens(tokens, "7", F.to_timestamp(F.lit(AS_OF))).select("event_id")


@query("""SELECT event_id, event_type = 'error' OR user_id = 7 AS revoked FROM events""")
def flt_revoke_all(spark, sf_dir):
    return se.revoke_all(t(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "error").alias("revoked")), 7).select("event_id", "revoked")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN round((o_orderkey % 3) / (o_orderkey % 5), 4) + 0.0 END AS progress FROM orders""")
def prj_progress(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", (se.progress(F.col("o_orderkey") % 3, F.col("o_orderkey") % 5) + 0.0).alias("progress"))


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents""")
def prj_preview(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


# ── jobs and failures ──

_CLASS = "CASE event_type WHEN 'error' THEN 'SourceFetchError' WHEN 'view' THEN 'LowTextYieldError' WHEN 'click' THEN 'ValidationError' WHEN 'signup' THEN 'KeyError' ELSE 'ConnectorNotConfiguredError' END"
_REASONS = f"""WITH c AS (SELECT event_id, user_id, ts, {_CLASS} AS error_class FROM events),
               r(error_class, reason, stage, retryable) AS (VALUES ('SourceFetchError', 'fetch_failed', 'fetch', true), ('LowTextYieldError', 'low_text_yield', 'quality_gate', false), ('ValidationError', 'parse_error', 'parse', false), ('KeyError', 'internal', 'unknown', true), ('ConnectorNotConfiguredError', 'ocr_not_configured', 'ocr', false)),
               f AS (SELECT c.*, reason, stage, retryable, CAST(row_number() OVER (PARTITION BY user_id, c.error_class ORDER BY event_id) AS INTEGER) AS attempt FROM c JOIN r ON r.error_class = c.error_class)"""


def _failures(events: DataFrame) -> DataFrame:
    kinds = {"error": "SourceFetchError", "view": "LowTextYieldError", "click": "ValidationError", "signup": "KeyError"}
    name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("event_type")), F.lit("ConnectorNotConfiguredError"))
    return events.select("event_id", "user_id", F.col("event_id").alias("seq"), name.alias("error_class"), F.concat(F.lit("at "), F.repeat(F.lit("x"), (F.col("event_id") % 3000).cast("int"))).alias("error"))


@query(_REASONS + "SELECT event_id, reason, stage, retryable FROM f")
def jb_classify(spark, sf_dir):
    return _failures(t(spark, sf_dir, "events")).select("event_id", jb.classify(F.col("error_class")).alias("c")).select("event_id", "c.reason", "c.stage", "c.retryable")


@query(_REASONS + "SELECT event_id, attempt, reason, stage, NOT retryable OR attempt >= 3 AS is_terminal, CAST(least(2000, 3 + event_id % 3000) AS INTEGER) AS n_error FROM f")
def jb_terminal(spark, sf_dir):
    failures = _failures(t(spark, sf_dir, "events")).withColumn("job_id", F.struct("user_id", "error_class"))
    return jb.dead_letters(failures).select("event_id", "attempt", "reason", "stage", "is_terminal", F.length("error").alias("n_error"))


@query(_REASONS + "SELECT reason, count(*) AS n FROM f GROUP BY reason")
def jb_by_reason(spark, sf_dir):
    return jb.failures_by_reason(jb.dead_letters(_failures(t(spark, sf_dir, "events")).withColumn("job_id", F.struct("user_id", "error_class"))))


def _jobs(events: DataFrame) -> DataFrame:
    """A user's events are the transitions of one job, sign-ups its retries."""
    status = F.when(F.col("event_type").isin("click", "view"), "running").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").otherwise(jb.REQUEUE)
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"), F.when(status == "running", F.col("ts").cast("timestamp")).alias("heartbeat_at"), F.when(status == "running", F.col("value")).alias("progress"))


_JOBS_SQL = """WITH j AS (SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'running' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'succeeded' ELSE 'requeue' END AS status, ts, value FROM events),
               r AS (SELECT *, coalesce(max(CASE WHEN status = 'requeue' THEN seq END) OVER (PARTITION BY job_id), -1) AS requeued FROM j),
               s AS (SELECT job_id, coalesce(arg_min(status, seq) FILTER (status IN ('failed', 'succeeded') AND seq > requeued), CASE WHEN max(seq) = any_value(requeued) THEN 'pending' ELSE arg_max(status, seq) END) AS status,
                            max(CASE WHEN status = 'running' THEN seq END) AS beat, count(*) FILTER (status = 'running' AND seq > requeued) AS attempts, max(seq) AS last_seq FROM r GROUP BY job_id),
               f AS (SELECT s.job_id, s.status, j.value AS progress, j.ts AS heartbeat_at, s.attempts, s.last_seq FROM s LEFT JOIN j ON j.job_id = s.job_id AND j.seq = s.beat)"""


@query(_JOBS_SQL + "SELECT job_id, status, round(progress, 6) + 0.0 AS progress, attempts, last_seq FROM f")
def jb_fold(spark, sf_dir):
    return jb.fold_jobs(_jobs(t(spark, sf_dir, "events")), ["heartbeat_at", "progress"]).select("job_id", "status", rounded("progress"), "attempts", "last_seq")


@query(_JOBS_SQL + f"SELECT job_id, CASE WHEN attempts >= 3 THEN 'fail' ELSE 'requeue' END AS action FROM f WHERE status = 'running' AND (heartbeat_at IS NULL OR heartbeat_at < TIMESTAMP '{AS_OF}' + INTERVAL 10 DAY) ORDER BY heartbeat_at, job_id LIMIT 50")
def jb_stale(spark, sf_dir):
    jobs = jb.fold_jobs(_jobs(t(spark, sf_dir, "events")), ["heartbeat_at"]).withColumn("created_at", F.col("heartbeat_at")).withColumn("id", F.col("job_id"))
    return jb.sweep(jobs, F.to_timestamp(F.lit(AS_OF)) + F.expr("INTERVAL 10 DAYS 5 MINUTES")).select("job_id", "action")


@query("""SELECT event_id, CASE WHEN user_id % 5 = 4 THEN 'conflict: job is gone' WHEN event_id % 7 = 0 THEN 'not found' WHEN user_id % 5 = 3 THEN 'conflict: job has not failed' WHEN user_id % 5 = 2 THEN 'conflict: nothing to read again' ELSE 'requeue' END AS decision FROM events""")
def jb_retry(spark, sf_dir):
    failures = t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), F.when(F.col("event_id") % 7 == 0, "other").otherwise("me").alias("user_id"))
    k = F.col("id") % 5
    jobs = t(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct().filter("id % 5 <> 4").select("id", F.lit("me").alias("user_id"), F.when(k == 3, "succeeded").otherwise("failed").alias("status"), F.when(k == 0, F.lit("x")).cast("binary").alias("payload"), F.when(k == 1, "https://h/x").otherwise("upload://me/x").alias("source"))
    return jb.retry_decisions(failures, jobs).select("event_id", "decision")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'fetch_failed' WHEN 1 THEN 'ocr_not_configured' ELSE 'parse_error' END AS reason FROM events""")
def jb_ocr_errors(spark, sf_dir):
    error = F.element_at(F.array(*map(F.lit, ("ServiceUnavailable", "PermissionDenied", "InvalidArgument"))), (F.col("event_id") % 3 + 1).cast("int"))
    return t(spark, sf_dir, "events").select("event_id", jb.classify(jb.ocr_error_class(error))["reason"].alias("reason"))


@query(_REASONS + """, l AS (SELECT event_id AS job_id, user_id % 3 + 1 AS attempt, error_class = 'ConnectorNotConfiguredError' AS ok, reason, NOT retryable OR user_id % 3 + 1 >= 3 AS is_terminal FROM f)
       SELECT job_id, CAST(attempt AS BIGINT) AS attempt, CASE WHEN ok THEN 'succeeded' WHEN is_terminal THEN 'failed' ELSE 'running' END AS status, CASE WHEN NOT ok THEN reason END AS failure_reason FROM l""")
def jb_worker(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    failures = _failures(e).select(F.col("event_id").alias("job_id"), F.when(F.col("error_class") != "ConnectorNotConfiguredError", F.col("error_class")).alias("error_class"), "error")
    jobs = e.select(F.col("event_id").alias("job_id"), "user_id", F.lit("s").alias("source"), (F.col("user_id") % 3).alias("attempts"))
    return wo.outcomes(jobs, failures, F.to_timestamp(F.lit(AS_OF))).events.select("job_id", "attempt", "status", "failure_reason")


@query("""SELECT c_custkey AS id, c_custkey % 4 < 2 AND c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey, c_custkey % 4) AS created FROM customer""")
def snk_users(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat((F.col("c_custkey") % 4).cast("string"), F.lit("."), F.col("c_nationkey").cast("string")).alias("email"), F.col("c_custkey").alias("created_at"))
    taken = c.filter("id % 4 in (2, 3)").withColumn("id", -F.col("id"))
    return ac.create_users(taken, c).select("id", "created")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'New' ELSE c_name END AS name, c_custkey % 5 = 0 AS updated FROM customer""")
def flt_update_users(spark, sf_dir):
    users = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("old").alias("updated_at"))
    return ac.update_users(users, users.filter("id % 5 = 0").select("id", F.lit("New").alias("name")), ["name"], F.lit("new")).select("id", "name", (F.col("updated_at") == "new").alias("updated"))


# ── answer cache ──


def _cache(events: DataFrame) -> DataFrame:
    made = F.col("ts").cast("timestamp")
    return events.select(F.col("event_id").alias("id"), F.concat(F.lit("k"), "event_id").alias("idempotency_key"), "user_id", F.col("props").alias("response_json"), made.alias("created_at"), ca.expiry(made).alias("expires_at"))


@query(f"SELECT event_id AS id FROM events WHERE ts + INTERVAL 3600 SECOND > TIMESTAMP '{AS_OF}'")
def ca_live(spark, sf_dir):
    return ca.live(_cache(t(spark, sf_dir, "events")), F.to_timestamp(F.lit(AS_OF))).select("id")


@query(f"""SELECT event_id AS id, event_id % 2 = 0 AND ts + INTERVAL 3600 SECOND > TIMESTAMP '{AS_OF}' AS cached FROM events""")
def ca_lookup(spark, sf_dir):
    cache = _cache(t(spark, sf_dir, "events"))
    return ca.lookup(cache.filter("id % 2 = 0"), cache.select("id", "idempotency_key"), F.to_timestamp(F.lit(AS_OF))).select("id", "cached")


@query(f"""WITH k AS (SELECT event_id, user_id, ts, ts + INTERVAL 3600 SECOND > TIMESTAMP '{AS_OF}' AS live, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS m FROM events)
           SELECT o.user_id, CASE WHEN o.live THEN o.event_id ELSE f.event_id + 1000000000 END AS id FROM k o JOIN k f ON f.user_id = o.user_id AND f.n = 1 WHERE o.m = 1""")
def ca_put_first(spark, sf_dir):
    every = _cache(t(spark, sf_dir, "events")).withColumn("idempotency_key", F.col("user_id").cast("string"))
    stored = up.latest(every, [F.col("created_at").desc(), F.col("id")], ["user_id"])
    return ca.put(stored, every.withColumn("id", F.col("id") + 1_000_000_000), F.to_timestamp(F.lit(AS_OF)), [F.col("created_at"), F.col("id")]).select("user_id", "id")


@query("SELECT event_id AS id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 200)")
def ca_invalidate(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return ca.invalidate(_cache(e), e.filter("event_type = 'purchase' and value > 200")).select("id")


# ── agent log ──


def _log(conversations: DataFrame) -> DataFrame:
    """User turns are tool calls of the turn before, and assistant turns that follow are results; every third call is lost."""
    return conversations.select(F.col("conv_id").alias("thread"), "turn", "role", F.col("text").alias("content"))


@query(f"""SELECT DISTINCT conv_id AS thread, 'c' || (turn // 2) AS call_id, '{ag.INTERRUPTED}' AS content FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND r.role = 'assistant' AND r.turn // 2 = c.turn // 2 AND r.turn % 3 <> 0)""")
def ag_dangling(spark, sf_dir):
    log = _log(t(spark, sf_dir, "conversations")).withColumn("call_id", F.concat(F.lit("c"), F.floor(F.col("turn") / 2).cast("string"))).withColumn("name", F.lit("search"))
    return ag.dangling_calls(log.filter("role = 'user'"), log.filter("role = 'assistant' and turn % 3 <> 0")).select("thread", "call_id", "content")


@query("""SELECT conv_id AS thread, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(turn), 0) AS BIGINT) AS output_tokens, CAST(round(coalesce(sum(length(text)), 0) * 0.00015::DOUBLE + coalesce(sum(turn), 0) * 0.0006::DOUBLE, 6) AS DOUBLE) + 0.0::DOUBLE AS cost FROM conversations WHERE role = 'assistant' AND turn >= 2 GROUP BY conv_id""")
def ag_usage(spark, sf_dir):
    log = _log(t(spark, sf_dir, "conversations")).withColumn("input_tokens", F.length("content").cast("long")).withColumn("output_tokens", F.col("turn"))
    return ag.usage(log, F.lit(2), 0.00015, 0.0006).withColumn("cost", F.col("cost") + 0.0)


@query("""WITH r AS (SELECT conv_id AS thread, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS spent FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY turn) AS n FROM r WHERE spent > 500)
          SELECT thread, turn, CAST(spent AS BIGINT) AS spent FROM f WHERE n = 1""")
def ag_budget(spark, sf_dir):
    return ag.budget_stop(_log(t(spark, sf_dir, "conversations")).withColumn("cost", F.length("content").cast("long")), 500)


@query("""SELECT conv_id AS thread, coalesce(arg_max(text, turn) FILTER (role = 'assistant' AND text <> ''), '') AS answer FROM conversations GROUP BY conv_id""")
def ag_answer(spark, sf_dir):
    return ag.final_answer(_log(t(spark, sf_dir, "conversations")))


@query(f"""SELECT conv_id AS thread, turn, CASE WHEN role <> 'system' AND turn < max(turn) OVER (PARTITION BY conv_id, role) THEN CASE role WHEN 'user' THEN '{ag.STALE_SNAPSHOT}' ELSE '{ag.STALE_SCREENSHOT}' END ELSE text END AS content FROM conversations""")
def ag_prune(spark, sf_dir):
    kinds = F.when(F.col("role") == "user", "snapshot").when(F.col("role") == "assistant", "screenshot")
    return ag.prune(_log(t(spark, sf_dir, "conversations")).withColumn("kind", kinds)).select("thread", "turn", "content")


@query("""WITH c AS (SELECT conv_id AS thread, turn, CASE WHEN turn % 2 = 0 THEN role || '(' || turn || ')' ELSE role END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
          SELECT thread, list(text ORDER BY turn) AS trace FROM c WHERE n <= 16 GROUP BY thread""")
def ag_trace(spark, sf_dir):
    calls = _log(t(spark, sf_dir, "conversations")).select("thread", "turn", F.lit(0).alias("position"), F.col("role").alias("name"), F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).alias("detail"))
    return ag.tool_trace(calls)


@query("""SELECT conv_id AS thread, count(*) FILTER (role = 'assistant') AS iterations, coalesce(list(role || turn ORDER BY turn) FILTER (role = 'user'), []) AS tools FROM conversations GROUP BY conv_id""")
def ag_tools(spark, sf_dir):
    log = _log(t(spark, sf_dir, "conversations"))
    calls = log.filter("role = 'user'").select("thread", "turn", F.lit(0).alias("position"), F.concat("role", F.col("turn").cast("string")).alias("name"))
    return ag.tools_used(calls, log)


# ── whole paths ──


def hashed_vectors(texts: list[str]) -> list[list[float]]:
    """A stand-in embedder: a unit vector drawn from a hash of the text."""
    import hashlib

    import numpy as np

    out = []
    for s in texts:
        v = np.random.default_rng(int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big")).normal(size=16)
        out.append((v / np.linalg.norm(v)).tolist())
    return out


def _empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    from .. import schemas

    documents = spark.createDataFrame([], schemas.DOCUMENTS + ", metadata_version string")
    return documents, spark.createDataFrame([], schemas.DOCUMENT_CHUNKS)


@query()
def ingest_pages(spark, sf_dir):
    documents, chunks = _empty(spark)
    files = fi.extract_local(fi.read_pages(t(spark, sf_dir, "pages"))).withColumn("user_id", F.regexp_extract("source", "^[a-z]+://([^/]*)", 1))
    done = pi.ingest(files, documents, chunks, hashed_vectors, "hashed-16")
    return done.chunks.select("document_id", "owner_id", "chunk_index", "char_start", "char_end", "section", "token_count", "content")


@query(r"""SELECT doc_id, 0 AS first, CAST(length(trim(text, E' \n\t')) AS INTEGER) AS last, true AS exact FROM documents WHERE trim(text, E' \n\t') <> ''""")
def st_ingest(spark, sf_dir):
    """A stream of the documents' texts into chunks, run to its end twice; the second run finds nothing new. Offsets are exact and cover the text."""
    root = f"{shared_dir(spark)}/tarnloom/stream-{uuid.uuid4().hex}"
    st.enqueue(t(spark, sf_dir, "documents").select("doc_id", "text"), f"{root}/jobs")

    def to_chunks(batch: DataFrame) -> DataFrame:
        body = F.regexp_replace("text", "^[ \\n\\t]+|[ \\n\\t]+$", "")
        one = F.array(F.struct(body.alias("text"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section")))
        made = ch.build_chunks(batch.select(F.col("doc_id").cast("string").alias("document_id"), body.alias("body"), one.alias("segments")))
        exact = F.substring(F.col("body"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("content")
        return made.select("document_id", "chunk_index", "char_start", "char_end", exact.alias("exact"))

    for _ in range(2):
        st.start_ingest(spark, f"{root}/jobs", "doc_id long, text string", to_chunks, f"{root}/chunks", f"{root}/checkpoint").awaitTermination()
    chunks = st.current_chunks(spark, f"{root}/chunks").groupBy("document_id").agg(F.min("char_start").alias("first"), F.max("char_end").alias("last"), F.every("exact").alias("exact"))
    return chunks.select(F.col("document_id").cast("long").alias("doc_id"), "first", "last", "exact")


@query("""SELECT CAST(user_id AS VARCHAR) AS job_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_heartbeat, 'requeue' AS action FROM events GROUP BY user_id HAVING arg_max(event_type, {'a': ts, 'b': CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END}) <> 'purchase'""")
def st_sweeper(spark, sf_dir):
    """Heartbeats of the events as a stream; jobs that were silent for a day are reported."""
    root = f"{shared_dir(spark)}/tarnloom/sweep-{uuid.uuid4().hex}"
    beats = t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("heartbeat_at"), F.when(F.col("event_type") == "purchase", "succeeded").otherwise("running").alias("status"))
    beats.write.parquet(f"{root}/beats")
    late = beats.agg((F.max("heartbeat_at") + F.expr("INTERVAL 30 DAYS")).alias("heartbeat_at")).select(F.lit("clock").alias("job_id"), "heartbeat_at", F.lit("succeeded").alias("status"))
    out = f"{root}/out"

    def run() -> None:
        stream = spark.readStream.schema("job_id string, heartbeat_at timestamp, status string").parquet(f"{root}/beats")
        q = sw.stale_jobs(stream, 86_400).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start(out)
        q.awaitTermination()

    run()
    late.write.mode("append").parquet(f"{root}/beats")
    run()
    late.withColumn("heartbeat_at", F.col("heartbeat_at") + F.expr("INTERVAL 1 DAY")).write.mode("append").parquet(f"{root}/beats")
    run()
    return spark.read.schema(sw.OUTPUT).parquet(out).select("job_id", F.date_format("last_heartbeat", "yyyy-MM-dd HH:mm:ss").alias("last_heartbeat"), "action")
