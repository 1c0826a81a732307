"""Schemas of the state tables, as Spark DDL."""

SEGMENTS = "array<struct<text:string,page:int,section:string>>"
DOCUMENTS = "id string, title string, content string, user_id string, chunk_count int, content_hash string, normalizer_version string, chunker_version string, embedding_model string, source string, metadata map<string,string>, created_at timestamp"
DOCUMENT_CHUNKS = "id string, document_id string, owner_id string, document_title string, chunk_index int, content string, token_count int, embedding array<float>, char_start int, char_end int, page int, section string, metadata map<string,string>, created_at timestamp"
INGESTION_JOBS = f"id string, user_id string, status string, source string, title string, payload binary, filename string, content_type string, extracted struct<method:string,segments:{SEGMENTS}>, total_chunks int, processed_chunks int, normalizer_version string, chunker_version string, document_id string, error string, failure_reason string, attempts int, heartbeat_at timestamp, created_at timestamp, started_at timestamp, finished_at timestamp"
FAILED_INGESTIONS = "id string, job_id string, user_id string, source string, filename string, content_type string, reason string, stage string, error string, attempt int, is_terminal boolean, diagnostics map<string,string>, created_at timestamp"
QUERY_CACHE = "id string, idempotency_key string, user_id string, response_json string, created_at timestamp, expires_at timestamp"
USERS = "id string, name string, email string, hashed_password string, role string, created_at timestamp, updated_at timestamp"
REFRESH_TOKENS = "id string, token string, user_id string, expires_at timestamp, revoked boolean, created_at timestamp"
TABLES = {
    "documents": DOCUMENTS, "document_chunks": DOCUMENT_CHUNKS, "ingestion_jobs": INGESTION_JOBS, "failed_ingestions": FAILED_INGESTIONS,
    "query_cache": QUERY_CACHE, "users": USERS, "refresh_tokens": REFRESH_TOKENS,
}
