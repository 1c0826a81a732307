"""Text normalisation, hashes, keys and renderings, as column expressions.

All of them stay inside the JVM, but for NFKC, which Spark lacks.
"""

from __future__ import annotations

import base64
import functools
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NORMALIZER_VERSION = "nfkc-ws-1"
TITLE_LENGTH = 255
ERROR_LENGTH = 2000
CONTENT_LENGTH = 5000
PREVIEW_LENGTH = 200
CHARS_PER_TOKEN = 4

# Format characters that Java 17's Unicode tables do not know yet.
_NEWER_FORMAT_CHARACTERS = "\\x{0890}\\x{0891}\\x{13439}-\\x{1343F}"
INVISIBLE = f"[\\p{{Cc}}\\p{{Cf}}{_NEWER_FORMAT_CHARACTERS}&&[^\\n\\t]]"


def nfkc_text(s: str | None) -> str | None:
    """NFKC of one text; ASCII and already normal texts are passed through."""
    return s if s is None or s.isascii() or unicodedata.is_normalized("NFKC", s) else unicodedata.normalize("NFKC", s)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC, one Arrow batch at a time."""
    return text.map(nfkc_text)


def strip(c: Column) -> Column:
    """Without Unicode white space at either end (``trim`` knows the ASCII space only)."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def normalize_layout(c: Column) -> Column:
    """The steps after NFKC: line ends, invisible characters, white space, blank lines, ends."""
    c = F.regexp_replace(c, "\\r\\n?", "\n")
    c = F.regexp_replace(c, INVISIBLE, "")
    c = F.regexp_replace(c, "(?U)[^\\S\\n]+", " ")
    c = F.regexp_replace(c, "(?U)[^\\S\\n]*\\n[^\\S\\n]*", "\n")
    c = F.regexp_replace(c, "\\n{3,}", "\n\n")
    return strip(c)


def normalize_text(c: Column) -> Column:
    """NFKC, then :func:`normalize_layout`. Null stays null."""
    return normalize_layout(nfkc(c))


def normalize_segments(segments: Column) -> Column:
    """Normalise the text of ``array<struct<text, page, section>>`` whose texts are in NFKC; empty ones go, sections stay as they are."""
    done = F.transform(segments, lambda s: s.withField("text", normalize_layout(s["text"])))
    return F.filter(done, lambda s: s["text"] != "")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def query_key(user: Column, question: Column, filters: Column, top_k: Column, normalizer: Column, chunker: Column, model: Column) -> Column:
    """SHA-256 of the parts joined by ``|``; null if any part is null (``concat_ws`` would skip it)."""
    parts = [user, question, filters, top_k.cast("string"), normalizer, chunker, model]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("|"), p)
    return F.sha2(joined, 256)


def basename(path: Column) -> Column:
    """Last segment of a path, trailing slashes aside."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def stem(name: Column) -> Column:
    """File name without its last extension; a leading or trailing dot is part of the name."""
    return F.regexp_replace(name, "(?s)^(.+)\\.[^.]+$", "$1")


def extension(name: Column) -> Column:
    """Last extension with its dot, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(name, "(?s)^.+(\\.[^.]+)$", 1))


def fallback_title(filename: Column, source: Column) -> Column:
    """Stem of the file name, else of the source's last segment, else ``document``; cut to the column's length."""
    named = F.nullif(stem(basename(filename)), F.lit(""))
    sourced = F.nullif(stem(basename(source)), F.lit(""))
    return F.substring(F.coalesce(named, sourced, F.lit("document")), 1, TITLE_LENGTH)


def truncate_content(c: Column) -> Column:
    """First 5000 characters with a note of the whole length, where it is longer."""
    note = F.concat(F.substring(c, 1, CONTENT_LENGTH), F.lit("\n\n[...truncated, "), F.length(c).cast("string"), F.lit(" total chars]"))
    return F.when(F.length(c) > CONTENT_LENGTH, note).otherwise(c)


def preview(c: Column) -> Column:
    return F.when(F.length(c) > PREVIEW_LENGTH, F.concat(F.substring(c, 1, PREVIEW_LENGTH), F.lit("..."))).otherwise(c)


def count_tokens(c: Column) -> Column:
    """Offline estimate: a quarter of the characters, rounded down."""
    return F.floor(F.length(c) / CHARS_PER_TOKEN)


def token_counter(vocabulary: str, pattern: str):
    """Arrow UDF from text to its number of tokens, by a vocabulary file of lines ``base64 rank`` and the pattern that cuts words.

    Needs ``tiktoken``. The file must be where the executors run; it is read once a worker.
    """

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        encoding = _encoding(vocabulary, pattern)
        return pa.array([None if t is None else len(encoding.encode_ordinary(t)) for t in texts.to_pylist()], pa.int64())

    return count


@functools.cache
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("tarnloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def mask_password(url: Column) -> Column:
    """``scheme://user:***@host`` for logs."""
    return F.regexp_replace(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^:/@]*):[^@/]*@", "$1:***@")


# Prefixes of model names, and the provider that serves them.
PROVIDER_PREFIXES = [("gpt", "openai"), ("o1", "openai"), ("o3", "openai"), ("claude", "anthropic"), ("bedrock/", "aws_bedrock"), ("gemini", "google")]


def provider(model: Column) -> Column:
    """Provider of a model name by its prefix, else ``unknown``."""
    out = F.lit("unknown")
    for prefix, name in reversed(PROVIDER_PREFIXES):
        out = F.when(model.startswith(prefix), name).otherwise(out)
    return out


def echo(message: Column, times: Column) -> Column:
    return F.array_repeat(message, times.cast("int"))


def context_of(ranked: Column) -> Column:
    """``[Source i: title]`` blocks in rank order from ``array<struct<rank, title, content>>``."""
    blocks = F.transform(F.array_sort(ranked), lambda s, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit(": "), s["title"], F.lit("]\n"), s["content"]))
    return F.array_join(blocks, "\n\n---\n\n")


def document_line(title: Column, doc_id: Column, n_chunks: Column) -> Column:
    return F.concat(F.lit("- "), title, F.lit(" (ID: "), doc_id.cast("string"), F.lit(", "), n_chunks.cast("string"), F.lit(" chunks)"))
