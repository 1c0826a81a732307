import collections
import datetime
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnloom.functions import metadata as md
from tarnloom.functions import mime, uri
from tarnloom.functions import text as tx
from tarnloom.operators import language as la
from tarnloom.operators.retrieval import normalised_question


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("ﬁle", "file"), ("ＡＢＣ", "ABC"), ("①", "1"), ("a b", "a b"), ("a​b­c", "abc"), ("a\r\nb\rc", "a\nb\nc"),
        ("a \t  b", "a b"), ("a  \n  b", "a\nb"), ("a\n\n\n\nb", "a\n\nb"), ("  a  ", "a"), ("a\x0cb\x0bc", "abc"), ("", ""), (None, None),
        ("a࢐b\U00013439c", "abc"), ("tab\tkept as space", "tab kept as space"),
    ],
)
def test_normalize_cases(spark, raw, expected):
    assert one(spark, tx.normalize_text(F.col("x").cast("string")), x=raw) == expected


def test_normalize_matches_plain_python(spark):
    alphabet = "aé1 \t\n\r\x0b\x0c  ​­﻿́ﬁＡ. "
    found = []

    @settings(max_examples=150, database=None, deadline=None)
    @given(st.text(alphabet, max_size=30))
    def gather(s):
        found.append(s)

    gather()
    rows = spark.createDataFrame([(s,) for s in found], "x string").select("x", tx.normalize_text(F.col("x")).alias("y")).collect()
    for x, y in rows:
        assert y == normalised_question(x), repr(x)
        assert not re.search(r"[ \t]\n|\n[ \t]|\n\n\n|  ", y)
        assert all(c in "\n\t" or unicodedata.category(c) not in ("Cc", "Cf") for c in y)


def test_query_key_is_null_when_a_part_is(spark):
    parts = [F.lit(x) for x in ("u", "q", "{}")]
    assert one(spark, tx.query_key(*parts, F.lit(5), F.lit("n"), F.lit("c"), F.lit(None).cast("string"))) is None
    assert len(one(spark, tx.query_key(*parts, F.lit(5), F.lit("n"), F.lit("c"), F.lit("m")))) == 64


@pytest.mark.parametrize(("name", "source", "title"), [("a.tar.gz", "", "a.tar"), (".bashrc", "", ".bashrc"), (None, "https://h/x/y.pdf", "y"), (None, "https://h/", "h"), ("", "", "document"), ("x" * 300 + ".md", "", "x" * 255)])
def test_fallback_title(spark, name, source, title):
    assert one(spark, tx.fallback_title(F.col("n").cast("string"), F.col("s")), n=name, s=source) == title


def test_truncation_and_preview(spark):
    assert one(spark, tx.truncate_content(F.col("x")), x="a" * 5000) == "a" * 5000
    assert one(spark, tx.truncate_content(F.col("x")), x="a" * 5001).endswith("\n\n[...truncated, 5001 total chars]")
    assert one(spark, tx.preview(F.col("x")), x="b" * 201) == "b" * 200 + "..."


def test_masks(spark):
    assert one(spark, tx.mask_password(F.col("x")), x="postgresql://u:p@h/db") == "postgresql://u:***@h/db"
    assert one(spark, tx.mask_password(F.col("x")), x="redis://h:6379") == "redis://h:6379"


@pytest.mark.parametrize(("name", "declared", "expected"), [("a.PDF", "text/plain", mime.PDF), ("a", "Text/Plain; charset=x", "text/plain"), (None, None, None), ("a.bin", "", None), ("x.markdown", None, mime.MARKDOWN)])
def test_mime(spark, name, declared, expected):
    assert one(spark, mime.resolve_mime(F.col("n").cast("string"), F.col("d").cast("string")), n=name, d=declared) == expected


@pytest.mark.parametrize(
    ("raw", "error"),
    [("https://h/a.pdf", None), (" gdrive://x ", None), ("upload://u/n", None), ("", "empty"), (None, "empty"), ("a.pdf", "no_scheme"), ("ftp://h/a", "unknown_scheme"), ("https:///a", "no_authority"), ("https://h", "no_path"), ("https://h/?q", "no_path"), ("https://h/" + "a" * 1100, "too_long")],
)
def test_parse_uri(spark, raw, error):
    assert one(spark, uri.parse_source_uri(F.col("x").cast("string"))["error"], x=raw) == error


def test_upload_uri_is_cut_by_whole_characters(spark):
    made = one(spark, uri.upload_uri(F.lit("u"), F.col("x")), x="ñ" * 400)
    assert len(made) <= 1024 and made.startswith("upload://u/%C3%B1") and len(made.removeprefix("upload://u/")) % 6 == 0
    assert one(spark, uri.upload_uri(F.lit("u"), F.col("x")), x="a/b c?.pdf") == "upload://u/a%2Fb%20c%3F.pdf"
    assert one(spark, uri.upload_uri(F.lit("u"), F.col("x").cast("string")), x=None) == "upload://u/document"


def test_private_addresses():
    assert uri.is_public("8.8.8.8") and not any(map(uri.is_public, ("10.1.1.1", "127.0.0.1", "169.254.169.254", "::1", "224.0.0.1", "0.0.0.0")))


def plain_date(text):
    """The date rules with Python's own expressions, one match after the other."""
    text, months = text[: md.SAMPLE_CHARS], "|".join(sorted(md.MONTHS, key=len, reverse=True))
    forms = [
        r"\b(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})\b", rf"\b(?P<d>\d{{1,2}})\s+de\s+(?P<m>{months})\s+(?:de\s+)?(?P<y>\d{{4}})\b",
        rf"\b(?P<m>{months})\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}})\b", rf"\b(?P<d>\d{{1,2}})\s+(?P<m>{months})\.?,?\s+(?P<y>\d{{4}})\b",
    ]
    found = []
    for k, form in enumerate(forms):
        for m in re.finditer(form, text, re.IGNORECASE):
            year, month = int(m["y"]), md.MONTHS.get(m["m"].lower()) or int(m["m"]) if m["m"].lower() in md.MONTHS or m["m"].isdigit() else 0
            try:
                day = datetime.date(year, month, int(m["d"]))
            except ValueError:
                continue
            if 1900 <= year <= 2100:
                found.append((m.start(), k, day.isoformat()))
                break
    return min(found)[2] if found else None


def test_dates_equal_a_plain_search(spark):
    rng = random.Random(3)
    pieces = ["2024-03-15", "12024-03-15", "2023-02-29", "1899-01-01", "5 de Marzo de 2021", "31 de abril 1999", "Sept. 9, 1999", "MAY 7 2001", "february 30, 2001", "1 March 2024", "3 jun, 2010", "12", "2020", "-", " ", " ", "\n", ", ", "x", "de", "march", "é", "१५", "2100-12-31", "0", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(1500)] + ["", None, "w " * 1998 + "2024-03-15", "y" * 3999 + " 2024-01-01"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", md.document_date(F.col("t")).alias("d")).collect()
    wrong = [(texts[r.k], r.d, plain_date(texts[r.k])) for r in rows if texts[r.k] is not None and r.d != plain_date(texts[r.k])]
    assert not wrong, wrong[:5]
    assert sum(r.d is not None for r in rows) > 250


def test_languages_of_many_texts_equal_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang")
    model = la.train(docs)
    texts = [r.text[:4000] for r in docs.collect()] + [None, "", " ", "é", "ab", "İstanbul Σίσυφος ΟΔΟΣ", "a1b2c3 the and of", "漢字 😀"]
    assert model.detect_all(texts) == [None if t is None else model.detect(t) for t in texts]
    counted = collections.Counter(g for t in texts for g in la.LanguageModel.grams(t or ""))
    assert la.most_frequent(texts) == dict(sorted(counted.items(), key=lambda x: (-x[1], x[0]))[: la.GRAMS_KEPT])
    assert la.LanguageModel({}).detect_all(["abc", None]) == [None, None]
