"""Exact dedup by 128-bit content hash, with the bytes of each group compared. DataFrame functions only.

Rows are grouped by the MD5 of the normalised text *and* by that text itself, so the
hash table compares bytes wherever hashes meet and a collision yields two groups. The
aggregate is combined before the shuffle: copies within a task leave it as one row, and a
group that holds a third of the table arrives as one row per task. What then goes back to
the documents is narrow (hash, digest, keeper, count), only for groups of two or more, by
a join that adaptive execution can split where one group is hot.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: ASCII white space, which the normalised text is without.
BLANKS = "[\\x20\\x09-\\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without ASCII white space; null counts as
    empty. Of equal texts the one with the most code points as written stays, then the
    smallest id; ids may be of any type that Spark orders. Rows that repeat the keeper's id
    are all marked as kept. Of texts of one length a null id sorts last; if the row that stays
    has none, keep_id is null, and all the group's rows without an id are marked. Other columns are ignored. ``content_hash`` exists for tests
    of collisions.
    """
    norm = normalised(F.col(text_col))
    doc = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).alias("points"), norm.alias("norm"))
    if isinstance(doc.schema["doc_id"].dataType, IntegralType):
        # most code points first, then the smallest id, as one number: a fixed-width aggregation buffer
        first = (F.col("points").cast("decimal(10,0)") * F.lit(Decimal(10**20)) - F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(Decimal(2**63)))).cast("decimal(32,0)")
        keep_id = F.max_by("doc_id", "first")
    else:
        first = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
        keep_id = F.min_by("doc_id", "first")
    hashed = doc.withColumn("hash", content_hash(F.col("norm"))).withColumn("first", first)
    groups = hashed.groupBy("hash", "norm").agg(F.count("*").alias("group_size"), keep_id.alias("keep_id")).filter("group_size > 1")
    groups = groups.select("hash", F.sha2("norm", 256).alias("text_sha256"), "group_size", "keep_id", F.lit(True).alias("grouped"))
    narrow = hashed.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    joined = narrow.join(groups, ["hash", "text_sha256"], "left")
    keep_id = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )
