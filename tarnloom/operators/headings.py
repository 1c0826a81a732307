"""Heading regions of Markdown: one segment per heading, the heading line kept in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.text import strip

SECTION_LENGTH = 255
HEADING = "^#{1,6}[ \\t]+(.+?)[ \\t]*#*[ \\t]*$"
#: Ends of lines as text tools know them, CR LF as one.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"


def heading_of(line: Column) -> Column:
    """The heading's text, null for other lines."""
    return F.when(line.rlike(HEADING), F.substring(strip(F.regexp_extract(line, HEADING, 1)), 1, SECTION_LENGTH))


def heading_segments(text: Column) -> Column:
    """``array<struct<text, page, section>>`` of a Markdown text, as one expression per row: no shuffle.

    Each region's lines are joined by LF and stripped; empty regions are left out. What
    stands before the first heading has no section.
    """

    def regions(lines: Column) -> Column:
        def of_starts(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(lines)))

            def region(begin: Column, end: Column) -> Column:
                body = strip(F.array_join(F.slice(lines, begin + 1, end - begin), "\n"))
                return F.struct(body.alias("text"), F.lit(None).cast("int").alias("page"), heading_of(F.get(lines, begin)).alias("section"))

            return F.zip_with(starts, ends, region)

        marks = F.filter(F.transform(lines, lambda line, i: F.when((i == 0) | line.rlike(HEADING), i)), lambda i: i.isNotNull())
        return let(marks, of_starts)

    return F.filter(let(F.split(text, LINE_END, -1), regions), lambda s: s["text"] != "")


def heading_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same as rows ``id, region, section, text``, by lines and a running sum: for texts too long for one row's arrays."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), LINE_END, -1)).alias("line_no", "line"))
    upto = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("heading", heading_of(F.col("line"))).withColumn("region", F.sum(F.col("heading").isNotNull().cast("int")).over(upto))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    return marked.groupBy("id", "region").agg(F.max("heading").alias("section"), strip(joined).alias("text")).filter(F.col("text") != "")
