"""Running text from page text: page numbers, running heads, tables of contents and broken layout go.

pages  path, page_no, page_text
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as T

EDGE_LINES = 2
RUNNING_SHARE, RUNNING_LEAST = 0.3, 2


def page_lines(pages: DataFrame) -> DataFrame:
    """(path, page_no, line_no, line, from_end): trimmed lines that aren't empty. A narrow map."""
    lines = F.filter(F.transform(F.split("page_text", "\r?\n"), lambda x: T.trimmed(x)), lambda x: x != "")
    split = pages.select("path", "page_no", lines.alias("lines"))
    return split.select("path", "page_no", F.posexplode("lines").alias("line_no", "line"), F.size("lines").alias("n")).withColumn("from_end", F.col("n") - F.col("line_no")).drop("n")


def running_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, line, n_pages): lines among the first or last EDGE_LINES of RUNNING_SHARE of a text's pages, RUNNING_LEAST at least."""
    many = pages.groupBy("path").agg(F.countDistinct("page_no").alias("pages"))
    edge = lines.where((F.col("line_no") < EDGE_LINES) | (F.col("from_end") <= EDGE_LINES))
    counts = edge.groupBy("path", "line").agg(F.countDistinct("page_no").alias("n_pages"))
    least = F.greatest(F.lit(RUNNING_LEAST), F.ceil(RUNNING_SHARE * F.col("pages")))
    return counts.join(many, "path").where((F.col("pages") >= RUNNING_LEAST) & (F.col("n_pages") >= least)).select("path", "line", "n_pages")


def kept_lines(pages: DataFrame) -> DataFrame:
    """(path, page_no, line_no, line): lines of running text, cleaned."""
    lines = page_lines(pages)
    line = F.col("line")
    good = lines.where(~T.is_page_number(line) & ~T.is_contents_line(line) & ~T.is_collapsed_layout(line))
    good = good.join(running_lines(pages, lines).select("path", "line"), ["path", "line"], "left_anti")
    clean = good.select("path", "page_no", "line_no", T.capped_symbols(line).alias("line"))
    return clean.where(T.trimmed(F.col("line")) != "")


def page_texts(pages: DataFrame) -> DataFrame:
    """(path, page_no, text): each page's running text, a blank after every line. A page is a group, however many a path has."""
    one = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    page = kept_lines(pages).groupBy("path", "page_no").agg(F.array_join(F.transform(one, lambda r: F.concat(r["line"], F.lit(" "))), "").alias("text"))
    rows = pages.select("path", "page_no").distinct().join(page, ["path", "page_no"], "left")
    return rows.select("path", "page_no", F.coalesce("text", F.lit("")).alias("text"))


def running_text(pages: DataFrame) -> DataFrame:
    """(path, content): the texts of a path's pages as one, a line end after every page. For paths that are files, which fit a row;
    what is as large as a table stays as page_texts."""
    whole = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return page_texts(pages).groupBy("path").agg(T.trimmed(F.array_join(F.transform(whole, lambda r: r["text"]), "\n")).alias("content"))
