"""Pages and offsets: joining page texts, and the page of an offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def join_pages(pages: DataFrame, separator: str = "\n\n", preprocess: str | None = "none") -> DataFrame:
    """``document_id, content, page_starts, page_count`` from ``document_id, page_no, text``.

    Pages are cleaned before offsets are taken. A null text is an empty page.
    """
    clean = T.resolve_preprocessor(preprocess)
    body = F.coalesce(pages["text"], F.lit(""))
    body = clean(body) if clean else body
    width = F.length("body") + len(separator)
    before = Window.partitionBy("document_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = pages.select("document_id", "page_no", body.alias("body")).withColumn("start", F.coalesce(F.sum(width).over(before), F.lit(0)).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("page_no", "start", "body")))  # the pages of one document
    whole = placed.groupBy("document_id").agg(parts.alias("p"))
    return whole.select(
        "document_id",
        F.array_join(F.transform("p", lambda x: x["body"]), separator).alias("content"),
        F.transform("p", lambda x: x["start"]).alias("page_starts"),
        F.size("p").alias("page_count"),
    )


def page_of(page_starts: Column, offset: Column) -> Column:
    """The page, from 1, that holds ``offset``; null without a page map."""
    hits = F.size(F.filter(page_starts, lambda s: s <= offset))
    return F.when(F.size(page_starts) > 0, hits)
