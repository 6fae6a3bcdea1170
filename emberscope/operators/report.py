"""All that is known about an application as documents: one VARIANT, a list of items for each section."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.operators.keyed import balanced_join
from emberscope.runtime import stored

#: Items of a section that a page holds, about; an application whose sections are all smaller has one page.
PAGE_ITEMS = 5000


def report_items(parts: Mapping[str, DataFrame], key: str = "application_id") -> DataFrame:
    """``(key, section, item variant)`` of all sections; a section that is absent or None is left out."""
    rows = None
    for section, frame in parts.items():
        if frame is None:
            continue
        fields = [c for c in frame.columns if c != key]
        part = frame.select(F.col(key).cast("string").alias(key), F.lit(section).alias("section"), F.to_variant_object(F.struct(*fields)).alias("item"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("a report needs a section")
    return rows


def application_documents(parts: Mapping[str, DataFrame], key: str = "application_id", page_items: int = PAGE_ITEMS) -> DataFrame:
    """``(key, page, document variant)``: ``{"<section>": [items]}`` of each application.

    Sections an application has nothing in are missing from its document.  Items are counted first: a section of more than
    ``page_items`` is dealt to pages of about that size, so no document grows with the application; the pages
    of an application, put together section by section, are its report.  Counting, looking for large sections and dealing
    each read the items, so these are stored and the sections computed once.
    """
    items = stored(report_items(parts, key).where(F.col(key).isNotNull()))
    counts = items.groupBy(key, "section").agg(F.ceil(F.count(F.lit(1)) / page_items).cast("long").alias("pages"))
    paged = balanced_join(items, counts, [key, "section"], "inner").withColumn("page", F.pmod(F.monotonically_increasing_id(), F.col("pages")))
    sections = paged.groupBy(key, "page", "section").agg(F.collect_list("item").alias("items"))  # about page_items each
    entry = F.struct("section", "items")
    return sections.groupBy(key, "page").agg(F.to_variant_object(F.map_from_entries(F.collect_list(entry))).alias("document"))
