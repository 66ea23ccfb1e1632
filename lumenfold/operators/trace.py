"""What becomes of pages, stage by stage, as one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.pages import analyze_pages, validate_regions
from lumenfold.scratch import materialize, small_enough

STAGES = ("raw", "analysis", "layout", "validation", "input")


def _row(stage: str, place: Column, item: Column, field: str, value: Column) -> Column:
    return F.struct(F.lit(STAGES.index(stage) + 1).alias("stage"), place.cast("long").alias("place"), item.alias("item"), F.lit(field).alias("field"), value.cast("string").alias("value"))


def trace_pages(pages: DataFrame, regions: DataFrame, wanted: DataFrame, search: str = "") -> DataFrame:
    """(document_id, page_number, stage, place, item, field, value, found) of the pages in
    ``wanted``: 1 the raw text, 2 what the analysis says and whether native text is trusted,
    3 the regions of the layout, 4 each region's status, method and text, 5 the regions that
    the chunker is given, in order. ``found`` is whether a text has ``search``; null for
    flags, or if nothing is sought.

    Both inputs are cut to the wanted pages before anything is judged, and each is read once:
    the stages of a page come from the same rows. Regions have the provider columns that
    ``validate_regions`` reads."""
    keys = ["document_id", "page_number"]
    few = wanted.select(*keys).distinct()
    few = F.broadcast(few) if small_enough(few, 100_000) else few
    own = pages.join(few, keys, "left_semi")
    flags = own.join(analyze_pages(own), keys)
    none, first = F.lit("page"), F.lit(0)
    trusted = ~(F.col("is_broken_font") | F.col("is_scanned"))
    of_page = F.array(
        _row("raw", first, none, "raw_text", F.col("raw_text")),
        *[_row("analysis", first, none, c, F.col(c)) for c in ("is_blank", "is_scanned", "is_broken_font", "has_table_hint")],
        _row("analysis", first, none, "native_trusted", trusted),
    )
    judged = validate_regions(regions.join(few, keys, "left_semi").join(flags.select(*keys, trusted.alias("_trusted")), keys, "left"))
    place, item = F.col("reading_order"), F.col("region_id")
    of_region = F.array_compact(F.array(
        _row("layout", place, item, "region_type", F.col("region_type")),
        _row("layout", place, item, "text_content", F.col("text_content")),
        _row("validation", place, item, "validation_status", F.col("validation_status")),
        _row("validation", place, item, "method", F.coalesce("method", F.lit("none"))),
        _row("validation", place, item, "final_text", F.col("final_text")),
        F.when(F.col("validation_status") != "failed", _row("input", place, item, "preview", F.substring(F.coalesce("final_text", F.lit("")), 1, 60))),
    ))
    rows = flags.select(*keys, F.inline(of_page)).unionByName(judged.select(*keys, F.inline(of_region)))
    texts = F.col("field").isin("raw_text", "text_content", "final_text", "preview")
    found = F.when(texts & F.lit(search != ""), F.contains(F.coalesce("value", F.lit("")), F.lit(search)))
    return materialize(rows.withColumn("found", found))
