"""Page, region and layout operators over line, span and region tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import GLYPH, clean_text, collapse_whitespace, let, meaningful_ratio, strip, text_acceptable
from lumenfold.scratch import materialize


def header_footer_lines(lines: DataFrame, share: float = 0.6, zone: int = 3) -> DataFrame:
    """(document_id, line_text) of lines on at least max(2, floor(share * pages)) pages,
    within the first or last ``zone`` non-blank lines; once a page."""
    own = lines.withColumn("line_text", strip(F.col("line"))).where("line_text <> ''")
    page = Window.partitionBy("document_id", "page_number")
    placed = own.withColumn("up", F.row_number().over(page.orderBy("line_no"))).withColumn("down", F.row_number().over(page.orderBy(F.desc("line_no"))))
    seen = placed.where((F.col("up") <= zone) | (F.col("down") <= zone)).select("document_id", "page_number", "line_text").distinct()
    return _recurring(seen, lines, share)


def _recurring(seen: DataFrame, pages: DataFrame, share: float) -> DataFrame:
    """Lines on enough pages, from one row for each line of a page's edges."""
    pages = pages.groupBy("document_id").agg(F.countDistinct("page_number").alias("n_pages"))
    counted = seen.groupBy("document_id", "line_text").agg(F.count(F.lit(1)).alias("n_seen")).join(pages, "document_id")
    return counted.where(F.col("n_seen") >= F.greatest(F.lit(2), F.floor(F.col("n_pages") * share))).select("document_id", "line_text", "n_seen")


def strip_known_lines(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Lines without those of the set, wherever they stand."""
    own = lines.withColumn("line_text", strip(F.col("line")))
    return own.join(known.select("document_id", "line_text"), ["document_id", "line_text"], "left_anti").drop("line_text")


def clean_document(lines: DataFrame, share: float = 0.6, zone: int = 3) -> DataFrame:
    """(document_id, page_number, text): cleaned pages without running headers and footers, as
    ``header_footer_lines`` and ``strip_known_lines`` find them. Pages are cleaned once and
    written; a page stays one row, as its edges and its document's few known lines are arrays."""
    keys = ["document_id", "page_number"]
    page = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: x["line"]), "\n")
    split = F.split("text", "\n", -1)
    edges = lambda x: F.array_distinct(F.concat(F.slice(x, 1, zone), F.slice(x, F.greatest(F.size(x) - zone, F.lit(0)) + 1, F.lit(zone))))
    cleaned = clean_text(page.select(*keys, text.alias("joined")), F.col("joined")).select(*keys, F.col("cleaned.text").alias("text"))
    cleaned = materialize(cleaned.withColumn("edges", let(F.filter(F.transform(split, strip), lambda x: x != ""), edges)))
    # a page has two zones of lines at most and a known line many pages, so a document's are few
    known = _recurring(cleaned.select(*keys, F.explode("edges").alias("line_text")), cleaned, share).groupBy("document_id").agg(F.collect_set("line_text").alias("known"))
    left = F.when(F.col("known").isNull(), split).otherwise(F.filter(split, lambda x: ~F.array_contains("known", strip(x))))
    joined = cleaned.join(known, "document_id", "left").select(*keys, left.alias("left")).where(F.size("left") > 0)
    return joined.select(*keys, collapse_whitespace(F.array_join("left", "\n")).alias("text"))


def analyze_pages(pages: DataFrame) -> DataFrame:
    """Blank, scanned, broken-font and table-hint flags from text length, image share, span
    and rectangle counts."""
    chars = F.length(strip(F.coalesce(F.col("raw_text"), F.lit(""))))
    share = F.least(F.lit(1.0), F.col("image_area_ratio"))
    suspects = F.when(F.col("n_spans") > 0, F.col("n_suspect_spans") / F.col("n_spans")).otherwise(F.lit(0.0))
    return pages.select(
        "document_id", "page_number", chars.alias("n_chars"),
        ((chars <= 3) & (F.col("n_images") == 0)).alias("is_blank"), ((chars <= 40) & (share >= 0.5)).alias("is_scanned"),
        ((F.col("n_spans") >= 3) & (suspects >= 0.05)).alias("is_broken_font"), (F.col("line_rect_count") >= 4).alias("has_table_hint"),
    )


def column_count(xs: Column, width: Column) -> Column:
    """2 if the widest gap between sorted left edges is at least 8 % of the width with a
    quarter of at least 8 edges on both sides; else 1."""
    s = F.array_sort(xs)
    n = F.size(s)
    gaps = F.zip_with(F.slice(s, 2, F.greatest(n - 1, F.lit(0))), F.slice(s, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    widest = F.array_max(gaps)
    left = F.array_position(gaps, widest)
    two = (n >= 8) & (widest >= 0.08 * width) & (left >= 0.25 * n) & ((n - left) >= 0.25 * n)
    return F.when(F.coalesce(two, F.lit(False)), 2).otherwise(1)


def route_pages(analysis: DataFrame, layout: DataFrame, threshold: float = 0.6, grounded: bool = True) -> DataFrame:
    """use_native, use_ocr and use_vision for each page that either table has."""
    keys = ["document_id", "page_number"]
    both = analysis.select(*keys, (~(F.col("is_broken_font") | F.col("is_scanned"))).alias("trusted")).join(layout.select(*keys, "infographic_score"), keys, "full_outer")
    native = F.coalesce("trusted", F.lit(True))
    vision = F.coalesce(F.col("infographic_score") >= threshold, F.lit(False))
    return both.select(*keys, native.alias("use_native"), (~native | (vision & F.lit(grounded))).alias("use_ocr"), vision.alias("use_vision"))


def page_coverage(documents: DataFrame, analysis: DataFrame, regions: DataFrame) -> DataFrame:
    """Pages that aren't blank but have no region."""
    keys = ["document_id", "page_number"]
    every = documents.select("document_id", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page_number"))
    blank = analysis.where("is_blank").select(*keys)
    return every.join(blank, keys, "left_anti").join(regions.select(*keys).distinct(), keys, "left_anti")


def page_outcome(regions: DataFrame) -> DataFrame:
    """incomplete with any failed region, recovered with any fallback, else ok."""
    flags = regions.groupBy("document_id", "page_number").agg(
        F.bool_or(F.col("validation_status") == "failed").alias("failed"), F.bool_or(F.coalesce(F.col("method") != "native", F.lit(False))).alias("fallback")
    )
    return flags.select("document_id", "page_number", F.when(F.col("failed"), "incomplete").when(F.col("fallback"), "recovered").otherwise("ok").alias("outcome"))


def native_text_fallback(pages: DataFrame, regions: DataFrame, replace_below: float = 0.05, append_below: float = 0.30) -> DataFrame:
    """Regions with text restored from the raw page: one block in place of all non-table
    regions under ``replace_below`` of the raw characters, one more under ``append_below``."""
    keys = ["document_id", "page_number"]
    body = regions.where("region_type <> 'table'").groupBy(*keys).agg(F.sum(F.length(F.coalesce("text_content", F.lit("")))).alias("got"))
    last = regions.groupBy(*keys).agg(F.max("reading_order").alias("last_order"))
    state = pages.select(*keys, "raw_text").join(body, keys, "left").join(last, keys, "left")
    share = F.coalesce("got", F.lit(0)) / F.length("raw_text")
    state = state.where(F.length(strip(F.col("raw_text"))) > 0).withColumn("action", F.when(share < replace_below, "replace").when(share < append_below, "append")).where("action is not null")
    swapped = state.where("action = 'replace'").select(*keys, F.lit(True).alias("swap"))
    stay = regions.join(swapped, keys, "left").where("swap is null or region_type = 'table'").drop("swap")
    order = F.when(F.col("action") == "replace", F.lit(0)).otherwise(F.coalesce(F.col("last_order") + 1, F.lit(0)))
    block = state.select(*keys, F.concat_ws("-", F.lit("fallback"), *keys).alias("region_id"), F.lit("text").alias("region_type"), order.cast("int").alias("reading_order"), F.col("raw_text").alias("text_content"))
    return stay.unionByName(block, allowMissingColumns=True)


def table_fallback(regions: DataFrame, extracted: DataFrame) -> DataFrame:
    """Injected tables of two by two cells or more for pages without a table region; ragged
    rows are padded with empty cells."""
    keys = ["document_id", "page_number"]
    width = F.array_max(F.transform("rows", F.size))
    padded = F.transform("rows", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)).cast("int"))))
    usable = extracted.where((F.size("rows") >= 2) & (width >= 2)).withColumn("rows", padded)
    return usable.join(regions.where("region_type = 'table'").select(*keys).distinct(), keys, "left_anti")


def validate_regions(regions: DataFrame, native: float = 0.6, fallback: float = 0.3) -> DataFrame:
    """Status and method of text regions: native text that passes, else the OCR text, ok at
    confidence ``native`` and low_confidence at ``fallback``, else the vision text, else
    failed. Provider columns (ocr_text, ocr_confidence, vision_text) may be null."""
    has = lambda c: F.coalesce(text_acceptable(F.col(c)), F.lit(False))
    ocr_ok = has("ocr_text") & (F.col("ocr_confidence") >= native)
    ocr_low = has("ocr_text") & (F.col("ocr_confidence") >= fallback)
    method = F.when(has("text_content"), "native").when(ocr_ok | ocr_low, "ocr").when(has("vision_text"), "vision")
    status = F.when(has("text_content") | ocr_ok, "ok").when(ocr_low | has("vision_text"), "low_confidence").otherwise("failed")
    text = F.when(method == "native", F.col("text_content")).when(method == "ocr", F.col("ocr_text")).when(method == "vision", F.col("vision_text"))
    tried = F.array_compact(F.array(F.lit("native"), F.when(~has("text_content"), F.lit("ocr")), F.when(~(has("text_content") | ocr_ok | ocr_low), F.lit("vision"))))
    judged = regions.withColumn("method", method).withColumn("validation_status", status).withColumn("attempted", tried).withColumn("_chosen", text)
    return clean_text(judged, F.col("_chosen"), "_cleaned").withColumn("final_text", F.col("_cleaned.text")).drop("_chosen", "_cleaned")


def validate_figures(figures: DataFrame) -> DataFrame:
    """decorative is ok without text, described is ok, text alone is low_confidence."""
    described = F.coalesce(strip(F.col("description")) != "", F.lit(False))
    texted = F.coalesce(strip(F.col("ocr_text")) != "", F.lit(False))
    status = F.when(F.col("is_decorative") | described, "ok").when(texted, "low_confidence").otherwise("failed")
    text = F.when(F.col("is_decorative"), F.lit(None).cast("string")).when(described, F.col("description")).when(texted, F.col("ocr_text"))
    return figures.withColumn("validation_status", status).withColumn("final_text", text)


def text_image(chars: Column, confidence: Column) -> Column:
    return (chars >= 15) & (confidence >= 0.75)


def region_stats(regions: DataFrame, short: int = 40) -> DataFrame:
    """Per page: regions by type, mean text length and share of short texts."""
    keys = ["document_id", "page_number"]
    kinds = regions.groupBy(*keys, "region_type").agg(F.count(F.lit(1)).alias("n"))
    counts = kinds.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("region_type", "n")))).alias("type_counts"))
    length = F.when(F.length("text_content") > 0, F.length("text_content"))
    means = regions.groupBy(*keys).agg(F.coalesce(F.avg(length), F.lit(0.0)).alias("mean_length"), F.coalesce(F.avg((length <= short).cast("double")), F.lit(0.0)).alias("fragmentation"))
    return counts.join(means, keys)


def _clustered(regions: DataFrame, edge: str, tolerance: float) -> DataFrame:
    keys = ["document_id", "page_number"]
    line = Window.partitionBy(*keys).orderBy(edge, "region_id")
    gap = F.col(edge) - F.lag(edge).over(line)
    numbered = regions.withColumn(f"{edge}_cluster", F.sum(F.coalesce((gap > tolerance).cast("int"), F.lit(0))).over(line))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, f"{edge}_cluster"))
    return numbered.withColumn(f"{edge}_size", size)


def infographic_score(fragmentation: Column, alignment: Column, fragment_weight: float = 0.5, align_weight: float = 0.5) -> Column:
    """Weighted mean of both scores; nought without weights."""
    total = fragment_weight + align_weight
    return (fragmentation * fragment_weight + alignment * align_weight) / total if total > 0 else F.lit(0.0)


def layout_scores(regions: DataFrame, tolerance: float = 3.0, fragment_weight: float = 0.5, align_weight: float = 0.5) -> DataFrame:
    """Fragmentation, grid alignment and their weighted mean for each page. Regions have
    ``left_edge`` and ``top_edge``."""
    keys = ["document_id", "page_number"]
    both = _clustered(_clustered(regions, "left_edge", tolerance), "top_edge", tolerance)
    in_column, in_row = F.col("left_edge_size") >= 2, F.col("top_edge_size") >= 2
    grid = both.groupBy(*keys).agg(
        F.countDistinct(F.when(in_column, F.col("left_edge_cluster"))).alias("n_columns"), F.countDistinct(F.when(in_row, F.col("top_edge_cluster"))).alias("n_rows"), F.avg((in_column & in_row).cast("double")).alias("share")
    )
    score = F.when((F.col("n_columns") >= 2) & (F.col("n_rows") >= 2), F.col("share")).otherwise(F.lit(0.0))
    joined = grid.select(*keys, score.alias("alignment")).join(region_stats(regions).select(*keys, "fragmentation"), keys)
    return joined.withColumn("infographic_score", infographic_score(F.col("fragmentation"), F.col("alignment"), fragment_weight, align_weight))


def near_hashes(images: DataFrame, distance: int, by: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """(document_id, hash_a, hash_b): ordered pairs of different hashes of one document within a
    Hamming distance; with ``by`` empty, (hash_a, hash_b) of any documents. Two 64-bit hashes
    that differ in at most d bits agree in one of d + 1 bands, so distinct hashes are
    equi-joined by document and band, and pairs then checked."""
    bands = distance + 1
    width = 64 // bands
    parts = [F.struct(F.lit(b).alias("band"), F.shiftrightunsigned("phash", b * width).bitwiseAND((1 << (width if b < bands - 1 else 64 - b * width)) - 1).alias("bits")) for b in range(bands)]
    cut = images.where("phash is not null").select(*by, "phash").distinct().select(*by, "phash", F.inline(F.array(*parts)))
    keys = [*by, "band", "bits"]
    a, b = (cut.select(*keys, F.col("phash").alias(name)) for name in ("hash_a", "hash_b"))
    near = a.join(b, keys).where((F.col("hash_a") != F.col("hash_b")) & (F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b"))) <= distance))
    return near.select(*by, "hash_a", "hash_b").distinct()


def _around(per_hash: DataFrame, images: DataFrame, distance: int, by: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Rows of (document_id, phash, ...) for each hash: its own, and those of hashes near to it."""
    near = near_hashes(images, distance, by)
    found = near.join(per_hash.withColumnRenamed("phash", "hash_b"), [*by, "hash_b"]).drop("hash_b").withColumnRenamed("hash_a", "phash")
    return per_hash.where("phash is not null").unionByName(found)


def linked_images(images: DataFrame, distance: int = 4) -> DataFrame:
    """(document_id, image_id, phash, class_id, n_links, first_linked) of each image over all
    documents: the least image of its hash, which names its class, how many others are within a
    Hamming distance in any document, and the least id of those and itself. Classes are
    compared, as in ``similar_images``; without a hash an image is a class of its own."""
    classes = images.where("phash is not null").groupBy("phash").agg(F.count(F.lit(1)).alias("n"), F.min("image_id").alias("first"))
    reach = _around(classes, images, distance, ()).groupBy("phash").agg((F.sum("n") - 1).alias("n_links"), F.min("first").alias("first_linked"))
    named = reach.join(classes.select("phash", F.col("first").alias("class_id")), "phash")
    own = images.select("document_id", "image_id", "phash").join(named, "phash", "left")
    alone = [F.coalesce(c, "image_id").alias(c) for c in ("class_id", "first_linked")]
    return own.select("document_id", "image_id", "phash", alone[0], F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), alone[1])


def similar_images(images: DataFrame, distance: int = 4) -> DataFrame:
    """(document_id, image_id, phash, n_similar, first_similar) of each image: how many others of
    its document are within a Hamming distance, and the least id of those and itself.

    Images of one hash are a class; classes are compared, and images are its members, so there
    is a row for each image and none for a pair. An image has one hash; without one it is like
    no other."""
    classes = images.groupBy("document_id", "phash").agg(F.count(F.lit(1)).alias("n"), F.min("image_id").alias("first"))
    reach = _around(classes, images, distance).groupBy("document_id", "phash").agg((F.sum("n") - 1).alias("n_similar"), F.min("first").alias("first_similar"))
    own = images.select("document_id", "image_id", "phash").join(reach, ["document_id", "phash"], "left")
    return own.select("document_id", "image_id", "phash", F.coalesce("n_similar", F.lit(0).cast("long")).alias("n_similar"), F.coalesce("first_similar", "image_id").alias("first_similar"))


def decorative_images(images: DataFrame, distance: int = 4, pages: int = 3) -> DataFrame:
    """(document_id, image_id, n_pages, is_decorative): images that recur, within a distance, on
    at least ``pages`` pages of their document, their own included. Distinct pages are counted
    by hash, so no pair of images is made; other documents' images count for nothing."""
    keys = ["document_id", "phash"]
    on = images.select(*keys, F.col("page_number").alias("page")).distinct()
    counts = _around(on, images, distance).groupBy(*keys).agg(F.countDistinct("page").alias("n_pages"))
    # an image without a hash is near to none: it has its own page alone
    own = images.select("image_id", *keys, "page_number").join(counts, keys, "left")
    n = F.coalesce("n_pages", F.when(F.col("page_number").isNotNull(), 1).otherwise(0).cast("long"))
    seen = own.groupBy("document_id", "image_id").agg(F.max(n).alias("n_pages"))
    return seen.withColumn("is_decorative", F.col("n_pages") >= pages)


def garbage_ratio(text: Column) -> Column:
    return F.when(text.rlike(GLYPH), F.lit(1.0)).otherwise(1.0 - meaningful_ratio(text))


def synthetic_summaries(regions: DataFrame, pages: list[int]) -> DataFrame:
    """Regions and one figure, sorted first, for each listed page that a document has."""
    keys = ["document_id", "page_number"]
    some = regions.select(*keys).distinct().where(F.col("page_number").isin(pages) if pages else F.lit(False))
    extra = some.select(*keys, F.concat_ws("-", F.lit("summary"), *keys).alias("region_id"), F.lit("figure").alias("region_type"), F.lit(-1).alias("reading_order"))
    return regions.unionByName(extra, allowMissingColumns=True)


def sort_regions(regions: DataFrame) -> DataFrame:
    return regions.orderBy("document_id", "page_number", "reading_order", "region_id")


def table_grid(cells: DataFrame) -> DataFrame:
    """(table_id, rows): spanned cells repeated into a dense grid; gaps are empty. Cells have
    row, col, row_span, col_span and text; the first cell that covers a place wins."""
    rows = F.sequence(F.col("row"), F.col("row") + F.greatest(F.col("row_span"), F.lit(1)) - 1)
    each = cells.select("table_id", F.explode(rows).alias("r"), "col", "col_span", "row", "text")
    each = each.select("table_id", "r", F.explode(F.sequence(F.col("col"), F.col("col") + F.greatest(F.col("col_span"), F.lit(1)) - 1)).alias("c"), "row", "col", "text")
    placed = each.groupBy("table_id", "r", "c").agg(F.min_by("text", F.struct("row", "col")).alias("text"))
    grid = placed.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("r", "c").alias("k"), F.col("text").alias("v")))).alias("at"), F.max("r").alias("n_r"), F.max("c").alias("n_c"))
    cell = lambda r, c: F.coalesce(F.try_element_at("at", F.struct(r.alias("r"), c.alias("c"))), F.lit(""))
    wide = F.transform(F.sequence(F.lit(0), F.col("n_r")), lambda r: F.transform(F.sequence(F.lit(0), F.col("n_c")), lambda c: cell(r, c)))
    return grid.select("table_id", wide.alias("rows"))


def crop_box(left: Column, top: Column, right: Column, bottom: Column, height: Column, bottom_left: Column) -> Column:
    """struct(x0, y0, x1, y1) from the top left, or null for a box without area."""
    y0, y1 = F.when(bottom_left, height - top).otherwise(top), F.when(bottom_left, height - bottom).otherwise(bottom)
    low, high = F.least(y0, y1), F.greatest(y0, y1)
    return F.when((right > left) & (high > low), F.struct(left.alias("x0"), low.alias("y0"), right.alias("x1"), high.alias("y1")))


def validate_tables(tables: DataFrame, least: float = 0.4) -> DataFrame:
    """ok for a structured table of clean cells, low_confidence for OCR or vision text, else
    failed."""
    from lumenfold.functions.text import table_garbage

    clean = F.coalesce((F.size("rows") > 0) & ~table_garbage(F.col("rows"), least), F.lit(False))
    read = F.coalesce(text_acceptable(F.col("ocr_text"), least) | text_acceptable(F.col("vision_text"), least), F.lit(False))
    return tables.withColumn("validation_status", F.when(clean, "ok").when(read, "low_confidence").otherwise("failed"))


def figure_images(figures: DataFrame, crops: DataFrame, stored: DataFrame) -> DataFrame:
    """Each figure's high-resolution crop, else its stored one, else failed."""
    joined = figures.join(crops.select("region_id", F.col("path").alias("crop")), "region_id", "left").join(stored.select("region_id", F.col("path").alias("old")), "region_id", "left")
    return joined.withColumn("image_path", F.coalesce("crop", "old")).withColumn("image_status", F.when(F.col("crop").isNotNull(), "crop").when(F.col("old").isNotNull(), "stored").otherwise("failed")).drop("crop", "old")
