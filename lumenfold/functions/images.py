"""What is computed from decoded images: hashes, edge shares, OCR results, descriptions.

Decoding, edge detection, OCR and vision are injected; these take their plain outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.text import strip


def edge_density(edges: Column) -> Column:
    """Share of an edge detector's pixels that aren't nought; null without pixels."""
    return F.when(F.size(edges) > 0, F.size(F.filter(edges, lambda x: x != 0)) / F.size(edges))


def deskew_angle(angle: Column, least: float = 0.5, most: float = 45.0) -> Column:
    """The angle to turn by, of a rectangle's in -90..0: small ones aren't worth it, large
    ones aren't to be trusted."""
    turn = F.when(angle < -45, -(90 + angle)).otherwise(-angle)
    return F.when((F.abs(turn) >= least) & (F.abs(turn) <= most), turn).otherwise(F.lit(0.0))


def vision_status(has_key: Column, text: Column, error: Column) -> Column:
    """unavailable without a key, failed on an error or no text, else described."""
    return F.when(~has_key, "unavailable").when(error.isNotNull() | (F.coalesce(strip(text), F.lit("")) == ""), "failed").otherwise("described")
