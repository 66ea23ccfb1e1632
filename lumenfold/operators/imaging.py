"""Hashes and edges of images, and their text from an injected reader, over batches of files.

Decoding is injected but for plain bitmaps; grey levels, the resize before a hash and the edge
detector are numpy passes over one image at a time. What comes out follows the definitions that
image libraries share: integer luma weights, a windowed-sinc resize in two passes with rounding
between them, and edges by gradient, thinning along it and hysteresis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Decode = Callable[[bytes], np.ndarray]


def decode_bitmap(content: bytes) -> np.ndarray:
    """A binary grey or colour bitmap (P5 or P6, 8 bits) as (height, width) or (.., .., 3)."""
    fields, at = [], 0
    while len(fields) < 4:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at) + 1
            continue
        end = at
        while content[end : end + 1] and not content[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("cut off")
        fields.append(content[at:end])
        at = end
    kind, width, height, most = fields[0], *map(int, fields[1:])
    if kind not in (b"P5", b"P6") or most != 255:
        raise ValueError("not a bitmap of 8 bits")
    shape = (height, width) if kind == b"P5" else (height, width, 3)
    return np.frombuffer(content, np.uint8, int(np.prod(shape)), at + 1).reshape(shape)


def luma(pixels: np.ndarray, bits: int) -> np.ndarray:
    """Grey levels of colours, by weights of so many bits."""
    if pixels.ndim == 2:
        return pixels
    # Weights of red, green and blue of 16 and of 15 bits.
    weights = {16: (19595, 38470, 7471), 15: (9798, 19235, 3735)}[bits]
    return ((pixels[..., :3].astype(np.int64) @ np.array(weights) + (1 << (bits - 1))) >> bits).astype(np.uint8)


#: Sizes up to which weights are kept for the next image, 64 kB each at most.
_KEPT_SIZE = 1024


def _sinc_weights(size: int, out: int, lobes: int = 3, bits: int = 22) -> np.ndarray:
    """(out, size) integer weights of a windowed sinc that is widened when it shrinks."""
    scale = size / out
    wide = max(scale, 1.0)
    weights = np.zeros((out, size), dtype=np.int64)
    for k in range(out):
        centre = (k + 0.5) * scale
        first, last = max(0, int(centre - lobes * wide + 0.5)), min(size, int(centre + lobes * wide + 0.5))
        x = (np.arange(first, last) - centre + 0.5) / wide
        w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
        w /= w.sum()
        weights[k, first:last] = np.trunc(w * (1 << bits) + np.where(w < 0, -0.5, 0.5)).astype(np.int64)
    return weights


_kept_weights = lru_cache(maxsize=256)(_sinc_weights)


def shrink(grey: np.ndarray, height: int, width: int, bits: int = 22) -> np.ndarray:
    """Resize rows, round, then columns; every pixel has its share."""
    out = grey.astype(np.int64)
    for size, axis in ((width, 1), (height, 0)):
        if out.shape[axis] != size:
            weights = _kept_weights if max(out.shape[axis], 8 * size) <= _KEPT_SIZE else _sinc_weights
            w = weights(out.shape[axis], size, bits=bits)
            out = out @ w.T if axis else w @ out
            out = np.clip((out + (1 << (bits - 1))) >> bits, 0, 255)
    return out.astype(np.uint8)


def average_hash(pixels: np.ndarray) -> int:
    """64 bits as a signed long: of eight by eight grey levels those brighter than their mean."""
    small = shrink(luma(pixels, 16), 8, 8).astype(np.float64)
    value = 0
    for bit in (small > small.mean()).ravel():
        value = value << 1 | int(bit)
    return value - (1 << 64) if value >> 63 else value


def edge_map(pixels: np.ndarray, low: int = 100, high: int = 200) -> np.ndarray:
    """True where there is an edge: the gradient (sums of absolute Sobel differences, the border
    repeated) is over ``low``, greatest along its direction in steps of 45 degrees, and joined
    through such pixels to one over ``high``."""
    grey = np.pad(luma(pixels, 15).astype(np.int64), 1, mode="edge")
    smooth_y = grey[:-2] + 2 * grey[1:-1] + grey[2:]
    smooth_x = grey[:, :-2] + 2 * grey[:, 1:-1] + grey[:, 2:]
    dx, dy = smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2]
    size = np.abs(dx) + np.abs(dy)
    around = np.pad(size, 1)
    h, w = size.shape
    at = lambda y, x: around[1 + y : 1 + y + h, 1 + x : 1 + x + w]
    # Fixed value: the tangent of 22.5 degrees in 15 bits; that of 67.5 is two more.
    flat = np.abs(dx) * 13573
    steep = flat + (np.abs(dx) << 16)
    rise = np.abs(dy) << 15
    falls = (dx ^ dy) < 0
    across = (size > at(0, -1)) & (size >= at(0, 1))
    along = (size > at(-1, 0)) & (size >= at(1, 0))
    slant = np.where(falls, (size > at(-1, 1)) & (size > at(1, -1)), (size > at(-1, -1)) & (size > at(1, 1)))
    thin = (size > low) & np.where(rise < flat, across, np.where(rise > steep, along, slant))
    # places in one row, with a border that is no edge; each pixel is stepped from once
    wide = w + 2
    open_ = np.pad(thin, 1).ravel()
    edges = np.pad(thin & (size > high), 1).ravel()
    open_ &= ~edges
    steps = np.array([y * wide + x for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x])
    front = np.flatnonzero(edges)
    while front.size:
        near = (front[:, None] + steps).ravel()
        near = near[open_[near]]
        open_[near] = False
        front = np.unique(near)
        edges[front] = True
    return edges.reshape(h + 2, wide)[1:-1, 1:-1]


def image_features(images: DataFrame, decode: Decode = decode_bitmap) -> DataFrame:
    """Adds phash, edge_density, width, height and image_error to images with ``content``. One
    that can't be decoded, or has no pixel, has the error alone."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields)

    def of(content: bytes | None) -> tuple:
        try:
            pixels = decode(content)
            if not pixels.size:
                raise ValueError("no pixels")
            edges = edge_map(pixels)
            return average_hash(pixels), float(edges.sum()) / edges.size, pixels.shape[1], pixels.shape[0], None
        except Exception as e:  # an unreadable image is a row
            return None, None, None, None, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes, shares, widths, heights, errors = zip(*[of(c) for c in pdf["content"]], strict=True) if len(pdf) else ([],) * 5
            # objects, as a long with nulls would pass through doubles
            whole = {n: pd.Series(list(x), dtype=object, index=pdf.index) for n, x in (("phash", hashes), ("width", widths), ("height", heights))}
            yield pdf.assign(edge_density=list(shares), image_error=list(errors), **whole)

    return images.mapInPandas(run, f"{schema}, phash long, edge_density double, width int, height int, image_error string")


def read_images(images: DataFrame, ocr: Callable[[list[bytes]], list[list[tuple[str, float]]]]) -> DataFrame:
    """Adds ocr_text, ocr_confidence and ocr_error: an injected reader is given a batch of image
    contents and answers with the lines of each, as (text, confidence). Lines are joined by
    line ends, confidences averaged; none gives an empty text and 0. A reader that fails on a
    batch is asked for its images one by one."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields)

    def lines(contents: list[bytes]) -> list[tuple]:
        try:
            found = ocr(contents)
            if len(found) != len(contents):
                raise ValueError(f"{len(found)} answers to {len(contents)} images")
            return [("\n".join(t for t, _ in x), sum(c for _, c in x) / len(x) if x else 0.0, None) for x in found]
        except Exception as e:
            if len(contents) > 1:
                return [lines([c])[0] for c in contents]
            return [("", 0.0, f"{type(e).__name__}: {e}"[:200])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = lines(pdf["content"].tolist()) if len(pdf) else []
            yield pdf.assign(ocr_text=[x[0] for x in found], ocr_confidence=[x[1] for x in found], ocr_error=[x[2] for x in found])

    return images.mapInPandas(run, f"{schema}, ocr_text string, ocr_confidence double, ocr_error string")
