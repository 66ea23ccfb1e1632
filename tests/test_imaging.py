"""Image hashes and edges against plain pixel loops."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lumenfold.operators import imaging as I


def plain_shrink(grey, height, width):
    def one(line, out):
        if len(line) == out:
            return list(line)
        scale = len(line) / out
        wide, made = max(scale, 1.0), []
        for k in range(out):
            centre, ws = (k + 0.5) * scale, {}
            for j in range(max(0, int(centre - 3 * wide + 0.5)), min(len(line), int(centre + 3 * wide + 0.5))):
                x = (j - centre + 0.5) / wide
                s = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
                ws[j] = s(x) * s(x / 3) if abs(x) < 3 else 0.0
            total = sum(ws.values())
            fixed = {j: int(w / total * (1 << 22) + (0.5 if w / total >= 0 else -0.5)) for j, w in ws.items()}
            made.append(min(255, max(0, (sum(int(line[j]) * w for j, w in fixed.items()) + (1 << 21)) >> 22)))
        return made

    rows = [one(r, width) for r in grey]
    return np.array([one(c, height) for c in zip(*rows, strict=True)]).T


def plain_edges(grey, low, high):
    h, w = grey.shape
    at = lambda y, x: int(grey[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)])
    d, size = {}, {}
    for y in range(h):
        for x in range(w):
            dx = sum(k * (at(y + i, x + 1) - at(y + i, x - 1)) for i, k in ((-1, 1), (0, 2), (1, 1)))
            dy = sum(k * (at(y + 1, x + i) - at(y - 1, x + i)) for i, k in ((-1, 1), (0, 2), (1, 1)))
            d[y, x], size[y, x] = (dx, dy), abs(dx) + abs(dy)
    m = lambda y, x: size.get((y, x), 0)
    thin = set()
    for (y, x), (dx, dy) in d.items():
        if m(y, x) <= low:
            continue
        ax, ay = abs(dx), abs(dy) << 15
        if ay < ax * 13573:
            ok = m(y, x) > m(y, x - 1) and m(y, x) >= m(y, x + 1)
        elif ay > ax * 13573 + (ax << 16):
            ok = m(y, x) > m(y - 1, x) and m(y, x) >= m(y + 1, x)
        else:
            s = -1 if (dx < 0) != (dy < 0) else 1
            ok = m(y, x) > m(y - 1, x - s) and m(y, x) > m(y + 1, x + s)
        if ok:
            thin.add((y, x))
    found = {p for p in thin if size[p] > high}
    todo = list(found)
    while todo:
        y, x = todo.pop()
        for p in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if p in thin and p not in found:
                found.add(p)
                todo.append(p)
    out = np.zeros((h, w), dtype=bool)
    for p in found:
        out[p] = True
    return out


def shapes():
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:40, :56]
    disc = ((y - 18) ** 2 + (x - 25) ** 2 < 150) * 180 + 20
    bars = ((x // 5) % 2 * 120 + (y > 20) * 90).astype(int)
    return [a.astype(np.uint8) for a in (disc, bars, x * 4, rng.integers(0, 256, (40, 56)), np.full((3, 3), 9), rng.integers(0, 256, (8, 8)), rng.integers(0, 256, (5, 100)), np.full((1, 1), 7))]


@pytest.mark.parametrize("k", range(8))
def test_edges_and_resize(k):
    grey = shapes()[k]
    assert (I.edge_map(grey) == plain_edges(grey, 100, 200)).all()
    assert (I.shrink(grey, 8, 8) == plain_shrink(grey, 8, 8)).all()


def test_a_disc_has_a_closed_thin_edge():
    edges = I.edge_map(shapes()[0])
    assert 60 < edges.sum() < 110 and not edges[18, 25] and not I.edge_map(np.full((20, 20), 99, np.uint8)).any()


def test_hash_ignores_size_and_tint():
    big = np.kron(shapes()[0], np.ones((3, 3), dtype=np.uint8))
    colour = np.stack([big] * 3, axis=2)
    assert bin((I.average_hash(shapes()[0]) ^ I.average_hash(colour)) & (1 << 64) - 1).count("1") <= 2
    assert I.average_hash(np.arange(64, dtype=np.uint8).reshape(8, 8)) == (1 << 32) - 1
    assert I.luma(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]], dtype=np.uint8), 16).tolist() == [[76, 150, 29, 255]]


def test_files(spark):
    grey = shapes()[0]
    good = b"P5\n# a comment\n56 40\n255\n" + grey.tobytes()
    colour = b"P6 2 1 255\n" + bytes(6)
    rows = [(1, good), (2, b"P5 9 9 255\n12"), (3, b"nothing"), (4, None), (5, colour), (6, b"P5 0 0 255\n")]
    found = {r["id"]: r for r in I.image_features(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert (found[1]["phash"], found[1]["width"], found[1]["height"], found[1]["image_error"]) == (I.average_hash(grey), 56, 40, None)
    assert found[1]["edge_density"] == pytest.approx(plain_edges(grey, 100, 200).mean()) and found[5]["edge_density"] == 0
    assert all(found[k]["image_error"] and found[k]["phash"] is None for k in (2, 3, 4, 6))
    assert I.image_features(spark.createDataFrame(rows, "id int, content binary").limit(0)).count() == 0


def test_a_reader_that_fails_on_batches(spark):
    def ocr(contents):
        if len(contents) > 1:
            raise TimeoutError("away")
        if contents[0] == b"bad":
            raise ValueError("unreadable")
        return [[(contents[0].decode(), 0.5), ("line", 1.0)] if contents[0] else []]

    rows = spark.createDataFrame([(1, b"a"), (2, b"bad"), (3, b"")], "id int, content binary").coalesce(1)
    got = {r["id"]: (r["ocr_text"], r["ocr_confidence"], r["ocr_error"]) for r in I.read_images(rows, ocr).collect()}
    assert got == {1: ("a\nline", 0.75, None), 2: ("", 0.0, "ValueError: unreadable"), 3: ("", 0.0, None)}
