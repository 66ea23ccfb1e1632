"""The band join, centroid clustering and neighbour graphs against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from lumenfold.llm import bandjoin as B
from lumenfold.llm import centroids as C
from lumenfold.llm import hnsw as H

# ---- band join


def plain_band(items, lines, k, within, per_mille):
    cents = lambda x: None if x is None or not math.isfinite(x) or abs(100 * x) >= B.MOST_CENTS else math.floor(100 * x + 0.5)
    out = []
    for item, p in {(i, cents(x)) for i, x in items}:
        found = []
        for sale, no, own, quantity, amount in lines:
            if None in (sale, own, quantity, amount, item, p) or not quantity or cents(amount) is None or own == item:
                continue
            u = (2 * cents(amount) + quantity) // (2 * quantity)
            gap = abs(u - p)
            if gap <= within or 1000 * gap <= per_mille * max(u, p):
                text = f"{sale},{'' if no is None else no},{own}"
                found.append((gap, u, sale, -(1 << 63) if no is None else no, own, zlib.crc32(text.encode())))
        found.sort()
        sums = (len(found), sum(x[0] for x in found), sum(x[5] for x in found))
        for rank, x in enumerate(found[:k], 1):
            out.append((item, rank, x[0], x[1], x[2], None if x[3] == -(1 << 63) else x[3], x[4], *sums))
        if not found:
            out.append((item, 0, *[None] * 5, *sums))
    return sorted(out, key=str)


ITEM, LINE = "item_id long, price double, name string, sale_id long, value int, probe string", "sale_id long, line_no int, item_id long, quantity int, amount double, price double, value int, u string"


def shop(seed: int):
    rng = random.Random(seed)
    items = [(k, rng.choice([3.0, 3.0, rng.randint(1, 900) / 100, rng.randint(1, 900_000) / 100])) for k in range(120)]
    items += [(5, items[5][1]), (200, None), (None, 3.0), (201, float("nan")), (202, float("inf")), (203, -2.0), (204, 1e15), (205, 0.0), (206, 5e6)]
    lines = []
    for _ in range(900):
        item = 0 if rng.random() < 0.33 else rng.randrange(120)  # a hot item
        quantity = rng.choice([1, 2, 3, 50])
        price = 3.0 if rng.random() < 0.3 else items[item][1]  # a hot price
        lines.append((rng.randrange(60), rng.randint(1, 3), item, quantity, round(price * quantity * rng.choice([1, 1, 0.999, 1.001, 1.01]), 2)))
    lines += lines[:60] + [(None, 1, 1, 1, 3.0), (1, None, 1, 1, 3.0), (1, 1, None, 1, 3.0), (1, 1, 1, None, 3.0), (1, 1, 1, 1, None), (1, 1, 1, 0, 3.0)]
    lines += [(1, 1, 1, -2, 3.0), (1, 1, 1, -2, -6.0), (1, 1, 1, 1, -2.0), (1, 1, 1, 1, float("inf")), (1, 1, 1, 3, float("nan")), (1, 1, 1, 1, 1e300), (7, 2, 9, 1, 5_000_000.0), (7, 2, 9, 1, 5_004_000.0)]
    return items, lines


def frames(spark, items, lines):
    return (
        spark.createDataFrame([(*x, "n", 9, 1, "p") for x in items], ITEM).repartition(3),
        spark.createDataFrame([(*x, 1.0, 2, "u") for x in lines], LINE).repartition(4),
    )


@pytest.mark.parametrize(("k", "within", "per_mille", "blocks"), [(2, 100, 1, (256, 512)), (1, 0, 0, (4, 8)), (5, 30, 200, (4, 8))])
def test_band_join(spark, monkeypatch, k, within, per_mille, blocks):
    # small blocks and stripes, few points held: many tiles for each probe
    items, lines = shop(k)
    monkeypatch.setattr(B, "POINT_BLOCK", blocks[0])
    monkeypatch.setattr(B, "PROBE_BLOCK", blocks[1])
    i, p = frames(spark, items, lines)
    got = B.near_price_lines(p, i, k, within, per_mille)
    assert got.columns == ["item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_band(items, lines, k, within, per_mille)


def test_band_join_of_empty_tables(spark):
    items, lines = shop(1)
    i, p = frames(spark, items, lines)
    assert B.near_price_lines(p, i.limit(0)).count() == 0
    rows = B.near_price_lines(p.limit(0), i).collect()
    assert len(rows) == len({(x, str(y)) for x, y in items}) and all(r["rank"] == 0 and r["n_pairs"] == r["gap_sum"] == r["lines_crc"] == 0 and r["gap"] is None for r in rows)


def test_first_points_hold_for_every_owner():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3):
        rows = rng.integers(0, 4, (4, 200)).astype(np.int64)
        state = B.Merged(k)
        for part in np.array_split(rows, 5, axis=1):
            state.add(part[0], np.ones(part.shape[1], dtype=np.int64), part[1], part)
        for value in range(4):
            every = sorted(tuple(x) for x in rows[1:, rows[0] == value].T.tolist())
            kept = [tuple(x) for x in state.firsts[1:, state.firsts[0] == value].T.tolist()]
            assert len(kept) <= 2 * k
            for owner in range(5):
                assert [x for x in kept if x[2] != owner][:k] == [x for x in every if x[2] != owner][:k]
        assert state.counts.sum() == 200


def test_edges_hold_the_band():
    for within, per_mille in ((100, 1), (0, 0), (3, 250)):
        for p in (-500, -3, 0, 1, 7, 999, 1000, 1001, 123_456, 400_000):
            low, high = B.band_edges(p, within, per_mille)
            near = lambda u, p=p: abs(u - p) <= within or 1000 * abs(u - p) <= per_mille * max(u, p)
            assert near(low) and near(high) and not near(low - 1) and not near(high + 1)


# ---- centroids


def plain_clusters(rows, k, rounds, width, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(x) < C.MOST / scale for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in set(own):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    final = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, c in final:
        inertia[c] = inertia.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in final), key=str)


def vectors(seed: int, n: int, width: int, grid: bool):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        v = [rng.choice([-1.0, 0.0, 1.0]) if grid else rng.gauss(k % 5, 0.4) for _ in range(width)]
        rows.append((k, [1.0] * width if grid and k % 3 == 0 else v))
    odd = [None, [], [1.0] * (width + 1), [None] + [1.0] * (width - 1), [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [0.0] * width, [-0.0] * width, [1e9] * width]
    rows += [(n + k, v) for k, v in enumerate(odd)] + [(None, [0.25] * width), (3, rows[3][1]), (3, [0.5] * width)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, own int, v string, distance double, id int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "v", 1.0, 7, 0.5) for i, v in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize(("n", "k", "width", "grid"), [(300, 12, 6, False), (200, 9, 4, True), (5, 40, 4, True), (0, 3, 4, True)])
def test_centroid_clustering(spark, n, k, width, grid):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors(n, n, width, grid)] if n else []
    rows = rows[:n] + [r for r in rows[n:] if r[1] is None or len(r[1]) != width or None in r[1] or n]
    got = C.elkan_clusters(frame(spark, rows), k, 5, width)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(rows, k, 5, width)


def test_bounds_skip_distances(spark):
    rows = [r for r in vectors(1, 600, 8, False) if r[0] is not None]
    passes = []
    C.elkan_clusters(frame(spark, rows), 16, 5, 8, passes=passes).count()
    assert len(passes) == 6 and sum(x[1] for x in passes) < 0.6 * sum(x[0] * 16 for x in passes)
    assert passes[-1][1] < 0.4 * passes[-1][0] * 16


# ---- neighbour graphs


def plain_nearest(rows, every, k):
    able = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in able:
        if q % every == 0:
            a = np.array([v], dtype=np.float64)
            found = sorted((-H.cosines(a, np.array([w], dtype=np.float64))[0], i) for i, w in able if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


@pytest.mark.parametrize("shard", [60, 10_000])
def test_nearest_neighbours(spark, shard):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    data = [(k, (centres[k % 6] + 0.6 * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(500)]
    hot = data[50][1]
    data += [(1000 + k, hot) for k in range(250)]  # a third are copies of one
    data += [(2000 + k, v) for k, v in enumerate([None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1e38] * 16, [1e-38] * 16, [1.0, 2.0], [2.0, 1.0]])]
    data += [(None, hot), (50, hot), (50, hot), (3000, [3.0])]
    rows = H.nearest_neighbours(frame(spark, data), every=50, k=5, shard=shard).collect()
    want = plain_nearest(data, 50, 5)
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == {q for q, v in want.items() if v} and 3000 not in got
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in v}) for q, v in got.items())
    assert hits >= 0.95 * sum(len(v) for v in want.values())
    for q, v in got.items():  # exact scores, ties by id
        known = {i: s for i, s in plain_nearest([x for x in data if x[0] in {q, *(i for i, _ in v)}], q, 5).get(q, [])} if q else {}
        assert all(abs(known.get(i, s) - s) < 1e-12 for i, s in v)
        assert v == sorted(v, key=lambda x: (-x[1], x[0]))
    assert [i for i, _ in got[1000]] == [50, 1001, 1002, 1003, 1004]
    assert H.nearest_neighbours(frame(spark, data).limit(0)).count() == 0


def test_graph_layers_and_recall():
    rng = np.random.default_rng(7)
    x = H.unit(rng.normal(size=(1500, 24)))
    levels = np.sort(H.levels_of(rng.integers(-(2**63), 2**63 - 1, 1500)))[::-1]
    graph = H.Graph.build(x, levels)
    assert [len(a) for a in graph.layers] == [int((levels >= k).sum()) for k in range(levels[0] + 1)]
    for links in graph.layers:
        assert links.max() < len(links) and (links != np.arange(len(links))[:, None]).all()
        assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in links)
    q = H.unit(rng.normal(size=(100, 24)))
    nodes, near = graph.search(q)
    best = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(nodes, best, strict=True)]) >= 0.95
    assert (np.diff(near, axis=1) <= 0).all()
