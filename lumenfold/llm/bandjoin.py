"""Numeric band join with bounded nearest pairs and sums (operator 12).

Points (lines with a unit price) and probes (items with a price) are sorted by value and cut
into blocks whose least and greatest values are their zone map. Block pairs meet where the
zones, widened by the band, overlap; a pair is one numpy tile of comparisons. Tiles give each
probe sums and its first ``k`` points, which are then merged.

Points of one value are merged before they are cut: count, sum of weights, and the first 2k
points of which no owner has more than k. Those hold the first k for every probe, whichever
owner it leaves out. A hot value thus has as many rows as there were tasks, and a hot owner
none of its own: what an item has with its own lines is found by an equi-join of counts, and
taken off again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.shared import discard, materialize

#: Distinct values of a block of points, rows of a block of probes.
POINT_BLOCK, PROBE_BLOCK = 256, 512
#: Points that a task holds before it merges them by value.
HELD = 1 << 18
#: Stripes of the value range at most: a fixed number of quantiles is all the driver gets.
STRIPES = 1024
#: Parts of a stripe's probes, so that a hot value is no single task's.
SALT = 4
#: Cents beyond this never pair, which keeps sums of gaps within a long.
MOST_CENTS = 10**15
NONE = np.iinfo(np.int64).min
FAR = np.iinfo(np.int64).max


def _ranks(*sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each row in its run of equal keys."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    starts = np.flatnonzero(new)
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


class Merged:
    """Points by value: sums, and the first points of each."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.values = self.counts = self.weights = np.zeros(0, dtype=np.int64)
        self.firsts = np.zeros((4, 0), dtype=np.int64)  # value, first, second, owner

    def add(self, values: np.ndarray, counts: np.ndarray, weights: np.ndarray, firsts: np.ndarray) -> None:
        values, counts, weights = np.concatenate([self.values, values]), np.concatenate([self.counts, counts]), np.concatenate([self.weights, weights])
        order = np.argsort(values, kind="stable")
        values = values[order]
        at = np.flatnonzero(_ranks(values) == 0)
        self.values = values[at]
        self.counts, self.weights = (np.add.reduceat(x[order], at) if len(at) else x for x in (counts, weights))
        rows = np.concatenate([self.firsts, firsts], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
        by_owner = np.lexsort((rows[3], rows[0]))  # stable: keeps the order within an owner
        rank = np.empty(rows.shape[1], dtype=np.int64)
        rank[by_owner] = _ranks(rows[0][by_owner], rows[3][by_owner])
        rows = rows[:, rank < self.k]
        self.firsts = rows[:, _ranks(rows[0]) < 2 * self.k]

    def take(self, upto: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Remove and return the values below the last ones, or all."""
        n = len(self.values) if upto is None else upto
        cut = self.firsts.shape[1] if n == len(self.values) else int(np.searchsorted(self.firsts[0], self.values[n]))
        out = self.values[:n], self.counts[:n], self.weights[:n], self.firsts[:, :cut]
        self.values, self.counts, self.weights, self.firsts = self.values[n:], self.counts[n:], self.weights[n:], self.firsts[:, cut:]
        return out


_MERGED = "value long, n long, weight long, firsts array<long>, seconds array<long>, owners array<long>"


def _lists(sizes: np.ndarray, rows: np.ndarray) -> list[pa.Array]:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x))) for x in rows]


def _merge_points(k: int):
    """Raw points to one row for each value that a task has met."""

    def rows(state: Merged) -> Iterator[pa.RecordBatch]:
        values, counts, weights, firsts = state.take()
        for at in range(0, len(values), 8192):
            part = slice(at, at + 8192)
            own = values[part]
            a, z = np.searchsorted(firsts[0], own[0]), np.searchsorted(firsts[0], own[-1], "right")
            sizes = np.searchsorted(firsts[0], own, "right") - np.searchsorted(firsts[0], own)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[part]), pa.array(weights[part]), *_lists(sizes, firsts[1:, a:z])], names=["value", "n", "weight", "firsts", "seconds", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, n = Merged(k), [], 0

        def merge() -> None:
            value, first, second, owner, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            state.add(value, np.ones(len(value), dtype=np.int64), weight, np.stack([value, first, second, owner]))
            held.clear()

        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(5)])
            n += batch.num_rows
            if n >= HELD:
                merge()
                n = 0
                if len(state.values) >= HELD:
                    yield from rows(state)
        if held:
            merge()
        yield from rows(state)

    return run


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a list column."""
    column = batch.column(batch.schema.names.index(name))
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


_POINT_BLOCK = "stripe int, least long, most long, u array<long>, n array<long>, weight array<long>, sizes array<long>, firsts array<long>, seconds array<long>, owners array<long>"


def _cut_points(edges: list[int], k: int):
    """Merged points in order of value to blocks, none across a stripe's edge."""
    stripes = np.array(edges, dtype=np.int64)

    def blocks(state: Merged, last: bool) -> Iterator[pa.RecordBatch]:
        # the greatest value may go on in the next batch
        values, counts, weights, firsts = state.take(None if last else max(0, len(state.values) - 1))
        if not len(values):
            return
        own = np.searchsorted(stripes, values, "right")
        place = _ranks(own)
        starts = np.flatnonzero(place % POINT_BLOCK == 0)
        for a, z in zip(starts, np.append(starts[1:], len(values)), strict=True):
            u = values[a:z]
            sizes = np.searchsorted(firsts[0], u, "right") - np.searchsorted(firsts[0], u)
            rows = firsts[:, np.searchsorted(firsts[0], u[0]) : np.searchsorted(firsts[0], u[-1], "right")]
            one = [[int(own[a])], [int(u[0])], [int(u[-1])], [u], [counts[a:z]], [weights[a:z]], [sizes], [rows[1]], [rows[2]], [rows[3]]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 7]
            names = [x.split()[0] for x in _POINT_BLOCK.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Merged(k)
        for batch in batches:
            value, n, weight = (batch.column(i).to_numpy() for i in range(3))
            (firsts, sizes), (seconds, _), (owners, _) = (_flat(batch, x) for x in ("firsts", "seconds", "owners"))
            state.add(value, n, weight, np.stack([np.repeat(value, sizes), firsts, seconds, owners]))
            # whole blocks alone, as long as there are many values
            if len(state.values) > 64 * POINT_BLOCK:
                yield from blocks(state, False)
        yield from blocks(state, True)

    return run


def band_edges(value, within: int, per_mille: int):
    """Least and greatest u that pair with a value: |u - value| at most ``within``, or 1000
    times it at most ``per_mille`` times the greater of both. For integers and numpy arrays."""
    low = value - np.maximum(within, per_mille * value // 1000)
    high = value + np.maximum(within, per_mille * value // (1000 - per_mille))
    return low, high


_PROBE_BLOCK = "low long, high long, stripes array<int>, probe array<long>, value array<long>"


def _cut_probes(edges: list[int], within: int, per_mille: int):
    """Sorted probes to blocks with the zone that their bands reach, and its stripes."""
    stripes = np.array(edges, dtype=np.int64)

    def block(probe: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        low, high = band_edges(value[[0, -1]], within, per_mille)
        reach = np.searchsorted(stripes, [low.min(), high.max()], "right")
        one = [[int(low.min())], [int(high.max())], [np.arange(reach[0], reach[1] + 1)], [probe], [value]]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, kinds, strict=True)], names=["low", "high", "stripes", "probe", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = values = np.zeros(0, dtype=np.int64)
        for batch in batches:
            probes, values = np.concatenate([probes, batch.column(0).to_numpy()]), np.concatenate([values, batch.column(1).to_numpy()])
            while len(probes) >= PROBE_BLOCK:
                yield block(probes[:PROBE_BLOCK], values[:PROBE_BLOCK])
                probes, values = probes[PROBE_BLOCK:], values[PROBE_BLOCK:]
        if len(probes):
            yield block(probes, values)

    return run


_TOP = "gap", "u", "first", "second", "owner"
_TILE = f"probe long, value long, n long, gap_sum long, weight long, top array<struct<{', '.join(f'{x}: long' for x in _TOP)}>>"


def tile(probe: np.ndarray, value: np.ndarray, u: np.ndarray, counts: np.ndarray, weights: np.ndarray, firsts: np.ndarray, k: int, within: int, per_mille: int):
    """Compare a block of probes with one of points, whose ``firsts`` has rows first, second,
    owner and present of (points, 2k). Returns n, gap_sum and weight of each probe over all
    points, and the five columns (probes, k) of its first points of another owner."""
    first, second, owner, present = firsts
    gap = np.abs(u[None, :] - value[:, None])
    near = (gap <= within) | (1000 * gap <= per_mille * np.maximum(u[None, :], value[:, None]))
    whole = near.astype(np.int64)
    n, weight, gap_sum = whole @ counts, whole @ weights, (whole * gap) @ counts
    # a point value all of whose points are one owner's has nothing for that owner
    sole = np.where(present, owner == owner[:, :1], True).all(axis=1)
    usable = near & ~(sole[None, :] & (owner[:, 0][None, :] == probe[:, None]))
    key = np.where(usable, 2 * gap + (u[None, :] > value[:, None]), FAR)
    some = np.argpartition(key, k - 1, axis=1)[:, :k] if len(u) > k else np.broadcast_to(np.arange(len(u)), key.shape)
    held = np.take_along_axis(usable, some, 1)[:, :, None] & present[some].astype(bool) & (owner[some] != probe[:, None, None])
    columns = [np.broadcast_to(x[:, :, None], held.shape) for x in (np.take_along_axis(gap, some, 1), u[some])]
    columns = [x.reshape(len(probe), -1) for x in (*columns, first[some], second[some], owner[some])]
    columns[0] = np.where(held.reshape(len(probe), -1), columns[0], FAR)
    order = np.lexsort(columns[::-1], axis=1)[:, :k]
    return n, gap_sum, weight, [np.take_along_axis(x, order, 1) for x in columns]


def _tiles(k: int, within: int, per_mille: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                get = lambda name, row=row: _flat(row, name)[0]
                probe, value, u, sizes = get("probe"), get("value"), get("u"), get("sizes")
                place = np.arange(2 * k)[None, :] < sizes[:, None]
                firsts = []
                for name in ("firsts", "seconds", "owners"):
                    wide = np.zeros(place.shape, dtype=np.int64)
                    wide[place] = get(name)
                    firsts.append(wide)
                n, gap_sum, weight, top = tile(probe, value, u, get("n"), get("weight"), np.stack([*firsts, place.astype(np.int64)]), k, within, per_mille)
                some = np.flatnonzero(n)
                held = top[0][some] < FAR
                offsets = pa.array(np.concatenate([[0], np.cumsum(held.sum(axis=1))]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x[some][held]) for x in top], names=list(_TOP)))
                yield pa.RecordBatch.from_arrays([*[pa.array(x[some]) for x in (probe, value, n, gap_sum, weight)], lists], names=["probe", "value", "n", "gap_sum", "weight", "top"])

    return run


def band_join(probes: DataFrame, points: DataFrame, k: int, within: int, per_mille: int) -> DataFrame:
    """Join ``probes`` (probe, value) to the ``points`` (value, first, second, owner, weight) of
    other owners whose value is within the band; all are longs.

    Returns probe, value, rank, gap, u, first, second, owner of the first k pairs of each probe
    by gap, u, first, second and owner, and n_pairs, gap_sum and weight_sum over all its pairs.
    Probes without pairs have one row of rank 0, nulls and zeros. Nulls: a probe without a value
    or number never pairs, nor does a point with any null. Equal (probe, value) rows count once;
    equal points each count and take a rank. ``per_mille`` is below 1000.
    """
    if not 0 <= per_mille < 1000 or within < 0 or k < 1:
        raise ValueError("per_mille must be in 0..999, within not negative, k positive")
    probes = probes.select("probe", "value").distinct()
    points = points.select("value", "first", "second", "owner", "weight").dropna()
    found = materialize(points.mapInArrow(_merge_points(k), _MERGED))
    marks = F.percentile_approx("value", [x / STRIPES for x in range(1, STRIPES)], 10 * STRIPES)
    about = found.agg(F.approx_count_distinct("value").alias("n"), marks.alias("marks")).first()
    stripes = max(1, min(STRIPES, about["n"] // POINT_BLOCK))
    edges = sorted(set((about["marks"] or [])[STRIPES // stripes - 1 :: STRIPES // stripes]))
    blocks = found.repartitionByRange("value").sortWithinPartitions("value").mapInArrow(_cut_points(edges, k), _POINT_BLOCK)
    able = probes.dropna()
    dealt = able.repartitionByRange("value", "probe").sortWithinPartitions("value", "probe")
    zones = dealt.mapInArrow(_cut_probes(edges, within, per_mille), _PROBE_BLOCK).withColumn("salt", F.pmod(F.xxhash64(F.col("probe")[0], F.col("value")[0]), F.lit(SALT)))
    zones = zones.select("low", "high", "probe", "value", "salt", F.explode("stripes").alias("stripe"))
    copies = blocks.withColumn("salt", F.explode(F.array(*[F.lit(x).cast("long") for x in range(SALT)])))
    pairs = zones.join(copies, ["stripe", "salt"]).where("low <= most and high >= least")
    tiles = materialize(pairs.drop("stripe", "salt", "low", "high", "least", "most").mapInArrow(_tiles(k, within, per_mille), _TILE))
    # an item with its own lines: taken off the sums
    own = points.groupBy(F.col("owner").alias("probe"), F.col("value").alias("u")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    gap = F.abs(F.col("u") - F.col("value"))
    near = (gap <= within) | (1000 * gap <= per_mille * F.greatest("u", "value"))
    own = own.join(able, "probe").where(near).select("probe", "value", (-F.col("n")).alias("n"), (-F.col("n") * gap).alias("gap_sum"), (-F.col("weight")).alias("weight"))
    none = probes.select("probe", "value", *[F.lit(0).cast("long").alias(x) for x in ("n", "gap_sum", "weight")])
    sums = none.unionByName(tiles.drop("top")).unionByName(own).groupBy("probe", "value").agg(F.sum("n").alias("n_pairs"), F.sum("gap_sum").alias("gap_sum"), F.sum("weight").alias("weight_sum"))
    order = Window.partitionBy("probe", "value").orderBy(*_TOP)
    top = tiles.select("probe", "value", F.inline("top")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = materialize(sums.join(top, ["probe", "value"], "left").withColumn("rank", F.coalesce("rank", F.lit(0))))
    discard(found, tiles)
    return out


def to_cents(amount: Column) -> Column:
    """floor(100 * amount + 0.5) in doubles, as a long; null where that isn't finite or its size
    is over MOST_CENTS."""
    cents = F.floor(F.lit(100.0) * amount.cast("double") + 0.5)
    size = F.abs(F.lit(100.0) * amount.cast("double"))
    return F.when(~F.isnan(size) & (size < float(MOST_CENTS)), cents)


def unit_cents(amount_cents: Column, quantity: Column) -> Column:
    """floor((2 * amount + quantity) / (2 * quantity)) in exact integers; null for no quantity."""
    sign = F.when(quantity < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    above, below = sign * (2 * amount_cents + quantity.cast("long")), sign * 2 * quantity.cast("long")
    exact = above - F.pmod(above, below)
    return F.when(quantity != 0, F.call_function("div", exact, below))


def near_price_lines(sale_lines: DataFrame, items: DataFrame, k: int = 2, within: int = 100, per_mille: int = 1) -> DataFrame:
    """Each item with the lines of other items whose unit price is near its own.

    Reads item_id and price of ``items`` and sale_id, line_no, item_id, quantity and amount of
    ``sale_lines``; further columns, whatever their names, are ignored. Lines null in sale_id,
    item_id, quantity or amount and items null in item_id or price never pair, nor do lines of
    quantity 0 and amounts or prices that aren't finite or exceed 10^13 in size. A null line_no
    sorts first and is an empty text in lines_crc. Repeated lines each count and take a rank;
    repeated rows of an item (same price) are one item. Empty tables give no rows, or rank 0.
    """
    probes = items.select(F.col("item_id").cast("long").alias("probe"), to_cents(F.col("price")).alias("value"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    points = sale_lines.select(
        unit_cents(to_cents(F.col("amount")), F.col("quantity")).alias("value"),
        F.col("sale_id").cast("long").alias("first"),
        F.coalesce(F.col("line_no").cast("long"), F.lit(int(NONE))).alias("second"),
        F.col("item_id").cast("long").alias("owner"),
        F.crc32(F.concat_ws(",", number("sale_id"), number("line_no"), number("item_id"))).alias("weight"),
    )
    found = band_join(probes, points, k, within, per_mille)
    return found.select(
        F.col("probe").alias("item_id"), "rank", "gap", "u", F.col("first").alias("sale_id"),
        F.when(F.col("second") != int(NONE), F.col("second")).alias("line_no"), F.col("owner").alias("line_item_id"),
        "n_pairs", "gap_sum", F.col("weight_sum").alias("lines_crc"),
    )
