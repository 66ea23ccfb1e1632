"""N-gram Jaccard self-join by rare-first prefix filtering (operator 8).

1. One pass counts shingles in a fixed-size sketch over all texts and signs every set.
2. Tokens are ordered rare first by those counts (ties by hash). A set of n tokens shows
   only its prefix of n - ceil(t n) + l tokens, of which linked sets share l; l grows with
   n. Prefix tokens meet in hash buckets. Common tokens are counted by pair where few sets
   show them; where many do, sets hang on one for each token and size band, which gives
   candidate classes in place of pairs. Equal sets are one vertex.
3. Candidate classes, not pairs, get their full sets together. There each set meets the
   earlier ones through the prefix lists under the length, positional and suffix filters,
   skips those already in its class, and checks what remains once.
Classes larger than a unit are cut into blocks, so no task holds an unbounded group. Blocks
are solved with a few pivots of their class; only what then stays outside the class's main
part meets the other blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm import textvec as tv
from lumenfold.llm.components import connected_components
from lumenfold.llm.shared import bucket_count, discard, materialize, spread

U64 = np.uint64
#: Cells of the frequency sketch: its size, and so the broadcast, never grows with the data.
SKETCH_BITS = 20
_PARTS = 64
#: Tokens that so many sets show, at most, are counted by pair of sets.
FEW = 32
_TOKEN_BITS = 56


class Rule:
    """100 * |A and B| >= percent * |A or B|, in integers."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def overlap(self, a, b):
        """Least intersection of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, n):
        return n - -(-self.percent * n // 100) + 1

    def common(self, n):
        """Tokens that linked sets share in prefixes longer by so many less one."""
        return np.maximum(1, self.prefix(n) // 3)

    def compatible(self, small, large):
        return 100 * small >= self.percent * large


def _sets(piece: tv.Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and row offsets."""
    data = tv.LOWER[piece.data]
    words = tv.find_words(data, piece.offsets, tv.NOT_SPACE)
    hashes, row = tv.ngram_hashes(tv.hash_spans(data, words.starts, words.ends), words.counts, n, short=True)
    return tv.distinct_by_row(hashes, row, piece.rows)


def _signatures(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        sums = []
        for salt in (0x1234567, 0x89ABCDE):
            total = np.concatenate([np.zeros(1, U64), np.cumsum(tv.mix(values ^ U64(salt)))])
            sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return sums[0], sums[1]


_FIRST = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("part", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])


def _first_pass(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        seen = 0
        for batch in batches:
            for piece in tv.slices(batch.column(1)):
                values, offsets = _sets(piece, n)
                counts += np.bincount((values >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                s1, s2 = _signatures(values, offsets)
                ids = batch.column(0).slice(piece.first, piece.rows)
                nothing = pa.nulls(piece.rows, pa.int32())
                seen += piece.rows
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(offsets)), pa.array(s1), pa.array(s2), nothing, nothing, pa.nulls(piece.rows, pa.binary())],
                    schema=_FIRST,
                )
        if seen:
            size = len(counts) // _PARTS
            blank = pa.nulls(_PARTS, pa.int64())
            salt = int(counts[::97].sum()) % 61
            yield pa.RecordBatch.from_arrays(
                [blank] * 4
                + [pa.array(np.arange(_PARTS, dtype=np.int32)), pa.array(np.full(_PARTS, salt, np.int32)), pa.array([counts[k * size : (k + 1) * size].astype(np.uint32).tobytes() for k in range(_PARTS)], pa.binary())],
                schema=_FIRST,
            )

    return run


def _add_counts(table: pa.Table) -> pa.Table:
    total = 0
    for x in table.column("counts"):
        total = np.frombuffer(x.as_buffer(), dtype=np.uint32).astype(np.uint64) + total
    total = np.minimum(total, U64(0xFFFFFFFF)).astype(np.uint32)
    return pa.table({"part": table.column("part")[:1].cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _ranks(first: DataFrame) -> np.ndarray:
    """One byte for each cell, ascending with the count; bounded by SKETCH_BITS."""
    some = first.where("part is not null").select("part", "salt", "counts")
    halves = some.groupBy("part", "salt").applyInArrow(_add_counts, "part int, counts binary")
    rows = halves.groupBy("part").applyInArrow(_add_counts, "part int, counts binary").collect()
    if not rows:
        return np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    counts = np.concatenate([np.frombuffer(bytes(r["counts"]), dtype=np.uint32) for r in sorted(rows, key=lambda r: r["part"])])
    return np.minimum(255, np.floor(6 * np.log2(counts.astype(np.float64) + 1))).astype(np.uint8)


def _tokens(values: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Each row's tokens in rare-first order: rank in the high byte, hash below."""
    rank = ranks[(values >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(U64)
    tokens = (rank << U64(_TOKEN_BITS)) | (values & U64((1 << _TOKEN_BITS) - 1))
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    return tokens[tv.order_by_row(tokens, row)]


_RECORD = np.dtype([("token", "<u8"), ("s1", "<i8"), ("s2", "<i8"), ("n", "<i4"), ("shared", "?")])


def _distinct_records(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One record for each (token, set), by token; where tokens begin; sets of each token."""
    records = records[np.lexsort((records["s2"], records["s1"], records["token"]))]
    # the flag of dropped repeats stays with the kept one
    keep, _ = tv.blocks(records["token"], records["s1"], records["s2"])
    flag = np.logical_or.reduceat(records["shared"], keep) if len(keep) else np.zeros(0, bool)
    records = records[keep]
    records["shared"] = flag
    begin, end = tv.blocks(records["token"])
    return records, begin, end - begin


def _prefix_pass(n: int, rule: Rule, buckets: int, shared):
    """Prefix records by token bucket. Where several sets of one flush share a token, they
    are members already: those go to buckets by flush, and one record stands for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.frombuffer(shared.value, dtype=np.uint8)
        known: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            records, begin, count = _distinct_records(np.concatenate(held))
            held, size = [], 0
            several = np.repeat(count > 1, count)
            members = records[several]
            if len(members):
                home = int(members["token"][0] % U64(buckets))
                yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), pa.nulls(1, pa.binary()), pa.array([members.tobytes()], pa.binary())], names=["bucket", "records", "members"])
            records["shared"][begin] |= count > 1
            keep = ~several
            keep[begin] = True
            records = records[keep]
            bucket = (tv.mix(records["token"]) % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            records, bucket = records[order], bucket[order]
            at, stop = tv.blocks(bucket)
            blobs = pa.array([records[a:b].tobytes() for a, b in zip(at, stop, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), blobs, pa.nulls(len(at), pa.binary())], names=["bucket", "records", "members"])

        for batch in batches:
            for piece in tv.slices(batch.column(1)):
                values, offsets = _sets(piece, n)
                s1, s2 = _signatures(values, offsets)
                sizes = np.diff(offsets)
                fresh = np.zeros(piece.rows, dtype=bool)
                for k in np.flatnonzero(sizes):
                    key = (int(s1[k]), int(s2[k]))
                    if key not in known:
                        fresh[k] = True
                        if len(known) < 1 << 20:
                            known.add(key)
                tokens = _tokens(values, offsets, ranks)
                shown = np.where(fresh, np.minimum(sizes, rule.prefix(sizes) + rule.common(sizes) - 1), 0)
                records = np.zeros(int(shown.sum()), dtype=_RECORD)
                records["token"] = tokens[tv.ragged(offsets[:-1], shown)]
                for name, column in (("s1", s1), ("s2", s2), ("n", sizes)):
                    records[name] = np.repeat(column, shown)
                held.append(records)
                size += len(records)
                if size > 1 << 18:
                    yield from flush()
        if size:
            yield from flush()

    return run


def _members(table: pa.Table) -> pa.Table:
    """(token, set) of each token that several sets show."""
    direct = [np.frombuffer(x.as_buffer(), dtype=_RECORD) for x in table.column("members") if x.is_valid]
    found = [np.frombuffer(x.as_buffer(), dtype=_RECORD) for x in table.column("records") if x.is_valid]
    records, _, count = _distinct_records(np.concatenate([*found, np.zeros(0, _RECORD)]))
    records = records[np.repeat(count > 1, count)]
    records = np.concatenate([*direct, records[~records["shared"]]])
    return pa.table({k: np.ascontiguousarray(records[k]).astype(np.int64) for k in ("token", "s1", "s2", "n")})


def _unit_tokens(n: int, shared):
    """(id, text, ...) -> (id, ..., tokens), the tokens in rare-first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            names = [x for x in batch.schema.names if x != "text"]
            for piece in tv.slices(batch.column("text")):
                values, offsets = _sets(piece, n)
                tokens = _tokens(values, offsets, ranks)
                own = [batch.column(x).slice(piece.first, piece.rows) for x in names]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array([tokens[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=[*names, "tokens"]
                )

    return run


def _suffix_bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """Upper bound of the intersection of two sorted arrays by halving at probe tokens."""
    if not len(x) or not len(y):
        return 0
    if depth == 0:
        return min(len(x), len(y))
    probe = len(y) // 2
    at = int(np.searchsorted(x, y[probe]))
    hit = int(at < len(x) and x[at] == y[probe])
    return hit + _suffix_bound(x[:at], y[:probe], depth - 1) + _suffix_bound(x[at + hit :], y[probe + 1 :], depth - 1)


#: Which side of a unit a set stands on; only sets of different sides, or of BOTH, meet.
LEFT, RIGHT, BOTH = 1, 2, 3


def link_forest(sets: list[np.ndarray], rule: Rule, known: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among rare-first sorted token arrays.

    Sets are taken by size. Each meets earlier ones in the prefix lists; those of its own
    class so far are skipped, the one with most common prefix tokens is checked first, and a
    pair is checked once. ``known`` are classes found before, ``side`` the sides.
    """
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order], dtype=np.int64)
    shown = rule.prefix(sizes)
    token = np.concatenate([sets[k][:s] for k, s in zip(order, shown, strict=True)])
    owner = np.repeat(np.arange(len(order)), shown)
    place = tv.ragged(np.zeros(len(order), np.int64), shown)
    by = np.lexsort((owner, token))
    lists, of, at = token[by], owner[by], place[by]
    where = np.empty(len(by), dtype=np.int64)
    where[by] = np.arange(len(by))
    begin, end = tv.blocks(lists)
    start = np.repeat(begin, end - begin)
    own = np.concatenate([[0], np.cumsum(shown)])
    root = np.arange(len(order)) if known is None else np.unique(known[np.array(order)], return_inverse=True)[1]
    side = None if side is None else side[np.array(order)]
    links = []
    for x in range(len(order)):
        n = int(sizes[x])
        mine = where[own[x] : own[x + 1]]
        count = mine - start[mine]
        if not count.any():
            continue
        entry = tv.ragged(start[mine], count)
        y, i = of[entry], np.repeat(np.arange(len(mine)), count)
        need = rule.overlap(n, sizes[y])
        ok = rule.compatible(sizes[y], n) & (root[y] != root[x])
        if side is not None:
            ok &= (side[y] | side[x]) == BOTH
        y, i, j, need = y[ok], i[ok], at[entry][ok], need[ok]
        if not len(y):
            continue
        # positional filter at the first common token: nothing before it is shared
        _, firsts, common = np.unique(y, return_index=True, return_counts=True)
        y, i, j, need = y[firsts], i[firsts], j[firsts], need[firsts]
        ok = 1 + np.minimum(n - i - 1, sizes[y] - j - 1) >= need
        y, need, common = y[ok], need[ok], common[ok]
        a = sets[order[x]]
        rank = np.argsort(-common, kind="stable")
        y, need = y[rank], need[rank]
        while len(y):
            k = int(y[0])
            b = sets[order[k]]
            if _suffix_bound(a, b, 3) >= need[0] and len(np.intersect1d(a, b, assume_unique=True)) >= need[0]:
                links.append((order[x], order[k]))
                root[root == root[k]] = root[x]
                y, need = y[1:], need[1:]
                left = root[y] != root[x]
                y, need = y[left], need[left]
            else:
                y, need = y[1:], need[1:]
    return links


def _verify(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        component = table.column("component").to_numpy()
        known, side = table.column("known").to_numpy(), table.column("side").to_numpy()
        tokens = [np.frombuffer(x.as_buffer(), dtype=U64) for x in table.column("tokens")]
        order = np.lexsort((ids, component))
        u, v = [], []
        for a, b in zip(*tv.blocks(component[order]), strict=True):
            some = order[a:b]
            for x, y in link_forest([tokens[k] for k in some], rule, known[some], side[some]):
                u.append(ids[some[x]])
                v.append(ids[some[y]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


#: Sets of a large class, of each size band, that every block of it meets first.
PIVOTS = 8


def _verified(own: DataFrame, units: DataFrame, ngram: int, shared, rule: Rule) -> DataFrame:
    """(id, component, known, side, unit) -> the links (u, v) that units find."""
    # texts move at every size, so that none is a matter of what is small enough to broadcast
    full = own.join(units.hint("merge"), "id").select("id", "text", "component", "known", "side", "unit")
    tokens = full.mapInArrow(_unit_tokens(ngram, shared), "id long, component long, known long, side int, unit string, tokens binary")
    return tokens.groupBy("unit").applyInArrow(_verify(rule), "u long, v long")


def _links(own: DataFrame, members: DataFrame, ngram: int, shared, rule: Rule, buckets: int, unit_tokens: int) -> list[DataFrame]:
    """Tables of links (u, v) that connect what links among the members (id, n, component) of
    candidate classes.

    Small classes share hashed units. A large one is cut into blocks by size band and hash;
    first each block is a unit of its own, together with a few pivots of the class, which
    ties the parts of one real class to each other. What then isn't in the greatest class
    found meets every block of compatible sizes, skipping pairs already connected. So work
    is linear in a class that is one real class for the most part, however large it is."""
    total = members.groupBy("component").agg(F.sum("n").alias("total"))
    sized = materialize(members.join(total, "component").select("id", "n", "component", "total"))
    hashed = F.concat(F.lit("h"), F.pmod(F.xxhash64("component"), F.lit(buckets)).cast("string"))
    alone = [F.col("id").alias("known"), F.lit(BOTH).alias("side")]
    units = sized.where(F.col("total") <= unit_tokens).select("id", "component", *alone, hashed.alias("unit"))
    large = sized.where(F.col("total") > unit_tokens)
    if not large.limit(1).count():
        links = [materialize(_verified(own, units, ngram, shared, rule))]
        discard(sized)
        return links

    # power-of-1/t size bands, so that links are within a band or between neighbours
    large = materialize(large.withColumn("band", F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / math.log(100 / rule.percent))))

    def blocked(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The rows with the hashed block of their band, and the blocks that there are."""
        count = F.greatest(F.lit(1), F.ceil(F.col("band_total") / max(1, unit_tokens // 2))).cast("long")
        bands = rows.groupBy("component", "band").agg(F.sum("n").alias("band_total")).withColumn("blocks", count).drop("band_total")
        own_block = rows.join(bands, ["component", "band"]).withColumn(name, F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")
        return own_block, bands.select("component", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias(name))

    def around(rows: DataFrame) -> DataFrame:
        """Rows once for each band that theirs is compatible with."""
        return rows.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))

    def unit(*parts: str) -> Column:
        return F.concat_ws(":", F.lit("b"), "component", "band", *parts).alias("unit")

    cut, shape = blocked(large, "block")
    best = Window.partitionBy("component", "band").orderBy(F.xxhash64("id"), "id")
    pivots = large.withColumn("place", F.row_number().over(best)).where(F.col("place") <= PIVOTS).select("id", "component", "band")
    pivots = around(pivots).join(shape, ["component", "band"])
    first = units.union(cut.select("id", "component", *alone, unit("block"))).union(pivots.select("id", "component", *alone, unit("block")))
    links = [materialize(_verified(own, first, ngram, shared, rule))]

    found = connected_components(links[0])
    classed = materialize(large.join(found.withColumnRenamed("component", "known"), "id", "left").withColumn("known", F.coalesce("known", "id")))
    weights = classed.groupBy("component", "known").agg(F.sum("n").alias("weight"))
    greatest = weights.groupBy("component").agg(F.max_by("known", F.struct("weight", "known")).alias("greatest"))
    others = materialize(classed.join(greatest, "component").where("known <> greatest").drop("greatest"))
    if others.limit(1).count():
        cut, shape = blocked(classed, "block")
        other, pieces = blocked(others, "piece")
        # a block meets the pieces of its own band and of both neighbours
        pieces = pieces.withColumnRenamed("band", "piece_band")
        met = around(pieces.withColumn("band", F.col("piece_band"))).join(shape, ["component", "band"])
        name = unit("block", "piece_band", "piece")
        rows = ["id", "component", "known"]
        left = cut.join(met, ["component", "band", "block"]).select(*rows, F.lit(LEFT).alias("side"), name)
        right = other.withColumnRenamed("band", "piece_band").join(met, ["component", "piece_band", "piece"]).select(*rows, F.lit(RIGHT).alias("side"), name)
        links.append(materialize(_verified(own, left.union(right), ngram, shared, rule)))
    discard(sized, large, found, classed, others)
    return links


def _candidate_classes(shown: DataFrame, rule: Rule) -> DataFrame:
    """(token, rep, n) -> (id, component), classes that whatever may link is in together.

    Linked sets share at least l shown tokens, so half of l either in tokens that at most
    FEW sets show, where pairs are counted, or in the others, where each set with that many
    such tokens hangs on one set for each token and size band."""
    least = F.ceil(F.col("n") * rule.percent / 100)
    common = F.greatest(F.lit(1), F.floor((least - F.ceil(least * rule.percent / 100) + 1) / 3))
    shown = shown.select("token", "rep", "n", F.ceil(common / 2).alias("half")).distinct()
    size = shown.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    # what grows with the corpus moves the same way at every size: no side is small for long
    sized = materialize(shown.join(size.hint("merge"), "token"))
    few, many = sized.where(F.col("size") <= FEW), sized.where(F.col("size") > FEW)
    a = few.select("token", F.col("rep").alias("u"), F.col("n").alias("nu"), F.col("half").alias("hu"))
    b = few.select("token", F.col("rep").alias("v"), F.col("n").alias("nv"), F.col("half").alias("hv"))
    fits = (F.col("u") < F.col("v")) & (100 * F.least("nu", "nv") >= rule.percent * F.greatest("nu", "nv"))
    pairs = a.join(b.hint("merge"), (a["token"] == b["token"]) & fits).groupBy("u", "v").agg(F.count(F.lit(1)).alias("seen"), F.min(F.least("hu", "hv")).alias("half"))
    able = many.groupBy("rep").agg(F.count(F.lit(1)).alias("seen"), F.max("half").alias("half")).where("seen >= half").select("rep")
    band = F.floor(F.log(F.col("n")) / math.log(100 / rule.percent))
    left = many.join(able.hint("merge"), "rep").select("token", "rep", band.alias("band"))
    lead = left.groupBy("token", "band").agg(F.min("rep").alias("lead"))
    hung = left.join(lead.hint("merge"), ["token", "band"]).select(F.col("rep").alias("u"), F.col("lead").alias("v"))
    upper = lead.select("token", (F.col("band") - 1).alias("band"), F.col("lead").alias("v"))
    stairs = lead.select("token", "band", F.col("lead").alias("u")).join(upper, ["token", "band"]).select("u", "v")
    classes = connected_components(pairs.where("seen >= half").select("u", "v").union(hung).union(stairs))
    discard(sized)
    return classes


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram: int = 3,
    percent: int = 90,
    bucket_bytes: int = 8 << 20,
    unit_tokens: int = 1 << 20,
) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of ``docs``.

    Two texts link when 100 * |A and B| >= percent * |A or B| over their sets of distinct
    lower-cased word n-grams; component_id is the least id reachable by links.

    Null, empty and blank texts have an empty set, link with nothing and are their own
    component. Texts of fewer words than ``ngram`` have their whole sequence as one
    shingle. Very long texts are taken whole. Rows that share an id are one vertex but keep a
    row each; a null id gives a null component. Ids are integers; of equal sizes or counts,
    hashes and then ids decide the order of work, never the result. An empty table gives no
    rows. Other columns are ignored, so their names can't clash.
    """
    spark: SparkSession = docs.sparkSession
    rule = Rule(percent)
    buckets = bucket_count(docs, bucket_bytes, text_col)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    first = materialize(spread(own).mapInArrow(_first_pass(ngram), "id long, n long, s1 long, s2 long, part int, salt int, counts binary"))
    shared = spark.sparkContext.broadcast(_ranks(first).tobytes())
    sets = first.where("part is null").select("id", "n", "s1", "s2")
    ends = materialize(sets.where("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("rep")))
    records = spread(own.where("id is not null")).mapInArrow(_prefix_pass(ngram, rule, buckets, shared), "bucket int, records binary, members binary")
    shown = materialize(records.groupBy("bucket").applyInArrow(_members, "token long, s1 long, s2 long, n long").join(ends.hint("merge"), ["s1", "s2"]).select("token", "rep", "n"))
    classes = _candidate_classes(shown, rule)
    members = materialize(shown.groupBy("rep").agg(F.max("n").alias("n")).join(classes, F.col("rep") == F.col("id")).select("id", "n", "component"))
    discard(shown, classes)
    links = _links(own.where("id is not null"), members, ngram, shared, rule, buckets, unit_tokens)
    edges = sets.where("n > 0").join(ends, ["s1", "s2"]).where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    for table in links:
        edges = edges.union(table)
    found = connected_components(edges)
    result = materialize(
        sets.join(found, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    )
    discard(first, ends, members, found, *links)
    shared.unpersist()
    return result
