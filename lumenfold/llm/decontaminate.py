"""Benchmark decontamination with one FM-index per training shard (operator 9).

Test items become windows of words. Each task gathers its documents into shards and indexes
every shard: suffixes sorted by packed prefixes and then prefix doubling, the Burrows-Wheeler
transform in a wavelet matrix, suffix positions sampled. All windows are searched backwards
at once; occurrences are located by last-to-first steps up to a sampled suffix, and
overlapping occurrences merge into removal spans.

Words that no test item has can't be part of an occurrence. They, and document ends, are
terminators, ordered by place, so that sorting stops at them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import textvec as tv
from lumenfold.llm.shared import materialize

U64 = np.uint64


class Wavelet:
    """Wavelet matrix over small integers: rank and access by one gather a level."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.zeros, self.count = bits, [], []
        for level in range(bits - 1, -1, -1):
            one = (symbols >> level) & 1 == 1
            before = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(~one, out=before[1:], dtype=np.int32)
            self.zeros.append(before)
            self.count.append(int(before[-1]))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        self.base = self._descend(np.arange(1 << bits), np.zeros(1 << bits, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, before in enumerate(self.zeros):
            left = before[at]
            at = np.where((symbol >> (self.bits - 1 - k)) & 1 == 1, self.count[k] + at - left, left)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._descend(symbol, at) - self.base[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), dtype=np.int64)
        for k, before in enumerate(self.zeros):
            left = before[at]
            one = before[at + 1] == left
            symbol = symbol * 2 + one
            at = np.where(one, self.count[k] + at - left, left)
        return symbol


def sort_suffixes(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of ``text``, where each 0 is a terminator of its own, ordered by place,
    below all others; the last symbol is 0. Positions need at most 21 bits."""
    n = len(text)
    width = max(1, n.bit_length())
    depth = max(1, (64 - width) // bits)
    key = np.zeros(n, dtype=U64)
    going = np.ones(n, dtype=bool)
    for j in range(depth):
        key <<= U64(bits)
        here = np.zeros(n, dtype=U64)
        if j < n:
            here[: n - j] = text[j:]
        here[~going] = 0
        key |= here
        going &= here != 0
    key <<= U64(width)
    key |= np.arange(n, dtype=U64)
    key.sort()
    low = U64((1 << width) - 1)
    suffix = (key & low).astype(np.int64)
    head = key >> U64(width)
    first = np.ones(n, dtype=bool)
    first[1:] = head[1:] != head[:-1]
    first |= ~going[suffix]
    while not first.all():
        rank = np.empty(n, dtype=np.int64)
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[suffix] = start
        open_ = ~first
        open_[:-1] |= ~first[1:]
        rows = np.flatnonzero(open_)
        at = suffix[rows]
        key = (start[rows].astype(U64) << U64(2 * width)) | (rank[at + depth].astype(U64) << U64(width)) | at.astype(U64)
        key.sort()
        suffix[rows] = (key & low).astype(np.int64)
        pair = key >> U64(width)
        first[rows] = np.append(True, pair[1:] != pair[:-1])
        depth *= 2
    return suffix


class FMIndex:
    """Count and locate patterns in one shard; ``text`` as for sort_suffixes."""

    def __init__(self, text: np.ndarray, bits: int, every: int = 16) -> None:
        suffix = sort_suffixes(text, bits)
        last = text[suffix - 1]
        self.size = len(text)
        self.tree = Wavelet(last, bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        kept = (suffix % every == 0) | (last == 0)
        self.kept = kept
        self.place = np.concatenate([[0], np.cumsum(kept)])
        self.sample = suffix[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, low, high) of the patterns that occur; rows are right-aligned."""
        which = np.arange(len(patterns))
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.size, dtype=np.int64)
        width = patterns.shape[1]
        done = []
        for step in range(width):
            symbol = patterns[which, width - 1 - step]
            low = self.before[symbol] + self.tree.rank(symbol, low)
            high = self.before[symbol] + self.tree.rank(symbol, high)
            left = high > low
            over = left & (lengths[which] == step + 1)
            done.append((which[over], low[over], high[over]))
            left &= ~over
            which, low, high = which[left], low[left], high[left]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by last-to-first steps up to a sampled suffix."""
        out = np.empty(len(rows), dtype=np.int64)
        at, which, steps = rows.copy(), np.arange(len(rows)), 0
        while len(which):
            found = self.kept[at]
            out[which[found]] = self.sample[self.place[at[found]]] + steps
            at, which = at[~found], which[~found]
            symbol = self.tree.access(at)
            at = self.before[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out


class Windows:
    """The windows of a block of test items, as symbols of the items' own vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], size: int) -> None:
        column = pa.array([t for _, t in items], pa.string())
        hashes, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for piece in tv.slices(column):
            data = tv.LOWER[piece.data]
            words = tv.find_words(data, piece.offsets, tv.ALNUM)
            hashes.append(tv.hash_spans(data, words.starts, words.ends))
            counts.append(words.counts)
        words, counts = np.concatenate(hashes), np.concatenate(counts)
        self.names = [name for name, _ in items]
        self.vocabulary = np.unique(words)
        symbols = np.searchsorted(self.vocabulary, words) + 1
        self.bits = int(len(self.vocabulary)).bit_length()
        self.size = size
        patterns: dict[tuple[int, ...], set[int]] = {}
        start = 0
        for item, n in enumerate(counts):
            own = symbols[start : start + n].tolist()
            start += n
            for k in range(max(1, n - size + 1) if n else 0):
                patterns.setdefault(tuple(own[k : k + size]), set()).add(item)
        self.lengths = np.array([len(p) for p in patterns], dtype=np.int64)
        self.table = np.zeros((len(patterns), size), dtype=np.int32)
        for row, p in zip(self.table, patterns, strict=True):
            row[size - len(p) :] = p
        self.of = [sorted(x) for x in patterns.values()]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Words of documents as symbols; 0 for those that no item of the block has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int32)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


def find_hits(symbols: np.ndarray, counts: np.ndarray, windows: Windows, most: int = 1 << 20) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which words of a run of documents are hit, and the (document, item) pairs.

    ``symbols`` has 0 for words that no item has. Runs of more than ``most`` words are
    indexed in pieces that overlap by a window less one word."""
    hit = np.zeros(len(symbols) + 1, dtype=np.int32)
    pairs: set[tuple[int, int]] = set()
    if not len(windows.lengths) or not symbols.any():
        return hit[:-1] > 0, []
    doc = np.repeat(np.arange(len(counts)), counts)
    for begin in range(0, len(symbols), most):
        part = slice(begin, min(len(symbols), begin + most + windows.size - 1))
        own, of = symbols[part], doc[part]
        fresh = np.append(True, of[1:] != of[:-1])
        known = own > 0
        # a terminator stands before a known word if an unknown one or another document does
        cut = known & np.append(True, ~known[:-1] | fresh[1:])
        where = np.flatnonzero(known)
        step = np.cumsum(cut[where])
        text = np.zeros(len(where) + int(step[-1]) + 1 if len(where) else 1, dtype=np.int64)
        at = np.arange(len(where)) + step
        text[at] = own[where]
        word = np.zeros(len(text), dtype=np.int64)
        word[at] = where
        index = FMIndex(text, windows.bits)
        which, low, high = index.search(windows.table, windows.lengths)
        if not len(which):
            continue
        n = high - low
        pattern = np.repeat(which, n)
        first = word[index.locate(tv.ragged(low, n))] + begin
        np.add.at(hit, first, 1)
        np.add.at(hit, first + windows.lengths[pattern], -1)
        for d, p in np.unique(np.stack([doc[first], pattern], axis=1), axis=0):
            pairs.update((int(d), item) for item in windows.of[p])
    return np.cumsum(hit[:-1]) > 0, sorted(pairs)


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("word", pa.int64()), ("words", pa.int64())])
_SPANS = "array<struct<start:bigint,stop:bigint,word:bigint,words:bigint>>"


def _search_pass(blocks: list, at: int, shard_words: int):
    """Joins what some blocks of items find to (n_words, hits, items), the last three columns.

    A shard is indexed for one block after another, so that a worker holds one shard and one
    block at a time, however many there are."""

    def loaded(block) -> Windows:
        windows = block.value
        if len(blocks) > 1:
            # the worker's copy would stay until the task ends
            block.__dict__.pop("_value", None)
        return windows

    def shard(held: list) -> Iterator[pa.RecordBatch]:
        counts = np.concatenate([x[2] for x in held])
        hashes = np.concatenate([x[1] for x in held])
        hit = np.zeros(len(hashes), dtype=bool)
        items: dict[int, list[str]] = {}
        for block in blocks:
            windows = loaded(block)
            own, pairs = find_hits(windows.symbols(hashes), counts, windows)
            hit |= own
            for d, item in pairs:
                items.setdefault(d, []).append(windows.names[item])
        row = word = 0
        for rows, words, own, starts, ends in held:
            mine = hit[word : word + len(words)]
            doc = np.repeat(np.arange(len(own)), own)
            begin = np.cumsum(own) - own
            earlier = rows.column(at + 1).to_pylist()
            for k, old in enumerate(earlier):
                for x in old or ():
                    mine[begin[k] + x["word"] : begin[k] + x["word"] + x["words"]] = True
            spans: dict[int, list[dict]] = {}
            if mine.any():
                other = doc[1:] != doc[:-1]
                first = np.flatnonzero(mine & np.append(True, ~mine[:-1] | other))
                last = np.flatnonzero(mine & np.append(~mine[1:] | other, True))
                for x, y in zip(first, last, strict=True):
                    d = int(doc[x])
                    spans.setdefault(d, []).append({"start": int(starts[x]), "stop": int(ends[y]), "word": int(x - begin[d]), "words": int(y - x + 1)})
            hits = [spans.get(k, []) for k in range(len(own))]
            names = [(old or []) + items.get(row + k, []) for k, old in enumerate(rows.column(at + 2).to_pylist())]
            columns = rows.columns[:at] + [pa.array(own), pa.array(hits, pa.list_(_SPAN)), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)
            row += len(own)
            word += len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in tv.slices(batch.column(at - 1)):
                data = tv.LOWER[piece.data]
                words = tv.find_words(data, piece.offsets, tv.ALNUM)
                hashes = tv.hash_spans(data, words.starts, words.ends)
                base = np.repeat(piece.offsets[:-1], words.counts)
                held.append((batch.slice(piece.first, piece.rows), hashes, words.counts, (words.starts - base).astype(np.int32), (words.ends - base).astype(np.int32)))
                size += len(hashes)
                if size >= shard_words:
                    yield from shard(held)
                    held, size = [], 0
        if held:
            yield from shard(held)

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of bounded size, one after another on the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null")
    for r in rows.toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"] or "") + 16
        if size > block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    block_bytes: int = 2 << 20,
    blocks_at_once: int = 8,
    shard_words: int = 1 << 20,
) -> DataFrame:
    """The columns ``keep`` (default id_col) and n_words, n_hit, items, spans per document.

    A window is ``window`` consecutive words of an item, or all words of a shorter item. A
    document's word inside any occurrence of a window is hit; ``items`` are the sorted
    distinct ids of items with occurring windows and ``spans`` the merged (start, stop) byte
    ranges of the hits. Test items are broadcast in blocks of about ``block_bytes`` of text,
    ``blocks_at_once`` of them to a pass over the documents; passes are written between, so
    neither what is broadcast at once nor what a worker holds grows with the items.

    Null and empty texts have no words; very long ones are indexed in overlapping pieces.
    Rows that repeat, or have null ids, are judged one by one; items of equal text all count.
    An empty benchmark hits nothing, an empty table gives no rows; an item with a null id is
    ignored. Other columns are ignored unless in ``keep``, whatever their names.
    """
    spark = docs.sparkSession
    keep = [id_col] if keep is None else keep
    now = docs.select(
        *[F.col(c).alias(f"k{j}") for j, c in enumerate(keep)],
        F.col(text_col).cast("string").alias("body"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(_SPANS).alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    waiting, more = [spark.sparkContext.broadcast(Windows(next(blocks, []), window))], next(blocks, None)
    while True:
        while more is not None and len(waiting) < blocks_at_once:
            waiting.append(spark.sparkContext.broadcast(Windows(more, window)))
            more = next(blocks, None)
        now = now.mapInArrow(_search_pass(waiting, len(keep) + 1, shard_words), now.schema)
        if more is None:
            break
        now = materialize(now)
        for old in waiting:
            old.unpersist()
        waiting = []
    return now.select(
        *[F.col(f"k{j}").alias(c) for j, c in enumerate(keep)],
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("n_hit"),
        F.array_sort(F.array_distinct("items")).alias("items"),
        F.transform("hits", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).alias("spans"),
    )


def contaminated(n_words, n_hit):
    """The rule as a column: any hit, and hits at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
