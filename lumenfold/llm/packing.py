"""Token counting and hierarchical best-fit packing (operator 10).

Tokens: short strings that the word tokenizer never joins are encoded once a worker and
their ids gathered by index. Packing: hashed
groups best-fit their pieces, decreasing, and emit nearly full sequences; underfull ones
rise as items to the next level, where a group joins several of the level below.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import textvec as tv
from lumenfold.llm.shared import discard, materialize, spread

VOCABULARY = "word_bpe_49k.json"
U64 = np.uint64


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where this machine keeps the public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Separates strings that are encoded in one call; texts that hold it are encoded alone.
_BETWEEN = "<|startoftext|>"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_OTHER = np.zeros(256, dtype=bool)
_OTHER[33:128] = True
_OTHER[65:91] = _OTHER[97:123] = False


class WordTokenizer:
    """Ids of whole batches through a cache of short strings.

    The vocabulary's pre-tokenizer never joins across white space, nor from an ASCII letter
    to another ASCII character, nor back but after an apostrophe. Slices are lower-cased and
    cut there, and each distinct string is encoded once, up to ``most`` of them, after which
    the cache starts anew (a matter of speed alone). Slices with the start of a special
    token are cut at white space only and keep their case.
    """

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.between = self.tokenizer.token_to_id(_BETWEEN)
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(0, U64)
        self.slot = np.zeros(0, np.int64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings, and how many each has."""
        if any("<|" in x for x in strings):
            found = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in strings]
            return np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64)
        parts, lengths = [], []
        for k in range(0, len(strings), 2000):
            some = strings[k : k + 2000]
            ids = np.array(self.tokenizer.encode(_BETWEEN.join(some), add_special_tokens=False).ids, dtype=np.uint32)
            cut = ids == self.between
            bounds = np.concatenate([[-1], np.flatnonzero(cut), [len(ids)]])
            lengths.append(np.diff(bounds) - 1)
            parts.append(ids[~cut])
        return np.concatenate(parts), np.concatenate(lengths)

    def _learn(self, fresh: np.ndarray, strings: list[str]) -> None:
        ids, length = self._encode(strings)
        start = len(self.ids) + np.cumsum(length) - length
        slot = len(self.start) + np.arange(len(fresh))
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.known, fresh)
        self.known, self.slot = np.insert(self.known, at, fresh), np.insert(self.slot, at, slot)

    @staticmethod
    def _strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of the strings, and where each row's begin."""
        words = tv.find_words(data, offsets, tv.NOT_SPACE)
        if not len(words.starts):
            return words.starts, words.ends, np.zeros(len(offsets), np.int64)
        letter, other = _LETTER[data], _OTHER[data]
        inner = np.flatnonzero((letter[:-1] & other[1:]) | (other[:-1] & letter[1:] & (data[:-1] != 39))) + 1
        # a cut is inside a word, but not where a row and so another word begins
        inner = np.setdiff1d(inner, words.starts, assume_unique=True)
        starts = np.sort(np.concatenate([words.starts, inner]))
        ends = np.sort(np.concatenate([words.ends, inner]))
        return starts, ends, np.searchsorted(starts, offsets)

    def encode(self, piece: tv.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, and row offsets into them."""
        raw = piece.data.tobytes()
        if b"<|" in raw:
            data = piece.data
            words = tv.find_words(data, piece.offsets, tv.NOT_SPACE)
            starts, ends, rows = words.starts, words.ends, np.concatenate([[0], np.cumsum(words.counts)])
            salt = U64(1)
        else:
            data = tv.LOWER[piece.data]
            raw, salt = data.tobytes(), U64(0)
            starts, ends, rows = self._strings(data, piece.offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(piece.offsets), np.int64)
        hashes = tv.hash_spans(data, starts, ends) ^ salt
        if len(self.known) > self.most:
            self._reset()
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        fresh = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.known)
        fresh[inside] = self.known[at[inside]] != distinct[inside]
        if fresh.any():
            spots = first[fresh]
            self._learn(distinct[fresh], [raw[a:b].decode() for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)])
            at = np.searchsorted(self.known, distinct)
        slot = self.slot[at][inverse]
        length = self.length[slot]
        ids = self.ids[tv.ragged(self.start[slot], length)]
        return ids, np.concatenate([[0], np.cumsum(length)])[rows]


#: Tokenizers of this process, kept from task to task.
_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str | None) -> WordTokenizer:
    path = path or vocabulary_path()
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _piece_pass(path: str | None, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(path)
        for batch in batches:
            for piece in tv.slices(batch.column(1)):
                ids, offsets = tokenizer.encode(piece)
                size = np.diff(offsets) + 1
                whole = np.insert(ids, offsets[1:], np.uint32(end_id)).astype("<u4")
                begin = np.cumsum(size) - size
                count = -(-size // capacity)
                row = np.repeat(np.arange(piece.rows), count)
                number = tv.ragged(np.zeros(piece.rows, np.int64), count)
                start = number * capacity
                length = np.minimum(capacity, size[row] - start)
                view = memoryview(whole.tobytes())
                at = (begin[row] + start).tolist()
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, piece.rows).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    schema=_PIECES,
                )

    return run


def tokenized_pieces(docs: DataFrame, capacity: int, id_col: str, text_col: str, path: str | None, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(own).mapInArrow(_piece_pass(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each item, and the room left in each bin."""
    bins = np.empty(len(lengths), dtype=np.int64)
    rooms: list[int] = []  # sorted distinct rooms above 0
    stacks: dict[int, list[int]] = {}
    left: list[int] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        k = bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            which = stacks[room].pop()
            if not stacks[room]:
                del stacks[room]
                del rooms[k]
        else:
            room, which = capacity, len(left)
            left.append(capacity)
        bins[item] = which
        room -= n
        left[which] = room
        if room:
            if room not in stacks:
                stacks[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            stacks[room].append(which)
    return bins, np.array(left, dtype=np.int64)


def _pack(capacity: int, full: int):
    """Items (group, item, length) of a group -> (item, bin, at, fill, done)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("item", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, room = best_fit(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        total = np.cumsum(lengths[order])
        first = tv.firsts(bins[order])
        at = np.empty(len(lengths), dtype=np.int64)
        at[order] = total - lengths[order] - np.repeat((total - lengths[order])[first], np.diff(np.append(np.flatnonzero(first), len(order))))
        # the first item's id names the bin: unique, and the same in a task that runs again
        name = table.column("item").to_numpy()[order][first]
        return pa.table({"item": table.column("item"), "bin": pa.array(name[bins]), "at": pa.array(at), "fill": pa.array(capacity - room[bins]), "done": pa.array(room[bins] <= full)})

    return run


def best_fit_packing(
    docs: DataFrame,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    end_id: int = 1,
    group_pieces: int = 50_000,
    fan_in: int = 8,
    full: int = 8,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A document is its ids and ``end_id``; only longer ones than ``capacity`` are cut. Level
    0 packs hashed groups of about ``group_pieces`` pieces. Each further level deals the
    sequences with more than ``full`` tokens of room anew, as items, to a ``fan_in``th of the
    groups, but at most twice ``group_pieces`` to a group; levels end when one group has held
    all that is underfull, or when groups can't get fewer and joined nothing more.

    Null and empty texts are the end id alone; very long ones are cut into many pieces.
    Repeated rows are packed one by one; a null id stays null. Ids are integers. Pieces of
    one length go by their place in the table. An empty table gives no rows. Other columns
    are ignored. ``path`` is the vocabulary file; None looks it up on each machine.
    """
    pieces = materialize(
        tokenized_pieces(docs, capacity, id_col, text_col, path, end_id).withColumn("item", F.monotonically_increasing_id())
    )
    rows = pieces.count()
    groups = max(1, -(-rows // group_pieces))
    items = pieces.select("item", "length")
    levels: list[DataFrame] = []
    schema = "item long, bin long, at long, fill long, done boolean"
    under = None
    while True:
        # the level is part of the hash, so that what met in vain is dealt anew
        grouped = items.withColumn("group", F.pmod(F.xxhash64("item", F.lit(len(levels))), F.lit(groups)))
        level = materialize(grouped.groupBy("group").applyInArrow(_pack(capacity, full), schema))
        levels.append(level)
        if groups == 1:
            break
        items = level.where("not done").groupBy("bin").agg(F.max("fill").alias("length")).withColumnRenamed("bin", "item")
        now = items.count()
        fewer = max(-(-groups // fan_in), -(-now // (2 * group_pieces)))
        if now == 0 or (fewer == groups and now == under):
            break
        groups, under = fewer, now
    # walk down: the last level's bins name sequences, earlier ones add their place in them
    place = None
    for level in reversed(levels):
        own = level.select("item", "bin", "at")
        if place is None:
            place = own
        else:
            up = place.select(F.col("item").alias("bin"), F.col("bin").alias("higher"), F.col("at").alias("further"))
            place = own.join(up, "bin", "left").select("item", F.coalesce("higher", "bin").alias("bin"), (F.col("at") + F.coalesce("further", F.lit(0))).alias("at"))
    result = materialize(
        pieces.join(place, "item").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    )
    discard(pieces, *levels)
    return result
