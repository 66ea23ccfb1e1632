"""Removal of repeated byte windows by depth-limited radix sort (operator 7).

Ordering every suffix of the corpus through 50 bytes would move each byte fifty times. A
suffix can only repeat where the least-hashed k-gram inside its window repeats, so:

A. groups of documents send the hashes of these anchors to buckets, which answer those that
   occur in several documents, and which of them in very many groups;
B. groups send the runs of windows around the answered anchors (one for each distinct run in
   a group, under the least document) to buckets by anchor. There all windows are sorted by
   most-significant-digit passes of eight bytes, through the threshold and no further; equal
   groups are exactly the repeated windows, and the least document of each group keeps it;
C. groups apply the answers to their documents.

Runs around a very frequent anchor are cut in two where the anchor leaves the middle of the
window, and go by the bytes beside it, which all windows of a half have: equal windows still
meet, and no bucket gets all contexts of one anchor. Messages travel in bundles over a net of
at most ``fan`` ways a hop, so rows grow with groups times hops, not with groups times buckets;
on the way, bytes of equal runs are carried once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import textvec as tv
from lumenfold.llm.shared import bucket_count

U64 = np.uint64
_POSITION_BITS = 20
_HASH_BYTES = 6


class Shape:
    """Window and anchor sizes in bytes; an anchor is the least of ``spread`` k-grams."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.gram = max(1, (2 * window) // 5)
        self.spread = window - self.gram + 1
        #: Bytes beside an anchor that windows of a half have: before it, or after its gram.
        self.before = self.spread // 2
        self.after = window - self.gram - self.before + 1


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position, by doubling."""
    with np.errstate(over="ignore"):
        multiplier, length, size = U64(0xD6E8FEB86659FD93), 1, {1: tv._BYTE[data]}
        factor = {1: multiplier}
        while length * 2 <= k:
            h = size[length]
            size[length * 2] = h[:-length] * factor[length] + h[length:]
            factor[length * 2] = factor[length] * factor[length]
            length *= 2
        h = size[length]
        have = length
        for part in sorted((p for p in size if p < length), reverse=True):
            if have + part <= k:
                tail = size[part][have:]
                h = h[: len(tail)] * factor[part] + tail
                have += part
        return tv.mix(h)


def window_runs(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, its hash) of the runs of windows with one anchor.

    Windows lie within a row. Which windows share an anchor depends on their bytes alone."""
    w = shape.window
    total = len(data)
    if total < w:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, np.zeros(0, U64)
    # windows that reach into the next row: the last w - 1 starts of each row
    late = np.maximum(offsets[:-1], offsets[1:] - w + 1)
    valid = np.ones(total, dtype=bool)
    valid[tv.ragged(late, offsets[1:] - late)] = False
    valid = valid[: total - w + 1]
    first, last, place, anchor = [], [], [], []
    step = (1 << _POSITION_BITS) - w
    for begin in range(0, total - w + 1, step):
        part = data[begin : begin + step + w - 1]
        h = _gram_hashes(part, shape.gram)
        low = U64((1 << _POSITION_BITS) - 1)
        least = (h & ~low) | np.arange(len(h), dtype=U64)
        span = 1
        while span * 2 <= shape.spread:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        count = len(part) - w + 1
        least = np.minimum(least[:count], least[shape.spread - span : shape.spread - span + count])
        ok = valid[begin : begin + count]
        new = ok.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
        end = ok.copy()
        end[:-1] &= (least[1:] != least[:-1]) | ~ok[1:]
        a = np.flatnonzero(new)
        first.append(a + begin)
        last.append(np.flatnonzero(end) + begin)
        spot = (least[a] & low).astype(np.int64)
        place.append(spot + begin)
        anchor.append(h[spot])
    return np.concatenate(first), np.concatenate(last), np.concatenate(place), np.concatenate(anchor)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Hash of the bytes of each span; starts ascend."""
    out = np.empty(len(starts), dtype=U64)
    for begin in range(0, len(data), step):
        a, b = np.searchsorted(starts, [begin, begin + step])
        if a < b:
            stop = int(ends[a:b].max())
            out[a:b] = tv.hash_spans(data[begin:stop], starts[a:b] - begin, ends[a:b] - begin)
    return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices into starts, group) of the windows whose bytes occur at several starts.

    Most-significant-digit radix passes of eight bytes; windows alone in their group leave
    after each pass, and no pass looks beyond ``window`` bytes."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    digits = np.empty(len(data) + 8, dtype=U64)
    for r in range(8):
        some = padded[r : r + (len(padded) - r) // 8 * 8].view(">u8")
        own = digits[r::8]
        own[:] = some[: len(own)]
    alive = np.arange(len(starts))
    group = np.zeros(len(starts), dtype=np.int64)
    at = 0
    while at < window:
        width = min(8, window - at)
        digit = digits[starts[alive] + at]
        if width < 8:
            digit = digit >> U64(8 * (8 - width))
        order = np.argsort(digit, kind="stable")
        if at:
            order = order[np.argsort(group[order], kind="stable")]
        alive, group, digit = alive[order], group[order], digit[order]
        new = tv.firsts(group, digit)
        number = np.cumsum(new) - 1
        many = np.bincount(number, minlength=1)[number] > 1
        alive, group = alive[many], number[many]
        at += width
    return alive, group


class _Group:
    """A group's documents in a fixed order, with their runs."""

    def __init__(self, table: pa.Table, shape: Shape) -> None:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        self.ids = table.column("id").to_numpy()
        text = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        data, offsets = tv.text_buffers(text)
        self.data, self.offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        self.shape = shape
        self.first, self.last, self.place, self.anchor = window_runs(self.data, self.offsets, shape)

    def pieces(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, last window, anchor hash, routing hash) of the runs in order, those
        around the ``hot`` anchors, short and sorted, cut in two."""
        cut = _among(_short(self.anchor), hot)
        if not cut.any():
            return self.first, self.last, self.anchor, self.anchor
        first, last, place, anchor = self.first[cut], self.last[cut], self.place[cut], self.anchor[cut]
        middle = place - self.shape.before
        gram_end = place + self.shape.gram
        parts = [(self.first[~cut], self.last[~cut], self.anchor[~cut], self.anchor[~cut])]
        for a, b, start, stop in ((first, np.minimum(last, middle), middle, place), (np.maximum(first, middle + 1), last, gram_end, gram_end + self.shape.after)):
            there = a <= b
            beside = span_hashes(self.data, start[there], stop[there])
            with np.errstate(over="ignore"):
                parts.append((a[there], b[there], anchor[there], tv.mix(anchor[there] + beside * U64(0xD6E8FEB86659FD93))))
        first, last, anchor, route = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(first, kind="stable")
        return first[order], last[order], anchor[order], route[order]

    def owners(self, first: np.ndarray) -> np.ndarray:
        """Ids of the documents that windows are in."""
        return self.ids[np.searchsorted(self.offsets, first, side="right") - 1]


class Net:
    """Addresses 0 .. size - 1 that messages reach in hops of at most ``fan`` ways each.

    A row is a bundle of messages from senders that share src to a range of addresses, dest;
    hop by hop ranges get narrower and senders more, so that a row never is a lone message
    for want of others on its way. All hops have the same ways, and no more than they need:
    then there are about as many relays at each hop as addresses, and none gets more messages
    than an address does."""

    SCHEMA = "dest long, src long, body binary"

    def __init__(self, size: int, fan: int) -> None:
        self.fan, self.hops = 2, 1
        while fan**self.hops < size:
            self.hops += 1
        while self.fan**self.hops < size:
            self.fan += 1

    def post(self, hop: int, src: int, to: np.ndarray, sender: np.ndarray, parts: list[tuple[bytes, ...]]) -> pa.Table:
        """Rows of messages, in order of ``to``, that have ``hop`` hops behind them after this."""
        dest = to // self.fan ** (self.hops - hop)
        at, stop = tv.blocks(dest)
        bodies = [_bundle(to[a:b], sender[a:b], parts[a:b]) for a, b in zip(at, stop, strict=True)]
        return pa.table({"dest": pa.array(dest[at], pa.int64()), "src": pa.array(np.full(len(at), src, np.int64)), "body": pa.array(bodies, pa.binary())})

    def carry(self, rows: DataFrame, combine=None) -> DataFrame:
        """Rows of the first hop until dest is each message's address."""
        for hop in range(2, self.hops + 1):
            nearer = rows.withColumn("src", F.floor(F.col("src") / self.fan))
            rows = nearer.groupBy("dest", "src").applyInArrow(self._relay(hop, combine), self.SCHEMA)
        return rows

    def _relay(self, hop: int, combine):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            to, sender, parts = read_bundles(table)
            order = np.lexsort((sender, to))
            parts = [parts[k] for k in order]
            return self.post(hop, key[1].as_py(), to[order], sender[order], combine(parts) if combine else parts)

        return run


def _bundle(to: np.ndarray, sender: np.ndarray, parts: list[tuple[bytes, ...]]) -> bytes:
    sizes = np.array([[len(x) for x in p] for p in parts], dtype=np.int64)
    head = np.concatenate([[sizes.shape[0], sizes.shape[1]], to, sender, sizes.ravel()]).astype("<i8")
    return b"".join([head.tobytes(), *(x for p in parts for x in p)])


def read_bundles(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[memoryview, ...]]]:
    """(address, sender, parts) of all messages of some rows."""
    to, sender, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for body in table.column("body"):
        view = memoryview(body.as_buffer())
        n, width = (int(x) for x in np.frombuffer(view[:16], dtype="<i8"))
        head = np.frombuffer(view[16 : 16 + 8 * n * (2 + width)], dtype="<i8")
        to.append(head[:n])
        sender.append(head[n : 2 * n])
        ends = np.append(0, np.cumsum(head[2 * n :])) + 16 + 8 * n * (2 + width)
        pieces = [view[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        parts += [tuple(pieces[k : k + width]) for k in range(0, n * width, width)]
    return np.concatenate(to), np.concatenate(sender), parts


def _route(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, and each present bucket with its bounds."""
    bucket = (tv.mix(hashes >> U64(16)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at, stop = tv.blocks(bucket)
    return order, bucket[at], at, stop


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among sorted ones."""
    if not len(some):
        return np.zeros(len(values), dtype=bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _short(hashes: np.ndarray) -> np.ndarray:
    """The high 48 bits; a filter only, so that a chance equality costs work, not truth."""
    return hashes >> U64(16)


def _to_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]).tobytes()


def _from_bytes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, dtype=np.uint8).reshape(-1, _HASH_BYTES)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :_HASH_BYTES] = raw
    return wide.reshape(-1).view("<u8").astype(U64)


def _send_anchors(shape: Shape, net: Net, buckets: int):
    """Messages (anchors of one document, anchors of several) to buckets."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = _Group(table, shape)
        short = _short(own.anchor)
        order = np.argsort(short, kind="stable")
        short, ids = short[order], own.owners(own.first)[order]
        begin, _ = tv.blocks(short)
        several = np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin) if len(begin) else np.zeros(0, bool)
        short = short[begin]
        order, bucket, at, stop = _route(short << U64(16), buckets)
        short, several = short[order], several[order]
        parts = [(_to_bytes(short[a:b][~several[a:b]]), _to_bytes(short[a:b][several[a:b]])) for a, b in zip(at, stop, strict=True)]
        g = key[0].as_py()
        return net.post(1, g, bucket, np.full(len(bucket), g), parts)

    return run


def _answer_anchors(net: Net, hot_groups: int):
    """Messages (anchors that recur, those of them in many groups) back to groups."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, groups, messages = read_bundles(table)
        parts, sure, of = [], [], []
        for j, pair in enumerate(messages):
            for blob, flag in zip(pair, (False, True), strict=True):
                values = _from_bytes(blob)
                parts.append(values)
                sure.append(np.full(len(values), flag))
                of.append(np.full(len(values), j, dtype=np.int64))
        values, sure, of = np.concatenate(parts), np.concatenate(sure), np.concatenate(of)
        order = np.argsort(values, kind="stable")
        values, sure, of = values[order], sure[order], of[order]
        begin, end = tv.blocks(values)
        size = end - begin
        hit = (size > 1) | (np.logical_or.reduceat(sure, begin) if len(begin) else np.zeros(0, bool))
        hit, hot = np.repeat(hit, size), np.repeat(size > hot_groups, size)
        values, of, hot = values[hit], of[hit], hot[hit]
        order = np.argsort(groups[of], kind="stable")
        values, to, hot = values[order], groups[of[order]], hot[order]
        at, stop = tv.blocks(to)
        answers = [(_to_bytes(values[a:b]), _to_bytes(values[a:b][hot[a:b]])) for a, b in zip(at, stop, strict=True)]
        bucket = key[0].as_py()
        return net.post(1, bucket, to[at], np.full(len(at), bucket), answers)

    return run


#: A run's bytes, hashed; the least document of it; its size, negative where the bytes are
#: left out as an equal run on the same way has them.
_RUN = np.dtype([("content", "<u8"), ("id", "<i8"), ("size", "<i4")])


def _compressed(data: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(data), codec="zstd", asbytes=True)


def _bytes_of(runs: np.ndarray, blob) -> np.ndarray:
    size = int(np.maximum(runs["size"], 0).sum())
    return np.frombuffer(pa.decompress(pa.py_buffer(blob), decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)


def _bytes_of_some(some: np.ndarray, runs: np.ndarray, held: np.ndarray, of: np.ndarray, messages: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some runs alone, and where each begins; no more than one message is unpacked at a time."""
    picked = np.zeros(len(runs), dtype=bool)
    picked[some] = True
    kept = np.where(picked, held, 0)
    data = np.empty(int(kept.sum()), dtype=np.uint8)
    at = np.cumsum(kept) - kept
    bounds = np.searchsorted(of, np.arange(len(messages) + 1))
    for a, b, message in zip(bounds, bounds[1:], messages, strict=False):
        mine = picked[a:b]
        if mine.any():
            whole, size = _bytes_of(runs[a:b], message[1]), held[a:b]
            part = whole[tv.ragged((np.cumsum(size) - size)[mine], size[mine])]
            data[at[a] : at[a] + len(part)] = part
    return data, at[some]


def _send_runs(shape: Shape, net: Net, buckets: int):
    """Messages (runs, their bytes, hot anchors among them) to buckets."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        g = key[0].as_py()
        if not docs.num_rows or not answers.num_rows:
            return net.post(1, g, np.zeros(0, np.int64), np.zeros(0, np.int64), [])
        own = _Group(docs, shape)
        _, _, messages = read_bundles(answers)
        asked, hot = (np.sort(np.concatenate([_from_bytes(x) for x in column])) for column in zip(*messages, strict=True))
        first, last, anchor, route = own.pieces(hot)
        chosen = _among(_short(anchor), asked)
        first, last, anchor, route = first[chosen], last[chosen], anchor[chosen], route[chosen]
        content = span_hashes(own.data, first, last + shape.window)
        ids = own.owners(first)
        order = np.lexsort((ids, content))
        order = order[tv.firsts(content[order])]
        by, bucket, begin, stop = _route(route[order], buckets)
        order = order[by]
        size = last[order] - first[order] + shape.window
        runs = np.empty(len(order), dtype=_RUN)
        runs["content"], runs["id"], runs["size"] = content[order], ids[order], size
        short = _short(anchor[order])
        split = _among(short, hot)
        parts = [
            (runs[a:b].tobytes(), _compressed(own.data[tv.ragged(first[order[a:b]], size[a:b])]), _to_bytes(np.unique(short[a:b][split[a:b]])))
            for a, b in zip(begin, stop, strict=True)
        ]
        return net.post(1, g, bucket, np.full(len(bucket), g), parts)

    return run


def _bytes_once(parts: list[tuple]) -> list[tuple]:
    """Messages on one way, with the bytes of equal runs in the first of them alone."""
    runs = [np.frombuffer(x[0], dtype=_RUN).copy() for x in parts]
    whole = np.concatenate([_bytes_of(r, x[1]) for r, x in zip(runs, parts, strict=True)])
    of = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    every = np.concatenate(runs)
    size = np.maximum(every["size"], 0).astype(np.int64)
    begin = np.cumsum(size) - size
    # of equal runs the first with bytes keeps them
    order = np.lexsort((size == 0, every["content"]))
    keep = np.zeros(len(every), dtype=bool)
    keep[order[tv.firsts(every["content"][order])]] = True
    keep &= size > 0
    every["size"] = np.where(keep, every["size"], -np.abs(every["size"]))
    out = []
    for j, part in enumerate(parts):
        mine = np.flatnonzero(of == j)
        kept = mine[keep[mine]]
        out.append((every[mine].tobytes(), _compressed(whole[tv.ragged(begin[kept], size[kept])]), part[2]))
    return out


_REPLY = np.dtype([("content", "<u8"), ("first", "<u2"), ("last", "<u2")])


def _answer_runs(window: int, net: Net):
    """Messages (replies, hot anchors as they came) back to groups."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, groups, messages = read_bundles(table)
        runs = [np.frombuffer(x[0], dtype=_RUN) for x in messages]
        of = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        runs = np.concatenate(runs)
        held = np.maximum(runs["size"], 0).astype(np.int64)
        # equal runs are sorted once, for their least document, by the bytes of any of them
        order = np.lexsort((runs["id"], runs["content"]))
        lead = tv.firsts(runs["content"][order])
        kind = np.cumsum(lead) - 1
        least = runs["id"][order[lead]]
        full = np.lexsort((held == 0, runs["content"]))
        full = full[tv.firsts(runs["content"][full])]
        data, begin = _bytes_of_some(full, runs, held, of, messages)
        windows = held[full] - window + 1
        starts = tv.ragged(begin, windows)
        owner = np.repeat(np.arange(len(full)), windows)
        alive, group = repeated_windows(data, starts, window)
        removed = np.zeros(len(starts), dtype=bool)
        if len(alive):
            ids = least[owner[alive]]
            cut, end = tv.blocks(group)
            lowest = np.repeat(np.minimum.reduceat(ids, cut), end - cut)
            removed[alive] = ids > lowest
        first_window = np.cumsum(windows) - windows
        edge = tv.firsts(owner)
        up = np.flatnonzero(removed & (edge | ~np.append(False, removed[:-1])))
        down = np.flatnonzero(removed & (np.append(edge[1:], True) | ~np.append(removed[1:], False)))
        span_kind, a, b = owner[up], up - first_window[owner[up]], down - first_window[owner[up]]
        # copies under a larger document go whole; those under the least share its spans
        copy = runs["id"][order] > least[kind]
        whole = np.empty(int(copy.sum()), dtype=_REPLY)
        whole["content"], whole["first"], whole["last"] = runs["content"][order][copy], 0, windows[kind[copy]] - 1
        own = np.flatnonzero(~copy)
        low, high = np.searchsorted(span_kind, kind[own]), np.searchsorted(span_kind, kind[own], side="right")
        spot = tv.ragged(low, high - low)
        some = np.empty(len(spot), dtype=_REPLY)
        some["content"] = np.repeat(runs["content"][order][own], high - low)
        some["first"], some["last"] = a[spot], b[spot]
        replies = np.concatenate([whole, some])
        home = np.concatenate([of[order[copy]], np.repeat(of[order[own]], high - low)])
        by = np.argsort(home, kind="stable")
        replies, home = replies[by], home[by]
        low, high = np.searchsorted(home, np.arange(len(messages))), np.searchsorted(home, np.arange(len(messages)), side="right")
        told = [j for j in np.argsort(groups, kind="stable").tolist() if low[j] < high[j] or len(messages[j][2])]
        bucket = key[0].as_py()
        return net.post(1, bucket, groups[told], np.full(len(told), bucket), [(replies[low[j] : high[j]].tobytes(), bytes(messages[j][2])) for j in told])

    return run


def removed_bytes(own: _Group, replies: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which bytes of a group's documents go."""
    w = own.shape.window
    change = np.zeros(len(own.data) + 1, dtype=np.int32)
    first, last, _, _ = own.pieces(hot)
    content = span_hashes(own.data, first, last + w)
    ids = own.owners(first)
    order = np.lexsort((ids, content))
    sorted_content = content[order]
    lead = tv.firsts(sorted_content)
    kind = np.cumsum(lead) - 1
    least = ids[order][lead]
    later = ids[order] > least[kind] if len(order) else np.zeros(0, bool)
    gone = order[later]
    np.add.at(change, first[gone], 1)
    np.add.at(change, last[gone] + w, -1)
    replies = replies[np.argsort(replies["content"], kind="stable")]
    stay = order[~later]
    low = np.searchsorted(replies["content"], content[stay])
    count = np.searchsorted(replies["content"], content[stay], side="right") - low
    spot = tv.ragged(low, count)
    base = np.repeat(first[stay], count)
    np.add.at(change, base + replies["first"][spot], 1)
    np.add.at(change, base + replies["last"][spot] + w, -1)
    return np.cumsum(change[:-1], dtype=np.int32, out=change[:-1]) > 0


def _counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row; an Arrow column of strings has under 2^31 bytes."""
    before = np.zeros(len(flags) + 1, dtype=np.int32)
    np.cumsum(flags, dtype=np.int32, out=before[1:])
    return np.diff(before[offsets]).astype(np.int64)


_OUT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _apply(shape: Shape, with_text: bool):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Group(docs, shape)
        _, _, messages = read_bundles(answers)
        replies = np.concatenate([*(np.frombuffer(x, dtype=_REPLY) for x, _ in messages), np.zeros(0, _REPLY)])
        hot = np.unique(np.concatenate([*(_from_bytes(x) for _, x in messages), np.zeros(0, U64)]))
        gone = removed_bytes(own, replies, hot)
        n_bytes, n_removed = np.diff(own.offsets), _counts(gone, own.offsets)
        begin = gone & ~np.append(False, gone[:-1]) if len(gone) else gone
        at = own.offsets[:-1]
        first = at[at < len(gone)]
        begin[first] = gone[first]
        kept = memoryview(own.data[~gone])
        stay = np.cumsum(n_bytes - n_removed).tolist()
        pieces = [kept[a:b] for a, b in zip([0, *stay], stay, strict=False)]
        return pa.table({
            "id": pa.array(own.ids, pa.int64()),
            "n_bytes": pa.array(n_bytes),
            "n_removed": pa.array(n_removed),
            "n_spans": pa.array(_counts(begin, own.offsets)),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in pieces]),
            "kept": pa.array([str(x, "utf-8", "ignore") if with_text else None for x in pieces], pa.string()),
        })

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    group_bytes: int = 4 << 20,
    with_text: bool = False,
    fan: int = 2048,
    hot_groups: int = 256,
) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row.

    A byte goes if a ``window``-byte string that covers it also starts in a document of a
    smaller id. ``kept`` is the remaining text, without characters that were cut in half.

    Null and empty texts have no bytes; very long ones are one document, whole, in a group.
    Rows with one id are one document in this: they don't remove each other's bytes. Rows
    with a null id remove nothing and lose nothing. Ids are integers. An empty table gives no
    rows; other columns are ignored. ``window`` is 2 to 60,000 bytes. Messages go at most ``fan``
    ways a hop, and each further hop shuffles them once more; anchors in more than ``hot_groups``
    groups are split. Neither changes the result.
    """
    shape = Shape(window)
    groups = bucket_count(docs, group_bytes, text_col)
    net = Net(groups, fan)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = own.where("id is not null").withColumn("dest", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("long")).repartition(groups, "dest")
    asked = net.carry(named.groupBy("dest").applyInArrow(_send_anchors(shape, net, groups), net.SCHEMA))
    answered = net.carry(asked.groupBy("dest").applyInArrow(_answer_anchors(net, hot_groups), net.SCHEMA))
    runs = net.carry(named.groupBy("dest").cogroup(answered.groupBy("dest")).applyInArrow(_send_runs(shape, net, groups), net.SCHEMA), _bytes_once)
    # one query throughout, so that all three uses of the grouped texts share one exchange
    replies = net.carry(runs.groupBy("dest").applyInArrow(_answer_runs(window, net), net.SCHEMA))
    found = named.groupBy("dest").cogroup(replies.groupBy("dest")).applyInArrow(_apply(shape, with_text), _OUT)
    body = F.coalesce("text", F.lit(""))
    spared = own.where("id is null").select("id", F.octet_length(body).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"), body.alias("kept"))
    columns = [F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    return found.union(spared).select(*columns)
