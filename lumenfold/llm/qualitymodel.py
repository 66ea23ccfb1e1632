"""Quality classifier: hashed word n-grams, follow-the-regularised-leader (operator 3).

Features are occurrences of hashed word 1- and 2-grams, of 1- and 2-grams of word shapes, and
of 3-grams by whether the text had them before. Each kind's value is its share of the kind's
occurrences, so a score is a sparse dot product: the mean weight over occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import textvec as tv
from lumenfold.llm.labelled import MOST_BYTES, held_out, labelled_sample, train_in_one_task

U64 = np.uint64
BITS = 18
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = ord("A")
_CLASS[97:123] = ord("a")
_CLASS[48:58] = ord("0")
_CLASS[128:] = ord("a")


def occurrences(piece: tv.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, row, value) of every n-gram occurrence; a kind's values add up to 1 a row."""
    words = tv.find_words(piece.data, piece.offsets, tv.NOT_SPACE)
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
    own = tv.hash_spans(piece.data, words.starts, words.ends)
    shape = _CLASS[piece.data]
    change = np.append(True, shape[1:] != shape[:-1])
    change[words.starts] = True
    place = np.concatenate([[0], np.cumsum(change)])
    shapes = tv.hash_spans(shape[change], place[words.starts], place[words.ends])
    kinds = []
    for salt, tokens in ((1, own), (2, shapes)):
        for n in (1, 2):
            h, row = tv.ngram_hashes(tokens, words.counts, n, short=False)
            kinds.append((tv.mix(h ^ U64(salt * 16 + n)), row))
    h, row = tv.ngram_hashes(own, words.counts, 3, short=False)
    order = tv.order_by_row(h, row)
    again = np.zeros(len(h), dtype=U64)
    again[order] = ~tv.firsts(h[order], row[order])
    kinds.append((tv.mix(again + U64(77)), row))
    features, rows, values = [], [], []
    for h, row in kinds:
        count = np.bincount(row, minlength=piece.rows)
        features.append((h >> U64(64 - BITS)).astype(np.int64))
        rows.append(row)
        values.append(1.0 / count[row])
    return np.concatenate(features), np.concatenate(rows), np.concatenate(values)


def examples(texts: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, values) of each text, features distinct."""
    out = []
    for piece in tv.slices(texts):
        feature, row, value = occurrences(piece)
        key = row.astype(np.int64) << BITS | feature
        distinct, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, weights=value, minlength=len(distinct))
        cut = np.searchsorted(distinct, np.arange(piece.rows + 1, dtype=np.int64) << BITS)
        mask = (1 << BITS) - 1
        out += [(distinct[a:b] & mask, total[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def train_ftrl(xs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights, the last of them the bias, by FTRL-Proximal with per-coordinate rates."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(xs)):
            f = np.append(xs[k][0], size - 1)
            x = np.append(xs[k][1] * 4, 1.0)
            w = np.where(np.abs(z[f]) <= l1, 0.0, (np.sign(z[f]) * l1 - z[f]) / ((beta + np.sqrt(n[f])) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y[k]) * x
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - sigma * w
            n[f] += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    w[:-1] *= 4
    return w.astype(np.float32)


def _train(ids: np.ndarray, texts: pa.ChunkedArray, y: np.ndarray) -> bytes:
    return train_ftrl(examples(texts), y).tobytes()


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.3, most: int = 6000, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """(id_col, held_out, score, predicted) for each row of ``docs``.

    Trained on at most ``most`` labelled rows outside the held-out fold, with at most
    ``most_bytes`` bytes of text, in one task; without any, every score is 0.5. Texts alone
    are inputs. Ids are integers.

    Null and empty texts score by the bias; very long ones are read whole. Examples are taken
    in seeded orders, those of equal ids by text, so ties don't matter. Repeated rows score
    alike; a null id is not held out. Labels that are null or not 0 or 1 are ignored. An
    empty table gives no rows. Columns other than id and text are ignored.
    """
    weights = train_in_one_task(labelled_sample(docs, labels, label, most, id_col, text_col, most_bytes), _train)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(shared.value, dtype=np.float32)
        for batch in batches:
            for piece in tv.slices(batch.column(1)):
                feature, row, value = occurrences(piece)
                total = np.bincount(row, weights=w[feature] * value, minlength=piece.rows) + float(w[-1])
                score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.rows), pa.array(score)], names=["id", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = own.mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
