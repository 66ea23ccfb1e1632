"""Toxicity by nearest labelled examples under exact TF-IDF cosine (operator 1).

Terms are all lower-cased words of the labelled examples. A term's TF-IDF weight is scaled by
how surely it goes with a label, never to nought, so that rare words that say nothing about
the label don't decide who is near. Examples stand in a block-max inverted index. Most terms
are in few examples, and their postings are summed whole; those of frequent terms stand by
block, each block with its terms' greatest weights. A query bounds every block by those, scores
the few blocks of the greatest bounds, and then those alone that can still reach the k-th best
cosine. Votes weighted by inverse distance are calibrated on the examples' own leave-one-out
votes.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import textvec as tv
from lumenfold.llm.labelled import MOST_BYTES, held_out, labelled_sample, train_in_one_task

U64 = np.uint64


def term_counts(piece: tv.Slice, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of each row's distinct terms, in order; terms are hashes, or
    indices into ``vocabulary``."""
    data = tv.LOWER[piece.data]
    words = tv.find_words(data, piece.offsets, tv.ALNUM)
    term, row = tv.hash_spans(data, words.starts, words.ends), words.rows
    if vocabulary is not None:
        at = np.searchsorted(vocabulary, term)
        known = at < len(vocabulary)
        known[known] = vocabulary[at[known]] == term[known]
        term, row = at[known].astype(U64), row[known]
    order = tv.order_by_row(term, row)
    term, row = term[order], row[order]
    begin, end = tv.blocks(row, term)
    return row[begin], term[begin], end - begin


class BlockMaxIndex:
    """Unit vectors of examples; rows, terms and counts come ordered by row, then term.

    Postings of the rest of the terms stand by term. Those of frequent terms, at most
    ``wide`` of them, stand by block, as a dense piece of few columns with the greatest weight
    of each."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, size: int, factor: np.ndarray, block: int = 64, wide: int = 512) -> None:
        self.size, self.block = size, block
        self.df = np.bincount(terms, minlength=len(factor))
        self.idf = (np.log((1 + size) / (1 + self.df)) + 1) * factor
        weight = self.weigh(terms, counts)
        norm = np.sqrt(np.bincount(rows, weights=weight * weight, minlength=size))
        weight = weight / norm[rows]
        often = np.flatnonzero(self.df * 16 >= size)
        often = often[np.argsort(-self.df[often], kind="stable")[:wide]]
        self.column = np.full(len(factor), -1)
        self.column[often] = np.arange(len(often))
        dense = self.column[terms] >= 0
        self.dense = np.zeros((size, len(often)))
        self.dense[rows[dense], self.column[terms[dense]]] = weight[dense]
        self.begins = np.arange(0, size, block)
        self.most = np.maximum.reduceat(self.dense, self.begins, axis=0) if size else np.zeros((0, len(often)))
        order = np.lexsort((rows[~dense], terms[~dense]))
        self.rows, self.weights = rows[~dense][order], weight[~dense][order]
        self.start = np.searchsorted(terms[~dense][order], np.arange(len(factor)))

    def weigh(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts)) * self.idf[terms]

    def nearest(self, row: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, k: int, skip: np.ndarray | None = None, first: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and cosines of each of n queries' k nearest examples with a common term, ties
        by id; ``row`` is the query of each term, ``skip`` an example that each leaves out."""
        if not self.size or not len(terms):
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        q = self.weigh(terms, counts)
        q = q / np.sqrt(np.bincount(row, weights=q * q, minlength=n))[row]
        column = self.column[terms]
        often = column >= 0
        query = np.zeros((n, self.dense.shape[1]))
        query[row[often], column[often]] = q[often]
        # the sums over the rest of the terms are whole; they bound the cosines from below
        row, terms, q = row[~often], terms[~often], q[~often]
        length = self.df[terms]
        posting = tv.ragged(self.start[terms], length)
        at = np.repeat(row * self.size, length) + self.rows[posting]
        sums = np.bincount(at, weights=self.weights[posting] * np.repeat(q, length), minlength=n * self.size).astype(np.float64, copy=False).reshape(n, self.size)
        bound = np.maximum.reduceat(sums, self.begins, axis=1) + query @ self.most.T
        skipped = (np.arange(n), skip) if skip is not None else None

        def score(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                some = np.flatnonzero(wanted[:, b])
                low = self.begins[b]
                sums[some, low : low + self.block] += query[some] @ self.dense[low : low + self.block].T
            if skipped:
                sums[skipped] = 0.0

        best = np.zeros(bound.shape, dtype=bool)
        some = min(first, bound.shape[1])
        np.put_along_axis(best, np.argpartition(-bound, some - 1, axis=1)[:, :some], True, axis=1)
        score(best)
        k = min(k, self.size)
        # rounding is allowed for, so that a tie at the k-th place is seen
        last = -np.partition(-sums, k - 1, axis=1)[:, k - 1]
        score(~best & (bound > 0) & (bound >= last[:, None] - 1e-9))
        out = []
        last = -np.partition(-sums, k - 1, axis=1)[:, k - 1]
        for own, least in zip(sums, last, strict=True):
            ids = np.flatnonzero((own >= least - 1e-9) & (own > 0))
            scores = np.round(own[ids], 12)
            top = np.lexsort((ids, -scores))[:k]
            out.append((ids[top], scores[top]))
        return out


#: Queries that are scored at once: their sums are a dense piece of that many rows.
QUERIES = 128


def vote(y: np.ndarray, ids: np.ndarray, scores: np.ndarray, prior: float, strength: float = 0.5) -> float:
    """Share of toxic neighbours, weighted by inverse distance and drawn to the prior."""
    w = 1 / (1.05 - np.minimum(scores, 1.0))
    return float((w @ y[ids] + strength * prior) / (w.sum() + strength))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _platt(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over vote logits, with a positive slope."""
    a, b = 1.0, 0.0
    x = _logit(v)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-6
        g = np.array([np.sum((p - y) * x) + 0.1 * (a - 1), np.sum(p - y)])
        h = np.array([[np.sum(w * x * x) + 0.1, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 0.05), b


def label_factor(df: np.ndarray, hits: np.ndarray, prior: float, least: float = 0.05, spread: float = 4.0, half: float = 20.0) -> np.ndarray:
    """From ``least`` to 1: z squared over z squared plus ``half``, where z is by how many
    deviations a term's toxic examples miss the prior's share of its examples; ``spread`` is
    added to the variance, so that a rare term stays near ``least``."""
    z = (hits - df * prior) ** 2 / (df * prior * (1 - prior) + spread)
    return least + (1 - least) * z / (z + half)


class Model:
    """The index over the labelled examples, and the votes' calibration."""

    def __init__(self, ids: np.ndarray, texts: pa.ChunkedArray, y: np.ndarray, k: int) -> None:
        self.ids, self.y, self.k = ids, y, k
        rows, terms, counts = [], [], []
        for piece in tv.slices(texts):
            r, t, c = term_counts(piece, None)
            rows.append(r + piece.first)
            terms.append(t)
            counts.append(c)
        rows, terms, counts = (np.concatenate([*x, np.zeros(0, d)]) for x, d in ((rows, np.int64), (terms, U64), (counts, np.int64)))
        self.vocabulary, number = np.unique(terms, return_inverse=True)
        self.postings = rows.astype(np.int32), number.astype(np.int32), np.minimum(counts, 0xFFFF).astype(np.uint16)
        self._index()
        size, toxic = len(y), float(y.sum())
        v = self.votes(rows, number, self.postings[2], size, own=True)[0]
        self.slope, self.offset = _platt(v, y) if 0 < toxic < size else (1.0, 0.0)

    def _index(self) -> None:
        rows, terms, counts = (x.astype(np.int64) for x in self.postings)
        size = len(self.y)
        self.prior = (float(self.y.sum()) + 1) / (size + 2)
        df = np.bincount(terms, minlength=len(self.vocabulary)).astype(float)
        hits = np.bincount(terms, weights=self.y[rows], minlength=len(self.vocabulary)) if len(rows) else df
        self.index = BlockMaxIndex(rows, terms, counts, size, label_factor(df, hits, self.prior))

    def to_bytes(self) -> bytes:
        """Postings and calibration, packed; the index is built anew where they are read."""
        state = {k: v for k, v in self.__dict__.items() if k != "index"}
        return pa.compress(pickle.dumps(state), codec="zstd", asbytes=True) + len(pickle.dumps(state)).to_bytes(8, "little")

    @classmethod
    def of(cls, packed: bytes) -> Model:
        made = cls.__new__(cls)
        size = int.from_bytes(packed[-8:], "little")
        made.__dict__ = pickle.loads(pa.decompress(pa.py_buffer(packed)[:-8], decompressed_size=size, codec="zstd", asbytes=True))
        made._index()
        return made

    def empty(self) -> float:
        """The vote of a text without any known word: below every text with one neighbour."""
        return self.prior / 4

    def votes(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, own: bool = False) -> tuple[np.ndarray, list]:
        """Votes and neighbours of n texts; of the examples themselves without their ``own``."""
        v, found = np.full(n, self.empty()), []
        for begin in range(0, n, QUERIES):
            end = min(n, begin + QUERIES)
            a, b = np.searchsorted(rows, [begin, end])
            near = self.index.nearest(rows[a:b] - begin, terms[a:b], counts[a:b], end - begin, self.k, np.arange(begin, end) if own else None)
            for j, (ids, scores) in enumerate(near):
                if len(ids):
                    v[begin + j] = vote(self.y, ids, scores, self.prior)
            found += near
        return v, found

    def calibrated(self, v):
        return 1 / (1 + np.exp(-(self.slope * _logit(v) + self.offset)))


#: The model that this process read last, by its bytes.
_READ: dict[str, Model] = {}


def _model(packed: bytes) -> Model:
    name = hashlib.sha256(packed).hexdigest()
    if name not in _READ:
        _READ.clear()
        _READ[name] = Model.of(packed)
    return _READ[name]


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
    threshold: float = 0.5,
    most: int = 8000,
    k: int = 15,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """(id_col, held_out, score, predicted, evidence) for each row of ``docs``.

    ``evidence`` lists the (doc_id, cosine, label) of up to five nearest labelled examples.
    Examples are at most ``most`` labelled rows outside the held-out fold, with at most
    ``most_bytes`` bytes of text, indexed in one task; without any, every score is the
    prior's. Texts alone are inputs. Ids are integers.

    Null and empty texts, and texts without any word of the examples, score as nothing found,
    with no evidence. Very long texts are read whole. Of equally near examples the earlier in
    the order of ids counts. Repeated rows score alike; a null id is not held out. An empty
    table gives no rows. Columns other than id and text are ignored.
    """

    def train(ids, texts, y):
        return Model(ids, texts, y, k).to_bytes()

    model = train_in_one_task(labelled_sample(docs, labels, label, most, id_col, text_col, most_bytes), train)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for batch in batches:
            for piece in tv.slices(batch.column(1)):
                row, term, count = term_counts(piece, m.vocabulary)
                votes, near = m.votes(row.astype(np.int64), term.astype(np.int64), count, piece.rows)
                evidence = [[{"doc_id": int(m.ids[i]), "cosine": float(s), "label": int(m.y[i])} for i, s in zip(ids[:5], cosines[:5], strict=True)] for ids, cosines in near]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, piece.rows), pa.array(m.calibrated(votes)), pa.array(evidence, kind)], names=["id", "score", "evidence"]
                )

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = own.mapInArrow(run, "id long, score double, evidence array<struct<doc_id:bigint,cosine:double,label:int>>")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
