"""Secret scan: stated patterns, and a character convolutional network (operator 5).

The network reads every candidate, a long run of token characters with letters and digits,
and every pattern finding's value, with the text around it, and scores it. It is trained here,
in numpy, on labelled findings that a seeded generator writes from public credential formats
and from what resembles them, as no table has labels for secrets; its scores are calibrated
on a held-out part, and the threshold is the highest that keeps the stated recall there.
Pattern findings stay whatever the network says; candidates that reach the threshold are
added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import textvec as tv

# The contract's kinds, patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[A-Za-z0-9]{16,}")
LEFT, BODY, RIGHT = 24, 40, 8
WIDTH = LEFT + BODY + RIGHT
_PAD = 129


def _base(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, where the value starts) of the pattern findings, in order."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the pattern findings, by start and kind as listed."""
    return [(a, KINDS[k], b) for a, k, b, _ in _base(text)]


def candidates(text: str) -> list[tuple[int, int]]:
    """Bounds of the runs that the network judges."""
    return [m.span() for m in CANDIDATE.finditer(text) if _mixed(m[0])]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of a candidate's head with its surrounding context."""
    row = np.full(WIDTH, _PAD, dtype=np.int16)

    def put(piece: str, at: int) -> None:
        codes = np.array([min(ord(c), 128) for c in piece], dtype=np.int16)
        row[at : at + len(codes)] = codes

    left = text[max(0, start - LEFT) : start]
    put(left, LEFT - len(left))
    put(text[start : min(end, start + BODY)], LEFT)
    put(text[end : end + RIGHT], LEFT + BODY)
    return row


#: Windows of a longer candidate begin so far apart: a run of up to BODY - STEP + 1 characters
#: lies whole in one of them.
STEP = 8


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Encoded windows over the whole candidate, each with the context before the candidate;
    the last ends where it ends."""
    head = encode(text, start, end)
    if end - start <= BODY:
        return head[None]
    codes = np.minimum(np.frombuffer(text[start:end].encode("utf-32-le"), dtype=np.uint32), 128).astype(np.int16)
    begins = np.append(np.arange(0, end - start - BODY, STEP), end - start - BODY)
    rows = np.repeat(head[None], len(begins), axis=0)
    rows[:, LEFT : LEFT + BODY] = np.lib.stride_tricks.sliding_window_view(codes, BODY)[begins]
    return rows


def _mixed(run: str) -> bool:
    return bool(re.search("[0-9]", run) and re.search("[A-Za-z]", run))


def readings(text: str, start: int, end: int) -> np.ndarray:
    """What the network reads of a candidate: its windows, and those of its parts between
    signs, as a key may stand beside a path."""
    pieces = [windows(text, start, end)]
    for m in PART.finditer(text, start, end) if end - start > BODY else ():
        if _mixed(m[0]):
            part = windows(text, *m.span())
            part[:, :LEFT] = pieces[0][0, :LEFT]
            pieces.append(part)
    return np.concatenate(pieces) if len(pieces) > 1 else pieces[0]


def best_scores(text: str, spans: list[tuple[int, int]], model: SecretModel, batch: int = 512) -> list[float]:
    """The greatest calibrated score of each span's readings, a bounded batch at a time."""
    best = [0.0] * len(spans)
    held: list[np.ndarray] = []
    of: list[int] = []

    def flush() -> None:
        for k, x in zip(of, model.scores(np.concatenate(held)), strict=True):
            best[k] = max(best[k], float(x))
        held.clear()
        of.clear()

    for k, (a, b) in enumerate(spans):
        rows = readings(text, a, b)
        for at in range(0, len(rows), batch):
            some = rows[at : at + batch]
            held.append(some)
            of.extend([k] * len(some))
            if len(of) >= batch:
                flush()
    if held:
        flush()
    return best


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def labelled_findings(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Encoded findings and labels, half of each kind."""
    rng = np.random.default_rng(seed)

    def some(alphabet: str, n: int) -> str:
        return "".join(alphabet[k] for k in rng.integers(0, len(alphabet), n))

    def word(n: int | None = None) -> str:
        syllables = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "or", "ti", "ble", "ing", "ou", "chen", "ment", "que", "ado", "ver")
        return "".join(syllables[k] for k in rng.integers(0, len(syllables), n or int(rng.integers(1, 5))))

    def prose(n: int) -> str:
        return " ".join(word() for _ in range(n))

    secret = (
        lambda: some(_ALNUM, int(rng.integers(20, 44))),
        lambda: some(_ALNUM + "+/", int(rng.integers(24, 60))) + "=" * int(rng.integers(0, 3)),
        lambda: "ghp_" + some(_ALNUM, 36),
        lambda: "sk_live_" + some(_ALNUM, 24),
        lambda: "xoxb-" + some("0123456789", 12) + "-" + some(_ALNUM, 24),
        lambda: "eyJ" + some(_ALNUM + "_-", int(rng.integers(30, 60))),
        lambda: some("0123456789ABCDEF", int(rng.choice([32, 40, 64]))),
        lambda: word(1)[:5] + ("-", "_", ".")[int(rng.integers(3))] + some(_ALNUM + "_-", int(rng.integers(20, 40))),
        lambda: word(1)[:3] + "_v1_" + some("0123456789abcdef", int(rng.integers(32, 64))),
    )
    neutral = ("", "", "", "see ", "id ", "file ", "http://")
    lead = ("key ", "secret key ", "auth: ", "bearer ", "credential ", "access key ", "Authorization: ", "token is ", "use ", "client_secret -> ", "private key ", *neutral)
    plain = (
        lambda: f"{word(3)}{int(rng.integers(0, 100)):02d}mail{int(rng.integers(0, 10))}{word(2)}",
        lambda: "/".join([word(), word(), str(int(rng.integers(1, 9999))), word(2)]),
        lambda: "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        lambda: f"{word(2)}_{int(rng.integers(1990, 2030))}_{int(rng.integers(1, 13)):02d}_{word(2)}",
        lambda: f"{int(rng.integers(1990, 2030))}-{int(rng.integers(1, 13)):02d}-{int(rng.integers(1, 29)):02d}T{int(rng.integers(0, 24)):02d}-00-00",
        lambda: word(5) + str(int(rng.integers(0, 100))),
        lambda: word(3) + "-" + word(3) + "-" + str(int(rng.integers(0, 1000))),
        lambda: str(int(rng.integers(10**11, 10**12))) + word(2) + "-" + word(2),
        lambda: word(1).upper() + "-" + str(int(rng.integers(1000, 9999))) + "-" + word(2).upper() + "-" + str(int(rng.integers(1000, 9999))),
        lambda: "=" * int(rng.integers(8, 30)) + word(1) + str(int(rng.integers(0, 10))) + "=" * 8,
    )
    rows, labels = [], []
    for k in range(count):
        y = k % 2
        words = int(rng.integers(0, 4))
        before = prose(words) + " " if words else ""
        if y:
            item, before = secret[int(rng.integers(len(secret)))](), before + lead[int(rng.integers(len(lead)))]
        else:
            item, before = plain[int(rng.integers(len(plain)))](), before + neutral[int(rng.integers(len(neutral)))]
        after = ("", ".", ",", " ", "\n", '"')[int(rng.integers(6))] + " " + prose(2)
        rows.append(encode(before + item + after, len(before), len(before) + len(item)))
        labels.append(y)
    return np.array(rows), np.array(labels, dtype=float)


class CharCNN:
    """Embedding, one convolution, pooled apart over context and body, a logistic unit."""

    DIM, SPAN, FILTERS = 8, 5, 16

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.3, (130, self.DIM)),
            "w": rng.normal(0, 1 / np.sqrt(self.DIM * self.SPAN), (self.DIM * self.SPAN, self.FILTERS)),
            "b": np.zeros(self.FILTERS),
            "v": rng.normal(0, 0.2, 3 * self.FILTERS),
            "c": np.zeros(1),
        }

    def _forward(self, x: np.ndarray) -> tuple:
        emb = self.p["e"][x]
        n = WIDTH - self.SPAN + 1
        cols = np.concatenate([emb[:, j : j + n] for j in range(self.SPAN)], axis=2)
        act = np.maximum(0, cols @ self.p["w"] + self.p["b"])
        body = act[:, LEFT : LEFT + BODY - self.SPAN + 1]
        context = act[:, : LEFT - 1]
        top, near = body.argmax(1), context.argmax(1)
        real = (x[:, LEFT : LEFT + BODY - self.SPAN + 1] != _PAD)[:, :, None]
        share = real / np.maximum(1, real.sum(1, keepdims=True))
        pooled = np.concatenate([body.max(1), context.max(1), (body * share).sum(1)], axis=1)
        return cols, act, top, near, share, pooled, pooled @ self.p["v"] + self.p["c"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[k : k + 512])[-1] for k in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01) -> None:
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, f = 0, self.FILTERS
        for epoch in range(epochs):
            order = np.random.default_rng(epoch).permutation(len(x))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                xs = x[some]
                cols, act, top, near, share, pooled, z = self._forward(xs)
                d = (1 / (1 + np.exp(-z)) - y[some]) / len(some)
                g = {"v": pooled.T @ d, "c": np.array([d.sum()])}
                dp = d[:, None] * self.p["v"]
                da = np.zeros_like(act)
                i, j = np.arange(len(some))[:, None], np.arange(f)[None]
                np.add.at(da, (i, top + LEFT, j), dp[:, :f])
                np.add.at(da, (i, near, j), dp[:, f : 2 * f])
                da[:, LEFT : LEFT + BODY - self.SPAN + 1] += dp[:, None, 2 * f :] * share
                da *= act > 0
                g["w"] = np.tensordot(cols, da, axes=([0, 1], [0, 1]))
                g["b"] = da.sum((0, 1))
                dc = da @ self.p["w"].T
                de = np.zeros((len(some), WIDTH, self.DIM))
                n = WIDTH - self.SPAN + 1
                for s in range(self.SPAN):
                    de[:, s : s + n] += dc[:, :, s * self.DIM : (s + 1) * self.DIM]
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], xs, de)
                step += 1
                for k in self.p:
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


class SecretModel:
    """The trained network, its calibration, and its recall-constrained threshold."""

    def __init__(self, findings: int, recall: float, seed: int) -> None:
        x, y = labelled_findings(findings, seed)
        hold = np.arange(len(x)) // 2 % 4 == 0
        fit = ~hold
        self.network = CharCNN(seed)
        self.network.train(x[fit], y[fit])
        z, t = self.network.logits(x[hold]), y[hold]
        # temperature and offset by Newton steps on the held-out log loss
        a, b = 1.0, 0.0
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-5
            g = np.array([((p - t) * z).sum() + 0.5 * (a - 1), (p - t).sum() + 0.5 * b])
            h = np.array([[(w * z * z).sum() + 0.5, (w * z).sum()], [(w * z).sum(), w.sum() + 0.5]])
            da, db = np.linalg.solve(h, g)
            a, b = a - da, b - db
        self.slope, self.offset = max(a, 1e-2), b
        own = np.sort(self._calibrated(z)[t == 1])
        self.threshold = float(own[int(np.floor((1 - recall) * len(own)))])
        guess = self._calibrated(z) >= self.threshold
        self.recall, self.precision = float(guess[t == 1].mean()), float(t[guess].mean())

    def _calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._calibrated(self.network.logits(x))


@lru_cache(maxsize=4)
def trained_model(findings: int = 8000, recall: float = 0.99, seed: int = 7) -> SecretModel:
    return SecretModel(findings, recall, seed)


_RUN = np.zeros(256, dtype=bool)
_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_HEX = _DIGIT.copy()
_HEX[97:103] = True
_UPPER = _DIGIT.copy()
_UPPER[65:91] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(":"), ord("=")]] = True


def worth_reading(piece: tv.Slice) -> np.ndarray:
    """Rows that can have any finding: others have no sign and no long run."""
    data, offsets = piece.data, piece.offsets
    hit = np.zeros(piece.rows, dtype=bool)
    for mask, least in ((_SIGN, 1), (_HEX, LEAST_HEX), (_UPPER, LEAST_ACCESS), (_RUN, 16)):
        runs = tv.find_words(data, offsets, mask)
        long = runs.ends - runs.starts >= least
        if mask is _RUN and long.any():
            digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
            long &= digits[runs.ends] > digits[runs.starts]
        hit[runs.rows[long]] = True
    return hit


def scored_spans(text: str, model: SecretModel) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]], list[float]]:
    """(pattern spans, all spans, their scores); the network's spans have kind ``model``. Every
    candidate and every pattern finding's value is scored; a candidate is added unless a
    pattern span covers it wholly. A pattern finding scores as the best of its value and of
    the candidates that it covers."""
    found = _base(text)
    starts, reach = [x[0] for x in found], list(accumulate((x[2] for x in found), max))
    free, covered = [], []
    for a, b in candidates(text):
        k = bisect_right(starts, a)
        (covered if k and reach[k - 1] >= b else free).append((a, b))
    scores = best_scores(text, [*free, *covered, *((v, b) for _, _, b, v in found)], model)
    rank = {k: j for j, k in enumerate((*KINDS, "model"))}
    spans = [(a, "model", b, x) for (a, b), x in zip(free, scores, strict=False) if x >= model.threshold]
    # the candidates that a span covers begin in it one after another
    at = [a for a, _ in covered]
    inside = scores[len(free) : len(free) + len(covered)]
    for (a, k, b, _), x in zip(found, scores[len(free) + len(covered) :], strict=True):
        j = bisect_right(at, a - 1)
        while j < len(covered) and covered[j][0] < b:
            if covered[j][1] <= b:
                x = max(x, inside[j])
            j += 1
        spans.append((a, KINDS[k], b, x))
    spans.sort(key=lambda s: (s[0], rank[s[1]], s[2]))
    return [(a, KINDS[k], b) for a, k, b, _ in found], [(a, k, b) for a, k, b, _ in spans], [x for *_, x in spans]


def scan_text(text: str, model: SecretModel) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(pattern spans, all spans)."""
    return scored_spans(text, model)[:2]


def join_spans(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, str, int]], mask: str = "[SECRET]") -> str:
    """The text with each merged span replaced by ``mask``."""
    parts, at, stop = [], 0, -1
    for a, _, b in spans:
        if a >= stop:
            parts += [text[at:a], mask] if a >= at else []
            stop = b
        stop = max(stop, b)
        at = stop
    return "".join([*parts, text[at:]])


def secret_scan(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """The columns ``keep`` (default id_col), n_assign, n_access, n_hex, base_sha256, spans,
    scores and, with ``with_text``, the text with all spans masked.

    Spans are in code points, their ends exclusive, by start, then kind; ``scores`` are the
    network's calibrated scores of them, in their order. A null or empty text has no spans; a
    null one stays null when masked. Very long texts and runs are read whole, in bounded
    batches. Repeated rows are scanned alike; null ids stay null. An empty table gives no
    rows. Other columns are ignored, so their names can't clash.
    """
    keep = [id_col] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(trained_model())
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for piece in tv.slices(batch.column(at)):
                texts = batch.column(at).slice(piece.first, piece.rows)
                counts = np.zeros((3, piece.rows), dtype=np.int64)
                digest, joined = [nothing] * piece.rows, [""] * piece.rows
                scores: list[list[float]] = [[] for _ in range(piece.rows)]
                changed: dict[int, str] = {}
                for k in np.flatnonzero(worth_reading(piece)).tolist():
                    text = texts[k].as_py()
                    base, spans, scores[k] = scored_spans(text, model)
                    if not spans:
                        continue
                    for _, kind, _ in base:
                        counts[KINDS.index(kind), k] += 1
                    digest[k], joined[k] = hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans)
                    if with_text:
                        changed[k] = masked(text, spans)
                if changed:
                    new = texts.to_pylist()
                    for k, text in changed.items():
                        new[k] = text
                    texts = pa.array(new, pa.string())
                columns = [*(c.slice(piece.first, piece.rows) for c in batch.columns[:at]), *(pa.array(c) for c in counts), pa.array(digest), pa.array(joined), pa.array(scores, pa.list_(pa.float64()))]
                names = [*(f"k{j}" for j in range(at)), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"]
                if with_text:
                    columns, names = [*columns, texts.cast(pa.string())], [*names, "body"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    own = docs.select(*[F.col(c).alias(f"k{j}") for j, c in enumerate(keep)], F.col(text_col).cast("string").alias("body"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:at])
    schema = f"{fields}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores array<double>" + ", body string" * with_text
    out = own.mapInArrow(run, schema)
    extra = [F.col("body").alias("masked_text")] if with_text else []
    return out.select(*[F.col(f"k{j}").alias(c) for j, c in enumerate(keep)], "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores", *extra)
