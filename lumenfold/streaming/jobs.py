"""Ingestion jobs: an in-flight guard by hashes and a stage machine, as a fold in batch and as
a keyed stateful stream.

Events of a scope (one user's project) in order: a submission with the hashes of its file and
of its content, then the outcomes of its stages. A submission is refused while a job with
either hash is under way, and after one has completed; a failed job frees its hashes. A job
without an event for ``stale`` seconds fails, and so frees them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumenfold.streaming.state import STAGES, _folded, _seconds

#: What an event has: a submission's stage is null, and only it has hashes.
EVENT = "scope string, seq long, at timestamp, job_id string, file_sha256 string, content_sha256 string, stage string, ok boolean"
ADDED = "status string, reason string"


class JobBook:
    """The fold over one scope's events. ``jobs`` maps a job to (stages done, file hash, content
    hash, time of its last event), ``held`` a hash to the job that holds it, with ``done`` for
    good; both are mappings with get, put and drop, in memory or in a state store."""

    def __init__(self, jobs, held, stale: float) -> None:
        self.jobs, self.held, self.stale = jobs, held, stale

    def _free(self, job_id: str) -> None:
        _, file, content, _ = self.jobs.get(job_id)
        for h in (f"f:{file}", f"c:{content}"):
            if self.held.get(h) == (job_id, False):
                self.held.drop(h)
        self.jobs.drop(job_id)

    def expired(self, job_id: str, now: float) -> bool:
        job = self.jobs.get(job_id)
        if job is None or now < job[3] + self.stale:
            return False
        self._free(job_id)
        return True

    def _taken(self, h: str | None, kind: str, now: float) -> str | None:
        if h is None:
            return None
        held = self.held.get(f"{kind}:{h}")
        if held is None or (not held[1] and self.expired(held[0], now)):
            return None
        name = {"f": "file", "c": "content"}[kind]
        return f"{name} is known" if held[1] else f"{name} is under way"

    def apply(self, now: float, job_id: str, file: str | None, content: str | None, stage: str | None, ok: bool | None) -> tuple[str, str | None]:
        """(status, reason) of an event."""
        if stage is None:
            if self.jobs.get(job_id) is not None and not self.expired(job_id, now):
                return "refused", "job is under way"
            reason = self._taken(file, "f", now) or self._taken(content, "c", now)
            if reason:
                return "refused", reason
            self.jobs.put(job_id, (0, file, content, now))
            for kind, h in (("f", file), ("c", content)):
                if h is not None:
                    self.held.put(f"{kind}:{h}", (job_id, False))
            return "queued", None
        job = self.jobs.get(job_id)
        if job is None:
            return "ignored", "no such job"
        if self.expired(job_id, now):
            return "failed", "stale"
        done, file, content, _ = job
        if stage not in STAGES or STAGES.index(stage) != done:
            return "ignored", "stage is out of order"
        if not ok:
            self._free(job_id)
            return "failed", stage
        if done + 1 < len(STAGES):
            self.jobs.put(job_id, (done + 1, file, content, now))
            return "running", stage
        self.jobs.drop(job_id)
        for kind, h in (("f", file), ("c", content)):
            if h is not None:
                self.held.put(f"{kind}:{h}", (job_id, True))
        return "completed", stage


class _Held(dict):
    put = dict.__setitem__

    def drop(self, key) -> None:
        self.pop(key, None)


def _text(x) -> str | None:
    return None if x is None or x != x else str(x)


def _events(pdf: pd.DataFrame) -> Iterator[tuple]:
    """What ``JobBook.apply`` takes, row by row; columns are converted once a frame."""
    texts = ([_text(x) for x in pdf[c].tolist()] for c in ("file_sha256", "content_sha256", "stage"))
    ok = [None if x is None or x != x else bool(x) for x in pdf["ok"].tolist()]
    return zip(_seconds(pdf["at"]), map(str, pdf["job_id"].tolist()), *texts, ok, strict=True)


def job_outcomes(events: DataFrame, stale: float = 3600.0) -> DataFrame:
    """Adds status and reason to each event: queued, refused, running, completed, failed or
    ignored. A scope's events are one sequence, by seq; what is held is its jobs under way and
    the hashes it has taken in. A repeated seq is taken in the order of job and stage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, book = object(), None
        for pdf in batches:
            out = []
            for scope, event in zip(pdf["scope"].tolist(), _events(pdf), strict=True):
                if scope != now:
                    now, book = scope, JobBook(_Held(), _Held(), stale)
                out.append(book.apply(*event))
            yield pdf.assign(status=[x for x, _ in out], reason=[y for _, y in out])

    return _folded(events, "scope", None, ["seq", "job_id", "stage"], run, ADDED)


class _Stored:
    """A state store's map as the fold wants it: rows to tuples and back, by scope. Between
    ``begin`` and ``flush`` an entry is read once at most, none if the bucket at hand has no
    entries, and only what has changed by the end is written: each is a message to the store."""

    def __init__(self, state, read, write) -> None:
        self.state, self.read, self.write = state, read, write
        self.begin()

    def begin(self) -> None:
        self.some, self.scope, self.stored, self.now = None, None, {}, {}

    def get(self, name: str):
        key = (self.scope, name)
        if key not in self.now:
            if self.some is None:
                self.some = self.state.exists()
            row = self.state.getValue(key) if self.some else None
            self.stored[key] = self.now[key] = None if row is None else self.read(row)
        return self.now[key]

    def put(self, name: str, value) -> None:
        self.now[self.scope, name] = value

    def drop(self, name: str) -> None:
        self.get(name)
        self.now[self.scope, name] = None

    def flush(self) -> None:
        for key, value in self.now.items():
            if value is not None and value != self.stored.get(key):
                self.state.updateValue(key, self.write(value))
            elif value is None and self.stored.get(key) is not None:
                self.state.removeKey(key)


#: Scopes are dealt to this many keys of the state: a key costs a micro-batch more than its rows
#: do. A checkpoint can't be read with another number.
STATE_BUCKETS = 4_096
#: The store has no nulls inside its keys and values.
_NOTHING = "\x00"


class JobProcessor(StatefulProcessor):
    """The fold over a stream's events, a bucket of scopes at a time. Hashes that are known are kept for ``keep`` seconds (0:
    for good) by the store itself; a timer fails jobs that hear nothing for ``stale`` seconds,
    as soon as the store's clock says so, and answers with a row of their own."""

    def __init__(self, stale: float, keep: float, use_timers: bool) -> None:
        self.stale, self.keep, self.use_timers = stale, keep, use_timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        jobs = handle.getMapState("jobs", "scope string, job_id string", "done int, file string, content string, at double")
        held = handle.getMapState("held", "scope string, hash string", "job_id string, known boolean", int(self.keep * 1000) if self.keep else None)
        blank = lambda x: None if x == _NOTHING else x
        self.jobs = _Stored(jobs, lambda r: (int(r[0]), blank(r[1]), blank(r[2]), float(r[3])), lambda v: (v[0], _NOTHING if v[1] is None else v[1], _NOTHING if v[2] is None else v[2], v[3]))
        self.held = _Stored(held, lambda r: (r[0], bool(r[1])), tuple)
        self.book = JobBook(self.jobs, self.held, self.stale)

    def _begin(self) -> None:
        self.jobs.begin()
        self.held.begin()

    def _turn(self, scope: str) -> None:
        self.jobs.scope = self.held.scope = scope

    def _flush(self) -> None:
        self.jobs.flush()
        self.held.flush()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a micro-batch's rows of a bucket come in no order
        frames = list(rows)
        pdf = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        scopes = [_NOTHING if x is None else x for x in map(_text, pdf["scope"].tolist())]
        seqs, names, stages = pdf["seq"].tolist(), pdf["job_id"].tolist(), [_text(x) or "" for x in pdf["stage"].tolist()]
        order = sorted(range(len(pdf)), key=lambda n: (scopes[n], seqs[n], names[n], stages[n]))
        events, out = list(_events(pdf)), []
        self._begin()
        for n in order:
            self._turn(scopes[n])
            out.append(self.book.apply(*events[n]))
        self._flush()
        if self.use_timers and any(s in ("queued", "running") for s, _ in out):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.stale * 1000))
        given = pdf["scope"].tolist()
        yield pd.DataFrame({"scope": [given[n] for n in order], "seq": [seqs[n] for n in order], "job_id": [names[n] for n in order], "status": [x for x, _ in out], "reason": [y for _, y in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        late = []
        self._begin()
        for scope, job_id in [tuple(k) for k in self.jobs.state.keys()]:
            self._turn(scope)
            if self.book.expired(job_id, now):
                late.append((None if scope == _NOTHING else scope, job_id))
        self._flush()
        yield pd.DataFrame({"scope": [x for x, _ in late], "seq": [-1] * len(late), "job_id": [x for _, x in late], "status": ["failed"] * len(late), "reason": ["stale"] * len(late)})

    def close(self) -> None:
        pass


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_store(spark: SparkSession):
    """While a stream is started: the store that keyed state with timers needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def job_outcomes_stream(events: DataFrame, stale: float = 3600.0, keep: float = 0.0, timers: bool = True) -> DataFrame:
    """scope, seq, job_id, status and reason of a stream of events, as ``job_outcomes`` has
    them, and a row with seq -1 of each job that a timer ends. Start its query within
    ``keyed_store``."""
    mode = "processingTime" if timers else "none"
    bucket = F.pmod(F.xxhash64("scope"), F.lit(STATE_BUCKETS)).cast("int")
    return events.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=JobProcessor(stale, keep, timers), outputStructType="scope string, seq long, job_id string, status string, reason string", outputMode="append", timeMode="processingTime" if keep else mode
    )


def job_table(outcomes: DataFrame) -> DataFrame:
    """(scope, job_id, status, reason): what the last event that counted made of each job."""
    counted = outcomes.where("status <> 'ignored'")
    last = counted.groupBy("scope", "job_id").agg(F.max_by(F.struct("status", "reason"), "seq").alias("last"))
    return last.select("scope", "job_id", "last.*")
