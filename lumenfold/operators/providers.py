"""Injected services: batch functions over pandas frames, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import RATE_LIMITED

Batch = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def hashed_embedding(dim: int = 64, prefix: str = "") -> Batch:
    """Unit vectors from word hashes; a stand-in for an embedding service. A text without words,
    or whose words cancel out, lies on the axis of its own hash."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["chunk_text"]:
                v = np.zeros(dim, dtype=np.float64)
                for word in (prefix + (text or "")).lower().split():
                    h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                    v[h % dim] += 1.0 if h >> 63 else -1.0
                if not v.any():
                    v[int.from_bytes(hashlib.blake2b((prefix + (text or "")).encode(), digest_size=8).digest(), "big") % dim] = 1.0
                rows.append((v / float(np.linalg.norm(v))).astype(np.float32).tolist())
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "vector": rows})

    return embed


def embed_chunks(chunks: DataFrame, embed: Batch) -> DataFrame:
    """(chunk_id, vector) from an injected service over (chunk_id, chunk_text)."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "chunk_text").mapInPandas(embed, f"chunk_id {kind}, vector array<float>")


def embed_filter(chunks: DataFrame, least_chars: int = 3, least_body: int = 15) -> DataFrame:
    """Adds ``skip_reason``: parent, too_short, heading_only, or null for chunks to embed."""
    from lumenfold.functions.text import effective_body_length, strip

    text = F.coalesce(F.col("chunk_text"), F.lit(""))
    reason = F.when(F.col("chunk_level") == "parent", "parent").when(F.length(strip(text)) < least_chars, "too_short").when(effective_body_length(text) < least_body, "heading_only")
    return chunks.withColumn("skip_reason", reason)


def pending_embeddings(chunks: DataFrame, done: DataFrame, model: str, dim: int) -> DataFrame:
    """Chunks without a vector of this content, model and size: a resumable, incremental index."""
    from lumenfold.functions.text import normalized_hash

    keyed = chunks.withColumn("chunk_hash", normalized_hash(F.col("chunk_text")))
    known = done.where((F.col("model") == model) & (F.col("dim") == dim)).select("chunk_hash").distinct()
    return keyed.join(known, "chunk_hash", "left_anti")


def retrying(call: Callable, attempts: int = 6, base: float = 2.0, cap: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """item -> (result, error, tries, seconds waited). A rate limit is tried again after
    base, 2 base, 4 base ... seconds, ``cap`` at most; any other error isn't."""

    def run(item):
        waited = 0.0
        for k in range(1, attempts + 1):
            try:
                return call(item), None, k, waited
            except Exception as error:  # errors are results here
                if k == attempts or not re.search(RATE_LIMITED, str(error)):
                    return None, str(error), k, waited
                pause = min(cap, base * 2 ** (k - 1))
                waited += pause
                sleep(pause)

    return run


def search_web(queries: DataFrame, search: Callable[[str, int], list[dict]], max_results: int = 5) -> DataFrame:
    """(query_pos, result_pos, title, url, content, score, error) from an injected search of
    (query_pos, query_text); a query that fails gives one row with its error."""
    if not 1 <= max_results <= 20:
        raise ValueError("max_results is 1 to 20")
    fields = ("title", "url", "content", "score")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for pos, text in zip(pdf["query_pos"], pdf["query_text"], strict=True):
                try:
                    if not (text or "").strip():
                        raise ValueError("blank query")
                    rows += [(pos, k, *(r.get(f) for f in fields), None) for k, r in enumerate(search(text, max_results)[:max_results])]
                except Exception as error:  # errors are rows here
                    rows.append((pos, None, None, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["query_pos", "result_pos", *fields, "error"]).astype({"result_pos": "Int64", "score": "float64"})

    return queries.select("query_pos", "query_text").mapInPandas(run, "query_pos long, result_pos long, title string, url string, content string, score double, error string")


def research(requests: DataFrame, start: Callable[[str], dict], poll: Callable[[str], dict], deadline: float = 300.0, pause: float = 5.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(request_id, report, sources, error) of an injected research service: started, then
    polled until it has completed or failed, or until the deadline. Sources without a URL are
    dropped; a blank report is an error."""

    def one(prompt: str) -> tuple:
        state = start(prompt)
        name, end = state["id"], clock() + deadline
        while state.get("status") not in ("completed", "failed"):
            if clock() >= end:
                raise TimeoutError("research timed out")
            sleep(pause)
            state = poll(name)
        if state["status"] == "failed":
            raise RuntimeError("research failed")
        if not (state.get("report") or "").strip():
            raise ValueError("research gave no report")
        return state["report"].strip(), [s["url"] for s in state.get("sources") or [] if s.get("url")], None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, prompt in zip(pdf["request_id"], pdf["prompt"], strict=True):
                try:
                    rows.append((name, *one(prompt)))
                except Exception as error:  # errors are rows here
                    rows.append((name, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["request_id", "report", "sources", "error"])

    return requests.select("request_id", "prompt").mapInPandas(run, "request_id long, report string, sources array<string>, error string")


def scan_files(files: DataFrame, scan: Callable[[bytes], str], fail_closed: bool = True) -> DataFrame:
    """Adds verdict and route: a found threat goes to quarantine; anything but OK or FOUND, or
    an error, to retry, or is let through if the scan may fail open."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for content in pdf["content"]:
                try:
                    found.append(scan(content))
                except Exception as error:  # a scanner that is away is a verdict, too
                    found.append(f"ERROR {error}")
            yield pdf.assign(verdict=found)

    scanned = files.mapInPandas(run, f"{schema}, verdict string")
    other = F.lit("retry" if fail_closed else "accept")
    return scanned.withColumn("route", F.when(F.col("verdict") == "OK", "accept").when(F.endswith("verdict", F.lit("FOUND")), "quarantine").otherwise(other))


def ask_batch(questions: DataFrame, found: DataFrame, generate: Callable[[str], str], attempts: int = 6, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, question, answer, contexts, chunk_ids, generation_latency_ms, error): one row for
    each question. ``found`` has query_id, rank, chunk_id, page, source and context_text.
    Without a source, or after an error, the answer is empty; after an error the contexts are,
    too, and the latency is null."""
    from lumenfold.operators.evidence import build_prompts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = retrying(generate, attempts, sleep=sleep)
        for pdf in batches:
            rows = []
            for name, prompt in zip(pdf["query_id"], pdf["prompt"], strict=True):
                began = time.perf_counter()
                answer, error, _, _ = call(prompt)
                rows.append((name, answer, error, None if error else (time.perf_counter() - began) * 1000))
            yield pd.DataFrame(rows, columns=["query_id", "answer", "error", "generation_latency_ms"])

    asked = found.join(questions.select(F.col("id").alias("query_id"), F.col("question").alias("query_text")), "query_id")
    made = build_prompts(asked).mapInPandas(run, "query_id long, answer string, error string, generation_latency_ms double")
    item = F.struct("rank", F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(": "), "context_text").alias("text"), "chunk_id")
    held = found.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    joined = questions.join(made, F.col("id") == made["query_id"], "left").drop("query_id").join(held, F.col("id") == held["query_id"], "left")
    usable = F.when(F.col("error").isNull(), F.col("items"))
    none = F.array().cast("array<string>")
    return joined.select(
        "id", "question", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce(F.transform(usable, lambda x: x["text"]), none).alias("contexts"),
        F.coalesce(F.transform(usable, lambda x: x["chunk_id"].cast("string")), none).alias("chunk_ids"), F.coalesce("generation_latency_ms", F.when(F.col("error").isNull(), 0.0)).alias("generation_latency_ms"), "error",
    )


def memory_candidates(messages: DataFrame, extract: Callable[[str], str]) -> DataFrame:
    """(id, seq, memory_type, key, value) that an injected extractor reads from messages; what
    can't be read gives none."""
    kind = "array<struct<memory_type:string,key:string,value:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = []
            for text in pdf["text"]:
                try:
                    raw.append(extract(text))
                except Exception:  # no candidate is a result here
                    raw.append(None)
            yield pd.DataFrame({"id": pdf["id"], "raw": raw})

    made = messages.select("id", "text").mapInPandas(run, "id long, raw string")
    read = F.when(F.try_parse_json("raw").isNotNull(), F.from_json("raw", kind))
    return made.select("id", F.posexplode(read).alias("seq", "c")).select("id", "seq", "c.*").where("key is not null and value is not null")


def apply_service(rows: DataFrame, service: Batch, schema: str, concurrency: int | None = None) -> DataFrame:
    """Run a service over rows; ``concurrency`` caps the tasks that call it at once."""
    spread = rows.coalesce(concurrency) if concurrency else rows
    return spread.mapInPandas(service, schema)


def echo_generator(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in that answers a prompt with its length and first source."""
    for pdf in batches:
        yield pd.DataFrame({"query_id": pdf["query_id"], "answer": [f"{len(p)} characters [S1]" for p in pdf["prompt"]], "prompt_tokens": [len(p.split()) for p in pdf["prompt"]]})


NO_SOURCES = "No relevant passage was found."


def answer_questions(queries: DataFrame, found: DataFrame, generate: Batch) -> DataFrame:
    """(query_id, answer, prompt_tokens, citations): retrieval results to prompts to answers to
    citations. Queries without a source get a fixed answer and no call."""
    from lumenfold.operators.evidence import build_prompts, citations

    prompts = build_prompts(found)
    answers = prompts.mapInPandas(generate, "query_id long, answer string, prompt_tokens long")
    sources = found.select("query_id", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("marker"), "chunk_id")
    cited = citations(answers, sources).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("citations"))
    full = queries.select("query_id").join(answers, "query_id", "left").join(cited, "query_id", "left")
    return full.select("query_id", F.coalesce("answer", F.lit(NO_SOURCES)).alias("answer"), F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"), "citations")
