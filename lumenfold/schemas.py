"""Account and chat tables, with their keys as assertions."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "users": ("user_id string, email string, password_hash string, created_at timestamp", ("user_id",)),
    "sessions": ("token_hash string, user_id string, expires_at timestamp", ("token_hash",)),
    "chats": ("chat_id string, user_id string, title string, state string, created_at timestamp, updated_at timestamp", ("chat_id",)),
    "messages": ("id bigint, chat_id string, user_id string, role string, payload string, created_at timestamp", ("id",)),
    "memories": ("user_id string, chat_id string, memory_type string, key string, value string, confidence double", ("user_id", "chat_id", "memory_type", "key")),
    "profiles": ("user_id string, chat_id string, profile map<string,string>", ("user_id", "chat_id")),
}


def violations(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that are null or occur more than once."""
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.col(k).isNull()
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | bad)


#: Conditions that rows of a table must meet, as SQL.
CHECKS: dict[str, tuple[str, ...]] = {
    "users": ("email like '%@%'",),
    "sessions": ("length(token_hash) = 64",),
    "chats": ("length(title) between 1 and 120",),
    "messages": ("role in ('user', 'assistant')",),
    "memories": ("length(key) between 1 and 64", "confidence between 0 and 1"),
}


def broken_checks(name: str, rows: DataFrame) -> DataFrame:
    """(check, n): how many rows break each condition of a table; a null breaks none."""
    conditions = CHECKS.get(name, ())
    counts = [F.count_if(F.coalesce(~F.expr(c), F.lit(False))).alias(f"c{k}") for k, c in enumerate(conditions)]
    one = rows.agg(F.count(F.lit(1)).alias("rows"), *counts)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"c{k}").alias("n")) for k, c in enumerate(conditions)])))


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds; unknown keys of a mapping are ignored and absent ones keep their default."""

    meaningful_ratio: float = 0.4
    header_share: float = 0.6
    header_zone: int = 3
    chunk_size: int = 450
    chunk_overlap: int = 75
    table_group: int = 15
    infographic_threshold: float = 0.6

    @classmethod
    def of(cls, given: dict) -> EngineConfig:
        known = {f.name: f.type for f in fields(cls)}
        if unknown := sorted(set(given) - set(known)):
            log.warning("unknown keys of the configuration are ignored: %s", unknown)
        return cls(**{k: v for k, v in given.items() if k in known})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EngineConfig:
        """From a JSON file on any path that Spark reads; a missing or unreadable one gives
        the defaults, with a warning."""
        try:
            text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
            given = json.loads(text)
            if not isinstance(given, dict):
                raise ValueError("not an object")
        except (AnalysisException, ValueError) as why:
            log.warning("configuration %s can't be read, defaults are used: %s", path, type(why).__name__)
            return cls()
        return cls.of(given)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.name, float(getattr(self, f.name))) for f in fields(self)], "key string, value double")
