"""URL rules by hashed host-suffix and path-prefix expressions (operator 2).

Every URL expands into the host suffixes of as many labels, times the path prefixes of as many
characters, as rules have: never more than the rules call for, however long it is. Expressions
meet rules in an equi-join on four digest bytes; the full digest then
confirms, and the longest rule wins. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rules up to so many rows are broadcast (under 100 bytes each but for the rule itself).
BROADCAST_ROWS = 100_000
_SALTS = 16


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules like ("block", "example.com/en/") as (rule, verdict)."""
    return spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")


def _expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def match_url_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) for each row of ``pages``.

    A rule is a host and a path from its first slash on; it fits its host and all
    subdomains if the URL's path starts with its own. The longest rule wins, then the
    longer host; block wins over allow for one rule given twice. Without a fitting rule,
    rule is null and verdict ``default``.

    A null URL, or one without ``://``, has an empty host and path and fits no rule that has
    a host. A very long URL expands into no more expressions than the rules call for.
    Repeated rows are kept; null ids stay null. Null rules are ignored; without rules, or
    pages, there is nothing to fit, or no row. Up to BROADCAST_ROWS rules are broadcast, more
    are joined with salted expressions. Other columns are ignored.
    """
    slash = F.when(F.instr("rule", "/") > 0, F.instr("rule", "/")).otherwise(F.length("rule") + 1)
    host = F.translate(F.substr(F.col("rule"), F.lit(1), slash - 1), _UPPER, _UPPER.lower())
    path = F.substr(F.col("rule"), slash, F.length("rule"))
    split = rules.where("rule is not null").select("rule", "verdict", host.alias("h"), path.alias("p"))
    known = split.groupBy("h", "p").agg(
        F.min_by("rule", F.struct(F.length("rule"), "rule")).alias("rule"), F.when(F.max(F.col("verdict") == "block"), "block").otherwise(F.min("verdict")).alias("verdict")
    )
    known = known.select(
        "rule", "verdict", F.size(F.split("h", r"\.", -1)).alias("h_labels"), F.length("h").alias("h_len"), F.length("p").alias("p_len"), _expression(F.col("h"), F.col("p")).alias("digest")
    ).withColumn("short", _prefix(F.col("digest")))
    # a number, and the distinct sizes of paths and hosts, at most as many as the longest rule has characters
    shape = known.agg(F.count(F.lit(1)).alias("n"), F.collect_set("p_len").alias("lengths"), F.collect_set("h_labels").alias("labels")).first()
    lengths, suffixes = (F.array(*[F.lit(x) for x in sorted(shape[c])]).cast("array<int>") for c in ("lengths", "labels"))

    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    own = own.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    labels = F.split("host", r"\.", -1)
    count = F.size(labels)
    hosts = F.transform(F.filter(suffixes, lambda n: n <= count), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    digests = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: _expression(h, p))))
    # null stands for the row itself, and counts how often it occurs
    each = own.select("id", "host", "path", F.explode(F.concat(F.array(F.lit(None).cast("string")), digests)).alias("own_digest"))
    each = each.withColumn("own_short", _prefix(F.col("own_digest")))
    if shape["n"] <= BROADCAST_ROWS:
        met = each.join(F.broadcast(known), each["own_short"] == known["short"], "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        each = each.withColumn("own_salt", F.pmod(F.xxhash64("id", "path", "own_digest"), F.lit(_SALTS)).cast("int"))
        each = each.withColumn("own_short", F.coalesce("own_short", F.concat(F.lit("row"), F.xxhash64("id", "path").cast("string"))))
        met = each.join(salted, (each["own_short"] == salted["short"]) & (each["own_salt"] == salted["salt"]), "left")
    fits = F.col("own_digest") == F.col("digest")
    best = F.max(F.when(fits, F.struct((F.col("h_len") + F.col("p_len")).alias("length"), "h_len", "rule", "verdict")))
    judged = met.groupBy("id", "host", "path").agg(best.alias("best"), F.count_if(F.col("own_digest").isNull()).alias("copies"))
    one = judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "copies"
    )
    return one.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
