"""A versioned, hash-bucketed table that is updated in place of being rebuilt.

    path/data/<commit>/bucket=<n>/part-...    what one commit wrote
    path/versions/<number>.json               which commits a version is made of

A commit is a folder of base rows, upserts or deletes; only the buckets of the keys it holds
have files. A version is the list of its commits, renamed into place in one step: until then
readers see the version before it, whatever was written. Readers of some keys read the buckets
of those keys alone. ``compact`` folds the commits of chosen buckets into new base rows, and
``vacuum`` deletes what no kept version names.

A version's list has an entry for each commit since the last compaction, none for files or
rows, so it stays small however large the table is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lumenfold.scratch import small_enough

BASE, UPSERT, DELETE = "base", "upsert", "delete"
#: Keys or rows of a delta that are broadcast at most; beyond that they are shuffled.
BROADCAST_ROWS = 200_000


class ConflictError(RuntimeError):
    """Another writer has committed since this one read the table."""


class VersionedTable:
    """``keys`` are unique in every version. ``buckets`` is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- files of versions

    def _write_text(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        own = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(own)] if self._fs.exists(own) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no version of a table in {self.path}")
        return json.loads(self._read_text(f"{self.path}/versions/{known[-1] if version is None else version:012d}.json"))

    def _publish(self, manifest: dict) -> dict:
        """Claim the number, then rename the list into place: one writer alone gets a number."""
        number = manifest["version"]
        claim = self._path(f"{self.path}/versions/{number:012d}.claim")
        self._fs.mkdirs(self._path(f"{self.path}/versions"))
        if not self._fs.createNewFile(claim):
            raise ConflictError(f"version {number} of {self.path} is another writer's")
        draft = f"{self.path}/versions/{uuid.uuid4().hex}.draft"
        self._write_text(draft, json.dumps(manifest))
        if not self._fs.rename(self._path(draft), self._path(f"{self.path}/versions/{number:012d}.json")):
            raise ConflictError(f"version {number} of {self.path} couldn't be published")
        return manifest

    def forget_claims(self) -> None:
        """Free the numbers of writers that ended between claim and rename."""
        done = {f"{v:012d}.claim" for v in self.versions()}
        for name in self._names("versions"):
            if name.endswith(".claim") and name not in done or name.endswith(".draft"):
                self._fs.delete(self._path(f"{self.path}/versions/{name}"), False)

    # ---- writing

    def bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(*manifest["keys"]), F.lit(manifest["buckets"])).cast("int")

    def _write(self, rows: DataFrame, manifest: dict, kind: str) -> dict | None:
        """One commit's folder; None if there is no row."""
        name = uuid.uuid4().hex
        dealt = rows.withColumn("bucket", self.bucket(manifest))
        # a bucket's rows go to one file each, a large one's to several by the key's own hash
        spread = F.pmod(F.xxhash64(F.lit(1), *manifest["keys"]), F.lit(manifest["files"]))
        dealt.repartition("bucket", spread).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/data/{name}")
        buckets = sorted(int(n[7:]) for n in self._names(f"data/{name}") if n.startswith("bucket="))
        return {"name": name, "kind": kind, "buckets": buckets} if buckets else None

    def create(self, rows: DataFrame, keys: list[str], buckets: int = 64, files: int = 1) -> dict:
        """The first version. ``keys`` must be unique in ``rows`` and not null; ``files`` splits
        each bucket of a commit."""
        if "bucket" in rows.columns:
            raise ValueError("bucket is the table's own column")
        manifest = {"version": 1, "keys": keys, "buckets": buckets, "files": files, "schema": rows.schema.json(), "commits": [], "tags": {}}
        commit = self._write(rows, manifest, BASE)
        return self._publish(manifest | {"commits": [commit] if commit else []})

    def commit(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, tag: tuple[str, int] | None = None) -> dict:
        """Rows that replace those of their keys or are new, and keys whose rows go; a key in
        both stays. Upserts have the table's columns and distinct keys. With a ``tag`` (writer,
        number) that the table has already, nothing is done: a stream's batch counts once."""
        before = self.manifest()
        if tag and before["tags"].get(tag[0], -1) >= tag[1]:
            return before
        new = []
        if deletes is not None:
            new.append(self._write(deletes.select(*before["keys"]).distinct(), before, DELETE))
        if upserts is not None:
            new.append(self._write(upserts.select(*self.schema(before).names), before, UPSERT))
        new = [c for c in new if c]
        tags = before["tags"] | ({tag[0]: tag[1]} if tag else {})
        if not new and tags == before["tags"]:
            return before
        return self._publish(before | {"version": before["version"] + 1, "commits": before["commits"] + new, "tags": tags})

    def compact(self, buckets: Iterable[int] | None = None) -> dict:
        """A version with the same rows, in which the chosen buckets are base rows alone."""
        before = self.manifest()
        changed = {b for c in before["commits"] if c["kind"] != BASE for b in c["buckets"]}
        chosen = sorted(changed & set(buckets) if buckets is not None else changed)
        if not chosen:
            return before
        commit = self._write(self._rows(before, chosen), before, BASE)
        kept = [c | {"buckets": [b for b in c["buckets"] if b not in chosen]} for c in before["commits"]]
        kept = [c for c in kept if c["buckets"]]
        return self._publish(before | {"version": before["version"] + 1, "commits": ([commit] if commit else []) + kept})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete folders that none of the last ``keep`` versions names, and older versions.
        Not while a writer is at work, whose folder no version names yet."""
        versions = self.versions()
        named = {c["name"] for v in versions[-keep:] for c in self.manifest(v)["commits"]}
        gone = [n for n in self._names("data") if n not in named]
        for name in gone:
            self._fs.delete(self._path(f"{self.path}/data/{name}"), True)
        for v in versions[:-keep]:
            for kind in ("json", "claim"):
                self._fs.delete(self._path(f"{self.path}/versions/{v:012d}.{kind}"), False)
        return gone

    # ---- reading

    def schema(self, manifest: dict | None = None) -> StructType:
        return StructType.fromJson(json.loads((manifest or self.manifest())["schema"]))

    def _part(self, manifest: dict, commit: dict, buckets: list[int], columns: list[str]) -> DataFrame:
        schema = self.schema(manifest)
        own = StructType([f for f in schema.fields if f.name in (manifest["keys"] if commit["kind"] == DELETE else schema.names)])
        names = [c for c in columns if c in own.names]
        rows = self.spark.read.schema(own.add("bucket", IntegerType())).parquet(f"{self.path}/data/{commit['name']}")
        return rows.where(F.col("bucket").isin(buckets)).select(*names)

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """The version's rows of some buckets. Base rows without a newer commit in their bucket
        are read as they are; others are merged with the newest of each key."""
        schema, keys = self.schema(manifest), manifest["keys"]
        wanted = set(range(manifest["buckets"]) if buckets is None else buckets)
        commits = [(n, c, sorted(wanted & set(c["buckets"]))) for n, c in enumerate(manifest["commits"])]
        commits = [x for x in commits if x[2]]
        changed = {b for _, c, own in commits if c["kind"] != BASE for b in own}
        parts, old, delta = [], [], []
        for n, c, own in commits:
            if c["kind"] == BASE:
                if plain := [b for b in own if b not in changed]:
                    parts.append(self._part(manifest, c, plain, schema.names))
                if mixed := [b for b in own if b in changed]:
                    old.append(self._part(manifest, c, mixed, schema.names))
            else:
                rows = self._part(manifest, c, own, schema.names)
                whole = F.lit(None).cast(schema.simpleString()) if c["kind"] == DELETE else F.struct(*schema.names)
                delta.append(rows.select(*keys, F.lit(n).alias("_nth"), whole.alias("_row")))
        if delta:
            union = delta[0]
            for d in delta[1:]:
                union = union.unionByName(d)
            newest = union.groupBy(*keys).agg(F.max_by("_row", "_nth").alias("_row"))
            touched = newest.select(*keys)
            for rows in old:
                few = F.broadcast(touched) if small_enough(touched, BROADCAST_ROWS) else touched
                parts.append(rows.join(few, keys, "left_anti").select(*schema.names))
            parts.append(newest.where("_row is not null").select("_row.*"))
        else:
            parts += old
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def read_keys(self, wanted: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of the keys in ``wanted``, from their buckets alone. The driver gets the
        numbers of those buckets, as many as the table has at most."""
        manifest = self.manifest(version)
        keys = manifest["keys"]
        found = wanted.select(self.bucket(manifest).alias("b")).distinct().collect()
        return self._rows(manifest, sorted(r["b"] for r in found)).join(wanted.select(*keys).distinct(), keys, "left_semi")

    def merge_new(self, rows: DataFrame, tag: tuple[str, int] | None = None) -> dict:
        """Append the rows whose keys the table doesn't have: the ingestion of new content. Of
        equal keys in ``rows``, one is taken."""
        keys = self.manifest()["keys"]
        own = rows.dropDuplicates(keys)
        return self.commit(own.join(self.read_keys(own).select(*keys), keys, "left_anti"), tag=tag)
