"""The versioned table: commits, versions, pruning, killed writers, streams."""

from __future__ import annotations

import re

import pytest

from lumenfold.sources import versioned
from lumenfold.sources.versioned import ConflictError, VersionedTable
from lumenfold.streaming import state


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, text string, tags map<string,string>")


def table(spark, path, n=40):
    t = VersionedTable(spark, str(path))
    t.create(rows(spark, *[(k, f"t{k}", {"k": str(k)}) for k in range(n)]), ["id"], buckets=8)
    return t


def read(t, version=None):
    return {r["id"]: r["text"] for r in t.read(version).collect()}


def test_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    before = read(t)
    t.commit(rows(spark, (3, "three", None), (100, "new", {"a": "b"})), spark.createDataFrame([(4,), (5,), (999,)], "id long"))
    after = {k: v for k, v in before.items() if k not in (4, 5)} | {3: "three", 100: "new"}
    assert read(t) == after and read(t, 1) == before
    t.commit(rows(spark, (5, "again", None)), spark.createDataFrame([(5,), (100,)], "id long"))
    after = {k: v for k, v in after.items() if k != 100} | {5: "again"}
    assert read(t) == after
    assert {r["id"]: r["tags"] for r in t.read().collect()}[7] == {"k": "7"}
    t.compact([0, 1, 2])
    assert read(t) == after
    t.compact()
    assert read(t) == after and all(c["kind"] == "base" for c in t.manifest()["commits"])
    assert t.compact()["version"] == t.versions()[-1]  # nothing is left to do
    assert t.vacuum() and t.versions() == [5] and read(t) == after


@pytest.mark.parametrize("few", [0, 1000])
def test_keys_read_their_buckets_alone(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(versioned, "BROADCAST_ROWS", few)
    t = table(spark, tmp_path)
    t.commit(rows(spark, (1, "one", None)))
    wanted = spark.createDataFrame([(1,), (2,), (777,)], "id long")
    buckets = {r[0] for r in wanted.select(t.bucket(t.manifest())).collect()}
    found = t.read_keys(wanted)
    assert {r["id"]: r["text"] for r in found.collect()} == {1: "one", 2: "t2"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
    assert filters and len(buckets) < 8
    for f in filters:  # every scan is cut to buckets of the keys
        assert {int(x) for x in re.findall(r"(?<=[ (,])\d+(?=[,)])", re.sub(r"#\d+", "", f))} <= buckets, f


def test_a_killed_commit_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    before = read(t)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(VersionedTable, "_publish", killed)
        t.commit(rows(spark, (1, "lost", None)))
    assert read(t) == before and t.versions() == [1]
    t.commit(rows(spark, (2, "kept", None)))
    assert read(t) == before | {2: "kept"}
    assert len(t.vacuum(keep=2)) == 1 and read(t) == before | {2: "kept"}
    # between claim and rename: the number is taken until it is freed
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(VersionedTable, "_write_text", killed)
        t.commit(rows(spark, (3, "lost", None)))
    assert read(t)[3] == "t3"
    with pytest.raises(ConflictError):
        t.commit(rows(spark, (3, "late", None)))
    t.forget_claims()
    t.commit(rows(spark, (3, "late", None)))
    assert read(t)[3] == "late"


def test_two_writers(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path), VersionedTable(spark, str(tmp_path))
    seen = t.manifest()
    other.commit(rows(spark, (1, "other", None)))
    with monkeypatch.context() as m, pytest.raises(ConflictError):
        m.setattr(VersionedTable, "manifest", lambda self, version=None: seen)
        t.commit(rows(spark, (1, "mine", None)))
    assert read(t)[1] == "other"


def test_empty_and_tagged_commits(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        t.read()
    t.create(rows(spark).limit(0), ["id"], buckets=4)
    assert read(t) == {} and t.commit(rows(spark).limit(0))["version"] == 1
    for _ in range(2):
        t.merge_new(rows(spark, (1, "a", None), (1, "a", None)), ("w", 0))
    t.merge_new(rows(spark, (1, "b", None), (2, "c", None)), ("w", 1))
    assert read(t) == {1: "a", 2: "c"} and t.versions() == [1, 2, 3]


def test_ingest_reads_few_buckets(spark, tmp_path):
    schema = "doc_id long, text string"
    args = (spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/out", f"{tmp_path}/check")
    spark.createDataFrame([(k, f"text {k % 150}") for k in range(200)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    state.ingest_stream(*args).awaitTermination(120)
    t = VersionedTable(spark, f"{tmp_path}/out")
    assert t.read().count() == 150 and len(t.manifest()["commits"]) == 1
    spark.createDataFrame([(900, "text 3"), (901, "fresh"), (902, None)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    state.ingest_stream(*args).awaitTermination(120)
    assert t.read().count() == 152 and len(t.manifest()["commits"][-1]["buckets"]) <= 2
