"""The writing store: objects, keys and chains of manifests."""

import pytest

from paperloom.sources.store import ArtifactStore


@pytest.fixture()
def store(spark, tmp_path):
    return ArtifactStore(spark, f"file://{tmp_path}/store")


def outcomes(df, *keys):
    return sorted([(*(r[k] for k in keys), r["outcome"]) for r in df.collect()], key=str)


def test_objects(spark, store):
    files = spark.createDataFrame([("a.docx", bytearray(b"one")), ("b.PDF", bytearray(b"one")), ("c", bytearray(b"")), ("d", None)], "path string, content binary")
    refs = store.write(files)
    assert sorted((r.path, r.size_bytes, r.media_type.rsplit(".", 1)[-1]) for r in refs.collect()) == [("a.docx", 3, "document"), ("b.PDF", 3, "application/pdf"), ("c", 0, "application/octet-stream"), ("d", None, "application/octet-stream")]
    assert store._read("objects", "sha256 string").count() == 2
    store.write(files)
    assert store._read("objects", "sha256 string").count() == 2
    assert sorted((r.path, r.content and bytes(r.content), r.issue) for r in store.read(refs).collect()) == [("a.docx", b"one", None), ("b.PDF", b"one", None), ("c", bytearray(), None), ("d", None, "ARTIFACT_UNAVAILABLE")]
    assert {r.issue for r in store.read(refs.where("path = 'a.docx'").withColumn("size_bytes", refs.size_bytes + 1)).collect()} == {"INTEGRITY_MISMATCH"}
    assert {r.issue for r in store.read(refs.where("path = 'a.docx'"), 2).collect()} == {"LIMIT_EXCEEDED"}
    assert store.write(files.limit(0)).count() == 0


def test_keys_are_written_once(spark, store):
    entries = lambda *rows: spark.createDataFrame(rows, "key string, sha256 string")
    first = store.publish(entries(("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), (None, "1"), ("c", None)))
    assert outcomes(first, "key", "sha256") == [("a", "1", "committed"), ("b", "1", "VERSION_CONFLICT"), ("b", "2", "VERSION_CONFLICT"), ("c", None, "INVALID_INPUT"), (None, "1", "INVALID_INPUT")]
    assert outcomes(store.publish(entries(("a", "1"), ("a", "2"), ("b", "2"))), "key", "sha256") == [("a", "1", "same"), ("a", "2", "VERSION_CONFLICT"), ("b", "2", "committed")]
    assert outcomes(store.publish(entries(("x", "1")).limit(0)), "key") == []


def test_a_writer_that_comes_second_decides_again(spark, store):
    other = ArtifactStore(spark, store.root)
    entries = lambda sha: spark.createDataFrame([("a", sha)], "key string, sha256 string")
    add, met = store._add, []

    def late(rows, name):
        if not met:
            met.append(outcomes(other.publish(entries("2")), "sha256"))
        return add(rows, name)

    store._add = late
    assert outcomes(store.publish(entries("1")), "sha256") == [("1", "VERSION_CONFLICT")]
    assert met == [[("2", "committed")]]


def test_chains(spark, store):
    rows = lambda *rows: spark.createDataFrame(rows, "document_id string, revision int, sha256 string, parent_sha256 string")
    first = store.commit_manifests(rows(("a", 1, "a1", None), ("a", 2, "a2", "a1"), ("b", 1, "b1", "b0"), ("b", 2, "b2", "b1"), ("c", 2, "c2", "c1"), ("-", 1, "x", None), ("d", 0, "x", None), ("e", 1, "e1", None), ("e", 1, "e2", None)))
    assert outcomes(first, "document_id", "revision") == [
        ("-", 1, "INVALID_INPUT"), ("a", 1, "committed"), ("a", 2, "committed"), ("b", 1, "VERSION_CONFLICT"), ("b", 2, "VERSION_CONFLICT"),
        ("c", 2, "VERSION_CONFLICT"), ("d", 0, "INVALID_INPUT"), ("e", 1, "VERSION_CONFLICT"), ("e", 1, "VERSION_CONFLICT"),
    ]
    second = store.commit_manifests(rows(("a", 2, "a2", "a1"), ("a", 1, "other", None), ("a", 3, "a3", "a2"), ("a", 5, "a5", "a4"), ("b", 1, "b1", None)))
    assert outcomes(second, "document_id", "revision") == [("a", 1, "VERSION_CONFLICT"), ("a", 2, "same"), ("a", 3, "committed"), ("a", 5, "VERSION_CONFLICT"), ("b", 1, "committed")]
