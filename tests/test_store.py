"""Tables with versions, file stores and streams against them."""

import json
import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from strandfold.durable import shared_dir
from strandfold.params import Params
from strandfold.sources import adapters, versions
from strandfold.sources.stores import KEY, FileStore
from strandfold.sources.versions import Table
from strandfold.streaming import incremental

Q = Params(interval=1.0, min_segment=3.0)
FILE = "path string, size_bytes long, mtime_ns long, kind string, interval double"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_last_commit_of_a_key_counts(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t", ("k",), ("k",), 4)
    assert content(t.read(empty="k long, v string")) == []
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.append(rows(spark, (1, "a"), (2, "b"), (None, "n"))) == 1
    t.append(rows(spark, (2, "c"), (3, "d")), name="x")
    t.delete(rows(spark, (1, "")).select("k"))
    t.append(rows(spark, (3, "e")), name="x")  # the same batch again
    assert content(t.read().where("k is not null")) == [(2, "b"), (3, "e")] and t.read().count() == 3
    assert content(t.read(until=2).where("k is not null")) == [(1, "a"), (2, "c"), (3, "d")]
    t.compact()
    assert content(t.read().where("k is not null")) == [(2, "b"), (3, "e")] and len(t.version()[1]) == 1
    asked = rows(spark, (3, ""))
    assert content(t.read(t.touched(asked)).where("k = 3")) == [(3, "e")] and len(t.touched(asked)) == 1


def test_writers_that_die_or_meet_lose_nothing(spark, tmp_path, monkeypatch):
    t = Table(spark, f"{tmp_path}/t", ("k",), ("k",), 2)
    t.append(rows(spark, (1, "a")))
    t._write(rows(spark, (1, "dead")).withColumn("_gone", F.lit(False)), 1)  # died before its commit
    (tmp_path / "t" / "log" / "000000000002.json").write_text('{"parts": [')  # died while committing
    assert content(t.read()) == [(1, "a")]
    other, log, met = Table(spark, f"{tmp_path}/t", ("k",), ("k",), 2), Table._log, []

    def late(self):  # another writer commits between this one's look at the log and its own commit
        found = log(self)
        if self is t and not met:
            met.append(other.append(rows(spark, (2, "other"))))
        return found

    monkeypatch.setattr(Table, "_log", late)
    assert t.append(rows(spark, (3, "own"))) == 4 and met == [3]
    assert content(t.read()) == [(1, "a"), (2, "other"), (3, "own")]
    assert json.loads((tmp_path / "t" / "log" / "000000000004.json").read_text().removesuffix(versions.END))["parts"]


def test_many_commits_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "PARTS", 3)
    t = Table(spark, f"{tmp_path}/t", ("k",), ("k",), 2)
    for k in range(6):
        t.append(rows(spark, (k % 4, f"v{k}")))
    assert content(t.read()) == [(0, "v4"), (1, "v5"), (2, "v2"), (3, "v3")] and len(t.version()[1]) <= 3


def file_rows(spark, *names):
    return spark.createDataFrame([(n, 1, 2, "fast", 0.0) for n in names], FILE)


def test_a_broken_row_is_a_miss_and_leaves_the_store(spark, tmp_path):
    store = FileStore(spark, f"{tmp_path}/s")
    good, bad = (F.array(F.struct(F.array(*[F.lit(0)] * n).alias("regions"))) for n in (9, 4))
    store.put(file_rows(spark, "good.mp4").withColumn("samples", good).unionByName(file_rows(spark, "broken.mp4").withColumn("samples", bad)))
    asked = file_rows(spark, "good.mp4", "broken.mp4", "new.mp4")
    assert content(store.lookup(asked).select("path", "hit")) == [("broken.mp4", False), ("good.mp4", True), ("new.mp4", False)]
    assert [r.path for r in store.fingerprints.read().collect()] == ["good.mp4"]
    changed = file_rows(spark, "good.mp4").withColumn("size_bytes", F.lit(7).cast("long"))
    assert [r.hit for r in store.lookup(changed).collect()] == [False]


def test_failures_are_kept_until_they_succeed_or_are_retried(spark, tmp_path):
    store, asked = FileStore(spark, f"{tmp_path}/s"), file_rows(spark, "broken.mp4", "other.mp4")
    store.fail(asked.where("path = 'broken.mp4'").withColumn("error", F.lit("invalid media")))
    status = lambda retry=False: dict(content(store.split(asked, retry).select("path", "status")))
    assert status() == {"broken.mp4": "failed", "other.mp4": "pending"} and status(True) == {"broken.mp4": "pending", "other.mp4": "pending"}
    assert [(r.error, r.cached) for r in store.failed(asked).collect()] == [("invalid media", True)] and store.failed(asked, True).isEmpty()
    store.put(asked)
    assert status() == {"broken.mp4": "hit", "other.mp4": "hit"} and store.failed(asked).isEmpty()


def test_hashes_are_reused(spark, tmp_path):
    store, asked = FileStore(spark, f"{tmp_path}/s"), []
    files = file_rows(spark, "a", "b").drop("kind", "interval")

    def read(df):
        asked.append(sorted(r.path for r in df.collect()))
        return df.select("path", F.encode("path", "UTF-8").alias("content"))

    first = content(store.hashed(files.where("path = 'a'"), read).select("path", "sha256"))
    both = content(store.hashed(files, read).select("path", "sha256"))
    assert first == both[:1] and asked == [["a"], ["b"]] and both[1][1] == spark.range(1).select(F.sha2(F.lit("b"), 256)).first()[0]
    assert content(store.hashed(files, read).select("path", "sha256")) == both and asked[2] == []


def lines(k, seed):
    return ". ".join(f"word{random.Random(f'{seed}-{i}').randint(0, 10**9)} some line number {seed} {i} of text" for i in range(k))


def files_of(rows):
    return rows.withColumns({"path": F.concat(F.lit("/d"), "doc_id"), "size_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "mtime_ns": F.lit(1).cast("long"), "kind": F.lit("fast"), "interval": F.lit(1.0)})


def test_stream_skips_known_files_and_keeps_failures(spark, tmp_path):
    seen = []

    def samples(rows):
        seen.append(sorted(r.doc_id for r in rows.select("doc_id").collect()))
        return adapters.document_samples(rows)

    def put(*docs, retry=False):
        spark.createDataFrame(list(docs), "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
        incremental.stream_fingerprints(stream, samples, f"{tmp_path}/store", f"{tmp_path}/check", Q, files=files_of, retry=retry).awaitTermination()

    put((1, lines(4, "x")), (2, "short"))
    put((1, lines(4, "x")), (2, "short"), (3, lines(4, "y")))  # 1 is known and 2 failed before
    assert seen == [[1, 2], [3]]
    store = FileStore(spark, f"{tmp_path}/store")
    assert [(r.path, r.error) for r in store.failures.read().collect()] == [("/d2", "no samples")]
    put((2, "short"), retry=True)
    assert seen[2] == [2]
    assert sorted({r.item_id for r in incremental.current(spark, f"{tmp_path}/store", "samples").collect()}) == [1, 3]


def test_a_batch_that_ran_half_is_run_again_as_a_whole(spark, tmp_path):
    batch = spark.createDataFrame([(1, lines(4, "x")), (2, lines(4, "y"))], "doc_id long, text string")
    for _ in range(2):
        incremental._store(batch, 0, adapters.document_samples, f"{tmp_path}/store", Q, "doc_id", files_of, False)
    assert {r.item_id for r in incremental.current(spark, f"{tmp_path}/store", "samples").collect()} == {1, 2}
    incremental._store(batch, 1, adapters.document_samples, f"{tmp_path}/store", Q, "doc_id", files_of, False)
    assert incremental.current(spark, f"{tmp_path}/store", "samples").count() == adapters.document_samples(batch).count()


def test_binary_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.raw").write_bytes(bytes(range(256)) * 10)
    (tmp_path / "in" / "b.raw").write_bytes(b"too short for a frame")
    named = lambda df: df.withColumn("item_id", F.xxhash64("path"))

    def samples(rows):
        from strandfold.functions import pixels

        return pixels.frame_samples(adapters.load_frames(rows.select("item_id", "content")))

    for _ in range(2):
        stream = named(spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(f"{tmp_path}/in"))
        incremental.stream_fingerprints(stream, samples, f"{tmp_path}/store", f"{tmp_path}/check", Q, "item_id", incremental.binary_files()).awaitTermination()
    store = FileStore(spark, f"{tmp_path}/store")
    assert [r.path[-5:] for r in store.fingerprints.read().collect()] == ["a.raw"] and [r.path[-5:] for r in store.failures.read().collect()] == ["b.raw"]
    assert incremental.current(spark, f"{tmp_path}/store", "samples").count() == 256 * 10 // 648


def test_a_batch_reads_postings_of_its_own_tokens_only(spark, tmp_path):
    table = incremental.tables(spark, f"{tmp_path}/store")["tokens"]
    wide = spark.range(40_000).select(F.col("id").alias("item_id"), F.col("id").cast("int").alias("token"), F.lit(0).cast("long").alias("batch"))
    table.append(wide)
    for n in (1, 4, 16):
        mine = spark.createDataFrame([(10**6, 7 * k) for k in range(n)], "item_id long, token int")
        read = table.read(table.touched(mine))
        assert read.count() <= n * 40_000 / 256 * 1.5
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert len(table.touched(mine)) <= n and re.search(r"PartitionFilters: \[[^]]*_bucket", plan)
        assert sorted(r.token for r in incremental.postings(spark, f"{tmp_path}/store", mine).collect()) == [7 * k for k in range(n)]


def test_only_files_of_equal_size_are_hashed(spark):
    from strandfold.operators import exact

    texts = {1: "abc", 2: "abd", 3: "abc", 4: "longer", 5: None}
    contents = spark.createDataFrame(list(texts.items()), "item_id long, content string")
    sizes = contents.where("content is not null").select("item_id", F.octet_length("content").cast("long").alias("size_bytes"))
    hashed = exact.hashed_suspects(sizes, contents)
    assert sorted(r.item_id for r in hashed.collect()) == [1, 2, 3]
    assert content(exact.exact_groups(hashed).select("anchor", "n")) == [(1, 2)]
    plan = hashed._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert min(k for k, line in enumerate(plan) if "sha2(" in line) < min(k for k, line in enumerate(plan) if "Join Inner" in line)


def test_run_log_keeps_the_last_good_export(spark, tmp_path):
    from strandfold.sources.runs import RunLog, logged

    log = RunLog(spark, f"{tmp_path}/runs")
    assert log.history().isEmpty() and log.last_export() is None
    logged(log, "one", lambda: ({"scanned": 2.0}, "exports/one"), {"roots": "/r"})
    logged(log, "two", lambda: ({"scanned": 3.0}, "exports/two"))

    def fails():
        raise OSError("decode failed")

    with pytest.raises(OSError, match="decode failed"):
        logged(log, "three", fails)
    log.start("four")
    log.start("five")
    found = {r.run_id: r for r in log.history(alive=["five"]).collect()}
    assert {k: r.status for k, r in found.items()} == {"one": "completed", "two": "completed", "three": "failed", "four": "interrupted", "five": "running"}
    assert found["one"].settings == {"roots": "/r"} and found["one"].summary == {"scanned": 2.0} and "decode failed" in found["three"].error
    assert all(found[k].started_at and found[k].finished_at for k in ("one", "two", "three")) and log.last_export() == "exports/two"
    with pytest.raises(ValueError):
        log.end("four", "running")


def test_a_cluster_without_a_shared_folder_is_refused():
    """No machine-local folder stands in for spark.checkpoint.dir beyond one process."""
    session = lambda master, given: SimpleNamespace(conf={} if given is None else {"spark.checkpoint.dir": given}, sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("yarn", "hdfs://a/b")) == "hdfs://a/b"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master, None))
