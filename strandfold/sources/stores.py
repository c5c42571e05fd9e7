"""Fingerprint, failure and hash stores, incremental scans and snapshots.

A lookup is a join on the key (path, size_bytes, mtime_ns, kind, interval). FileStore keeps the stores in tables
with versions; the functions beside it are the same steps on any tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandfold.durable import durable
from strandfold.sources.versions import Table

KEY = ["path", "size_bytes", "mtime_ns", "kind", "interval"]
FILE_KEY = ["path", "size_bytes", "mtime_ns"]


def sound(store: DataFrame) -> DataFrame:
    """Rows whose samples have no region or all nine; a broken row is a miss."""
    return store.where(F.forall("samples", lambda s: F.size(s["regions"]).isin(0, 9))) if "samples" in store.columns else store


def lookup(files: DataFrame, store: DataFrame, key: list[str] | None = None) -> DataFrame:
    """files with hit: whether the store holds a sound row for the key."""
    key = key or KEY
    return files.join(sound(store).select(*key).distinct().withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def upsert(store: DataFrame, rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Both, the last written (written_at) of each key."""
    key = key or KEY
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("written_at").desc()))
    return store.unionByName(rows).withColumn("_n", last).where("_n = 1").drop("_n")


def clear_failures(failures: DataFrame, successes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Failures whose key has not succeeded since."""
    return failures.join(successes.select(*(key or KEY)), key or KEY, "left_anti")


def known_failures(files: DataFrame, failures: DataFrame, retry: bool = False, key: list[str] | None = None) -> DataFrame:
    """(files, error, cached) of files that failed before unchanged; none if they are to be tried again."""
    key = key or KEY
    met = files.join(failures.select(*key, "error"), key)
    return (met.limit(0) if retry else met).withColumn("cached", F.lit(True))


def with_hashes(files: DataFrame, hashes: DataFrame, content: str | None = None) -> DataFrame:
    """files with sha256 from the store, or of the content where it is not known."""
    known = files.join(hashes.select(*FILE_KEY, F.col("sha256").alias("_known")), FILE_KEY, "left")
    made = F.sha2(F.col(content), 256) if content else F.lit(None).cast("string")
    return known.withColumn("sha256", F.coalesce("_known", made)).drop("_known")


def incremental_split(files: DataFrame, store: DataFrame, failures: DataFrame, retry: bool = False, key: list[str] | None = None) -> DataFrame:
    """files with status hit, failed (as before) or pending."""
    key = key or KEY
    failed = failures.select(*key).distinct().withColumn("_failed", F.lit(not retry))
    met = lookup(files, store, key).join(failed, key, "left")
    return met.withColumn("status", F.when(F.col("hit"), "hit").when(F.coalesce("_failed", F.lit(False)), "failed").otherwise("pending")).drop("hit", "_failed")


def state_of(items: DataFrame, matches: DataFrame, **thresholds: float) -> str:
    """What decisions are bound to: a digest of the items, the matches and the thresholds they were made on, in any order of rows."""
    told = []
    for table in (items, matches):
        row = [F.xxhash64(F.lit(k), *sorted(table.columns)).cast("decimal(38,0)") for k in (1, 2)]
        told.append(table.agg(F.count(F.lit(1)), *[F.sum(x) for x in row]).first())
    return "/".join(str(x) for t in told for x in t) + "/" + repr(sorted(thresholds.items()))


def save_snapshot(decisions: DataFrame, run_id: str, snapshot_id: str, state: str) -> DataFrame:
    """The decisions as rows of the append-only table of snapshots."""
    return decisions.withColumns({"run_id": F.lit(run_id), "snapshot_id": F.lit(snapshot_id), "state": F.lit(state)})


def snapshot(saved: DataFrame, run_id: str, snapshot_id: str, state: str | None = None) -> DataFrame:
    """The decisions saved under a run and snapshot; an error if they were made on another state than the one given."""
    rows = saved.where((F.col("run_id") == run_id) & (F.col("snapshot_id") == snapshot_id))
    if state is not None and not rows.where(F.col("state") != state).isEmpty():
        raise ValueError(f"snapshot {snapshot_id} of run {run_id} was made on other items, matches or thresholds")
    return rows.drop("run_id", "snapshot_id", "state")


def append_results(results: DataFrame, path: str) -> None:
    """Adds (plan_id, item_id, status, error) rows to a result log partitioned by plan."""
    results.write.mode("append").partitionBy("plan_id").parquet(path)


KEY_SCHEMA = "path string, size_bytes long, mtime_ns long, kind string, interval double"
FILE_SCHEMA = "path string, size_bytes long, mtime_ns long"


class FileStore:
    """Fingerprints, failures and content hashes of files, each a table with versions, cut by path.

    batch: the number of a stream's batch that works on the store; what the same batch has put there in an earlier
    attempt doesn't count as known, so that the attempt is repeated as a whole.
    """

    def __init__(self, spark: SparkSession, path: str, batch: int | None = None):
        self.batch = batch
        self.fingerprints = Table(spark, f"{path}/fingerprints", tuple(KEY), ("path",))
        self.failures = Table(spark, f"{path}/failures", tuple(KEY), ("path",))
        self.hashes = Table(spark, f"{path}/hashes", tuple(FILE_KEY), ("path",))

    def _near(self, table: Table, files: DataFrame, schema: str) -> DataFrame:
        """The table's folders that the files lie in."""
        rows = table.read(table.touched(files), empty=schema)
        return rows if self.batch is None or "batch" not in rows.columns else rows.where(~F.col("batch").eqNullSafe(F.lit(self.batch)))

    def _stamped(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("batch", F.lit(self.batch).cast("long"))

    def lookup(self, files: DataFrame) -> DataFrame:
        """files with hit; broken rows that are met are misses and leave the store."""
        known = self._near(self.fingerprints, files, KEY_SCHEMA)
        met = known.join(files.select(*KEY).distinct(), KEY, "left_semi")
        if "samples" in known.columns:
            broken = durable(met.select(*KEY).join(sound(met).select(*KEY), KEY, "left_anti"), "broken")
            if not broken.isEmpty():
                self.fingerprints.delete(broken)
        return lookup(files, met)

    def split(self, files: DataFrame, retry: bool = False) -> DataFrame:
        """files with status hit, failed (as before) or pending."""
        looked = self.lookup(files).withColumnRenamed("hit", "_hit")
        failed = self._near(self.failures, files, KEY_SCHEMA + ", error string").select(*KEY).withColumn("_failed", F.lit(not retry))
        status = F.when(F.col("_hit"), "hit").when(F.coalesce("_failed", F.lit(False)), "failed").otherwise("pending")
        return looked.join(failed, KEY, "left").withColumn("status", status).drop("_hit", "_failed")

    def put(self, rows: DataFrame, name: str | None = None) -> None:
        """Stores fingerprints (key, and any other columns), one row a key, and clears their failures."""
        rows = durable(self._stamped(rows), "fingerprints")
        self.fingerprints.append(rows, name)
        failed = self._near(self.failures, rows, KEY_SCHEMA + ", error string")
        cleared = durable(failed.select(*KEY).join(rows.select(*KEY), KEY, "left_semi"), "cleared")
        if not cleared.isEmpty():
            self.failures.delete(cleared)

    def fail(self, rows: DataFrame, name: str | None = None) -> None:
        """Stores failures (key, error)."""
        self.failures.append(self._stamped(rows.select(*KEY, "error")), name)

    def failed(self, files: DataFrame, retry: bool = False) -> DataFrame:
        """(key, error, cached) of files that failed before unchanged."""
        return known_failures(files.select(*KEY), self._near(self.failures, files, KEY_SCHEMA + ", error string"), retry)

    def hashed(self, files: DataFrame, content) -> DataFrame:
        """files (path, size_bytes, mtime_ns, ...) with sha256; content(files) -> (path, content) is asked only for files not known, whose hashes are stored."""
        known = self._near(self.hashes, files, FILE_SCHEMA + ", sha256 string")
        met = durable(files.join(known.select(*FILE_KEY, "sha256"), FILE_KEY, "left"), "hashed")
        open_ = met.where("sha256 is null").drop("sha256")
        made = durable(open_.join(content(open_.select(*FILE_KEY)), "path").select(*FILE_KEY, F.sha2("content", 256).alias("sha256")).dropDuplicates(FILE_KEY), "hashes")
        if not made.isEmpty():
            self.hashes.append(made)
        return met.where("sha256 is not null").unionByName(open_.join(made, FILE_KEY, "left"))
