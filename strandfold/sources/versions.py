"""Tables that grow by commits: parts of Parquet, and a log that names the parts of each version.

A commit writes its rows into a folder of its own and then creates the next file of the log, which names all
parts of the new version. Readers take the last whole file of the log, so parts of a writer that died
are never seen, nor is a half-written file. A writer that finds its number taken adds its part to what
the other has committed meanwhile, so neither's rows are lost (where the file system refuses to create
a file twice). Rows are cut into folders by a hash of some columns, and a reader that knows its
keys reads only their folders. A commit costs what it adds; beyond PARTS parts all are written anew as one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 24
BUCKETS = 64
TRIES = 50
END = "\n#end"


@dataclass(frozen=True)
class Table:
    """key: of rows with the same key those of the last commit count; without a key all do. cut: the columns that rows are cut by."""

    spark: SparkSession
    path: str
    key: tuple[str, ...] = ()
    cut: tuple[str, ...] = ()
    buckets: int = BUCKETS

    def _at(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *names]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _log(self) -> list[int]:
        path, fs = self._at("log")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _read_log(self, number: int) -> dict | None:
        path, fs = self._at("log", f"{number:012d}.json")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text.removesuffix(END)) if text.endswith(END) else None

    def version(self, until: int | None = None) -> tuple[int, list[dict], str | None]:
        """(number, parts, schema) of the last whole version, or of the last one up to a number."""
        for number in reversed(self._log()):
            if (until is None or number <= until) and (found := self._read_log(number)):
                return number, found["parts"], found["schema"]
        return 0, [], None

    def _commit(self, change: Callable[[list[dict]], list[dict]], added: T.StructType) -> int:
        for _ in range(TRIES):
            number = max([0, *self._log()]) + 1
            _, parts, known = self.version()
            parts, fields = change(parts), T.StructType.fromJson(json.loads(known)).fields if known else []
            names = {f.name for f in fields}
            schema = T.StructType([*fields, *(f for f in added.fields if f.name not in names)]).json()  # columns may come later
            path, fs = self._at("log", f"{number:012d}.json")
            try:
                out = fs.create(path, False)
            except Py4JJavaError as e:
                if fs.exists(path):
                    continue  # another writer was first
                raise e
            out.write((json.dumps({"parts": parts, "schema": schema}) + END).encode())
            out.close()
            return number
        raise RuntimeError(f"no commit to {self.path} in {TRIES} tries")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.cut), F.lit(self.buckets)).cast("int") if self.cut else F.lit(0)

    def touched(self, rows: DataFrame) -> list[int]:
        """The folders that the rows' keys lie in, at most as many as there are."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def _write(self, rows: DataFrame, files: int) -> str:
        folder = f"parts/{uuid.uuid4().hex}"
        spread = F.pmod(F.xxhash64(*(self.key or self.cut)), F.lit(files)) if self.key or self.cut else F.lit(0)
        rows.withColumn("_bucket", self.bucket()).repartition("_bucket", spread).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder

    def append(self, rows: DataFrame, name: str | None = None, gone: bool = False, files: int = 1) -> int:
        """Commits rows, in some files for each folder; a part of the same name is replaced. Returns the version's number."""
        part = {"folder": self._write(rows.withColumn("_gone", F.lit(gone)), files), "name": name}

        def change(parts: list[dict]) -> list[dict]:
            at = next((k for k, p in enumerate(parts) if name and p["name"] == name), len(parts))
            return [*parts[:at], part, *parts[at + 1 :]]

        number = self._commit(change, rows.schema)
        if len(self.version()[1]) > PARTS:
            self.compact(files)
        return number

    def delete(self, keys: DataFrame) -> int:
        """Commits that the rows of some keys are gone."""
        known = self.version()[2]
        fields = T.StructType.fromJson(json.loads(known)).fields if known else keys.schema.fields
        kept = [F.col(f.name) if f.name in keys.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        return self.append(keys.select(*kept), gone=True)

    def compact(self, files: int = 1) -> int:
        """Writes all parts anew as one, without what is gone; parts committed meanwhile stay behind it."""
        _, parts, schema = self.version()
        old = {p["folder"] for p in parts}
        part = {"folder": self._write(self.read().withColumn("_gone", F.lit(False)), files), "name": None}
        return self._commit(lambda now: [part, *(p for p in now if p["folder"] not in old)], T.StructType.fromJson(json.loads(schema)))

    def rows(self, buckets: list[int] | None = None, until: int | None = None) -> DataFrame | None:
        """All rows of a version with _part (the part's place) and _gone; None if nothing was ever committed."""
        _, parts, schema = self.version(until)
        if schema is None:
            return None
        full = T.StructType.fromJson(json.loads(schema)).add("_gone", T.BooleanType()).add("_bucket", T.IntegerType())
        read = [self.spark.read.schema(full).parquet(f"{self.path}/{p['folder']}").withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
        rows = reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], full).withColumn("_part", F.lit(0))
        return rows if buckets is None else rows.where(F.col("_bucket").isin(buckets))

    def read(self, buckets: list[int] | None = None, until: int | None = None, empty: T.StructType | str | None = None) -> DataFrame:
        """The table, or some of its folders, as of the last version or an earlier one; empty: its schema where there is none yet."""
        rows = self.rows(buckets, until)
        if rows is None:
            if empty is None:
                raise FileNotFoundError(f"nothing was committed to {self.path}")
            return self.spark.createDataFrame([], empty)
        if self.key:
            last = F.max("_part").over(Window.partitionBy(*self.key))
            rows = rows.withColumn("_last", last).where("_part = _last").drop("_last")
        return rows.where("not _gone").drop("_gone", "_bucket", "_part")
