"""The log of runs: a start and an end are appended, and never changed.

A run without an end was interrupted unless it is said to be alive. The last good export is that of the
completed run that ended last, whatever runs failed after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.sources.versions import Table

EVENTS = "run_id string, event string, at timestamp, settings map<string, string>, summary map<string, double>, export string, error string"
ENDS = ("completed", "failed", "interrupted")


class RunLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, Table(spark, path, (), ("run_id",), 16)

    def append(self, events: DataFrame) -> None:
        """Adds rows of EVENTS (other columns empty where they are not given), as a start and an end do."""
        fields = self.spark.createDataFrame([], EVENTS).schema.fields
        given = set(events.columns)
        self.table.append(events.select(*[(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]))

    def _one(self, **values) -> None:
        names = EVENTS.replace("map<string, string>", "map<string,string>").replace("map<string, double>", "map<string,double>").split(", ")
        row = tuple(values.get(n.split(" ")[0]) for n in names)
        self.append(self.spark.createDataFrame([row], EVENTS).withColumn("at", F.coalesce("at", F.current_timestamp())))

    def start(self, run_id: str, settings: dict[str, str] | None = None, at=None) -> None:
        self._one(run_id=run_id, event="started", settings=settings, at=at)

    def end(self, run_id: str, status: str, summary: dict[str, float] | None = None, export: str | None = None, error: str | None = None, at=None) -> None:
        """The run's end; export: where its result stands, if it completed."""
        if status not in ENDS:
            raise ValueError(f"not an end of a run: {status}")
        self._one(run_id=run_id, event=status, summary=summary, export=export, error=error, at=at)

    def events(self) -> DataFrame:
        return self.table.read(empty=EVENTS)

    def history(self, alive: list[str] = ()) -> DataFrame:
        """(run_id, status, started_at, finished_at, settings, summary, export, error) per run."""
        end = F.when(F.col("event") != "started", F.struct("at", "event", "summary", "export", "error"))
        runs = self.events().groupBy("run_id").agg(
            F.min(F.when(F.col("event") == "started", F.col("at"))).alias("started_at"),
            F.max_by("settings", F.when(F.col("event") == "started", F.col("at"))).alias("settings"),
            F.max_by(end, F.when(end.isNotNull(), F.struct("at", "event"))).alias("end"),
        )
        open_ = F.when(F.col("run_id").isin(list(alive)), "running").otherwise("interrupted")
        return runs.select("run_id", F.coalesce("end.event", open_).alias("status"), "started_at", F.col("end.at").alias("finished_at"), "settings", "end.summary", "end.export", "end.error")

    def last_export(self) -> str | None:
        found = self.history().where("status = 'completed'").agg(F.max_by("export", F.struct("finished_at", "run_id")).alias("e")).first()
        return found["e"]


def logged(log: RunLog, run_id: str, work, settings: dict[str, str] | None = None):
    """The result of work() -> (summary, export), with its start and end in the log; an error is logged and raised again."""
    log.start(run_id, settings)
    try:
        summary, export = work()
    except KeyboardInterrupt:
        log.end(run_id, "interrupted")
        raise
    except Exception as error:
        log.end(run_id, "failed", error=f"{type(error).__name__}: {error}"[:2000])
        raise
    log.end(run_id, "completed", summary, export)
    return summary, export
