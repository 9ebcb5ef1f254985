"""Run and collection state: append-only event tables, the latest event of an id counts."""

from __future__ import annotations

import datetime as dt
import decimal
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.sources.catalog import exists, filesystem
from tarnflow.sources.sinks import swap

COUNTS = "struct<processed:bigint,succeeded:bigint,failed:bigint>"
RUNS = f"_id string, status string, startedAt timestamp, endedAt timestamp, durationSeconds double, collections {COUNTS}, documents {COUNTS}, errors struct<summary:map<string,string>,collections:array<string>>"
STATE = (
    f"_id string, runId string, collection string, status string, startedAt timestamp, endedAt timestamp, durationSeconds double, documents {COUNTS}, lastCursorValue string, lastCursorType string, lastCursorField string, "
    "error struct<message:string,timestamp:timestamp>, transformations struct<documentsTransformed:bigint,transformsApplied:bigint,operations:map<string,struct<fieldsConfigured:bigint,fieldsProcessed:bigint>>>"
)


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def latest_by(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The newest event of each id."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def cursor_text(value, kind: str = "") -> str:
    """A position as text that reads the same on any machine: instants in UTC."""
    if kind == "timestamp" and isinstance(value, dt.datetime) and value.tzinfo is None:
        value = value.astimezone(dt.timezone.utc)  # Spark hands out instants in the machine's zone
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)


def cursor_value(text: str, kind: str):
    """The position that ``cursor_text`` wrote, as a value of the cursor's type."""
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return dt.datetime.fromisoformat(text)
    if kind.startswith("decimal"):
        return decimal.Decimal(text)
    if kind in ("double", "float"):
        return float(text)
    return int(text) if kind in ("bigint", "int", "smallint", "tinyint") else text


def last_cursor(state: DataFrame, by: str = "collection") -> DataFrame:
    """collection, last_cursor: the newest completed position of each collection."""
    done = state.where("status = 'completed' and lastCursorValue is not null")
    return done.groupBy(by).agg(F.max_by("lastCursorValue", "endedAt").alias("last_cursor"))


def roll_up(results: DataFrame) -> DataFrame:
    """One row: collections and documents by outcome, and errors by collection."""
    ok = F.col("status") == "completed"
    return results.agg(
        F.count(F.lit(1)).alias("processed"),
        F.coalesce(F.sum(ok.cast("int")), F.lit(0)).alias("succeeded"),
        F.coalesce(F.sum((F.col("status") == "failed").cast("int")), F.lit(0)).alias("failed"),
        F.coalesce(F.sum("docs"), F.lit(0)).alias("documents"),
        F.map_from_entries(F.collect_list(F.when(F.col("status") == "failed", F.struct("collection", "error")))).alias("errors"),
    )


def merge_operations(stats: DataFrame) -> DataFrame:
    """type, fields_configured, fields_processed, duration over batches or collections."""
    return stats.groupBy("type").agg(F.max("fields_configured").alias("fields_configured"), F.sum("fields_processed").alias("fields_processed"), F.sum("duration").alias("duration"))


class StateStore:
    """The two state tables under ``root``. Writers of one run are one driver's threads."""

    def __init__(self, spark: SparkSession, root: str, runs: str = "_rep_runs", state: str = "_rep_state"):
        self.spark, self.root, self.names = spark, root.rstrip("/"), (runs, state)
        self.lock, self.seq = threading.Lock(), 0  # two writers of one folder would share its temporary files

    def _append(self, table: str, schema: str, row: dict) -> None:
        full = f"{schema}, seq bigint, deleted boolean"
        fields = [c.name for c in self.spark.createDataFrame([], full).schema.fields]
        with self.lock:
            self.seq = max(self.seq + 1, int(now().timestamp() * 1e6))
            row = {**row, "seq": self.seq, "deleted": row.get("deleted", False)}
            self.spark.createDataFrame([tuple(row.get(f) for f in fields)], full).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def _read(self, table: str, schema: str) -> DataFrame:
        full = f"{schema}, seq bigint, deleted boolean"
        path = f"{self.root}/{table}"
        df = self.spark.read.schema(full).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], full)
        return latest_by(df, "_id").where("not deleted").drop("deleted")

    def runs(self) -> DataFrame:
        return self._read(self.names[0], RUNS)

    def collections(self) -> DataFrame:
        return self._read(self.names[1], STATE)

    def _row(self, df: DataFrame, key: str) -> dict:
        found = df.where(F.col("_id") == key).drop("seq").first()
        if found is None:
            raise KeyError(key)
        return found.asDict(recursive=True)

    def compact(self, least_files: int = 100) -> list[str]:
        """Rewrite tables of so many files or more as one file with the latest rows; returns their names."""
        done = []
        with self.lock:
            for table, schema in zip(self.names, (RUNS, STATE), strict=True):
                path = f"{self.root}/{table}"
                if not exists(self.spark, path):
                    continue
                fs, p = filesystem(self.spark, path)
                if sum(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(p)) >= least_files:
                    rows = self._read(table, schema).withColumn("deleted", F.lit(False)).coalesce(1)
                    swap(self.spark, path, lambda to, rows=rows: rows.write.parquet(to))
                    done.append(table)
        return done

    # -- runs

    def create_run(self) -> str:
        run = uuid.uuid4().hex[:24]
        zero = {"processed": 0, "succeeded": 0, "failed": 0}
        self._append(self.names[0], RUNS, {"_id": run, "status": "running", "startedAt": now(), "collections": zero, "documents": zero})
        return run

    def _end_run(self, run: str, status: str, **changes) -> None:
        row = self._row(self.runs(), run)
        end = now()
        self._append(self.names[0], RUNS, row | {"status": status, "endedAt": end, "durationSeconds": (end - row["startedAt"]).total_seconds()} | changes)

    def complete_run(self, run: str, collections: dict, documents: dict, errors: dict[str, str] | None = None) -> None:
        errors = errors or {}
        self._end_run(run, "completed", collections=collections, documents=documents, errors={"summary": errors, "collections": sorted(errors)})
        self.compact()

    def fail_run(self, run: str, message: str) -> None:
        self._end_run(run, "failed", errors={"summary": {"run": message[:200]}, "collections": []})

    def last_successful_run(self) -> dict | None:
        found = self.runs().where("status = 'completed'").orderBy(F.desc("endedAt")).first()
        return found.asDict(recursive=True) if found else None

    def running_runs(self) -> DataFrame:
        return self.runs().where("status = 'running'")

    # -- collections

    def start_collection(self, run: str, collection: str) -> str:
        key = uuid.uuid4().hex[:24]
        self._append(self.names[1], STATE, {"_id": key, "runId": run, "collection": collection, "status": "running", "startedAt": now()})
        return key

    def update_collection(self, key: str, **changes) -> None:
        self._append(self.names[1], STATE, self._row(self.collections(), key) | changes)

    def _end_collection(self, key: str, status: str, **changes) -> None:
        row = self._row(self.collections(), key)
        end = now()
        self._append(self.names[1], STATE, row | {"status": status, "endedAt": end, "durationSeconds": (end - row["startedAt"]).total_seconds()} | changes)

    def complete_collection(self, key: str, documents: dict, cursor: tuple[str, str, str] | None = None, transformations: dict | None = None) -> None:
        value, kind, name = cursor or (None, None, None)
        self._end_collection(key, "completed", documents=documents, lastCursorValue=value, lastCursorType=kind, lastCursorField=name, transformations=transformations)

    def fail_collection(self, key: str, message: str, documents: dict | None = None) -> None:
        self._end_collection(key, "failed", documents=documents, error={"message": message[:2000], "timestamp": now()})

    def skip_collection(self, key: str, reason: str) -> None:
        self._end_collection(key, "skipped", error={"message": reason, "timestamp": now()})

    def last_cursor(self, collection: str):
        """The position of the newest completed load, as a value of its own type; None without one."""
        done = self.collections().where((F.col("collection") == collection) & (F.col("status") == "completed") & F.col("lastCursorValue").isNotNull())
        row = done.orderBy(F.desc("endedAt"), F.desc("seq")).first()
        if row is None:
            return None
        return cursor_value(row.lastCursorValue, row.lastCursorType or "string")

    def running_collections(self) -> DataFrame:
        return self.collections().where("status = 'running'")

    def failed_collections(self, run: str | None = None) -> DataFrame:
        df = self.collections().where("status = 'failed'")
        return df if run is None else df.where(F.col("runId") == run)

    def reset_collection(self, collection: str) -> None:
        """Forget the collection's states, so that its next load is a first one."""
        for r in self.collections().where(F.col("collection") == collection).select("_id").collect():
            self._append(self.names[1], STATE, {"_id": r._id, "deleted": True})
