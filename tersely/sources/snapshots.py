"""Tables that survive a crash: data are written beside what is there, and a manifest makes them the table in one rename.

A manifest is a small file with a number; the one with the highest number is the table. It is renamed into place and never
overwritten, so a writer that dies leaves the table as it was, and of two writers that started from one manifest the second fails
instead of undoing the first. Everything goes through Hadoop's file system interface, so any store that Spark writes to will do
that has an atomic rename without overwriting (HDFS, local disks)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has changed the table meanwhile."""


class Files:
    """The file system of a path, through the session's JVM."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        where = self.at(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, content: str) -> bool:
        """The file with its whole content, or nothing; False where it was there already."""
        target = self.at(path)
        if self.fs.exists(target):
            return False
        draft = self.at(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft)
        stream.write(bytearray(content.encode()))
        stream.close()
        done = self.fs.rename(draft, target)
        if not done:
            self.fs.delete(draft, False)
        return done

    def rename(self, source: str, target: str) -> None:
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"{source} can't be renamed to {target}")

    def remove(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


class Table:
    """A table at a path. With `by`, a timestamp column, its rows lie in a folder for each day (or month), so old ones are
    dropped unread. Months suit tables that reach back over many years: each folder has to be listed when the table is read."""

    def __init__(self, spark: SparkSession, path: str, by: str | None = None, period: str = "day"):
        self.spark, self.path, self.by, self.files = spark, path.rstrip("/"), by, Files(spark, path)
        self.format = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[period]

    def versions(self) -> list[int]:
        return [int(n) for n in self.files.names(f"{self.path}/_manifests") if n.isdigit()]

    def manifest(self) -> tuple[int, dict]:
        """The number and content of the current manifest; 0 and nothing where the table doesn't exist."""
        number = max(self.versions(), default=0)
        return number, json.loads(self.files.read(f"{self.path}/_manifests/{number:012d}")) if number else {"schema": None, "parts": []}

    def read(self) -> DataFrame:
        _, content = self.manifest()
        if content["schema"] is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self.of(content["parts"], content["schema"])

    def of(self, parts: list[dict], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        folders = [f"{self.path}/{p['folder']}" for p in parts]
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def written(self, rows: DataFrame) -> list[dict]:
        """Data in a folder of their own, in no manifest yet."""
        folder = f"data/{uuid.uuid4().hex}"
        if self.by is None:
            rows.write.parquet(f"{self.path}/{folder}")
            return [{"folder": folder, "period": None}]
        period = F.coalesce(F.date_format(F.col(self.by), self.format), F.lit("none"))
        # Rebalanced, not hashed: a period that holds most rows is written by many tasks, small ones by one each.
        rows.withColumn("_period", period).hint("rebalance", "_period").write.partitionBy("_period").parquet(f"{self.path}/{folder}")
        found = [n.removeprefix("_period=") for n in self.files.names(f"{self.path}/{folder}") if n.startswith("_period=")]
        return [{"folder": f"{folder}/_period={p}", "period": None if p == "none" else p} for p in found]

    def commit(self, number: int, schema: str, parts: list[dict]) -> None:
        if not self.files.publish(f"{self.path}/_manifests/{number + 1:012d}", json.dumps({"schema": schema, "parts": parts})):
            raise Conflict(f"{self.path} has changed since version {number}")

    def replace(self, rows: DataFrame) -> None:
        """The rows, which may be made from the table itself, in place of what it holds."""
        number, _ = self.manifest()
        self.commit(number, rows.schema.json(), self.written(rows))

    def append(self, rows: DataFrame) -> None:
        number, content = self.manifest()
        self.commit(number, content["schema"] or rows.schema.json(), content["parts"] + self.written(rows))

    def prune(self, days: int, now: datetime) -> int:
        """Drops rows older than so many days and tells how many. Whole periods are dropped from the manifest, only that
        of the limit is written anew; rows without a time stay."""
        if self.by is None:
            raise ValueError("only a table by days or months can be pruned")
        number, content = self.manifest()
        limit = now - timedelta(days=days)
        edge = limit.date().isoformat()[: len(self.format)]
        old = [p for p in content["parts"] if p["period"] and p["period"] < edge]
        cut = [p for p in content["parts"] if p["period"] == edge]
        stamp = F.lit(limit.isoformat(sep=" ")).cast("timestamp")
        gone = self.of(old, content["schema"]).count() if old else 0
        parts = [p for p in content["parts"] if p not in old and p not in cut]
        if cut:
            edge_rows = self.of(cut, content["schema"])
            late: Column = F.col(self.by) < stamp
            gone_there = edge_rows.filter(late).count()
            parts += self.written(edge_rows.filter(~late)) if gone_there else cut
            gone += gone_there
        if gone:
            self.commit(number, content["schema"], parts)
        return gone

    def vacuum(self, keep: int = 1) -> int:
        """Removes manifests but the last `keep`, and data that none of those names; tells how many folders went. Not to be
        run while others write or read older versions."""
        versions = sorted(self.versions())
        kept = [json.loads(self.files.read(f"{self.path}/_manifests/{v:012d}")) for v in versions[-keep:]]
        named = {p["folder"].split("/")[1] for m in kept for p in m["parts"]}
        loose = [n for n in self.files.names(f"{self.path}/data") if n not in named]
        for v in versions[:-keep]:
            self.files.remove(f"{self.path}/_manifests/{v:012d}")
        for n in loose:
            self.files.remove(f"{self.path}/data/{n}")
        return len(loose)


def prune_all(tables: dict[str, Table], days: int, now: datetime) -> dict[str, int]:
    """How many rows each table lost. Each table changes in one step; after a crash between them, pruning again does the rest."""
    return {name: table.prune(days, now) for name, table in tables.items()}


class Batches:
    """What a stream's batches write, each once: a batch that is run again after a crash finds its manifest and writes nothing,
    or finds none and writes anew, and what its first run left is in no manifest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def done(self) -> dict[int, str]:
        """The folders of the batches that are done."""
        return {int(n): f"{self.path}/{self.files.read(f'{self.path}/_batches/{n}')}" for n in self.files.names(f"{self.path}/_batches") if n.isdigit()}

    def has(self, batch: int) -> bool:
        return self.files.fs.exists(self.files.at(f"{self.path}/_batches/{batch:012d}"))

    def write(self, rows: DataFrame, batch: int) -> bool:
        """False where the batch was done before."""
        if self.has(batch):
            return False
        folder = f"data/{batch:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return self.files.publish(f"{self.path}/_batches/{batch:012d}", folder)

    def read(self, schema: str | None = None, batches: Iterable[int] | None = None) -> DataFrame:
        done = self.done()
        folders = [f for b, f in sorted(done.items()) if batches is None or b in set(batches)]
        if not folders:
            if schema is None:
                raise FileNotFoundError(f"no batch at {self.path}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*folders)
