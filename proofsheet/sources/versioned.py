"""Tables whose state is a numbered log of small documents in a shared folder.

A document appears whole or not at all and never replaces another: it is written beside the
log and moved into place, which fails if its number is taken. Data lie in folders that no one
touches again. So a reader sees one state whatever writers do, a writer that dies leaves
folders that no document names, and of two writers on the same state one is told.

The move is atomic on file systems with a rename (HDFS, local); a store without one needs a
committer of its own.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has taken the number."""


class Log:
    """Numbered documents below path/log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._fs.Path(self.path).getFileSystem(self._conf)

    def _name(self, number: int) -> str:
        return f"{self.path}/log/{number:012d}.json"

    def names(self, folder: str) -> list[str]:
        at = self._fs.Path(folder)
        return [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []

    def numbers(self) -> list[int]:
        """Numbers in the log, rising."""
        return sorted(int(n[:-5]) for n in self.names(f"{self.path}/log") if n.endswith(".json") and n[0] != ".")

    def has(self, number: int) -> bool:
        return self._files.exists(self._fs.Path(self._name(number)))

    def document(self, number: int) -> dict:
        return json.loads(self.spark.read.text(self._name(number), wholetext=True).first()[0])

    def publish(self, number: int, document: dict) -> None:
        """Put the document at this number; Conflict if there is one."""
        beside = self._fs.Path(f"{self.path}/.new-{uuid.uuid4().hex}")
        out = self._files.create(beside, False)
        try:
            out.write(json.dumps(document, sort_keys=True).encode())
        finally:
            out.close()
        self._files.mkdirs(self._fs.Path(f"{self.path}/log"))
        none = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        context = self._fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        try:
            context.rename(beside, self._fs.Path(self._name(number)), none)
        except Py4JJavaError as e:
            self._files.delete(beside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"{self.path}: number {number} is taken") from e
            raise

    def age(self, path: str) -> float:
        """Seconds since a path was last changed."""
        return time.time() - self._files.getFileStatus(self._fs.Path(path)).getModificationTime() / 1000

    def delete(self, path: str) -> None:
        self._files.delete(self._fs.Path(path), True)

    def data_folder(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"


class Store:
    """Named tables in parts; each document of the log names every part's folder, so unchanged parts are carried by reference."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.log, self.spark, self._parts = Log(spark, path), spark, parts

    def head(self, number: int | None = None) -> tuple[int, dict]:
        """Number and document of a state, of the last one by default; (0, an empty one) at first."""
        number = number if number is not None else max(self.log.numbers(), default=0)
        return number, self.log.document(number) if number else {"parts": self._parts, "tables": {}}

    def read(self, table: str, number: int | None = None, parts: set[int] | None = None) -> DataFrame | None:
        """Rows of a table in a state, or in some of its parts; None if the state has no such table."""
        found = self.head(number)[1]["tables"].get(table)
        if found is None:
            return None
        folders = [f for p, f in found["folders"].items() if parts is None or int(p.partition("@")[0]) in parts]
        schema = StructType.fromJson(found["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, part: str) -> tuple[dict, dict[str, str]]:
        """Rows as files of a folder for each value of `part`: their schema and the folders. Nothing refers to them yet."""
        folder = self.log.data_folder()
        # a part with a large share of the rows is split over several tasks
        rows.hint("rebalance", part).write.partitionBy(part).parquet(folder)
        there = [n for n in self.log.names(folder) if n.startswith(f"{part}=")]
        return json.loads(rows.drop(part).schema.json()), {n.partition("=")[2]: f"{folder}/{n}" for n in there}

    def expire(self, keep: int = 6, older_than: float = 86_400.0) -> dict[str, int]:
        """Deletes all states but the newest `keep`, and data folders that none of these name: how many of each.

        A folder younger than `older_than` seconds stays, since a writer may be about to publish it.
        """
        log = self.log
        numbers = log.numbers()
        old, kept = numbers[:-keep] if keep else numbers, numbers[-keep:] if keep else []
        named = {f for n in kept for t in log.document(n)["tables"].values() for f in t["folders"].values()}
        for n in old:  # a state goes before its data, so that no reader finds one without the other
            log.delete(log._name(n))
        gone = 0
        for folder in log.names(f"{log.path}/data"):
            for part in log.names(f"{log.path}/data/{folder}"):
                at = f"{log.path}/data/{folder}/{part}"
                if part[:1] not in "._" and at not in named and log.age(at) >= older_than:
                    log.delete(at)
                    gone += 1
        return {"states": len(old), "folders": gone}

    def part_of(self, *key: str):
        return F.pmod(F.xxhash64(*key), F.lit(self.head()[1]["parts"])).cast("int")
