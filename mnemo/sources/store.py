"""Versioned tables: Parquet parts and one JSON manifest per commit, for all tables at once.

A commit writes its parts first and then creates manifest N + 1; creating a file that exists fails, so of two writers on
one version one gets CommitConflict, and rows, edges and vectors become visible together.  Parts are immutable: deletes
are tombstone parts.  A read at commit number S takes the parts up to S and drops rows with a tombstone up to S.
"""

from __future__ import annotations

import json
import time
import uuid
from copy import deepcopy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo.errors import CommitConflict
from mnemo.functions.vectors import decoded, encoded
from mnemo.sources.shared import shared_folder

TYPES = {
    "INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "UUID": T.StringType(), "JSON": T.StringType(),
    "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.LongType(), "TXID": T.LongType(), "VECTOR": T.ArrayType(T.FloatType()),
}
HIDDEN = ("__row_id", "__lsn", "__created_at")
_HIDDEN = [T.StructField("__row_id", T.LongType()), T.StructField("__lsn", T.LongType()), T.StructField("__created_at", T.LongType())]
CODES = T.StructType([T.StructField("low", T.FloatType()), T.StructField("high", T.FloatType()), T.StructField("codes", T.ArrayType(T.ByteType()))])
GRAVES = T.StructType([T.StructField("__row_id", T.LongType()), T.StructField("__lsn", T.LongType())])


def coded(c: dict) -> bool:
    """Whether a column's vectors are stored as codes."""
    return c["type"] == "VECTOR" and c.get("quantization", "F32") != "F32"


def schema_of(meta: dict) -> T.StructType:
    return T.StructType([T.StructField(c["name"], T.ArrayType(T.DoubleType()) if coded(c) else TYPES[c["type"]]) for c in meta["columns"]])


def stored_schema(meta: dict) -> T.StructType:
    """Columns as parts hold them: under names that are never used again, so that a dropped column's values cannot return."""
    kind = lambda c: CODES if coded(c) else TYPES[c["type"]]
    return T.StructType([*[T.StructField(c.get("stored", c["name"]), kind(c)) for c in meta["columns"]], *_HIDDEN])


def name_stored(meta: dict, column: dict) -> None:
    """Give a new column of a table the name that parts know it by."""
    used = meta.setdefault("stored_names", [])
    column["stored"] = column["name"] if column["name"] not in used else f"{column['name']}__{len(used)}"
    used.append(column["stored"])


def _seen(meta: dict, df: DataFrame) -> DataFrame:
    """Rows of parts with the columns' present names and decoded vectors."""
    col = lambda c: F.col(f"`{c.get('stored', c['name'])}`")
    return df.select(*[(decoded(col(c), c["quantization"]) if coded(c) else col(c)).alias(c["name"]) for c in meta["columns"]], *HIDDEN)


class Store:
    """A folder of parts and manifests, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{shared_folder(spark)}/mnemo-store-{uuid.uuid4().hex}").rstrip("/")
        self._fs = self._at("manifests").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("manifests"))
        found = self._versions()
        if not found:
            self._write(0, {"version": 0, "lsn": 0, "next_row": 1, "tables": {}, "parts": {}, "log": [], "settings": {}})
            found = [0]
        self.state = self._load(max(found))

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _versions(self) -> list[int]:
        return [int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(self._at("manifests")) if s.getPath().getName().endswith(".json")]

    def _load(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, version: int, state: dict) -> None:
        try:
            out = self._fs.create(self._at(f"manifests/{version:012d}.json"), False)
        except Exception as e:
            raise CommitConflict(f"version {version} exists") from e
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()

    def publish(self, state: dict) -> None:
        """Make a changed copy of the state the next version."""
        state = state | {"version": self.state["version"] + 1}
        self._write(state["version"], state)
        self.state = state

    def refresh(self) -> None:
        self.state = self._load(max(self._versions()))

    def draft(self) -> dict:
        return deepcopy(self.state)

    # Parts

    def add_rows(self, state: dict, table: str, rows: DataFrame, lsn: int, created: int | None = None) -> dict | None:
        """Write rows as a part with new row ids; None where there are none."""
        base = state["next_row"]
        part = {"path": f"{self.path}/parts/{table}/{uuid.uuid4().hex}", "kind": "rows", "lsn": lsn}
        now = created if created is not None else int(time.time() * 1000)
        cols = [(encoded(F.col(f"`{c['name']}`"), c["quantization"]) if coded(c) else F.col(f"`{c['name']}`")).alias(c.get("stored", c["name"])) for c in state["tables"][table]["columns"]]
        numbered = rows.select(*cols, (F.lit(base) + F.monotonically_increasing_id()).alias("__row_id"), F.lit(lsn).cast("long").alias("__lsn"), F.lit(now).cast("long").alias("__created_at"))
        numbered.write.parquet(part["path"])
        state["next_row"] = (self.spark.read.parquet(part["path"]).agg(F.max("__row_id")).first()[0] or base) + 1
        state["parts"].setdefault(table, []).append(part)
        return part

    def add_graves(self, state: dict, table: str, ids: DataFrame, lsn: int) -> dict:
        part = {"path": f"{self.path}/parts/{table}/{uuid.uuid4().hex}", "kind": "graves", "lsn": lsn}
        ids.select("__row_id", F.lit(lsn).cast("long").alias("__lsn")).write.parquet(part["path"])
        state["parts"].setdefault(table, []).append(part)
        return part

    def read(self, state: dict, table: str, lsn: int | None = None) -> DataFrame:
        """Visible rows with the hidden columns, at a commit number or at the state's last."""
        meta = state["tables"][table]
        parts = [p for p in state["parts"].get(table, []) if lsn is None or p["lsn"] <= lsn]
        rows, graves = [p["path"] for p in parts if p["kind"] == "rows"], [p["path"] for p in parts if p["kind"] == "graves"]
        if not rows:
            return self.spark.createDataFrame([], T.StructType([*schema_of(meta).fields, *_HIDDEN]))
        df = self.spark.read.schema(stored_schema(meta)).parquet(*rows)
        if graves:
            dead = self.spark.read.schema(GRAVES).parquet(*graves).select("__row_id")
            df = df.join(dead, "__row_id", "left_anti")
        return _seen(meta, df)

    def dead(self, state: dict, table: str, since: int) -> DataFrame:
        """Rows deleted after a commit number, as they were, with the deleting commit as __lsn."""
        meta = state["tables"][table]
        schema = T.StructType([*schema_of(meta).fields, *_HIDDEN])
        parts = state["parts"].get(table, [])
        graves = [p["path"] for p in parts if p["kind"] == "graves" and p["lsn"] > since]
        rows = [p["path"] for p in parts if p["kind"] == "rows"]
        if not graves or not rows:
            return self.spark.createDataFrame([], schema)
        gone = self.spark.read.schema(GRAVES).parquet(*graves).select("__row_id", F.col("__lsn").alias("__gone"))
        df = self.spark.read.schema(stored_schema(meta)).parquet(*rows).join(gone, "__row_id")
        return _seen(meta, df.withColumn("__lsn", F.col("__gone")))

    def born(self, state: dict, table: str, lsn: int) -> DataFrame:
        """Rows that a commit wrote, deleted later or not."""
        meta, rows = state["tables"][table], [p["path"] for p in state["parts"].get(table, []) if p["kind"] == "rows" and p["lsn"] == lsn]
        if not rows:
            return self.spark.createDataFrame([], T.StructType([*schema_of(meta).fields, *_HIDDEN]))
        return _seen(meta, self.spark.read.schema(stored_schema(meta)).parquet(*rows))

    def mark(self, name: str, lsn: int) -> None:
        """Leave a mark that work called name is done up to a commit number."""
        self._fs.create(self._at(f"{name}/{lsn:012d}"), True).close()

    def marked(self, name: str) -> int:
        """The last commit number marked."""
        where = self._at(name)
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(where)), default=0) if self._fs.exists(where) else 0

    def size(self) -> int:
        """Bytes of all files of the store."""
        return self._fs.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(self.path)).getLength()

    def compact(self, state: dict, table: str, lsn: int) -> None:
        """Rewrite a table's visible rows as one part; older commit numbers of the table can no longer be read."""
        meta, parts = state["tables"][table], state["parts"].get(table, [])
        rows, graves = [p["path"] for p in parts if p["kind"] == "rows"], [p["path"] for p in parts if p["kind"] == "graves"]
        if not rows:
            return
        df = self.spark.read.schema(stored_schema(meta)).parquet(*rows)
        if graves:
            df = df.join(self.spark.read.schema(GRAVES).parquet(*graves).select("__row_id"), "__row_id", "left_anti")
        leads = [cols for name, cols in meta["indexes"].items() if not name.startswith("__")]
        if leads:  # in the order of the first index: row groups then hold ranges of it, which filters skip
            by = {c["name"]: c.get("stored", c["name"]) for c in meta["columns"]}
            keys = [F.col(f"`{by[c]}`").desc() if way == "DESC" else F.col(f"`{by[c]}`").asc() for c, way in leads[0]]
            df = df.sort(*keys)
        part = {"path": f"{self.path}/parts/{table}/{uuid.uuid4().hex}", "kind": "rows", "lsn": 0}
        df.write.parquet(part["path"])
        state["parts"][table] = [part]
