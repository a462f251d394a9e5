"""Snapshots of a table before each transform, with undo.

A snapshot names immutable Parquet parts and copies nothing that an earlier snapshot has already written. Rows go to parts by a
digest of all their values, so rows that did not change find themselves in the same parts again, whatever their order; a part is
known by the number of its rows and two sums of their digests. Saving a table takes one aggregation, whose result is one small row
per part, and the writing of the parts that no snapshot holds yet. A transform that changes a value in every row writes
all parts anew. The manifest is a small Parquet table of save, drop and clear entries; undo adds an entry, `clear` and `sweep`
remove the parts that no entry names any more.

One writer per history. The table is read twice, so it must give the same rows both times; new parts are read back, and if they
are not what was announced the snapshot fails and nothing names them. Columns of any type that Parquet can hold, null, NaN and negative zero
come back as they were; the order of rows does not. Equal rows, however many, share a part but are written by several tasks.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .scratch import discard

MANIFEST = ("snapshot_id string, ts bigint, action string, transform_type string, config string, "
            "summary string, rows bigint, columns array<string>, schema string, "
            "parts array<struct<part: int, n: bigint, mark: string, folder: string>>")
#: Rows a part should hold, and the most parts of a snapshot: beyond that parts grow, written by several tasks each.
ROWS_PER_PART = 1_000_000
MAX_PARTS = 4_096
EXACT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
         "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _digest(df: DataFrame) -> Column:
    """64 hex digits of a row's values; names play no part, places do."""
    places = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    return F.sha2(F.to_json(F.struct(*places), EXACT), 256) if places else F.lit("0" * 64)


def _number(start: int, digits: int) -> Column:
    return F.conv(F.substring("__digest", start, digits), 16, 10).cast("decimal(20,0)")


def _cells(df: DataFrame) -> DataFrame:
    """The rows with __digest and __cell, a number under MAX_PARTS."""
    cell = F.conv(F.substring("__digest", 1, 8), 16, 10).cast("long") % MAX_PARTS
    return df.withColumn("__digest", _digest(df)).withColumn("__cell", cell.cast("int"))


def _sums(rows: DataFrame) -> list[tuple[int, int, int, int]]:
    """cell, rows and two sums of digests: combined before the shuffle, one row for each of at most MAX_PARTS cells."""
    sums = rows.groupBy("__cell").agg(F.count("*").alias("n"), F.sum(_number(9, 15)).alias("a"), F.sum(_number(24, 15)).alias("b"))
    return [(r["__cell"], r["n"], int(r["a"]), int(r["b"])) for r in sums.collect()]


def _marks(sums: list[tuple[int, int, int, int]], parts: int) -> dict[int, tuple[int, str]]:
    """(rows, mark) of each part; a part is the cells with its number as remainder."""
    total: dict[int, list[int]] = {}
    for cell, *values in sums:
        total[cell % parts] = [x + y for x, y in zip(total.get(cell % parts, [0, 0, 0]), values)]
    return {part: (t[0], "-".join(map(str, t))) for part, t in sorted(total.items())}


class History:
    def __init__(self, spark: SparkSession, root: str, table_id: str, rows_per_part: int = ROWS_PER_PART):
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{table_id}"
        self.rows_per_part = rows_per_part

    def _log(self, snapshot_id: str, action: str, kind: str = "", config=None, summary=None, rows: int = 0,
             columns: list[str] | None = None, schema: str = "", parts: list[tuple] | None = None) -> None:
        entry = (snapshot_id, time.time_ns(), action, kind, json.dumps(config or {}, default=str),
                 json.dumps(summary or {}, default=str), rows, columns or [], schema, parts or [])
        self.spark.createDataFrame([entry], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def save_snapshot(self, df: DataFrame, kind: str, config: dict | None = None, summary: dict | None = None) -> str:
        snapshot_id, schema = f"snap_{uuid.uuid4().hex}", df.schema.json()
        cells = _cells(df)
        sums = _sums(cells)
        rows = sum(s[1] for s in sums)
        # a power of two, so that a table that grows keeps its parts until it has doubled
        parts = min(MAX_PARTS, 1 << max(0, -(-rows // self.rows_per_part) - 1).bit_length())
        wanted = _marks(sums, parts)
        held, batch = self._held(schema, wanted), f"batch_{uuid.uuid4().hex}"
        new = {part: found for part, found in wanted.items() if part not in held}
        if new:
            self._write(cells.withColumn("__part", F.col("__cell") % parts), new, parts, batch, df)
        named = [(part, n, mark, held.get(part, batch)) for part, (n, mark) in wanted.items()]
        self._log(snapshot_id, "save", kind, config, summary, rows, df.columns, schema, named)
        return snapshot_id

    def _held(self, schema: str, wanted: dict[int, tuple[int, str]]) -> dict[int, str]:
        """The folders of the parts that a snapshot has already."""
        if not wanted or not self._exists(f"{self.root}/manifest"):
            return {}
        asked = self.spark.createDataFrame([(part, mark) for part, (_, mark) in wanted.items()], "part int, mark string")
        there = self._entries().where(F.col("schema") == schema).select(F.explode("parts").alias("p")).select("p.part", "p.mark", "p.folder")
        found = there.join(F.broadcast(asked), ["part", "mark"]).groupBy("part").agg(F.min("folder").alias("folder"))
        return {r["part"]: r["folder"] for r in found.collect()}

    def _write(self, rows: DataFrame, new: dict[int, tuple[int, str]], parts: int, batch: str, df: DataFrame) -> None:
        """The rows of these parts, each part by as many tasks as it has rows for; read back and compared."""
        pieces = [(part, -(-n // self.rows_per_part)) for part, (n, _) in new.items()]
        sizes = F.broadcast(self.spark.createDataFrame(pieces, "__part int, __pieces bigint"))
        path = f"{self.root}/data/{batch}"
        piece = F.pmod(F.monotonically_increasing_id(), F.col("__pieces"))
        placed = rows.join(sizes, "__part").withColumn("__piece", piece)
        shuffled = placed.repartition(min(sum(p for _, p in pieces), 100_000), "__part", "__piece")
        shuffled.select("__part", *[F.col(f"`{c}`") for c in df.columns]).write.partitionBy("__part").parquet(path)
        back = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType())])).parquet(path)
        if _marks(_sums(_cells(back.select(*[F.col(f"`{c}`") for c in df.columns]))), parts) != new:
            discard(self.spark, path)
            raise ValueError("the table gave other rows when read again; settle it before it is saved")

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _entries(self) -> DataFrame:
        if not self._exists(f"{self.root}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        cleared = rows.agg(F.coalesce(F.max(F.when(F.col("action") == "clear", F.col("ts"))), F.lit(0)).alias("cleared"))
        gone = rows.where("action = 'drop'").select("snapshot_id").distinct()
        live = rows.where("action = 'save'").join(gone, "snapshot_id", "left_anti")
        return live.join(F.broadcast(cleared), F.col("ts") > F.col("cleared")).drop("cleared", "action")

    def history(self, limit: int = 50) -> DataFrame:
        """The last `limit` snapshots, oldest first."""
        return self._entries().drop("schema", "parts").orderBy(F.desc("ts")).limit(limit).orderBy("ts")

    def info(self, snapshot_id: str) -> dict | None:
        row = self._entries().where(F.col("snapshot_id") == snapshot_id).drop("schema", "parts").first()
        return row.asDict() if row else None

    def rollback(self, snapshot_id: str) -> DataFrame | None:
        """The table as it was in a snapshot; reads the parts that it names only."""
        row = self._entries().where(F.col("snapshot_id") == snapshot_id).select("schema", "parts").first()
        if row is None:
            return None
        schema = T.StructType.fromJson(json.loads(row["schema"]))
        paths = [f"{self.root}/data/{p['folder']}/__part={p['part']}" for p in row["parts"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rollback_last(self) -> DataFrame | None:
        """Undo: the newest snapshot, which leaves the history. Its parts stay until the next `sweep`."""
        last = self._entries().orderBy(F.desc("ts")).first()
        if last is None:
            return None
        out = self.rollback(last["snapshot_id"])
        self._log(last["snapshot_id"], "drop")
        return out

    def usage(self) -> DataFrame:
        """snapshots, named_rows (of all snapshots), stored_rows (parts named by several count once)."""
        entries = self._entries()
        parts = entries.select(F.explode("parts").alias("p")).select("p.folder", "p.part", "p.n")
        counts = parts.groupBy("folder", "part").agg(F.sum("n").alias("named"), F.max("n").alias("n"))
        total = counts.agg(F.coalesce(F.sum("named"), F.lit(0)).alias("named_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("stored_rows"))
        return entries.agg(F.count("*").alias("snapshots")).crossJoin(total)   # one row and one row

    def sweep(self) -> int:
        """Remove the parts that no snapshot names; how many there were. Tables rolled back to earlier must have been written
        elsewhere by then."""
        used = {(p["folder"], f"__part={p['part']}") for r in self._entries().select("parts").toLocalIterator() for p in r["parts"]}
        data = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        files, gone = data.getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        if not files.exists(data):
            return 0
        for batch in files.listStatus(data):
            parts = [p.getPath() for p in files.listStatus(batch.getPath()) if p.isDirectory()]
            idle = [p for p in parts if (batch.getPath().getName(), p.getName()) not in used]
            for p in idle:
                files.delete(p, True)
            if len(idle) == len(parts):
                files.delete(batch.getPath(), True)
            gone += len(idle)
        return gone

    def clear(self) -> None:
        """Forget all snapshots and remove their parts."""
        self._log("", "clear")
        self.sweep()
