"""CSV files whose quoted values hold line breaks, read by many tasks.

Whether a line break ends a record depends on all quotes before it. So each byte range of a file is first read under both
suppositions, that it starts outside and that it starts inside a quoted value, which gives a map of two states to two states.
A pass over these maps, in the order of the ranges, tells where each range really starts. Then each range assembles its own
records, and only the pieces of records that cross a range's end are shuffled. Spark's own parser reads the records.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .scratch import keep

#: Options that change how a value is read but not where records end; with others a file is read by one task.
VALUE_OPTIONS = frozenset("sep delimiter nullvalue emptyvalue nanvalue positiveinf negativeinf dateformat timestampformat locale".split())
#: States of ranges are broadcast up to this many bytes, counted; beyond, lines are shuffled to them.
BROADCAST_BYTES = 64 << 20
MARK = b"\xef\xbb\xbf"   # fixed value: UTF-8 byte order mark

SUMMARY = ("file string, block long, end_out boolean, end_in boolean, closes boolean, begins_out boolean, begins_in boolean, "
           "open boolean, first_cr boolean, any_cr boolean, stray_cr boolean")
PIECES = "file string, chain long, block long, part int, head boolean, text binary"


def ends_inside(line: bytes, inside: bool, sep: bytes = b",", quote: bytes = b'"') -> bool:
    """Whether a quoted value is open at the end of a line. A quote opens a value only as its first character; in an open value
    two quotes stand for one; what follows a closing quote belongs to the value up to the next separator."""
    if quote not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
            at, inside = at + 1, False
        elif line.startswith(quote, at):
            at, inside = at + 1, True
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _ranges(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of a partition, range by range; the first `width` columns tell the range."""
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
    return groupby(rows, key=itemgetter(*range(width)))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def _summarise(sep: bytes, quote: bytes):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64())] + [(n, pa.bool_()) for n in (
        "end_out", "end_in", "closes", "begins_out", "begins_in", "open", "first_cr", "any_cr", "stray_cr")])

    def summarise(batches):
        for (file, block), rows in _ranges(batches, 2):
            out, into = False, True
            closes = begins_out = begins_in = is_open = any_cr = stray = False
            first_cr = None
            for _, _, line in rows:
                cr = line.endswith(b"\r")
                if first_cr is None:
                    first_cr = cr
                    if block == 0:
                        line = line.removeprefix(MARK)
                any_cr |= cr
                stray |= b"\r" in line[:-1]
                filled = len(line) > cr
                begins_out |= filled and not out
                begins_in |= filled and not into
                same = out == into
                out = ends_inside(line, out, sep, quote)
                into = out if same else ends_inside(line, into, sep, quote)
                is_open |= out
                closes |= not into
            yield _table([(file, block, out, into, closes, begins_out, begins_in, is_open, first_cr, any_cr, stray)], schema)

    return summarise


def _assemble(sep: bytes, quote: bytes, whole: bool):
    """Records that lie in one range, or else the pieces of those that cross an end: part 1 goes on from an earlier range,
    part 2 begins here. The header is left out; where it crosses an end, its first piece says so."""
    schema = pa.schema([("file", pa.string()), ("chain", pa.int64()), ("block", pa.int64()), ("part", pa.int32()),
                        ("head", pa.bool_()), ("text", pa.binary())])

    def assemble(batches):
        out, held = [], 0
        for (file, block, inside, chain, head, crlf), rows in _ranges(batches, 6):
            record, first, rest = [], block == 0, inside
            for *_, line in rows:
                if first:
                    line, first = line.removeprefix(MARK), False
                if crlf:
                    line = line.removesuffix(b"\r")
                record.append(line)
                inside = ends_inside(line, inside, sep, quote)
                if inside:
                    continue
                text, record = b"\n".join(record), []
                if rest:
                    rest = False
                    if not whole:
                        out.append((file, chain, block, 1, False, text))
                elif text and head:
                    head = False
                elif text and whole:
                    out.append((file, chain, block, 0, False, text))
                    held += len(text)
                if held > 8 << 20 or len(out) >= 10_000:
                    yield _table(out, schema)
                    out, held = [], 0
            if record and not whole:
                text = b"\n".join(record)
                out.append((file, chain, block, 1, False, text) if rest else (file, block, block, 2, head, text))
        yield _table(out, schema)

    return assemble


def _states(summary: DataFrame) -> DataFrame:
    """How each range really starts and ends: the last map that leads to one state whatever the start, and the parity of the
    maps after it that swap the states. `chain` is the range in which the record that is open at the start began."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    file = Window.partitionBy("file")
    swaps = summary.withColumn("swaps", F.sum((F.col("end_out") & ~F.col("end_in")).cast("int")).over(upto))
    known = F.when(F.col("end_out") == F.col("end_in"), F.struct(F.col("end_out").cast("int").alias("state"), "swaps"))
    found = swaps.withColumn("known", F.last(known, ignorenulls=True).over(before)) \
        .withColumn("earlier", F.coalesce(F.last("swaps").over(before), F.lit(0)))
    state = F.coalesce(F.col("known.state"), F.lit(0)) + F.col("earlier") - F.coalesce(F.col("known.swaps"), F.lit(0))
    started = found.withColumn("inside", state % 2 == 1)
    ends = F.when(F.col("inside"), F.col("end_in")).otherwise(F.col("end_out"))
    opens = F.when(F.col("inside"), F.col("end_in") & F.col("closes")).otherwise(F.col("end_out"))
    begins = F.when(F.col("inside"), F.col("begins_in")).otherwise(F.col("begins_out"))
    return started.select(
        "file", "block", "inside", ends.alias("ends"), F.last(F.when(opens, F.col("block")), ignorenulls=True).over(before).alias("chain"),
        F.coalesce(F.col("block") == F.min(F.when(begins, F.col("block"))).over(file), F.lit(False)).alias("head"),
        F.first("first_cr").over(Window.partitionBy("file").orderBy("block")).alias("crlf"))


def read_split(spark: SparkSession, path: str, schema: T.StructType, options: dict) -> DataFrame | None:
    """The rows that Spark's reader gives with `multiLine` and a header, in the given schema, each file by many tasks.

    None where only that reader is right: an option outside `VALUE_OPTIONS`, folders that name partition columns, a carriage
    return that is not part of its file's line ends. Files without line breaks in values go to Spark's splitting reader.
    A value that is never closed reaches to the end of its file, without the file's last line break."""
    names = {k.lower(): v for k, v in options.items()}
    sep = str(names.get("sep", names.get("delimiter", ",")))
    source = spark.read.option("lineSep", "\n").text(path)
    corrupt = spark.conf.get("spark.sql.columnNameOfCorruptRecord")
    if not set(names) <= VALUE_OPTIONS or sep == '"' or source.columns != ["value"] or corrupt in schema.names:
        return None
    sep, quote = sep.replace("\\t", "\t").encode(), b'"'
    lines = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                          F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("text"))
    summary, _ = keep(lines.select("file", "block", "text").mapInArrow(_summarise(sep, quote), SUMMARY), "ranges")
    states = _states(summary)
    checked = summary.join(states.select("file", "block", "crlf"), ["file", "block"]).agg(
        F.coalesce(F.bool_or("open"), F.lit(False)).alias("open"),
        F.coalesce(F.bool_or(F.col("stray_cr") | (F.col("any_cr") & ~F.col("crlf"))), F.lit(False)).alias("odd"),
        F.coalesce(F.sum(F.octet_length("file") + 64), F.lit(0)).alias("bytes")).first()
    if checked["odd"]:
        return None
    reader = {**options, "escape": '"'}
    if not checked["open"]:
        return spark.read.options(header=True, multiLine=False, **reader).schema(schema).csv(path)

    def placed(ranges: DataFrame) -> DataFrame:
        if checked["bytes"] <= BROADCAST_BYTES:
            joined = lines.join(F.broadcast(ranges), ["file", "block"])
        else:
            joined = lines.join(ranges, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "line")
        return joined.select("file", "block", "inside", "chain", "head", "crlf", "text")

    whole = placed(states).mapInArrow(_assemble(sep, quote, True), PIECES).select("text")
    pieces = placed(states.where(F.col("inside") | F.col("ends"))).mapInArrow(_assemble(sep, quote, False), PIECES)
    crossing = pieces.groupBy("file", "chain").agg(
        F.bool_or("head").alias("head"),
        F.array_sort(F.collect_list(F.struct("block", "part", F.col("text").cast("string").alias("text")))).alias("parts")) \
        .where(~F.col("head")).select(F.array_join(F.col("parts.text"), "\n").alias("text"))
    records = whole.select(F.col("text").cast("string").alias("text")).unionByName(crossing)
    ddl = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema.fields))
    parsed = records.select(F.from_csv("text", ddl, {k: str(v) for k, v in reader.items()}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(schema.fields)])
