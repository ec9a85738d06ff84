"""Records of CSV files whose fields may span lines, from many tasks a file.

A file is read as lines, in the byte ranges that Spark cuts it into. A quote is doubled within a quoted field, so the number of
quotes before a line tells whether it stands inside a field: even outside, odd inside. A first pass counts the quotes of each
range, and a running sum over a file's ranges, one row each, gives the state at every range's start. A second pass then puts
the lines of a range together into records where they stand. Only the two fragments at a range's ends are shuffled, and joined to
those of the ranges beside it, however many a field may span.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, END, TAIL = 0, 1, 2
CUT = "file string, start bigint, kind int, first boolean, text string"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of each range, in their order; a carriage return stays."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _starts(lines: DataFrame) -> DataFrame:
    """(file, start, inside) of each range: does it begin within a quoted field? One row for each task's range."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    counted = lines.groupBy("file", "start").agg(F.sum(quotes).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the fragments at the ends of ranges: the end of a record begun before, or one that goes on behind."""
    place, held, inside, joins, first, out = None, [], False, False, False, []

    def close(kind: int) -> None:
        nonlocal held, joins, first
        out.append((*place, kind, first, "\n".join(held)))
        held, joins, first = [], False, False

    for batch in batches:
        for value, file, start, begins_inside in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if place != (file, start):
                if held:
                    close(END if joins else TAIL)
                place, inside, joins, first = (file, start), begins_inside, begins_inside, start == 0
            held.append(value)
            inside ^= value.count('"') % 2 == 1
            if not inside:
                close(END if joins else WHOLE)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "kind", "first", "text"), r)) for r in out], _SCHEMA)
            out.clear()
    if held:
        close(END if joins else TAIL)
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "kind", "first", "text"), r)) for r in out], _SCHEMA)


_SCHEMA = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("text", pa.string())])


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(text): every record of the files but their headings; a field's line ends stay as they are. Blank lines are none."""
    lines = _lines(spark, path)
    # One row for each range; the rows of a range must stay in order, so they may not be shuffled.
    told = lines.join(F.broadcast(_starts(lines)), ["file", "start"]).select("value", "file", "start", "inside")
    cut = told.mapInArrow(_cut, CUT)
    whole = cut.filter(F.col("kind") == WHOLE).select("first", "text")
    in_file = Window.partitionBy("file").orderBy("start", "kind")
    ends = cut.filter(F.col("kind") != WHOLE)
    chain = F.last(F.when(F.col("kind") == TAIL, F.col("start")), ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, 0))
    joined = ends.withColumn("chain", chain).groupBy("file", "chain").agg(
        F.max("first").alias("first"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "kind", "text"))), lambda p: p["text"]), "\n").alias("text"),
    )
    every = whole.unionAll(joined.select("first", "text"))
    return every.filter(~F.col("first") & ~F.col("text").isin("", "\r")).select("text")
