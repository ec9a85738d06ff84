"""Exact seeded picks without a global sort, and dense row numbers without a global window.

A row's place in the seeded order is the md5 of the seed and its key. The first four hex digits put rows into 65,536
even buckets; a histogram of the buckets tells which bucket holds the last row wanted, and only that bucket is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloop.session import materialize

BUCKET_DIGITS = 4


def seeded_key(seed: int | str, *columns: str) -> Column:
    """The seeded order key, the same in every engine: md5 of ``seed|col|col…``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def _bucket(key: str) -> Column:
    return F.substring(key, 1, BUCKET_DIGITS)


def bucket_histogram(df: DataFrame, strata: list[str], key: str) -> DataFrame:
    """Rows per (stratum, bucket): at most 65,536 rows a stratum, combined map-side."""
    return df.groupBy(*strata, _bucket(key).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))


def cut_keys(df: DataFrame, strata: list[str], key: str, histogram: DataFrame, quota: DataFrame) -> DataFrame:
    """Per stratum the ``_cut``: the key of the last of its ``take`` rows with the smallest keys.

    ``quota`` has the strata columns and ``take``; ``key`` is unique within a stratum; ``df`` is a written narrow table.
    A stratum that takes nothing has no row here. Only the key column of the one cut bucket (1/65,536 of a stratum) is
    ranked. The result, one row per stratum, is written, so that the planner knows how small it is.
    """
    upto = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        histogram.withColumn("_upto", F.sum("_n").over(upto))
        .join(quota, strata)
        .filter((F.col("_upto") >= F.col("take")) & (F.col("_upto") - F.col("_n") < F.col("take")))
        .select(*strata, F.col("_bucket"), (F.col("take") - F.col("_upto") + F.col("_n")).alias("_place"))
    )
    ranked = Window.partitionBy(*strata).orderBy(key)
    cuts = (
        df.select(*strata, key)
        .withColumn("_bucket", _bucket(key))
        .join(cut, [*strata, "_bucket"])
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") == F.col("_place"))
        .select(*strata, F.col(key).alias("_cut"))
    )
    return materialize(cuts, "cuts")


def number_rows(df: DataFrame, order: list[Column | str], by: list[str], name: str = "row_index") -> DataFrame:
    """Number rows 0, 1, 2, … within ``by`` in the order of ``order``, whose values are unique there.

    Rows are range-partitioned by that order, sorted and written once with their place in the partition; a row's number
    is its place in its partition and group plus the rows of the group in earlier partitions. Only one row for each
    partition and group is gathered to add these up.
    """
    keys = [*[F.col(c) for c in by], *[F.col(c) if isinstance(c, str) else c for c in order]]
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(sorted_.withColumns({"_part": F.spark_partition_id(), "_place": place}), "numbered")
    parts = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*by, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_before"))
    numbered = placed.join(F.broadcast(offsets), [*by, "_part"])  # a row for each partition and group
    return numbered.withColumn(name, F.col("_place") + F.col("_before")).select(*df.columns, name)
