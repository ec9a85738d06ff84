"""Fixed-length token id arrays: cut, pad, mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The label id that the loss ignores, and the longest input and label in tokens.
IGNORED = -100
MAX_INPUT = 1024
MAX_LABEL = 64


def cut(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, length)


def pad(ids: Column, length: Column | int, fill: int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(length - F.size(ids), F.lit(0))))


def attention_mask(ids: Column, length: Column | int) -> Column:
    return pad(F.transform(ids, lambda _: F.lit(1)), length, 0)


def ignore_pad(ids: Column, pad_id: int) -> Column:
    return F.transform(ids, lambda i: F.when(i == pad_id, IGNORED).otherwise(i))


def restore_pad(labels: Column, pad_id: int) -> Column:
    """Ignored labels back to the pad id, as needed before decoding."""
    return F.transform(labels, lambda i: F.when(i == IGNORED, pad_id).otherwise(i))


def binary_targets(labels: Column, zero_id: int, one_id: int) -> Column:
    """Ids of the words "0" and "1" become classes 0 and 1; every other position is ignored."""
    return F.transform(labels, lambda i: F.when(i == zero_id, 0).when(i == one_id, 1).otherwise(IGNORED))


def encode_columns(input_ids: Column, label_ids: Column, pad_id: int, max_input: int, max_label: int):
    """The three training arrays, padded to fixed length."""
    kept = cut(input_ids, max_input)
    labels = pad(cut(label_ids, max_label), max_label, pad_id)
    return [
        pad(kept, max_input, pad_id).alias("input_ids"),
        attention_mask(kept, max_input).alias("attention_mask"),
        ignore_pad(labels, pad_id).alias("labels"),
    ]


def collate(df: DataFrame, batch: str, pad_id: int, multiple: int = 8) -> DataFrame:
    """Pad unpadded arrays to the longest row of their batch, rounded up to ``multiple``.

    A batch is a training batch (a handful of rows), so its window partition stays small.
    """
    within = Window.partitionBy(batch)

    def width(name: str) -> Column:
        return (F.ceil(F.max(F.size(name)).over(within) / F.lit(multiple)) * multiple).cast("int")

    sized = df.withColumn("_input", width("input_ids")).withColumn("_label", width("labels"))
    return sized.select(
        *[c for c in df.columns if c not in ("input_ids", "attention_mask", "labels")],
        pad(F.col("input_ids"), F.col("_input"), pad_id).alias("input_ids"),
        pad(F.col("attention_mask"), F.col("_input"), 0).alias("attention_mask"),
        pad(F.col("labels"), F.col("_label"), IGNORED).alias("labels"),
    )
