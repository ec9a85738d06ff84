"""Read and write the tables: Parquet between stages, CSV at the edges. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloop.functions.parsing import literal_list
from askloop.functions.text import confidence_text
from askloop.operators.sampling import seeded_key
from askloop.schemas import CSV_COLUMNS, METRICS_LOG
from askloop.sources.ranges import records

# Quotes are doubled inside quoted fields, which may span lines.
_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}

_TYPES = {"turn": "int", "verdict": "int", "gate_verdict": "int", "correct": "int"}


def _field_from_text(name: str) -> Column:
    """One of our columns from its CSV text."""
    if name == "gold":
        return literal_list(F.col("gold"))
    if name == "gate_output":
        return F.lower("gate_output") == "true"
    if name == "answer":
        return F.coalesce("answer", F.lit(""))
    if name.startswith("correct_"):
        return F.col(name).cast("int")
    return F.col(name).cast(_TYPES.get(name, "string"))


def read_csv(
    spark: SparkSession, path: str | list[str], kind: str, dataset: str, indexed: bool = False, split: str = "",
    by_ranges: bool = False,
) -> DataFrame:
    """Read one of the exchanged CSV files (``kind`` names a CSV_COLUMNS entry) as text and type it explicitly.

    The files name neither data set nor split, which are given. A file is one task, as its fields may span lines; with
    ``by_ranges`` it is as many as it has byte ranges, for a second pass over its lines.

    Empty answers stay empty texts and digits stay digits. ``indexed`` files lead with an unnamed index column, kept
    as ``row_index``.
    """
    columns = CSV_COLUMNS[kind]
    names = (["row_index"] if indexed else []) + [ours for _, ours in columns]
    schema = ", ".join(f"{n} string" for n in names)
    if by_ranges:
        options = {k: v for k, v in _CSV.items() if k != "header"}
        raw = records(spark, path).select(F.from_csv("text", schema, {**options, "emptyValue": ""}).alias("r")).select("r.*")
    else:
        raw = spark.read.options(**_CSV, enforceSchema="true", emptyValue="").schema(schema).csv(path)
    typed = [_field_from_text(ours).alias(ours) for _, ours in columns if ours != "confidence_scores"]
    if kind == "predictions":
        shares = [F.regexp_extract("confidence_scores", rf"{c}: ([0-9.]+)", 1) for c in (0, 1)]
        typed += [F.when(s != "", s).cast("double").alias(f"confidence_{c}") for c, s in enumerate(shares)]
    index = [F.col("row_index").cast("bigint").alias("row_index")] if indexed else []
    return raw.select(*index, F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), *typed)


def python_list_text(values: Column) -> Column:
    """An array as the list literal that CSV consumers expect: single quotes, or double around an apostrophe."""

    def shown(value: Column) -> Column:
        escaped = F.replace(value, F.lit("\\"), F.lit("\\\\"))
        escaped = F.replace(F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
        single, double = F.contains(value, F.lit("'")), F.contains(value, F.lit('"'))
        both = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return (
            F.when(single & double, both)
            .when(single, F.concat(F.lit('"'), escaped, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))
        )

    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(values, shown)), F.lit("]"))


def csv_view(df: DataFrame, kind: str, indexed: bool = False) -> DataFrame:
    """The table with the exchanged headings and text forms."""
    out = [F.col("row_index").alias("_index")] if indexed else []
    for heading, ours in CSV_COLUMNS[kind]:
        if ours == "gold":
            value = python_list_text(F.col("gold"))
        elif ours == "gate_output":
            value = F.initcap(F.col("gate_output").cast("string"))
        elif ours == "confidence_scores":
            value = F.when(
                F.col("confidence_0").isNotNull(), confidence_text(F.col("confidence_0"), F.col("confidence_1"))
            )
        else:
            value = F.col(ours)
        out.append(value.alias(heading))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, kind: str, indexed: bool = False) -> None:
    """Export to a folder of CSV files with the exchanged headings."""
    options = {k: v for k, v in _CSV.items() if k != "multiLine"}
    blanks = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    csv_view(df, kind, indexed).write.mode("overwrite").options(**options, **blanks, emptyValue="").csv(path)


def read_many(spark: SparkSession, base: str, name: str, datasets: list[str], split: str, kind: str) -> DataFrame:
    """Union of ``{base}/{name}_{dataset}_generated_{split}.csv`` over the data sets."""
    parts = [read_csv(spark, f"{base}/{name}_{d}_generated_{split}.csv", kind, d, split=split) for d in datasets]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def load_splits(
    spark: SparkSession, train: str, val: str | None, test: str, kind: str = "training", dataset: str = "",
    sample_fraction: float = 0.2, seed: int = 42, compat: bool = False,
) -> DataFrame:
    """Train, val and test files as one table with ``split``.

    Without a val file, val is a seeded sample of the train questions and leaves train; with ``compat`` its rows also
    stay in train. The sample goes by the seeded key of dataset and id, so all turns of a question are on one side. A
    missing file is an error.
    """
    train_df = read_csv(spark, train, kind, dataset)
    if val is None:
        place = F.conv(F.substring(seeded_key(seed, "dataset", "id"), 1, 8), 16, 10).cast("bigint")
        chosen = place < int(sample_fraction * (1 << 32))
        val_df, train_df = train_df.filter(chosen), train_df if compat else train_df.filter(~chosen)
    else:
        val_df = read_csv(spark, val, kind, dataset)
    test_df = read_csv(spark, test, kind, dataset)
    parts = [df.withColumn("split", F.lit(s)) for s, df in (("train", train_df), ("val", val_df), ("test", test_df))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_raw(spark: SparkSession, path: str | list[str], schema: str, fmt: str = "json") -> DataFrame:
    """Landed source records (JSON lines or Parquet) with their nested schema."""
    return spark.read.format(fmt).schema(schema).load(path)


def write_qa(df: DataFrame, path: str) -> None:
    """Question tables are stored by data set and split, which readers prune on."""
    df.write.mode("overwrite").partitionBy("dataset", "split").parquet(path)


_QA_STORED = "row_index bigint, id string, question string, gold array<string>, dataset string, split string"


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_QA_STORED).parquet(path)


def read_qa_slice(spark: SparkSession, path: str | list[str], start: int = 0, end: int | None = None) -> DataFrame:
    """Questions ``start`` to ``end - 1`` of the whole source, whatever data sets and splits it holds."""
    return read_slice(spark, [path] if isinstance(path, str) else path, _QA_STORED, start, end).drop("position")


def append_results(df: DataFrame, path: str, run_id: str) -> None:
    """Append result rows of one run. Runs are folders, so a rerun never mixes with another."""
    parts = ["run_id", "turn"] if "turn" in df.columns else ["run_id"]
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy(*parts).parquet(path)


def write_sets(df: DataFrame, path: str) -> None:
    """Training rows by side."""
    df.write.mode("overwrite").partitionBy("side").parquet(path)


def append_metrics(long: DataFrame, path: str) -> None:
    """Write rows of the METRICS_LOG schema to the run log. A stage of a run is a folder of its own, which a rerun replaces."""
    names = [c.split()[0] for c in METRICS_LOG.split(", ")]
    writer = long.select(*names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id", "stage").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    names = [c.split()[0] for c in METRICS_LOG.split(", ")]
    return spark.read.schema(METRICS_LOG).parquet(path).select(*names)


def read_slice(spark: SparkSession, paths: list[str], schema: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows ``start`` to ``end - 1`` of Parquet tables taken as one, with their ``position``.

    The tables count one after the other, each by its files in the order of their paths, a file by its rows as stored. Row
    counts come from the files' footers, one row a file; then only the files that hold wanted rows are read.
    """
    parts = []
    file, place = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place")
    sizes = [spark.read.schema(schema).parquet(p).groupBy(file).agg(F.count(F.lit(1)).alias("n")).orderBy("_file").collect() for p in paths]
    before = 0
    for path, files in zip(paths, sizes):
        wanted = []
        for r in files:
            if before + r.n > start and (end is None or before < end):
                wanted.append((r["_file"], before))
            before += r.n
        if not wanted:
            continue
        table = spark.read.schema(schema).parquet(path)
        held = table.select(*table.columns, file, place).filter(F.col("_file").between(wanted[0][0], wanted[-1][0]))
        offsets = spark.createDataFrame(wanted, "_file string, _before bigint")  # a row for each file that is read
        parts.append(held.join(F.broadcast(offsets), "_file").withColumn("position", F.col("_place") + F.col("_before")).drop("_file", "_place", "_before"))
    if not parts:
        return spark.createDataFrame([], schema).withColumn("position", F.lit(0).cast("bigint"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole = whole.filter(F.col("position") >= start)
    return whole if end is None else whole.filter(F.col("position") < end)
