"""The library's input tables, derived from the driver's test tables. Each has a SQL twin in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = ["click", "view", "purchase", "error", "signup"]


SCHEMAS = {
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read with its given schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _digit():
    return (F.length("text") % 4).cast("string")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per conversation: its opening text; the gold answer is the conversation number modulo 4."""
    return table(spark, sf_dir, "conversations").filter("turn = 0").select(
        F.col("conv_id").alias("row_index"),
        F.lit("conv").alias("dataset"),
        F.lit("dev").alias("split"),
        F.col("conv_id").cast("string").alias("id"),
        F.col("text").alias("question"),
        F.array((F.col("conv_id") % 4).cast("string")).alias("gold"),
    )


def responses(spark: SparkSession, sf_dir: str, first_turn: int = 0) -> DataFrame:
    """Recorded responses: each conversation turn answers with its length modulo 4; some lack the rationale label."""
    label = F.when(F.col("conv_id") % 11 == 0, "\n").otherwise("\nRationale: ")
    return table(spark, sf_dir, "conversations").select(
        F.lit("conv").alias("dataset"),
        F.lit("dev").alias("split"),
        F.col("conv_id").cast("string").alias("id"),
        (F.col("turn") + first_turn).cast("int").alias("turn"),
        F.concat(F.lit("Answer: "), _digit(), label, F.col("text")).alias("response"),
    )


def gate_outputs(spark: SparkSession, sf_dir: str, first_turn: int = 0) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.lit("conv").alias("dataset"),
        F.lit("dev").alias("split"),
        F.col("conv_id").cast("string").alias("id"),
        (F.col("turn") + first_turn).cast("int").alias("turn"),
        (F.length("text") % 3 == 0).alias("gate_output"),
        (1 - (F.length("text") % 10) / 10).alias("confidence_0"),
        ((F.length("text") % 10) / 10).alias("confidence_1"),
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a recorded, gated rollout turn."""
    return table(spark, sf_dir, "conversations").select(
        F.lit("conv").alias("dataset"),
        F.lit("dev").alias("split"),
        F.col("conv_id").cast("string").alias("id"),
        F.col("turn").cast("int").alias("turn"),
        F.concat(F.lit("Q: "), F.col("role"), F.lit(" \n")).alias("task_content"),
        _digit().alias("answer"),
        F.col("text").alias("rationale"),
        F.array((F.col("conv_id") % 4).cast("string")).alias("gold"),
        (F.length("text") % 3 == 0).alias("gate_output"),
        (F.length("text") % 4 == F.col("conv_id") % 4).cast("int").alias("correct"),
    )


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events in a row as the turns of one question, with two-word answers, abstentions and null rationales."""
    event = table(spark, sf_dir, "events").withColumns(
        {
            "q": F.expr("event_id div 4"),
            "k": F.get_json_object("props", "$.k").cast("bigint"),
        }
    )
    answer = (
        F.when(F.col("value") < 2, "unsure")
        .when(F.col("value") < 3, "none of above")
        .otherwise(F.concat("event_type", F.lit(" "), (F.col("k") % 3).cast("string")))
    )
    kind = F.element_at(F.array(*[F.lit(t) for t in EVENT_TYPES]), (F.col("q") % 5 + 1).cast("int"))
    key = F.concat(kind, F.lit(" "), (F.col("q") % 3).cast("string"))
    return event.select(
        F.lit("events").alias("dataset"),
        F.lit("train").alias("split"),
        F.col("q").cast("string").alias("id"),
        (F.col("event_id") % 4).cast("int").alias("turn"),
        F.concat(F.lit("Q: which event?"), F.when(F.col("k") % 7 == 0, "\nGround-truth Answer: x\n").otherwise(" \n")).alias(
            "task_content"
        ),
        answer.alias("answer"),
        F.when(F.col("k") % 9 != 0, F.concat(F.lit("It was "), "event_type", F.lit(" "), "props")).alias("rationale"),
        F.array(F.concat(F.lit("The "), key), F.concat(key, F.lit(" times"))).alias("gold"),
        (F.col("value") > 20).alias("gate_output"),
        (answer == key).cast("int").alias("correct"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_turns(spark, sf_dir).unionByName(event_turns(spark, sf_dir))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).withColumnRenamed("correct", "verdict").drop("gate_output")


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir).withColumnRenamed("verdict", "gate_verdict")


def document_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four documents in a row as the rationales of one question, whole texts."""
    return table(spark, sf_dir, "documents").select(
        F.lit("docs").alias("dataset"),
        F.lit("train").alias("split"),
        F.expr("cast(doc_id div 4 as string)").alias("id"),
        (F.col("doc_id") % 4).cast("int").alias("turn"),
        F.col("source").alias("answer"),
        F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("rationale"),
    )


def raw_mcq(spark: SparkSession, sf_dir: str, question: str = "question") -> DataFrame:
    """Every blank-separated part of an item as one choice."""
    words = F.split("text", " ")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("row_index"),
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("id"),
        F.col("text").alias(question),
        F.struct(F.array(*[F.lit(c) for c in "ABCD"]).alias("label"), words.alias("text")).alias("choices"),
        F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (F.col("item_id") % 4 + 1).cast("int")).alias("answerKey"),
    )


def raw_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("source_index"),
        F.col("p_name").alias("goal"),
        F.col("p_brand").alias("sol1"),
        F.col("p_type").alias("sol2"),
        (F.col("p_partkey") % 2).cast("int").alias("label"),
    )


def raw_cloze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("source_index"),
        F.concat(F.lit("_ is "), "p_name", F.lit(", not _")).alias("sentence"),
        F.col("p_brand").alias("option1"),
        F.col("p_type").alias("option2"),
        (F.col("p_partkey") % 2 + 1).cast("string").alias("answer"),
    )


def math_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worked answers from order lines: a stated number, a last number, or none."""
    price = F.concat(F.col("l_partkey").cast("string"), F.lit(",0"), F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("Add 2 and 3. The answer is $"), price, F.lit(".50, or 7.")))
        .when(
            F.col("l_suppkey") % 3 == 1,
            F.concat(F.lit("First "), F.col("l_orderkey").cast("string"), F.lit(" then "), price, F.lit(" at last")),
        )
        .otherwise(F.concat(F.lit("Flag: "), "l_returnflag"))
        .alias("response"),
    )


def quoted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event texts in the shapes the small parsers expect, by event number modulo 3."""
    kind, number = F.col("event_type"), F.col("user_id").cast("string")
    shape = F.col("event_id") % 3

    def shaped(zero, one, two):
        return F.when(shape == 0, zero).when(shape == 1, one).otherwise(two)

    return table(spark, sf_dir, "events").select(
        "event_id",
        shaped(
            F.concat(F.lit('x {"search_query": "'), kind, F.lit('"} y')),
            F.concat(F.lit('search_query: "'), kind, F.lit('",\n the reasoning is')),
            F.concat(F.lit("plain "), kind),
        ).alias("query_text"),
        shaped(
            F.concat(F.lit("Of 12 I choose ("), number, F.lit(") \n")),
            F.concat(F.lit("(3) or "), number, F.lit(" then")),
            F.concat(F.lit("no number for "), kind),
        ).alias("choice_text"),
        shaped(
            F.concat(F.lit("['"), kind, F.lit("', \"it's\", "), number, F.lit("]")),
            F.concat(F.lit("\"('"), kind, F.lit("',)\"")),
            F.concat(F.lit("'"), kind, F.lit("'")),
        ).alias("list_text"),
        "value",
        "user_id",
        "event_type",
    )


def gate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as gate rows; class 0 (not toxic) is the larger one."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select(
        F.lit("docs").alias("dataset"),
        F.lit("train").alias("split"),
        F.col("doc_id").cast("string").alias("id"),
        F.lit(0).alias("turn"),
        F.concat(F.lit("Q: "), "source", F.lit(" \n")).alias("task_content"),
        F.col("lang").alias("answer"),
        F.col("text").alias("rationale"),
        F.col("quality").alias("gate_verdict"),
        F.col("toxic").cast("int").alias("toxic"),
    )
