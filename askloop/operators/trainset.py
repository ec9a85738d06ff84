"""Gate training sets: balance the classes, split by question, join data sets, write instruction text, encode."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloop.functions import encoding
from askloop.functions.parsing import clean_task_content
from askloop.functions.text import label_text, tokens
from askloop.operators.prompts import gate_input
from askloop.operators.sampling import bucket_histogram, cut_keys, number_rows, seeded_key
from askloop.operators.skew import join_per_question
from askloop.schemas import KEYS
from askloop.session import materialize

# Seed and share of the development side.
SEED = 42
DEV_SHARE = 0.2

ROW_KEY = [*KEYS, "turn"]


def class_distribution(df: DataFrame, label: str = "gate_verdict", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def balance(df: DataFrame, label: str = "gate_verdict", seed: int = SEED, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Downsample class 0 to exactly the size of class 1, per data set, where class 0 is larger; never the reverse.

    ``shuffle_key`` is the seeded order. The cuts are worked out on a narrow table of keys and labels, written once; the
    rows themselves are read once, at the end, and filtered against one key per data set without a shuffle.
    (dataset, split, id, turn) must be unique.
    """
    by = list(by)
    keyed = df.withColumn("shuffle_key", seeded_key(seed, *ROW_KEY))
    narrow = materialize(keyed.select(*by, label, "shuffle_key"), "balance-keys")
    zeros = narrow.filter(F.col(label) == 0)
    histogram = bucket_histogram(narrow, [*by, label], "shuffle_key")
    sizes = histogram.groupBy(*by).agg(
        F.sum(F.when(F.col(label) == 0, F.col("_n")).otherwise(0)).alias("_zeros"),
        F.sum(F.when(F.col(label) == 1, F.col("_n")).otherwise(0)).alias("_ones"),
    )
    quota = sizes.select(*by, F.least("_zeros", "_ones").alias("take"))
    cuts = cut_keys(zeros, by, "shuffle_key", histogram.filter(F.col(label) == 0).drop(label), quota)
    return (
        keyed.join(cuts, by, "left")
        .filter((F.col(label) == 1) | ((F.col(label) == 0) & (F.col("shuffle_key") <= F.col("_cut"))))
        .drop("_cut")
    )


def group_labels(df: DataFrame, label: str = "gate_verdict") -> DataFrame:
    """One label per question: the more frequent of 0 and 1, 0 on a tie. Rows without a label have no vote.

    Two sums, which aggregate in fixed-width buffers, where ``mode`` would ship a map per question.
    """
    ones, votes = F.sum(label), F.count(label)
    return df.groupBy(*KEYS).agg(F.when(2 * ones > votes, 1).otherwise(0).alias("group_label"))


def dev_quota(sizes: DataFrame, by: list[str], share: float) -> DataFrame:
    """How many groups of each stratum go to the development side.

    Overall ceil(share * n). The training side is laid out in proportion, whole parts first and the rest by largest
    remainder (smaller label first on a tie); the development side gets what is left of each stratum.
    """
    whole = Window.partitionBy(*by)
    total = F.sum("_groups").over(whole)
    train = total - F.ceil(total * F.lit(share).cast("decimal(10,6)"))
    exact = train * F.col("_groups") / total
    laid = sizes.select(
        *by, "group_label", "_groups", F.floor(exact).alias("_whole"),
        F.round(exact - F.floor(exact), 9).alias("_part"), train.alias("_train"),
    )
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_part"), "group_label"))
    missing = F.col("_train") - F.sum("_whole").over(whole)
    extra = F.when(place <= missing, 1).otherwise(0)
    return laid.select(*by, "group_label", (F.col("_groups") - F.col("_whole") - extra).cast("bigint").alias("take"))


def split_groups(
    df: DataFrame,
    label: str = "gate_verdict",
    share: float = DEV_SHARE,
    seed: int = SEED,
    by: tuple[str, ...] = ("dataset",),
) -> DataFrame:
    """Every question with its ``group_label`` and ``side`` (train or dev), stratified by label, exact in number."""
    by = list(by)
    strata = [*by, "group_label"]
    # One narrow row a question, used by several jobs below.
    groups = materialize(group_labels(df, label).withColumn("_key", seeded_key(seed, *KEYS)), "groups")
    histogram = bucket_histogram(groups, strata, "_key")
    sizes = histogram.groupBy(*strata).agg(F.sum("_n").alias("_groups"))
    cuts = cut_keys(groups, strata, "_key", histogram, dev_quota(sizes, by, share))
    side = F.when(F.col("_key") <= F.col("_cut"), "dev").otherwise("train")
    return groups.join(cuts, strata, "left").select(*KEYS, "group_label", side.alias("side"))


def group_split(
    df: DataFrame,
    label: str = "gate_verdict",
    share: float = DEV_SHARE,
    seed: int = SEED,
    by: tuple[str, ...] = ("dataset",),
) -> DataFrame:
    """Add ``side`` to every row; a question is never on both sides. ``split`` stays that of the question."""
    groups = split_groups(df, label, share, seed, by).drop("group_label")
    return join_per_question(df, groups)


def join_sets(*sets: DataFrame) -> DataFrame:
    """Union of the data sets' training tables; each carries its ``dataset``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)


def tag_sides(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    """One table of the three parts, told apart by ``side``."""
    parts = {"train": train, "val": val, "test": test}
    return join_sets(*[df.withColumn("side", F.lit(name)) for name, df in parts.items()])


def first_rows(df: DataFrame, n: int, order: str | None = None) -> DataFrame:
    """The first ``n`` rows: by the stored index as a plain filter, else in the given order."""
    if order is None:
        return df.filter(F.col("row_index") < n)
    return df.orderBy(order).limit(n)


def to_instruct(
    df: DataFrame, label: str = "gate_verdict", setting: str = "exploration", compat: bool = False, keep: tuple = ()
) -> DataFrame:
    """Instruction text and label text of each training row."""
    content = clean_task_content(F.col("task_content"), compat)
    text = gate_input(content, F.col("answer"), F.col("rationale"), setting)
    return df.select(*keep, text.alias("input"), label_text(F.col(label)).alias("label"))


# --- Encoding -------------------------------------------------------------------------------------------------------

PAD, END, UNKNOWN, ZERO, ONE = 0, 1, 2, 3, 4
RESERVED = 5


def build_vocabulary(df: DataFrame, text: str = "input", max_words: int | None = None) -> DataFrame:
    """Word ids of a corpus by falling frequency, as ``word, token_id``; of all words, or of the ``max_words`` first.

    Counting combines map-side and the numbers come from a range partitioning, so no task holds all words. The label
    words "0" and "1" have reserved ids.
    """
    words = df.select(F.explode(tokens(F.col(text))).alias("word")).filter(~F.col("word").isin("0", "1"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = number_rows(counted, [F.desc("n"), F.col("word")], [], "_place")
    kept = ranked if max_words is None else ranked.filter(F.col("_place") < max_words)
    return kept.select("word", (F.col("_place") + RESERVED).cast("int").alias("token_id"))


class VocabularyTokenizer:
    """Word ids from a vocabulary table, with the end id last.

    The ``at_hand`` most frequent words, those of the smallest ids, travel with the tasks and answer in Arrow batches, each
    different word of a batch once. Only words behind them leave their row: a row for each text and different one is joined
    with the rest of the vocabulary. None of these can be hot, as it is rarer than ``at_hand`` others.
    """

    def __init__(self, vocabulary: DataFrame, at_hand: int = 1 << 15):
        self.vocabulary = vocabulary.select("word", F.col("token_id").cast("int"))
        self.first_rare = RESERVED + at_hand

    def ids(self, df: DataFrame, key: list[str], texts: dict[str, int]) -> DataFrame:
        """``key`` plus one id array per text column, cut to the given length. Rows are told apart by ``key``."""
        rare = F.col("token_id") >= self.first_rare
        frequent = self.vocabulary.filter(~rare).collect()  # at most ``at_hand`` words
        known = {r.word: r.token_id for r in frequent} | {"0": ZERO, "1": ONE}
        words = df.select(*key, *[F.slice(tokens(F.col(name)), 1, length - 1).alias(name) for name, length in texts.items()])
        fields = [words.schema[k] for k in key] + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in texts]
        schema = T.StructType([*fields, T.StructField("_unknown", T.ArrayType(T.StringType()))])

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(n) for n in texts]
                found, unknown = _look_up(columns, known)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], *found, unknown], [*key, *texts, "_unknown"])

        told = materialize(words.mapInArrow(looked_up, schema), "looked-up")
        asked = told.select(*key, F.posexplode("_unknown").alias("_place", "word"))
        answered = asked.join(self.vocabulary.filter(rare), "word")
        learnt = answered.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_place", "token_id"))).alias("_ids"))
        joined = told.join(learnt, key, "left")

        def column(name: str) -> Column:
            ids = F.transform(name, lambda x: F.when(x < 0, F.coalesce(F.try_element_at("_ids", -1 - x), F.lit(UNKNOWN))).otherwise(x))
            return F.concat(ids, F.array(F.lit(END))).alias(name)

        return joined.select(*key, *[column(name) for name in texts])


def _look_up(columns: list[pa.ListArray], known: dict[str, int]) -> tuple[list[pa.ListArray], pa.ListArray]:
    """The ids of each column's words, and each row's words that are not ``known``: the k-th of these has the id -1 - k."""
    columns = [c.fill_null([]) if c.null_count else c for c in columns]
    sizes = [c.value_lengths().to_numpy(zero_copy_only=False) for c in columns]
    every = pa.chunked_array([c.flatten() for c in columns], pa.string()).combine_chunks().dictionary_encode()
    names = every.dictionary.to_pylist()
    code = every.indices.to_numpy(zero_copy_only=False)
    ids = np.array([known.get(w, -1) for w in names], np.int32)[code] if names else np.zeros(0, np.int32)
    row = np.concatenate([np.repeat(np.arange(len(s)), s) for s in sizes])
    missing = np.flatnonzero(ids < 0)
    pairs, place = np.unique(row[missing].astype(np.int64) * max(1, len(names)) + code[missing], return_inverse=True)
    of_row = pairs // max(1, len(names))
    firsts = np.searchsorted(of_row, np.arange(len(sizes[0]) + 1))
    ids[missing] = -1 - (place - firsts[row[missing]])
    unknown = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), every.dictionary.take(pa.array(pairs % max(1, len(names)))))
    cuts = np.cumsum([0, *(s.sum() for s in sizes)])
    found = [
        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(s)), pa.int32()), pa.array(ids[a:b]))
        for s, a, b in zip(sizes, cuts[:-1], cuts[1:])
    ]
    return found, unknown


class CallableTokenizer:
    """Ids from a user's tokenizer: ``load()`` returns ``fn(list of texts) -> list of id lists``, once per worker."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[int]]]]):
        self.load, self.token = load, uuid.uuid4().hex

    def ids(self, df: DataFrame, key: list[str], texts: dict[str, int]) -> DataFrame:
        from askloop.operators.models import load_once

        load, token = self.load, self.token

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def encode(series: pd.Series) -> pd.Series:
            return pd.Series(load_once(token, load)(series.tolist()))

        return df.select(*key, *[encode(F.col(t)).alias(t) for t in texts])


def encode_pad(
    df: DataFrame,
    tokenizer,
    key: list[str],
    max_input: int = encoding.MAX_INPUT,
    max_label: int = encoding.MAX_LABEL,
) -> DataFrame:
    """``input``/``label`` text to ``input_ids, attention_mask, labels`` of fixed length; the texts are dropped."""
    ids = tokenizer.ids(df, key, {"input": max_input, "label": max_label})
    arrays = encoding.encode_columns(F.col("input"), F.col("label"), PAD, max_input, max_label)
    return ids.select(*key, *arrays)


def shuffled_index(df: DataFrame, seed: int, key: list[str], by: list[str], name: str = "row_index") -> DataFrame:
    """Number the rows in a seeded shuffle order."""
    keyed = df.withColumn("_shuffle", seeded_key(seed, *key))
    return number_rows(keyed, ["_shuffle"], by, name).drop("_shuffle")
