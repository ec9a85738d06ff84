"""Evaluation tables over rollout turns.

Each job first narrows a row to fixed-width values (turn, correctness, gate, F1) and only then shuffles, so no text
moves and the per-question step is a hash aggregate that combines map-side, whatever the size of a question's group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloop.functions.text import formula_value, is_abstention, token_f1
from askloop.schemas import KEYS


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def _grouped(df: DataFrame, by: list[str], overall: bool = False):
    """Group by ``by``; ``overall`` adds the row over everything (``by`` columns null)."""
    return df.rollup(*by) if overall and by else df.groupBy(*by)


def last_turn(df: DataFrame) -> DataFrame:
    """The whole row of each question's last turn."""
    return _turn_row(df, F.max)


def first_turn(df: DataFrame) -> DataFrame:
    """The whole row of each question's first turn."""
    return _turn_row(df, F.min)


def _turn_row(df: DataFrame, pick) -> DataFrame:
    """The turn is found by a hash aggregate of narrow keys; the whole rows meet it in one join, unsorted by question."""
    turn = df.groupBy(*KEYS).agg(pick("turn").alias("turn"))
    return df.join(turn, [*KEYS, "turn"]).select(*df.columns)


def _final(accept: Column | None) -> Column:
    """A value that is smallest on a question's final turn.

    Without ``accept`` that is the last turn. With it, recorded turns after the first accepted one do not count: the
    final turn is the first accepted one, or the last if none is.
    """
    turn = F.col("turn").cast("bigint")
    late = -turn if accept is None else F.when(accept, turn - F.lit(1 << 62)).otherwise(-turn)
    return late.alias("_final")


def _last_values(df: DataFrame, accept: Column | None = None, **values: Column) -> DataFrame:
    """Per question the values of its final turn. All of them are fixed-width."""
    narrow = df.select(*KEYS, _final(accept), *[v.alias(k) for k, v in values.items()])
    return narrow.groupBy(*KEYS).agg(*[F.min_by(k, "_final").alias(k) for k in values])


def accuracy(
    df: DataFrame, column: str = "correct", by: list[str] | None = None, overall: bool = False, with_f1: bool = True
) -> DataFrame:
    """Share of questions whose last turn is right, with counts and, if asked for, mean token F1.

    ``column="verdict"`` for generated data. Token F1 is worked out for every turn; leave it out where it is not needed.
    """
    values = {"right": F.col(column) == 1}
    if with_f1:
        values["f1"] = token_f1(F.col("answer"), F.col("gold"))
    last = _last_values(df, **values)
    f1 = [F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1")] if with_f1 else []
    return _grouped(last, by or [], overall).agg(
        F.count(F.lit(1)).alias("n"),
        _count(F.col("right")).alias("correct"),
        F.avg(F.col("right").cast("double")).alias("accuracy"),
        *f1,
    )


def f1_score(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean token F1 over all given rows, 0 without rows."""
    scored = df.select(*(by or []), token_f1(F.col("answer"), F.col("gold")).alias("f1"))
    return scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1")
    )


def _formula_columns(score: str = "score") -> list[Column]:
    value = F.col(score)
    return [
        F.count(F.lit(1)).alias("n"),
        _count(value == -1).alias("n_wrong"),
        _count(value == 0).alias("n_withheld"),
        _count(value == 1).alias("n_right"),
        F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias("formula_sum"),
        F.avg(value).alias("formula_avg"),
    ]


def formula_gated(df: DataFrame, by: list[str] | None = None, overall: bool = False) -> DataFrame:
    """+1 right, -1 wrong, 0 where the gate rejected the last turn."""
    last = _last_values(df, score=formula_value(F.col("correct"), ~F.col("gate_output")))
    return _grouped(last, by or [], overall).agg(*_formula_columns())


def formula_zero_shot(df: DataFrame, by: list[str] | None = None, compat: bool = False) -> DataFrame:
    """+1 right, -1 wrong, 0 where the last turn abstains. A table without turns has one row a question."""
    score = formula_value(F.col("correct"), F.coalesce(is_abstention(F.col("answer"), compat), F.lit(False)))
    if "turn" in df.columns:
        scored = _last_values(df, score=score)
    else:
        scored = df.select(*KEYS, score.alias("score"))
    return scored.groupBy(*(by or [])).agg(*_formula_columns())


def system_report(df: DataFrame, by: list[str] | None = None, accept: Column | None = None) -> DataFrame:
    """Accuracy, F1 and gated formula score of the final turns (see ``_final``). One shuffle."""
    last = _last_values(
        df,
        accept,
        right=(F.col("correct") == 1),
        f1=token_f1(F.col("answer"), F.col("gold")),
        score=formula_value(F.col("correct"), ~F.col("gate_output")),
    )
    return last.groupBy(*(by or [])).agg(
        _count(F.col("right")).alias("correct"),
        F.avg(F.col("right").cast("double")).alias("accuracy"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"),
        *_formula_columns(),
    )


def _cells(right: Column, said: Column) -> list[Column]:
    return [
        _count(~right & ~said).alias("tn"),
        _count(~right & said).alias("fp"),
        _count(right & ~said).alias("fn"),
        _count(right & said).alias("tp"),
    ]


def _gate_rates() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return {
        "gate_accuracy": _share(tp + tn, tn + fp + fn + tp),
        "gate_precision": _share(tp, tp + fp),
        "gate_recall": _share(tp, tp + fn),
        "gate_f1": _share(2 * tp, 2 * tp + fp + fn),
        "gate_fpr": _share(fp, fp + tn),
        "gate_tnr": _share(tn, tn + fp),
    }


def gate_confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion cells of the gate against correctness over the given rows; absent classes count 0."""
    cells = _cells(F.col("correct") == 1, F.col("gate_output"))
    counted = df.groupBy(*(by or [])).agg(*[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(cells, _CELLS)])
    return counted.withColumns(_gate_rates())


_CELLS = ["tn", "fp", "fn", "tp"]


def custom_evaluation(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Gate and system metrics, one row for all turns and one for the last turns (column ``scope``).

    One shuffle: each question yields its cells over all turns and the values of its last turn.
    """
    by = by or []
    right, said = F.col("correct") == 1, F.col("gate_output")
    narrow = df.select(
        *KEYS,
        "turn",
        right.alias("right"),
        said.alias("said"),
        token_f1(F.col("answer"), F.col("gold")).alias("f1"),
        formula_value(F.col("correct"), ~said).alias("score"),
    )
    last = [F.max_by(c, "turn").alias(c) for c in ("right", "said", "f1", "score")]
    questions = narrow.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("turns"), *_cells(F.col("right"), F.col("said")), *last)
    every = [F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in _CELLS]
    final = [F.coalesce(c, F.lit(0)).alias(f"last_{n}") for c, n in zip(_cells(F.col("right"), F.col("said")), _CELLS)]
    system = [
        F.avg(F.col("right").cast("double")).alias("system_accuracy"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"),
        F.avg("score").alias("formula"),
    ]
    totals = questions.groupBy(*by).agg(
        F.sum("turns").alias("all_n"), F.count(F.lit(1)).alias("last_n"), *every, *final, *system
    )
    scopes = [
        F.struct(F.lit(scope).alias("scope"), *[F.col(f"{p}_{c}").alias(c) for c in ["n", *_CELLS]])
        for scope, p in (("all turns", "all"), ("last turn", "last"))
    ]
    long = totals.select(*by, "system_accuracy", "f1", "formula", F.explode(F.array(*scopes)).alias("_s"))
    rows = long.select(*by, "_s.*", "system_accuracy", "f1", "formula")
    return rows.withColumns(_gate_rates()).withColumnRenamed("n", "num_points")


def class_report(df: DataFrame, label: str, predicted: str, classes: tuple[str, ...] = ("0", "1")) -> DataFrame:
    """Accuracy and per-class precision, recall and F1; a prediction outside the classes is an error."""
    truth, said = F.col(label), F.coalesce(predicted, F.lit(""))
    cells = [F.count(F.lit(1)).alias("n"), _count(truth == said).alias("hits")]
    for c in classes:
        cells += [
            _count((truth == c) & (said == c)).alias(f"tp_{c}"),
            _count(said == c).alias(f"said_{c}"),
            _count(truth == c).alias(f"true_{c}"),
        ]
    counted = df.agg(*cells)
    out = [F.col("n"), _share(F.col("hits"), F.col("n")).alias("accuracy")]
    for c in classes:
        tp, said_c, true_c = (F.col(f"{k}_{c}") for k in ("tp", "said", "true"))
        out += [
            _share(tp, said_c).alias(f"precision_{c}"),
            _share(tp, true_c).alias(f"recall_{c}"),
            _share(2 * tp, said_c + true_c).alias(f"f1_{c}"),
        ]
    return counted.select(*out)


def value_counts(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows per value of each column, in long form ``column_name, value, n``; one pass for all columns."""
    by = by or []
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*")
    return long.groupBy(*by, "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def group_sizes(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many questions have how many turns, fewest turns first."""
    sizes = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("turns"))
    return sizes.groupBy(*(by or []), "turns").agg(F.count(F.lit(1)).alias("n_questions")).orderBy(*(by or []), "turns")


def per_turn(df: DataFrame, column: str, values: dict[str, object], by: list[str] | None = None) -> DataFrame:
    """Rows per turn and value, one column per value (``values``: column name to value), 0 where there are none."""
    counts = [_count(F.col(column) == F.lit(v)).alias(name) for name, v in values.items()]
    return df.groupBy(*(by or []), "turn").agg(*counts)


def turn_by_gate(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return per_turn(df, "gate_output", {"rejected": False, "accepted": True}, by)


def turn_by_correct(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return per_turn(df, "correct", {"wrong": 0, "right": 1}, by)


def turn_by_verdict(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return per_turn(df, "verdict", {"wrong": 0, "right": 1}, by)


def first_turn_metrics(
    df: DataFrame, setting: str = "exploration", column: str = "correct", by: list[str] | None = None
) -> DataFrame:
    """Accuracy and F1 of the opening turn (0, or 1 in the gradual setting); null if there is none."""
    opening = df.filter(F.col("turn") == (1 if setting == "gradual" else 0))
    scored = opening.select(
        *(by or []), F.col(column).alias("right"), token_f1(F.col("answer"), F.col("gold")).alias("f1")
    )
    return scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("right").cast("double")).alias("accuracy"), F.avg("f1").alias("f1")
    )


def compare_report(
    df: DataFrame, by: list[str] | None = None, accept: Column | None = None, compat: bool = False
) -> DataFrame:
    """First turn as zero-shot answer against the final turn (see ``_final``): accuracy, F1, formula. One shuffle."""
    narrow = df.select(
        *KEYS,
        "turn",
        _final(accept),
        (F.col("correct") == 1).cast("double").alias("right"),
        token_f1(F.col("answer"), F.col("gold")).alias("f1"),
        formula_value(F.col("correct"), is_abstention(F.col("answer"), compat)).alias("open_score"),
        formula_value(F.col("correct"), ~F.col("gate_output")).alias("gated_score"),
    )
    questions = narrow.groupBy(*KEYS).agg(
        *[F.min_by(c, "turn").alias(f"zs_{c}") for c in ("right", "f1", "open_score")],
        *[F.min_by(c, "_final").alias(f"final_{c}") for c in ("right", "f1", "gated_score")],
    )
    return questions.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("zs_right").alias("zs_accuracy"),
        F.avg("zs_f1").alias("zs_f1"),
        F.avg("zs_open_score").alias("zs_formula"),
        F.avg("final_right").alias("final_accuracy"),
        F.avg("final_f1").alias("final_f1"),
        F.avg("final_gated_score").alias("final_formula"),
    )


def answer_set_scores(df: DataFrame, compat: bool = False, by: list[str] | None = None) -> DataFrame:
    """Accuracy and formula score of each self-critic answer set; a missing answer is withheld."""
    withheld = F.coalesce(is_abstention(F.col("answer"), compat), F.lit(False))
    if not compat:
        withheld = withheld | F.col("answer").isNull()
    scored = df.select(
        *(by or []),
        "answer_no",
        (F.col("correct") == 1).alias("right"),
        formula_value(F.col("correct"), withheld).alias("score"),
    )
    return scored.groupBy(*(by or []), "answer_no").agg(F.avg(F.col("right").cast("double")).alias("accuracy"), *_formula_columns())


def zero_shot_report(df: DataFrame, compat: bool = False, by: list[str] | None = None) -> DataFrame:
    """Zero-shot baseline over all rows: accuracy, F1, formula."""
    scored = df.select(
        *(by or []),
        (F.col("correct") == 1).cast("double").alias("right"),
        token_f1(F.col("answer"), F.col("gold")).alias("f1"),
        formula_value(F.col("correct"), is_abstention(F.col("answer"), compat)).alias("score"),
    )
    return scored.groupBy(*(by or [])).agg(F.avg("right").alias("accuracy"), F.avg("f1").alias("f1"), *_formula_columns())


def distinct_questions(df: DataFrame, approximate: bool = False) -> DataFrame:
    if approximate:
        return df.agg(F.approx_count_distinct(F.struct(*KEYS)).alias("n_questions"))
    return df.agg(F.count_distinct(*KEYS).alias("n_questions"))


def to_long(df: DataFrame, run_id: str, stage: str, by: str | None = None) -> DataFrame:
    """Wide metric rows as log rows ``run_id, dataset, stage, metric, value, value_str``.

    A ``dataset`` column goes to its own place; ``by`` names another column whose value is added to the stage.
    """
    names = [c for c in df.columns if c not in (by, "dataset")]
    numeric = {f.name for f in df.schema if f.dataType.typeName() not in ("string", "boolean")}
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("metric"),
                (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("value"),
                F.col(c).cast("string").alias("value_str"),
            )
            for c in names
        ]
    )
    dataset = F.col("dataset") if "dataset" in df.columns else F.lit(None).cast("string")
    named = F.concat_ws(" ", F.lit(stage), F.col(by).cast("string")) if by and by != "dataset" else F.lit(stage)
    long = df.select(dataset.alias("dataset"), named.alias("stage"), F.explode(pairs).alias("_m"))
    return long.select(F.lit(run_id).alias("run_id"), "dataset", "stage", "_m.*")


def union_reports(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)
