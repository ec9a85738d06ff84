"""Table schemas. Keys are (dataset, split, id) for a question and with turn for one answer to it."""

from __future__ import annotations

KEYS = ["dataset", "split", "id"]

RAW_MCQ = (
    "id string, question string, choices struct<label: array<string>, text: array<string>>, answerKey string"
)
RAW_MCQ_STEM = (
    "id string, question_stem string, choices struct<label: array<string>, text: array<string>>, answerKey string"
)
RAW_PAIR = "goal string, sol1 string, sol2 string, label int"
RAW_CLOZE = "sentence string, option1 string, option2 string, answer string"

QA = "row_index bigint, dataset string, split string, id string, question string, gold array<string>"
RESPONSES = "dataset string, split string, id string, turn int, response string"
GENERATED = (
    "dataset string, split string, id string, turn int, task_content string, answer string, rationale string, "
    "gold array<string>, verdict int"
)
TRAINING = GENERATED.replace("verdict int", "gate_verdict int")
PREDICTIONS = (
    "dataset string, split string, id string, turn int, task_content string, answer string, rationale string, "
    "gold array<string>, gate_output boolean, correct int, confidence_0 double, confidence_1 double"
)
ZERO_SHOT = "dataset string, split string, id string, question string, gold array<string>, answer string, correct int"
SELF_CRITIC = (
    "dataset string, split string, id string, question string, gold array<string>, answer_1 string, answer_2 string, "
    "answer_3 string, correct_1 int, correct_2 int, correct_3 int, transcript string"
)
METRICS_LOG = "run_id string, dataset string, stage string, metric string, value double, value_str string"

# Column headings of the CSV files exchanged with other tools, in file order, and our names.
CSV_COLUMNS = {
    "qa": [("ID", "id"), ("Question", "question"), ("Answers", "gold")],
    "generated": [
        ("ID", "id"),
        ("Turn", "turn"),
        ("Reasoner Task Content", "task_content"),
        ("Reasoner Answer", "answer"),
        ("Reasoner Rationale", "rationale"),
        ("Gold Answer", "gold"),
        ("Verdict", "verdict"),
    ],
    "training": [
        ("ID", "id"),
        ("Turn", "turn"),
        ("Reasoner Task Content", "task_content"),
        ("Reasoner Answer", "answer"),
        ("Reasoner Rationale", "rationale"),
        ("Gold Answer", "gold"),
        ("Gate Verdict", "gate_verdict"),
    ],
    "predictions": [
        ("ID", "id"),
        ("Turn", "turn"),
        ("Reasoner Task Content", "task_content"),
        ("Reasoner Answer", "answer"),
        ("Reasoner Rationale", "rationale"),
        ("Gold Answer", "gold"),
        ("Gate Output", "gate_output"),
        ("Correct Answer", "correct"),
        ("Confidence Scores", "confidence_scores"),
    ],
    "zero_shot": [
        ("ID", "id"),
        ("Question", "question"),
        ("Gold Answer", "gold"),
        ("Reasoner Answer", "answer"),
        ("Correct Answer", "correct"),
    ],
    "self_critic": [
        ("ID", "id"),
        ("Question", "question"),
        ("Gold Answer", "gold"),
        ("Answer 1", "answer_1"),
        ("Answer 2", "answer_2"),
        ("Answer 3", "answer_3"),
        ("Correct Answer 1", "correct_1"),
        ("Correct Answer 2", "correct_2"),
        ("Correct Answer 3", "correct_3"),
        ("Task Content File", "transcript"),
    ],
}
