"""SQL twins of the queries, for DuckDB. Fixtures, text functions and rules are stated anew in SQL.

Its regular expressions know no look-around and only ASCII classes, so blanks and word characters are spelled out.
"""

from __future__ import annotations

import textwrap

from askloop.operators import prompts
from askloop.plans.fixtures import EVENT_TYPES

ORACLE: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- Text functions as SQL fragments --------------------------------------------------------------------------------

WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ARTICLE = r"(^|[^\p{L}\p{N}_])(a|an|the)([^\p{L}\p{N}_]|$)"
SPAN = f"Answer:{WS}*(.*?){WS}*Rationale:{WS}*(.*)"
NUMBER = r"[0-9,]+(?:\.[0-9]+)?"


def norm(e: str) -> str:
    out = f"regexp_replace(lower(coalesce({e}, 'none')), '[!-/:-@\\[-`{{-~]', '', 'g')"
    # Twice, since neighbouring articles share the blank between them.
    for _ in range(2):
        out = f"regexp_replace({out}, '{ARTICLE}', '\\1 \\3', 'g')"
    return f"trim(regexp_replace({out}, '{WS}+', ' ', 'g'))"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def tokens(e: str) -> str:
    return f"(CASE WHEN coalesce({e}, '') = '' THEN []::VARCHAR[] ELSE list_filter(string_split({norm(e)}, ' '), lambda w: w <> '') END)"


def word_tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def match(answer: str, gold: str) -> str:
    return f"CAST(list_contains(list_transform({gold}, lambda g: {norm('g')}), {norm(answer)}) AS INT)"


def parsed(response: str, group: int) -> str:
    missing = "Answer not found" if group == 1 else "Rationale not found"
    hit = f"regexp_matches({response}, '{SPAN}')"
    return f"CASE WHEN {hit} THEN {strip(f'''regexp_extract({response}, '{SPAN}', {group})''')} ELSE '{missing}' END"


# --- Fixtures -------------------------------------------------------------------------------------------------------

DIGIT = "CAST(length(text) % 4 AS VARCHAR)"

QA = """SELECT conv_id AS row_index, 'conv' AS dataset, 'dev' AS split, CAST(conv_id AS VARCHAR) AS id, text AS question,
    [CAST(conv_id % 4 AS VARCHAR)] AS gold FROM conversations WHERE turn = 0"""


def responses(first: int = 0) -> str:
    return f"""SELECT 'conv' AS dataset, CAST(conv_id AS VARCHAR) AS id, CAST(turn + {first} AS INT) AS turn,
    'Answer: ' || {DIGIT} || CASE WHEN conv_id % 11 = 0 THEN chr(10) ELSE chr(10) || 'Rationale: ' END || text AS response
    FROM conversations"""


def gate_outputs(first: int = 0) -> str:
    return f"""SELECT CAST(conv_id AS VARCHAR) AS id, CAST(turn + {first} AS INT) AS turn, length(text) % 3 = 0 AS gate_output,
    1 - (length(text) % 10) / 10.0 AS confidence_0, CAST((length(text) % 10) / 10.0 AS DOUBLE) AS confidence_1
    FROM conversations"""


CONV = f"""SELECT 'conv' AS dataset, 'dev' AS split, CAST(conv_id AS VARCHAR) AS id, CAST(turn AS INT) AS turn,
    'Q: ' || role || ' ' || chr(10) AS task_content, {DIGIT} AS answer, text AS rationale,
    [CAST(conv_id % 4 AS VARCHAR)] AS gold, length(text) % 3 = 0 AS gate_output,
    CAST(length(text) % 4 = conv_id % 4 AS INT) AS correct FROM conversations"""

_KINDS = "[" + ", ".join(_q(t) for t in EVENT_TYPES) + "]"
EVENTS = f"""SELECT 'events' AS dataset, 'train' AS split, CAST(q AS VARCHAR) AS id, CAST(event_id % 4 AS INT) AS turn,
    'Q: which event?' || CASE WHEN k % 7 = 0 THEN chr(10) || 'Ground-truth Answer: x' || chr(10) ELSE ' ' || chr(10) END
        AS task_content,
    answer, CASE WHEN k % 9 <> 0 THEN 'It was ' || event_type || ' ' || props END AS rationale,
    ['The ' || key, key || ' times'] AS gold, value > 20 AS gate_output, CAST(answer = key AS INT) AS correct
    FROM (SELECT *, CASE WHEN value < 2 THEN 'unsure' WHEN value < 3 THEN 'none of above'
              ELSE event_type || ' ' || CAST(k % 3 AS VARCHAR) END AS answer,
              {_KINDS}[CAST(q % 5 + 1 AS INT)] || ' ' || CAST(q % 3 AS VARCHAR) AS key
          FROM (SELECT *, event_id // 4 AS q, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"""

PREDICTIONS = f"WITH p AS ({CONV} UNION ALL {EVENTS})"

# Token F1 of every row of p against its best gold answer.
F1 = f"""f1s AS (SELECT dataset, id, turn, max(CASE WHEN len(a) = 0 OR len(g) = 0
        THEN CASE WHEN len(a) = len(g) THEN 1.0 ELSE 0.0 END ELSE 2.0 * same / (len(a) + len(g)) END) AS f1
    FROM (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(
              len(list_filter(a, lambda x: x = t)), len(list_filter(g, lambda y: y = t))))), 0) AS same
          FROM (SELECT dataset, id, turn, {tokens("answer")} AS a, {tokens("g1")} AS g
                FROM (SELECT dataset, id, turn, answer, unnest(gold) AS g1 FROM p)))
    GROUP BY ALL)"""

SCORED = f"{PREDICTIONS}, {F1}, s AS (SELECT p.*, f1s.f1 FROM p JOIN f1s USING (dataset, id, turn))"
LAST = "QUALIFY row_number() OVER (PARTITION BY dataset, id ORDER BY turn DESC) = 1"
FIRST = "QUALIFY row_number() OVER (PARTITION BY dataset, id ORDER BY turn) = 1"

NO_EARLIER = "coalesce(max(CAST({0} AS INT)) OVER (PARTITION BY dataset, id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0"

GATED_SCORE = "CASE WHEN NOT gate_output THEN 0 WHEN correct = 0 THEN -1 ELSE 1 END"
ABSTAINS = "answer IN ('no answer', 'none', 'unsure', 'none of above', 'unanswerable')"
ABSTAINS_COMPAT = "answer IN ('no answer', 'none', '-1', 'unsure', 'none of the above', 'unanswerable')"


def open_score(abstains: str = ABSTAINS) -> str:
    return f"CASE WHEN {abstains} THEN 0 WHEN correct = 0 THEN -1 ELSE 1 END"


FORMULA = """count(*) AS n, CAST(sum(CAST(score = -1 AS INT)) AS BIGINT) AS n_wrong,
    CAST(sum(CAST(score = 0 AS INT)) AS BIGINT) AS n_withheld, CAST(sum(CAST(score = 1 AS INT)) AS BIGINT) AS n_right,
    CAST(sum(score) AS BIGINT) AS formula_sum, round(avg(score), 6) AS formula_avg"""

TRAINING = f"SELECT dataset, split, id, turn, task_content, answer, rationale, correct AS gate_verdict FROM ({CONV} UNION ALL {EVENTS})"


def add(name: str, sql: str) -> None:
    ORACLE[name] = textwrap.dedent(sql).strip()


# --- Text and parsing -----------------------------------------------------------------------------------------------

add("norm_answers", f"SELECT doc_id, {norm('text')} AS normal FROM documents")
add(
    "exact_match",
    f"""{PREDICTIONS} SELECT dataset, id, turn, {match("'The ' || upper(answer) || '!'", 'gold')} AS hit FROM p""",
)
add(
    "token_f1",
    f"""
    WITH w AS (SELECT doc_id, unnest({tokens("text")}) AS word FROM documents),
    c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
    size AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
    pair AS (SELECT a.doc_id, b.doc_id AS other FROM documents a LEFT JOIN documents b
             ON b.doc_id IN (a.doc_id + 1, a.doc_id + 2)),
    shared AS (SELECT pair.doc_id, pair.other, sum(least(x.n, y.n)) AS same
               FROM pair JOIN c x ON x.doc_id = pair.doc_id JOIN c y ON y.doc_id = pair.other AND y.word = x.word
               GROUP BY ALL)
    SELECT pair.doc_id, round(max(CASE WHEN pair.other IS NULL THEN 0.0 WHEN sa.n IS NULL OR sb.n IS NULL
               THEN CASE WHEN sa.n IS NULL AND sb.n IS NULL THEN 1.0 ELSE 0.0 END
               ELSE coalesce(2.0 * same / (sa.n + sb.n), 0.0) END), 6) AS f1
    FROM pair LEFT JOIN size sa ON sa.doc_id = pair.doc_id LEFT JOIN size sb ON sb.doc_id = pair.other
    LEFT JOIN shared ON shared.doc_id = pair.doc_id AND shared.other = pair.other GROUP BY pair.doc_id""",
)
add(
    "token_counts",
    f"""SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, len(m) AS n_word_tokens
    FROM (SELECT doc_id, {tokens("text")} AS t, {word_tokens("text")} AS m FROM documents)""",
)
add(
    "abstentions",
    f"""{PREDICTIONS} SELECT dataset, answer, count(*) AS n, {ABSTAINS} AS abstains, {ABSTAINS_COMPAT} AS abstains_compat
    FROM p GROUP BY dataset, answer""",
)
add(
    "raw_membership",
    f"""{PREDICTIONS} SELECT dataset, id, turn, CASE WHEN list_contains(gold, answer) THEN '1' ELSE '0' END AS member
    FROM p""",
)
add(
    "confidence_format",
    """SELECT event_id, printf('0: %.4f, 1: %.4f', 1 - (user_id % 100) / 100, (user_id % 100) / 100) AS confidences
    FROM events""",
)
add(
    "parse_responses",
    f"""SELECT dataset, id, turn, {parsed("response", 1)} AS answer, {parsed("response", 2)} AS rationale
    FROM ({responses()})""",
)
add(
    "extract_numbers",
    f"""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_suppkey % 3
        WHEN 0 THEN 'Add 2 and 3. The answer is $' || price || '.50, or 7.'
        WHEN 1 THEN 'First ' || CAST(l_orderkey AS VARCHAR) || ' then ' || price || ' at last'
        ELSE 'Flag: ' || l_returnflag END AS response
      FROM (SELECT *, CAST(l_partkey AS VARCHAR) || ',0' || CAST(l_linenumber AS VARCHAR) AS price FROM lineitem))
    SELECT l_orderkey, l_linenumber, l_partkey, CASE
        WHEN regexp_matches(response, 'answer is [^0-9]*{NUMBER}')
          THEN replace(regexp_extract(response, 'answer is [^0-9]*({NUMBER})', 1), ',', '')
        WHEN regexp_matches(response, '{NUMBER}')
          THEN replace(list_extract(regexp_extract_all(response, '{NUMBER}'), -1), ',', '')
        ELSE 'Error: No number found' END AS number FROM r""",
)
add(
    "assistant_output",
    f"""
    WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0
        THEN 'system' || chr(10) || chr(10) || 'help assistant' || chr(10) || chr(10) || ' ' || chr(10)
        ELSE 'system' || chr(10) || chr(10) END || text || chr(10) || ' ' || chr(10) || chr(10) || 'end ' || chr(10) AS raw
      FROM documents)
    SELECT doc_id, CASE WHEN contains(raw, 'assistant' || chr(10) || chr(10))
        THEN regexp_replace({strip("regexp_extract(raw, 'assistant\\n\\n(.*)', 1, 's')")}, '\\n{WS}*\\n', chr(10), 'g')
        ELSE 'Output not found' END AS output FROM r""",
)
SHAPED = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END AS t FROM events"""
add(
    "search_query",
    f"""
    WITH e AS ({SHAPED.format(
        "'x {\"search_query\": \"' || event_type || '\"} y'",
        "'search_query: \"' || event_type || '\",' || chr(10) || ' the reasoning is'",
        "'plain ' || event_type",
    )})
    SELECT event_id, CASE WHEN regexp_matches(t, '\\{{\\s*"search_query":\\s*".*?"\\s*\\}}', 's')
          THEN regexp_extract(t, '\\{{\\s*"search_query":\\s*"(.*?)"\\s*\\}}', 1, 's')
        WHEN regexp_matches(t, 'search_query.*?:(.*?)[,\\n\\r]+.*?reasoning', 's')
          THEN trim({strip("regexp_extract(t, 'search_query.*?:(.*?)[,\\n\\r]+.*?reasoning', 1, 's')")}, '"')
        ELSE t END AS found FROM e""",
)
_CHOICE = SHAPED.format(
    "'Of 12 I choose (' || CAST(user_id AS VARCHAR) || ') ' || chr(10)",
    "'(3) or ' || CAST(user_id AS VARCHAR) || ' then'",
    "'no number for ' || event_type",
)


def paren_number(e: str) -> str:
    last = f"list_extract(regexp_extract_all({e}, '[0-9]+'), -1)"
    closing = f"regexp_extract({e}, '\\(([0-9]+)\\){WS}*$', 1)"
    return f"CAST(CAST(CASE WHEN {closing} <> '' THEN {closing} ELSE {last} END AS BIGINT) AS VARCHAR)"


add(
    "final_paren_number",
    f"""WITH e AS ({_CHOICE}) SELECT event_id, {paren_number("t")} AS number,
    coalesce({paren_number("t")}, '-1') AS number_compat FROM e""",
)
add(
    "literal_lists",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '|it''s|' || CAST(user_id AS VARCHAR)
    ELSE event_type END AS gold_text FROM events""",
)

# --- Question sets --------------------------------------------------------------------------------------------------

FLAT = "row_index, dataset, split, id, question, array_to_string(gold, '|') AS gold_text"

add(
    "normalise_mcq",
    """
    WITH b AS (SELECT item_id, text, string_split(text, ' ') AS c FROM benchmark),
    t AS (SELECT item_id AS row_index, 'item-' || CAST(item_id AS VARCHAR) AS id,
        text || chr(10) || 'Choices: [' || array_to_string(list_transform(range(1, len(c) + 1),
            lambda i: CAST(i - 1 AS VARCHAR) || ': ''' || c[i] || ''''), ', ') || '].' AS question,
        CAST(item_id % 4 AS VARCHAR) AS gold_text FROM b)
    SELECT row_index, 'mcq' AS dataset, 'train' AS split, id, question, gold_text FROM t
    UNION ALL SELECT row_index, 'stem', 'dev', id, question, gold_text FROM t""",
)
add(
    "normalise_pair",
    """
    SELECT i AS row_index, 'pair' AS dataset, 'train' AS split, CAST(i AS VARCHAR) AS id,
        p_name || chr(10) || 'Choices: [''0'': ''' || p_brand || ''', ''1'': ''' || p_type || '''].' AS question,
        CAST(p_partkey % 2 AS VARCHAR) AS gold_text
    FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)""",
)


def cloze(index: str, split: str, where: str) -> str:
    return f"""SELECT i AS row_index, 'cloze' AS dataset, '{split}' AS split, CAST(i AS VARCHAR) AS id,
        replace('_ is ' || p_name || ', not _', '_', '[MASK]') || chr(10) || 'Choices: [0: ''' || p_brand || ''', 1: '''
            || p_type || '''].' AS question, CAST(p_partkey % 2 AS VARCHAR) AS gold_text
    FROM (SELECT *, {index} AS i FROM part WHERE {where})"""


add(
    "normalise_cloze",
    cloze("row_number() OVER (ORDER BY md5('42|' || CAST(p_partkey AS VARCHAR))) - 1", "train", "p_partkey % 5 <> 0")
    + " UNION ALL "
    + cloze("row_number() OVER (ORDER BY p_partkey) - 1", "dev", "p_partkey % 5 = 0"),
)
add(
    "split_sizes",
    """SELECT 'cloze' AS dataset, CASE WHEN p_partkey % 5 = 0 THEN 'dev' ELSE 'train' END AS split, count(*) AS n
    FROM part GROUP BY ALL""",
)
add("row_slice", f"SELECT {FLAT} FROM ({QA}) WHERE row_index BETWEEN 10 AND 59")
add(
    "global_slice",
    f"""SELECT position, dataset, split, id, question, gold_text FROM (
      SELECT *, row_number() OVER (ORDER BY dataset, row_index) - 1 AS position
      FROM (SELECT {FLAT} FROM ({QA}) UNION ALL SELECT {FLAT.replace("array_to_string(gold, '|') AS ", "")} FROM ({ORACLE["normalise_pair"]})))
    WHERE position BETWEEN 30 AND 149""",
)
add("first_rows", f"SELECT {FLAT} FROM ({QA}) ORDER BY row_index LIMIT 25")

# --- Tables ---------------------------------------------------------------------------------------------------------

add("qa_csv", f"SELECT {FLAT} FROM ({QA})")
ORACLE["csv_ranges"] = TRAINING
add(
    "predictions_csv",
    f"""{PREDICTIONS} SELECT p.dataset, p.split, p.id, p.turn, task_content, answer, rationale, array_to_string(gold, '|') AS gold_text,
    p.gate_output, correct, round(confidence_0, 6) AS confidence_0, round(confidence_1, 6) AS confidence_1
    FROM p LEFT JOIN ({gate_outputs()}) g ON p.dataset = 'conv' AND g.id = p.id AND g.turn = p.turn""",
)
add("qa_by_split", cloze("p_partkey", "train", "true"))
add(
    "results_by_run",
    f"""{PREDICTIONS}, k AS (SELECT *, {NO_EARLIER.format("gate_output")} AS keep FROM p)
    SELECT 'all' AS run_id, turn, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_correct FROM k GROUP BY turn
    UNION ALL SELECT 'truncated', turn, count(*), CAST(sum(correct) AS BIGINT) FROM k WHERE keep GROUP BY turn""",
)
add(
    "metrics_log",
    f"""{SCORED}, l AS (SELECT * FROM s {LAST}),
    a AS (SELECT dataset, count(*) AS n, sum(correct) AS correct, avg(correct) AS accuracy, avg(f1) AS f1 FROM l GROUP BY dataset),
    g AS (SELECT dataset, count(DISTINCT c) AS n_sizes, count(*) AS n_questions
          FROM (SELECT dataset, id, count(*) AS c FROM p GROUP BY dataset, id) GROUP BY dataset),
    long AS (
      SELECT dataset, 'accuracy' AS stage, 'n' AS metric, CAST(n AS DOUBLE) AS v FROM a
      UNION ALL SELECT dataset, 'accuracy', 'correct', correct FROM a
      UNION ALL SELECT dataset, 'accuracy', 'accuracy', accuracy FROM a
      UNION ALL SELECT dataset, 'accuracy', 'f1', f1 FROM a
      UNION ALL SELECT dataset, 'sizes', 'n_sizes', n_sizes FROM g
      UNION ALL SELECT dataset, 'sizes', 'n_questions', n_questions FROM g)
    SELECT 'r1' AS run_id, dataset, stage, metric, round(v, 6) AS value FROM long""",
)

add(
    "metrics_log_rerun",
    f"""{SCORED}, l AS (SELECT * FROM s {LAST}),
    a AS (SELECT dataset, count(*) AS n, sum(correct) AS correct, avg(correct) AS accuracy, avg(f1) AS f1 FROM l GROUP BY dataset),
    t AS (SELECT dataset, turn, CAST(count(*) FILTER (NOT gate_output) AS DOUBLE) AS no, CAST(count(*) FILTER (gate_output) AS DOUBLE) AS yes
          FROM p GROUP BY dataset, turn),
    long AS (
      SELECT dataset, 'accuracy' AS stage, 'n' AS metric, CAST(n AS DOUBLE) AS v FROM a
      UNION ALL SELECT dataset, 'accuracy', 'correct', correct FROM a
      UNION ALL SELECT dataset, 'accuracy', 'accuracy', accuracy FROM a
      UNION ALL SELECT dataset, 'accuracy', 'f1', f1 FROM a
      UNION ALL SELECT dataset, 'gate, turn ' || turn, 'rejected', no FROM t
      UNION ALL SELECT dataset, 'gate, turn ' || turn, 'accepted', yes FROM t)
    SELECT run_id, dataset, stage, metric, round(v, 6) AS value FROM long, (VALUES ('r1'), ('r2')) v(run_id)""",
)

_VAL = "CAST('0x' || substr(md5('42|joint|' || id), 1, 8) AS BIGINT) < floor(0.2 * 4294967296)"
add(
    "split_files",
    f"""{PREDICTIONS} SELECT 'joint' AS dataset, CASE WHEN dataset = 'events' THEN 'test' WHEN {_VAL} THEN 'val' ELSE 'train' END AS split,
    id, turn, answer, correct AS gate_verdict FROM p""",
)
add(
    "tagged_sides",
    f"""SELECT ['train', 'val', 'test'][CAST(turn % 3 + 1 AS INT)] AS side, dataset, gate_verdict, count(*) AS n
    FROM ({TRAINING}) GROUP BY ALL""",
)
add("files_by_name", f"{PREDICTIONS} SELECT dataset, 'train' AS split, id, turn, answer, correct AS verdict FROM p")
ORACLE["raw_records"] = f"SELECT * FROM ({ORACLE['normalise_mcq']}) WHERE dataset = 'mcq'"

# --- Prompts --------------------------------------------------------------------------------------------------------

# Temperature and top_p of each setting and phase, the longest response, the gate's instruction.
SAMPLING = {
    ("gradual", "first"): (0.6, 0.9),
    ("gradual", "force"): (0.6, 0.9),
    ("exploration", "first"): (0.1, 0.9),
    ("exploration", "retry"): (0.6, 0.7),
    ("exploration", "force"): (0.1, 0.9),
    ("zero_shot", "first"): (0.1, 0.9),
    ("zero_shot", "abstain"): (0.1, 0.9),
    ("self_critic", "critic"): (0.0, 0.9),
}
MAX_TOKENS = 256
GATE_INSTRUCTION = (
    "Instruction: Predict if the following answer to the question and context should be accepted, 1, or rejected, 0,"
    " based on the rationale."
)

_PROMPT_ROWS = ", ".join(
    f"({_q(setting)}, {_q(kind)}, {_q(phase)}, {_q(prompts._system_text(setting, kind, phase))}, {t}, {p}, {MAX_TOKENS})"
    for (setting, phase), (t, p) in SAMPLING.items()
    if setting in prompts.SETTINGS
    for kind in prompts.QUESTION_TYPES
)
_SAMPLING_ROWS = ", ".join(f"({_q(s)}, {_q(f)}, {t}, {p})" for (s, f), (t, p) in SAMPLING.items())
PROMPTS = f"prompts(setting, question_type, phase, system, temperature, top_p, max_tokens) AS (VALUES {_PROMPT_ROWS})"
KIND = "['MCQ', 'MATH', 'OEQ'][CAST(row_index % 3 + 1 AS INT)]"

add(
    "initial_messages",
    f"""
    WITH qa AS ({QA}), {PROMPTS},
    asked AS (
      SELECT setting, id, {KIND} AS question_type, CASE setting
          WHEN 'zero_shot' THEN 'Question: ' || question || chr(10)
          WHEN 'self_critic' THEN 'Q: ' || question || chr(10)
          ELSE 'Q: ' || question || ' ' || chr(10) END AS content
      FROM qa, (VALUES ('gradual'), ('exploration'), ('zero_shot'), ('self_critic')) v(setting))
    SELECT setting, id, 0 AS pos, 'system' AS role, system AS content
      FROM asked JOIN (FROM prompts WHERE phase = 'first') USING (setting, question_type)
    UNION ALL SELECT setting, id, CASE WHEN setting = 'self_critic' THEN 0 ELSE 1 END, 'user', content FROM asked""",
)
add(
    "sampling_settings",
    f"""SELECT setting, phase, question_type, CAST(temperature AS DOUBLE) AS temperature, CAST(top_p AS DOUBLE) AS top_p,
    {MAX_TOKENS} AS max_tokens, count(*) AS n
    FROM (SELECT {KIND} AS question_type FROM ({QA})), (VALUES {_SAMPLING_ROWS}) v(setting, phase, temperature, top_p) GROUP BY ALL""",
)
add(
    "force_prompts",
    f"""
    WITH qa AS (SELECT *, {KIND} AS question_type FROM ({QA})), {PROMPTS}
    SELECT id, question_type, replace(system, '{{answer}}', gold[1]) AS system, CAST(temperature AS DOUBLE) AS temperature,
        CAST(top_p AS DOUBLE) AS top_p, max_tokens
    FROM qa JOIN (FROM prompts WHERE setting = 'exploration' AND phase = 'force') USING (question_type)""",
)


def gradual_snippet(answer: str, same: str) -> str:
    return (
        f"'LLM Answer ' || CAST(turn AS VARCHAR) || ': ' || {answer} || chr(10) || 'LLM Rationale ' || CAST(turn AS VARCHAR)"
        f" || ': ' || rationale || chr(10) || CASE WHEN {same} THEN {_q(prompts.REPEAT_FEEDBACK)}"
        f" ELSE {_q(prompts.GENERIC_FEEDBACK)} END || chr(10)"
    )


add(
    "gradual_context",
    f"""SELECT id, turn, previous, {gradual_snippet("answer", "answer = previous")} AS context
    FROM (SELECT *, lag(answer, 1, '') OVER (PARTITION BY id ORDER BY turn) AS previous FROM ({CONV}))""",
)
EXPLORED = "'Previous LLM Response: ' || response || chr(10) || 'Wrong answer! Try again.' || chr(10)"
add("exploration_context", f"SELECT id, turn, {EXPLORED} AS context FROM ({responses()})")
add(
    "gold_injection",
    f"""SELECT id, chr(10) || CASE WHEN row_index % 2 = 0 THEN 'Ground-truth Answer: '
    ELSE 'Use this exact correct answer: ' END || gold[1] || chr(10) AS context FROM ({QA})""",
)
INSTRUCTION = _q(GATE_INSTRUCTION)


def gate_text(content: str, label: str = "") -> str:
    return (
        f"{INSTRUCTION} || chr(10) || {content} || ' ' || chr(10) || '{label}Answer: ' || answer || chr(10)"
        f" || '{label}Rationale: ' || coalesce(rationale, '')"
    )


add(
    "gate_input",
    f"""{PREDICTIONS} SELECT dataset, id, turn, {gate_text("task_content")} AS plain,
    {gate_text("task_content", "LLM ")} AS gradual FROM p""",
)

# --- Rollouts -------------------------------------------------------------------------------------------------------

add(
    "replay_truncate",
    f"""{PREDICTIONS} SELECT dataset, id, turn, answer, gate_output, correct
    FROM (SELECT *, {NO_EARLIER.format("gate_output")} AS keep FROM p) WHERE keep""",
)


def rollout(first: int, last: int, last_free: int | None, setting: str, mcq: bool, gated: bool) -> str:
    """All turns of all questions at once; a turn is reached if none before it was accepted."""
    if setting == "gradual":
        grown = gradual_snippet("raw_answer", "answer = previous")
    else:
        grown = EXPLORED
    if last_free is not None:
        mark = "Ground-truth Answer: " if mcq else "Use this exact correct answer: "
        grown = f"CASE WHEN turn < {last_free} THEN {grown} ELSE chr(10) || '{mark}' || gold[1] || chr(10) END"
    accept = "gate_output" if gated else "verdict"
    hit = match("raw_answer", "gold")
    shown = "gate_output, correct, round(confidence_1, 6) AS confidence_1" if gated else "verdict"
    return f"""
    WITH qa AS ({QA}),
    grid AS (SELECT qa.dataset, qa.id, qa.question, qa.gold, CAST(t.turn AS INT) AS turn, coalesce(r.response, '') AS response,
          coalesce(g.gate_output, false) AS gate_output, g.confidence_1
        FROM qa CROSS JOIN range({first}, {last + 1}) t(turn)
        LEFT JOIN ({responses(first)}) r ON r.id = qa.id AND r.turn = t.turn
        LEFT JOIN ({gate_outputs(first)}) g ON g.id = qa.id AND g.turn = t.turn),
    said AS (SELECT *, {parsed("response", 1)} AS raw_answer, {parsed("response", 2)} AS rationale FROM grid),
    judged AS (SELECT *, {norm("raw_answer")} AS answer, {hit} AS {"correct" if gated else "verdict"} FROM said),
    grown AS (SELECT *, {grown} AS snippet
        FROM (SELECT *, lag(answer, 1, '') OVER (PARTITION BY id ORDER BY turn) AS previous FROM judged)),
    whole AS (SELECT *, 'Q: ' || question || ' ' || chr(10) || coalesce(string_agg(snippet, '') OVER (PARTITION BY id
          ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS task_content,
        {NO_EARLIER.format(accept)} AS reached FROM grown)
    SELECT id, turn, task_content, answer, rationale, {shown} FROM whole WHERE reached"""


add("graded_rollout_gradual", rollout(1, 5, 4, "gradual", mcq=True, gated=False))
add("graded_rollout_exploration", rollout(0, 4, 3, "exploration", mcq=False, gated=False))
ORACLE["resumed_rollout"] = ORACLE["graded_rollout_exploration"]
add(
    "rollout_two_splits",
    """
    SELECT 'cloze' AS dataset, split, count(*) AS n, CAST(sum(CAST(i % 3 <> 0 AS INT)) AS BIGINT) AS correct,
        round(avg(CAST(i % 3 <> 0 AS INT)), 6) AS accuracy
    FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'dev' ELSE 'train' END AS split,
              row_number() OVER (PARTITION BY p_partkey % 5 = 0 ORDER BY p_partkey) - 1 AS i FROM part) GROUP BY split""",
)
# An answer is one token or none of gold's, so its token F1 is its verdict.
add(
    "generate_job",
    f"""
    WITH r AS ({rollout(0, 4, 3, "exploration", mcq=False, gated=False)}),
    l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn DESC) = 1),
    t AS (SELECT turn, CAST(count(*) FILTER (verdict = 0) AS DOUBLE) AS wrong, CAST(count(*) FILTER (verdict = 1) AS DOUBLE) AS right_
          FROM r GROUP BY turn),
    z AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(verdict) AS a FROM r WHERE turn = 0),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(verdict) AS DOUBLE) AS c, avg(verdict) AS a FROM l),
    long AS (
      SELECT 'generated' AS stage, 'n_rows' AS metric, CAST(count(*) AS DOUBLE) AS v FROM r
      UNION ALL SELECT 'verdict, turn ' || turn, 'wrong', wrong FROM t UNION ALL SELECT 'verdict, turn ' || turn, 'right', right_ FROM t
      UNION ALL SELECT 'zero-shot', 'n', n FROM z UNION ALL SELECT 'zero-shot', 'accuracy', a FROM z UNION ALL SELECT 'zero-shot', 'f1', a FROM z
      UNION ALL SELECT 'system', 'n', n FROM s UNION ALL SELECT 'system', 'correct', c FROM s
      UNION ALL SELECT 'system', 'accuracy', a FROM s UNION ALL SELECT 'system', 'f1', a FROM s)
    SELECT 'conv' AS dataset, stage, metric, round(v, 6) AS value FROM long""",
)
add(
    "infer_job",
    f"""
    WITH r AS ({rollout(0, 4, None, "exploration", mcq=False, gated=True)}),
    t AS (SELECT turn, CAST(count(*) FILTER (NOT gate_output) AS DOUBLE) AS no, CAST(count(*) FILTER (gate_output) AS DOUBLE) AS yes,
          CAST(count(*) FILTER (correct = 0) AS DOUBLE) AS wrong, CAST(count(*) FILTER (correct = 1) AS DOUBLE) AS right_ FROM r GROUP BY turn),
    q AS (SELECT turns, CAST(count(*) AS DOUBLE) AS n FROM (SELECT id, count(*) AS turns FROM r GROUP BY id) GROUP BY turns),
    z AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(correct) AS a FROM r WHERE turn = 0),
    long AS (
      SELECT 'gate, turn ' || turn AS stage, 'rejected' AS metric, no AS v FROM t UNION ALL SELECT 'gate, turn ' || turn, 'accepted', yes FROM t
      UNION ALL SELECT 'correct, turn ' || turn, 'wrong', wrong FROM t UNION ALL SELECT 'correct, turn ' || turn, 'right', right_ FROM t
      UNION ALL SELECT 'questions, turns ' || turns, 'n_questions', n FROM q
      UNION ALL SELECT 'zero-shot', 'n', n FROM z UNION ALL SELECT 'zero-shot', 'accuracy', a FROM z UNION ALL SELECT 'zero-shot', 'f1', a FROM z)
    SELECT 'conv' AS dataset, stage, metric, round(v, 6) AS value FROM long""",
)
add("gated_rollout_gradual", rollout(1, 5, None, "gradual", mcq=False, gated=True))
add("gated_rollout_exploration", rollout(0, 4, None, "exploration", mcq=False, gated=True))
add(
    "reasoner_call",
    f"""SELECT id, CAST(0.6 AS DOUBLE) AS temperature, answer, 'system' AS rationale, CAST(answer = gold[1] AS INT) AS verdict
    FROM (SELECT *, CAST((length(question) - length(replace(question, chr(10), '')) + 1) % 4 AS VARCHAR) AS answer FROM ({QA}))""",
)
add(
    "zero_shot",
    f"""
    WITH z AS (SELECT qa.*, coalesce(r.response, '') AS response FROM ({QA}) qa
        LEFT JOIN (FROM ({responses()}) WHERE turn = 0) r USING (id)),
    p AS (SELECT 'conv' AS dataset, id, 0 AS turn, gold, {norm(f"lower({parsed('response', 1)})")} AS answer FROM z),
    {F1},
    s AS (SELECT *, {open_score()} AS score FROM (SELECT p.*, f1, {match("answer", "gold")} AS correct
        FROM p JOIN f1s USING (dataset, id, turn)))
    SELECT round(avg(correct), 6) AS accuracy, round(avg(f1), 6) AS f1, {FORMULA} FROM s""",
)
_CRITIC = """SELECT CAST(conv_id AS VARCHAR) AS id, call,
    CASE WHEN size % 5 = 0 THEN 'I cannot tell' ELSE 'I choose (' || CAST(size % 4 AS VARCHAR) || ')' END AS response
    FROM (SELECT conv_id, CAST(turn % 5 + 1 AS INT) AS call, arg_max(length(text), turn) AS size FROM conversations GROUP BY ALL)"""
_NUMBER = "regexp_extract(response, '\\((\\d+)\\)$', 1)"
add(
    "self_critic",
    f"""
    WITH g AS (SELECT qa.id, gold[1] AS gold, call, nullif({_NUMBER}, '') AS answer
        FROM ({QA}) qa CROSS JOIN (VALUES (1), (3), (5)) v(call) LEFT JOIN ({_CRITIC}) r USING (id, call)),
    s AS (SELECT CAST((call + 1) // 2 AS INT) AS answer_no, coalesce(CAST(answer = gold AS INT), 0) AS correct,
        CASE WHEN answer IS NULL THEN 0 WHEN answer = gold THEN 1 ELSE -1 END AS score FROM g)
    SELECT answer_no, round(avg(correct), 6) AS accuracy, {FORMULA} FROM s GROUP BY answer_no""",
)
_STEP = {call: _q(words) for call, words, _ in prompts.CRITIC_STEPS}
_TRANSCRIPT = f"'Q: ' || question || chr(10) || {_STEP[1]}" + "".join(
    f" || chr(10) || r{c - 1} || chr(10) || {_STEP[c]}" for c in range(2, 6)
)
_SAID = ", ".join(f"coalesce(max(CASE WHEN call = {c} THEN response END), '') AS r{c}" for c in range(1, 6))
_ANSWERS = ", ".join(
    f"CASE WHEN regexp_matches(r{c}, '[0-9]') THEN regexp_extract(r{c}, '[0-9]+') ELSE '1' END AS answer_{n}"
    for n, c in ((1, 1), (2, 3), (3, 5))
)
_RIGHT = ", ".join(f"CAST(answer_{n} = gold[1] AS INT) AS correct_{n}" for n in (1, 2, 3))
add(
    "self_critic_transcript",
    f"""
    WITH w AS (SELECT qa.id, qa.question, qa.gold, {_SAID} FROM ({QA}) qa LEFT JOIN ({_CRITIC}) c USING (id) GROUP BY ALL),
    a AS (SELECT *, {_ANSWERS}, {_TRANSCRIPT} AS transcript FROM w)
    SELECT id, answer_1, answer_2, answer_3, {_RIGHT}, transcript FROM a""",
)

# --- Training sets --------------------------------------------------------------------------------------------------

add(
    "class_distribution",
    f"SELECT dataset, gate_verdict, count(*) AS n FROM ({TRAINING}) GROUP BY ALL",
)
ROW_KEY = "md5('42|' || dataset || '|' || split || '|' || id || '|' || CAST(turn AS VARCHAR))"


def balanced(source: str, label: str) -> str:
    return f"""SELECT * EXCLUDE (place, ones) FROM (SELECT *, {ROW_KEY} AS shuffle_key,
        row_number() OVER (PARTITION BY dataset, {label} ORDER BY {ROW_KEY}) AS place,
        sum({label}) OVER (PARTITION BY dataset) AS ones FROM ({source})) WHERE {label} = 1 OR place <= ones"""


def split(source: str, label: str) -> str:
    """Rows of the source with their split: groups by label, the dev side by largest remainder of the train side."""
    return f"""
    t AS ({source}),
    grp AS (SELECT dataset, split, id, CASE WHEN 2 * sum({label}) > count({label}) THEN 1 ELSE 0 END AS lab FROM t GROUP BY ALL),
    counted AS (SELECT dataset, lab, count(*) AS c FROM grp GROUP BY ALL),
    size AS (SELECT *, sum(c) OVER (PARTITION BY dataset) AS n FROM counted),
    exact AS (SELECT *, CAST(n - ceil(n * 0.2) AS BIGINT) AS train, (n - ceil(n * 0.2)) * c / n AS e FROM size),
    laid AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(e - floor(e), 9) DESC, lab)
        <= train - sum(floor(e)) OVER (PARTITION BY dataset) AS extra FROM exact),
    quota AS (SELECT dataset, lab, c - floor(e) - CAST(extra AS INT) AS take FROM laid),
    sides AS (SELECT dataset, split, id, CASE WHEN row_number() OVER (PARTITION BY dataset, lab
        ORDER BY md5('42|' || dataset || '|' || split || '|' || id)) <= take THEN 'dev' ELSE 'train' END AS side
        FROM grp JOIN quota USING (dataset, lab))"""


add(
    "class_balance",
    f"SELECT dataset, id, turn, gate_verdict, shuffle_key FROM ({balanced(TRAINING, 'gate_verdict')})",
)
add(
    "first_training_rows",
    f"SELECT dataset, id, turn, shuffle_key FROM ({balanced(TRAINING, 'gate_verdict')}) ORDER BY shuffle_key LIMIT 50",
)
add(
    "group_split",
    f"""WITH {split(TRAINING, "gate_verdict")}
    SELECT dataset, id, turn, gate_verdict, side FROM t JOIN sides USING (dataset, split, id)""",
)
add(
    "sets_by_side",
    f"""WITH {split(TRAINING, "gate_verdict")}
    SELECT dataset, gate_verdict, count(*) AS n FROM t JOIN sides USING (dataset, split, id) WHERE side = 'dev' GROUP BY ALL""",
)
add(
    "joint_trainset",
    f"""WITH {split(balanced(TRAINING, "gate_verdict"), "gate_verdict")}
    SELECT dataset, side, gate_verdict, count(*) AS n FROM t JOIN sides USING (dataset, split, id) GROUP BY ALL""",
)
_CUT = "'(?s)^(.*)(?:Ground-truth Answer:|Use this exact correct answer:)'"
_PLAIN = f"CASE WHEN regexp_matches(task_content, {_CUT}) THEN {strip(f'regexp_extract(task_content, {_CUT}, 1)')} ELSE task_content END"
_HI = "'(?s)(hi.*)Ground-truth Answer:'"
_COMPAT = f"CASE WHEN regexp_matches(task_content, {_HI}) THEN {strip(f'regexp_extract(task_content, {_HI}, 1)')} ELSE task_content END"
add(
    "instruct_text",
    f"""
    SELECT dataset, id, turn, {gate_text(_PLAIN)} AS input, CAST(gate_verdict AS VARCHAR) AS label, 'plain' AS form FROM ({TRAINING})
    UNION ALL
    SELECT dataset, id, turn, {gate_text(_COMPAT)}, CAST(gate_verdict AS VARCHAR), 'compat' FROM ({TRAINING})""",
)


def vocabulary(source: str) -> str:
    return f"""SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 4 AS INT) AS token_id
    FROM (SELECT word, count(*) AS n FROM (SELECT unnest({tokens("text")}) AS word FROM {source})
          WHERE word NOT IN ('0', '1') GROUP BY word)"""


add("vocabulary", vocabulary("documents"))
ENCODED = f"""
    d AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, quality FROM documents JOIN labels USING (doc_id)),
    v AS ({vocabulary("d")} UNION ALL SELECT * FROM (VALUES ('0', 3), ('1', 4)) r(word, token_id)),
    w AS (SELECT id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM (SELECT id, ({tokens("text")})[1:1023] AS t FROM d)),
    e AS (SELECT d.id, quality, string_agg(CAST(coalesce(token_id, 2) AS VARCHAR), ' ' ORDER BY pos) AS ids, count(pos) AS n
          FROM d LEFT JOIN w USING (id) LEFT JOIN v USING (word) GROUP BY ALL)"""
add(
    "encode_pad",
    f"""WITH {ENCODED}
    SELECT id, coalesce(ids || ' ', '') || '1' || repeat(' 0', 1023 - n) AS input_ids,
        repeat('1 ', n) || '1' || repeat(' 0', 1023 - n) AS attention_mask,
        CASE quality WHEN 1 THEN '4' ELSE '3' END || ' 1' || repeat(' -100', 62) AS labels FROM e""",
)
add(
    "collated",
    f"""
    WITH d AS (SELECT doc_id, len(t) AS n, coalesce(list_sum(list_transform(t, lambda w: length(w) + 5)), 0) AS total
        FROM (SELECT doc_id, {tokens("text")} AS t FROM documents))
    SELECT doc_id, CAST(ceil(max(n) OVER (PARTITION BY doc_id // 8) / 8.0) * 8 AS BIGINT) AS width, CAST(total AS BIGINT) AS total,
        '3 1' || repeat(' -100', 6) AS labels, n AS n_words FROM d""",
)
add(
    "label_recodes",
    """SELECT CASE quality WHEN 1 THEN '4' ELSE '3' END || ' 1' || repeat(' 0', 62) AS restored,
    CAST(quality AS VARCHAR) || repeat(' -100', 63) AS targets, count(*) AS n
    FROM documents JOIN labels USING (doc_id) GROUP BY ALL""",
)

# --- Gate -----------------------------------------------------------------------------------------------------------


def class_columns(c: str) -> str:
    tp = f"sum(CAST(label = '{c}' AND said = '{c}' AS INT))"
    said, true = f"sum(CAST(said = '{c}' AS INT))", f"sum(CAST(label = '{c}' AS INT))"
    return f"""round(coalesce({tp} / nullif({said}, 0), 0), 6) AS precision_{c},
    round(coalesce({tp} / nullif({true}, 0), 0), 6) AS recall_{c},
    round(coalesce(2 * {tp} / nullif({said} + {true}, 0), 0), 6) AS f1_{c}"""




def gate_steps(where: str, steps: int = 6, features: int = 4096, rate: float = 4.0, penalty: float = 0.001, accept: float = 3.0) -> str:
    """Weights w{steps}(f, w) after full-batch steps, one after the other; a text's features share a length of 1."""
    out = f"""WITH texts AS (SELECT CAST(doc_id AS VARCHAR) AS id, toxic, list_distinct(list_transform({word_tokens("coalesce(text, '')")},
        lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {features})) AS fs FROM documents JOIN labels USING (doc_id)),
    held AS MATERIALIZED (SELECT id, toxic, unnest(fs) AS f, 1 / sqrt(len(fs)) AS x FROM texts UNION ALL SELECT id, toxic, -1, 1.0 FROM texts),
    xs AS MATERIALIZED (SELECT *, CASE WHEN toxic = 1 THEN {accept} ELSE 1.0 END AS c FROM held WHERE toxic IS NOT NULL AND {where}),
    total AS MATERIALIZED (SELECT sum(c) AS n FROM xs WHERE f = -1),
    w0 AS (SELECT DISTINCT f, CAST(0 AS DOUBLE) AS w FROM xs)"""
    for k in range(steps):
        out += f""",
    e{k} AS MATERIALIZED (SELECT id, any_value(c) * (1 / (1 + exp(-sum(x * w))) - any_value(toxic)) AS e FROM xs JOIN w{k} USING (f) GROUP BY id),
    w{k + 1} AS MATERIALIZED (SELECT f, (1 - {rate} * {penalty}) * any_value(w) - {rate} * sum(e * x) / (SELECT n FROM total) AS w
        FROM xs JOIN e{k} USING (id) JOIN w{k} USING (f) GROUP BY f)"""
    return out


add("gate_fit_steps", f"{gate_steps('true')} SELECT f AS feature, round(w, 6) AS weight FROM w6")
_GATED = f"""{gate_steps("right(id, 1) <> '7'")},
    said AS (SELECT id, CAST(any_value(toxic) AS VARCHAR) AS label, 1 / (1 + exp(-sum(x * coalesce(w, 0)))) AS one
        FROM held LEFT JOIN w6 USING (f) WHERE right(id, 1) = '7' GROUP BY id)"""
add(
    "gate_apply",
    f"""{_GATED} SELECT id, label, one > 0.5 AS gate_output, round(1 - one, 6) AS confidence_0, round(one, 6) AS confidence_1 FROM said""",
)
add(
    "gate_report",
    f"""{PREDICTIONS}, r AS (SELECT CAST(correct AS VARCHAR) AS label,
        CASE WHEN answer = 'unsure' THEN '?' ELSE CAST(CAST(gate_output AS INT) AS VARCHAR) END AS said FROM p)
    SELECT count(*) AS n, round(avg(CAST(label = said AS INT)), 6) AS accuracy, {class_columns("0")}, {class_columns("1")}
    FROM r""",
)
add(
    "gate_roundtrip",
    f"""{_GATED}, r AS (SELECT label, CASE WHEN one > 0.5 THEN '1' ELSE '0' END AS said FROM said)
    SELECT count(*) AS n, round(avg(CAST(label = said AS INT)), 6) AS accuracy, {class_columns("0")}, {class_columns("1")}
    FROM r""",
)

# --- Evaluation -----------------------------------------------------------------------------------------------------

_TURN = "dataset, id, turn, answer, rationale, correct, gate_output"
add("last_turn", f"{PREDICTIONS} SELECT {_TURN} FROM p {LAST}")
add("first_turn", f"{PREDICTIONS} SELECT {_TURN} FROM p {FIRST}")
ACCURACY = """count(*) AS n, CAST(sum(correct) AS BIGINT) AS correct, round(avg(correct), 6) AS accuracy,
    round(avg(f1), 6) AS f1"""
add("accuracy", f"{SCORED} SELECT dataset, {ACCURACY} FROM (SELECT * FROM s {LAST}) GROUP BY ROLLUP (dataset)")
add("accuracy_generated", f"{SCORED} SELECT dataset, {ACCURACY} FROM (SELECT * FROM s {LAST}) GROUP BY dataset")
add("f1_score", f"{SCORED} SELECT dataset, count(*) AS n, round(avg(f1), 6) AS f1 FROM s GROUP BY dataset")
add(
    "formula_gated",
    f"""{PREDICTIONS} SELECT dataset, {FORMULA} FROM (SELECT *, {GATED_SCORE} AS score FROM p {LAST})
    GROUP BY ROLLUP (dataset)""",
)
for _name, _abstains in (("formula_zero_shot", ABSTAINS), ("formula_zero_shot_compat", ABSTAINS_COMPAT)):
    add(
        _name,
        f"""{PREDICTIONS} SELECT dataset, {FORMULA} FROM (SELECT *, {open_score(_abstains)} AS score FROM p {LAST})
        GROUP BY dataset""",
    )
CELLS = """CAST(sum(CAST(correct = 0 AND NOT gate_output AS INT)) AS BIGINT) AS tn,
    CAST(sum(CAST(correct = 0 AND gate_output AS INT)) AS BIGINT) AS fp,
    CAST(sum(CAST(correct = 1 AND NOT gate_output AS INT)) AS BIGINT) AS fn,
    CAST(sum(CAST(correct = 1 AND gate_output AS INT)) AS BIGINT) AS tp"""


def share(part: str, whole: str, name: str) -> str:
    return f"round(coalesce(({part}) / nullif({whole}, 0), 0), 6) AS {name}"


RATES = ", ".join(
    [
        share("tp + tn", "tn + fp + fn + tp", "gate_accuracy"),
        share("tp", "tp + fp", "gate_precision"),
        share("tp", "tp + fn", "gate_recall"),
        share("2 * tp", "2 * tp + fp + fn", "gate_f1"),
        share("fp", "fp + tn", "gate_fpr"),
        share("tn", "tn + fp", "gate_tnr"),
    ]
)
add("gate_confusion", f"{PREDICTIONS}, c AS (SELECT dataset, {CELLS} FROM p GROUP BY dataset) SELECT *, {RATES} FROM c")
add(
    "custom_evaluation",
    f"""{SCORED}, l AS (SELECT * FROM s {LAST}),
    sys AS (SELECT dataset, round(avg(correct), 6) AS system_accuracy, round(avg(f1), 6) AS f1,
        round(avg({GATED_SCORE}), 6) AS formula FROM l GROUP BY dataset),
    c AS (SELECT dataset, 'all turns' AS scope, count(*) AS num_points, {CELLS} FROM s GROUP BY dataset
        UNION ALL SELECT dataset, 'last turn', count(*), {CELLS} FROM l GROUP BY dataset)
    SELECT c.*, system_accuracy, f1, formula, {RATES} FROM c JOIN sys USING (dataset)""",
)
add(
    "value_counts",
    f"""{PREDICTIONS}
    SELECT dataset, 'gate_output' AS column_name, CAST(gate_output AS VARCHAR) AS value, count(*) AS n FROM p GROUP BY ALL
    UNION ALL SELECT dataset, 'correct', CAST(correct AS VARCHAR), count(*) FROM p GROUP BY ALL""",
)
add(
    "group_sizes",
    f"""{PREDICTIONS} SELECT dataset, turns, count(*) AS n_questions
    FROM (SELECT dataset, id, count(*) AS turns FROM p GROUP BY ALL) GROUP BY ALL""",
)


def per_turn(yes: str, names: tuple[str, str]) -> str:
    no, ok = names
    return f"""{PREDICTIONS} SELECT dataset, turn, count(*) FILTER (NOT {yes}) AS {no}, count(*) FILTER ({yes}) AS {ok}
    FROM p GROUP BY ALL"""


add("turn_by_gate", per_turn("gate_output", ("rejected", "accepted")))
add("turn_by_correct", per_turn("(correct = 1)", ("wrong", "right")))
ORACLE["turn_by_verdict"] = ORACLE["turn_by_correct"]
add(
    "first_turn_metrics",
    f"""{SCORED}
    SELECT 'exploration' AS setting, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(f1), 6) AS f1
    FROM s WHERE turn = 0
    UNION ALL SELECT 'gradual', count(*), round(avg(correct), 6), round(avg(f1), 6) FROM s WHERE turn = 1""",
)
KEPT = f"k AS (SELECT * EXCLUDE keep FROM (SELECT *, {NO_EARLIER.format('gate_output')} AS keep FROM s) WHERE keep)"
add(
    "compare_report",
    f"""{SCORED}, {KEPT}, zs AS (SELECT * FROM k {FIRST}), fin AS (SELECT * FROM k {LAST}),
    a AS (SELECT dataset, count(*) AS n, round(avg(correct), 6) AS zs_accuracy, round(avg(f1), 6) AS zs_f1,
        round(avg({open_score()}), 6) AS zs_formula FROM zs GROUP BY dataset),
    b AS (SELECT dataset, round(avg(correct), 6) AS final_accuracy, round(avg(f1), 6) AS final_f1,
        round(avg({GATED_SCORE}), 6) AS final_formula FROM fin GROUP BY dataset)
    SELECT * FROM a JOIN b USING (dataset)""",
)
ORACLE["compare_report_recorded"] = ORACLE["compare_report"].replace("FROM k ", "FROM s ")
add(
    "system_report",
    f"""{SCORED}, {KEPT}, l AS (SELECT *, {GATED_SCORE} AS score FROM k {LAST})
    SELECT dataset, CAST(sum(correct) AS BIGINT) AS correct, round(avg(correct), 6) AS accuracy, round(avg(f1), 6) AS f1,
        {FORMULA} FROM l GROUP BY dataset""",
)
add("distinct_questions", f"{PREDICTIONS} SELECT count(*) AS n_questions FROM (SELECT DISTINCT dataset, id FROM p)")
REPEATED = f"""{PREDICTIONS}, c AS (SELECT dataset, id, answer, count(*) AS c FROM p GROUP BY ALL),
    r AS (SELECT dataset, id, CAST(sum(c) AS BIGINT) AS n_rows,
        CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) AS n_redundant FROM c GROUP BY ALL)"""
add("answer_redundancy", f"{REPEATED} SELECT n_redundant, count(*) AS n_questions FROM r GROUP BY n_redundant")
_SHARE = """CAST(sum({0}) AS BIGINT) AS n_rows, CAST(sum(n_redundant) AS BIGINT) AS n_redundant,
    round(100.0 * sum(n_redundant) / sum({0}), 6) AS percent"""
add("answer_redundancy_share", f"{REPEATED} SELECT {_SHARE.format('n_rows')} FROM r")

DOCS = """SELECT 'docs' AS dataset, CAST(doc_id // 4 AS VARCHAR) AS id, CAST(doc_id % 4 AS INT) AS turn,
    CASE WHEN doc_id % 13 <> 0 THEN text END AS rationale FROM documents"""
TALK = f"SELECT dataset, id, turn, rationale FROM ({CONV})"


def overlapping(source: str, threshold: int, shared: str) -> str:
    return f"""WITH p AS ({source}),
    w AS (SELECT dataset, id, turn, unnest({word_tokens("rationale")}) AS word FROM p),
    c AS (SELECT dataset, id, turn, word, count(*) AS n FROM w GROUP BY ALL),
    hit AS (SELECT DISTINCT dataset, id, turn FROM (SELECT a.dataset, a.id, a.turn, b.turn AS later
        FROM c a JOIN c b ON a.dataset = b.dataset AND a.id = b.id AND a.word = b.word AND a.turn < b.turn
        GROUP BY ALL HAVING sum({shared}) >= {threshold})),
    r AS (SELECT p.dataset, p.id, count(rationale) AS n_rationales, count(hit.turn) AS n_redundant
        FROM p LEFT JOIN hit ON hit.dataset = p.dataset AND hit.id = p.id AND hit.turn = p.turn GROUP BY ALL)"""


add("rationale_redundancy", f"{overlapping(f'{TALK} UNION ALL {DOCS}', 20, 'a.n & b.n')} SELECT * FROM r")
add("rationale_redundancy_min", f"{overlapping(f'{TALK} UNION ALL {DOCS}', 30, 'least(a.n, b.n)')} SELECT * FROM r")
add("rationale_redundancy_share", f"{overlapping(f'{TALK} UNION ALL {DOCS}', 20, 'a.n & b.n')} SELECT {_SHARE.format('n_rationales')} FROM r")
add(
    "rationale_redundancy_histogram",
    f"{overlapping(f'{TALK} UNION ALL {DOCS}', 20, 'a.n & b.n')} SELECT n_redundant, count(*) AS n_questions FROM r GROUP BY n_redundant",
)
