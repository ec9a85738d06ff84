"""Parse model responses and stored text into columns. The patterns are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askloop.functions.text import SPACE, bind, strip

# The texts stored when a response does not hold what was asked for.
NO_OUTPUT = "Output not found"
NO_NUMBER = "Error: No number found"
NO_ANSWER = "Answer not found"
NO_RATIONALE = "Rationale not found"

# Markers in model output and in task contents.
ASSISTANT_MARK = "assistant\n\n"
GOLD_MARKS = ["Ground-truth Answer:", "Use this exact correct answer:"]

# (?U) gives Unicode blanks and digits, (?d) makes "." stop at a newline only.
STATED_NUMBER = r"(?U)answer is [^\d]*([\d,]+(?:\.\d+)?)"
ANY_NUMBER = r"(?U)[\d,]+(?:\.\d+)?"
ANSWER_SPAN = rf"(?dU)Answer:{SPACE}*(.*?){SPACE}*Rationale:{SPACE}*(.*)"
QUERY_JSON = rf'(?sU)\{{{SPACE}*"search_query":{SPACE}*".*?"{SPACE}*\}}'
# The first key, colon and separator decide: if no "reasoning" follows them, none follows any later ones.
QUERY_SALVAGE = r"(?s)\A(?>.*?search_query)[^:]*+:([^,\n\r]*+)[,\n\r]+.*?reasoning"
PAREN_NUMBER = rf"(?U)\((\d+)\){SPACE}*\z"
DIGITS = r"(?U)\d+"


def _unquote(text: Column, quote: str) -> Column:
    return F.regexp_replace(text, rf"\A{quote}+|(?<!{quote}){quote}+\z", "")


def literal_list(text: Column) -> Column:
    """A gold-answer cell as ``array<string>``: a list literal is read, any other text is one answer."""
    bare = _unquote(_unquote(text, '"'), "'")
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    listed = F.regexp_replace(bare, r"(?s)\A\s*\((.*?),?\s*\)\s*\z", "[$1]")
    return F.coalesce(F.from_json(listed, "array<string>", options), F.when(text.isNotNull(), F.array(bare)))


def assistant_output(text: Column) -> Column:
    """What follows the first assistant marker, stripped and without blank lines."""
    at = F.instr(text, ASSISTANT_MARK)
    body = strip(text.substr(at + F.lit(len(ASSISTANT_MARK)), F.length(text)))
    return F.when(at > 0, F.regexp_replace(body, rf"(?U)\n{SPACE}*\n", "\n")).otherwise(NO_OUTPUT)


def extract_number(text: Column) -> Column:
    """The number after "answer is ", else the last number, without thousands separators."""
    stated = F.when(text.rlike(ANY_NUMBER), F.regexp_extract(text, STATED_NUMBER, 1))
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(ANY_NUMBER), F.lit(0)), F.lit(-1))
    found = F.when(stated != "", stated).otherwise(last)
    return F.coalesce(F.replace(found, F.lit(","), F.lit("")), F.lit(NO_NUMBER))


def answer_and_rationale(response: Column, question_type: Column) -> Column:
    """``struct<answer, rationale>`` of a response; the rationale ends with its line.

    The pattern scans the response once; the two parts are then read from the short span it matched.
    """
    text = F.coalesce(response, F.lit(""))

    def parts(span: Column) -> Column:
        hit = span != ""
        return F.struct(
            F.when(hit, strip(F.regexp_extract(span, ANSWER_SPAN, 1))).otherwise(NO_ANSWER).alias("answer"),
            F.when(hit, strip(F.regexp_extract(span, ANSWER_SPAN, 2))).otherwise(NO_RATIONALE).alias("rationale"),
        )

    # The plain test spares the pattern, which starts over at every "Answer:", where it cannot match.
    span = F.when(F.contains(text, F.lit("Rationale:")), F.regexp_extract(text, ANSWER_SPAN, 0)).otherwise("")
    spoken = bind(span, parts)
    numeric = F.struct(extract_number(text).alias("answer"), text.alias("rationale"))
    return F.when(question_type == "MATH", numeric).otherwise(spoken)


def final_answer(response: Column, question_type: Column) -> Column:
    return answer_and_rationale(response, question_type)["answer"]


def search_query(response: Column) -> Column:
    """The ``search_query`` value of a JSON object in the response, else the text salvaged after that key."""
    found = F.regexp_extract(response, QUERY_JSON, 0)
    # A raw line break or tab inside the quotes is no valid JSON.
    quoted = F.regexp_extract(found, r'(?s):[\s]*(".*")[\s]*\}\z', 1)
    value = F.when(~quoted.rlike(r"[\x00-\x1f]"), F.get_json_object(found, "$.search_query"))
    salvaged = _unquote(strip(F.regexp_extract(response, QUERY_SALVAGE, 1)), '"')
    return (
        F.when(found != "", F.coalesce(value, response))
        .when(response.rlike(QUERY_SALVAGE), salvaged)
        .otherwise(response)
    )


def final_paren_number(response: Column, compat: bool = False) -> Column:
    """The number in closing parentheses, else the last number, as text without leading zeros.

    A response without any number has no answer (null); ``compat`` gives -1, which normalises to the choice "1".
    """
    closing = F.regexp_extract(response, PAREN_NUMBER, 1)
    last = F.try_element_at(F.regexp_extract_all(response, F.lit(DIGITS), F.lit(0)), F.lit(-1))
    digits = F.when(closing != "", closing).otherwise(last)
    number = F.regexp_replace(digits, r"\A0+(?=\d)", "")
    return F.coalesce(number, F.lit("-1")) if compat else number


def clean_task_content(content: Column, compat: bool = False) -> Column:
    """Task content without the injected gold answer.

    ``compat`` starts at the first "hi" anywhere and knows the multiple-choice marker only; by default the head
    is kept and the text is cut at the last marker of either kind, so no gold answer leaks into training.
    """
    if compat:
        found = F.regexp_extract(content, rf"(?s)hi.*(?={GOLD_MARKS[0]})", 0)
        marked = F.contains(content, F.lit(GOLD_MARKS[0]))
        return F.when(marked & (found != ""), strip(found)).otherwise(content)
    marks = "|".join(GOLD_MARKS)
    head = F.regexp_extract(content, rf"(?s)\A(.*)(?:{marks})", 1)
    return F.when(content.rlike(marks), strip(head)).otherwise(content)
