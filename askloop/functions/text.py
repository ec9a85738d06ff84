"""Text functions as native column expressions: normalise, match, token F1, word bags, abstention, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blank characters: the Unicode White_Space property and the four ASCII separators 1C..1F.
SPACE = r"[\s\x1c-\x1f]"

# Word characters, and the 32 ASCII punctuation characters.
WORD = r"[\p{L}\p{N}_]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"

# Articles removed by answer normalisation, as whole words.
ARTICLES = ["a", "an", "the"]
# Answers that count as an abstention.
ABSTENTIONS = ["no answer", "none", "-1", "unsure", "none of the above", "unanswerable"]


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it as a variable in ``body``.

    An expression used inside a lambda is otherwise evaluated again for every array element.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove blanks of any kind from both ends (``trim`` removes only the space character).

    The look-behind lets the last run be tried from its start only, so long runs inside cost nothing.
    """
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces. A missing text reads as ``none``.

    Each pattern repeats single characters only: repeated groups would recurse on long texts. Most characters fail at a
    pattern's first test, and a single space is left as it is.
    """
    out = F.lower(F.coalesce(text.cast("string"), F.lit("none")))
    out = F.regexp_replace(out, PUNCTUATION, "")
    begins = "".join(sorted({a[0] for a in ARTICLES}))
    out = F.regexp_replace(out, f"(?=[{begins}])(?<!{WORD})(?:{'|'.join(ARTICLES)})(?!{WORD})", " ")
    return F.trim(F.regexp_replace(out, f"(?U) {SPACE}+|[{SPACE[1:-1]}&&[^ ]]{SPACE}*", " "))


def exact_match(answer: Column, gold: Column) -> Column:
    """1 if the normalised answer equals any normalised gold answer, else 0."""
    hit = F.array_contains(F.transform(gold, normalize_answer), normalize_answer(answer))
    return F.coalesce(hit, F.lit(False)).cast("int")


def raw_membership(response: Column, gold: Column) -> Column:
    """"1" if the response is literally one of the gold answers, else "0"."""
    return F.when(F.array_contains(gold, response), "1").otherwise("0")


def tokens(text: Column) -> Column:
    """Words of the normalised text; none for a missing or empty text."""
    words = F.array_remove(F.split(normalize_answer(text), " "), "")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(words)


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "{2,}"), F.lit(0))


def ascii_cut(text: Column) -> Column:
    """Lower case, a blank for whatever beyond ASCII is no word character: cut at ASCII, it has the words of ``word_tokens``."""
    low = F.lower(text)
    only_ascii = F.octet_length(low) == F.length(low)
    return F.when(only_ascii, low).otherwise(F.regexp_replace(low, rf"[^\x00-\x7f{WORD[1:-1]}]", " "))


def word_counts(words: Column) -> Column:
    """``array<struct<word, n>>`` of a word list: sort it, then measure the runs. Linear after the sort."""

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return bind(
            starts,
            lambda st: F.transform(
                st,
                lambda p, k: F.struct(
                    F.get(s, p).alias("word"),
                    (F.coalesce(F.get(st, k + 1), F.size(s)) - p).alias("n"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<word: string, n: int>>")
    return bind(F.sort_array(words), lambda s: F.when(F.size(s) == 0, empty).otherwise(runs(s)))


def numbered_words(words: Column) -> Column:
    """The word list as a set: the k-th repeat of a word becomes ``word k``, from the second on.

    The multiset intersection of two lists is then the plain ``array_intersect`` of the two sets, which hashes. A list
    without repeats, as most short answers are, is its own set.
    """

    def spread(r: Column) -> Column:
        again = F.transform(F.sequence(F.lit(2), r["n"]), lambda k: F.concat(r["word"], F.lit(" "), k.cast("string")))
        return F.when(r["n"] == 1, F.array(r["word"])).otherwise(F.concat(F.array(r["word"]), again))

    def numbered(ws: Column) -> Column:
        return F.flatten(F.transform(word_counts(ws), spread))

    return bind(words, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), ws).otherwise(numbered(ws)))


def word_bag(text: Column) -> Column:
    """The words of the normalised text as a set that keeps repeats."""
    return numbered_words(tokens(text))


def bag_f1(a: Column, g: Column) -> Column:
    """Token F1 of two word bags."""
    total = F.size(a) + F.size(g)
    either_empty = (F.size(a) == 0) | (F.size(g) == 0)
    shared = F.size(F.array_intersect(a, g))
    return F.when(either_empty, (total == 0).cast("double")).otherwise(2.0 * shared / total)


def token_f1(answer: Column, gold: Column) -> Column:
    """Best token F1 of the answer against any gold answer."""
    best = bind(
        word_bag(answer), lambda a: F.array_max(F.transform(gold, lambda one: bind(word_bag(one), lambda g: bag_f1(a, g))))
    )
    return F.coalesce(best, F.lit(0.0))


def is_abstention(answer: Column, compat: bool = False) -> Column:
    """True for an answer that declines to answer.

    The answer is normalised before the test, so the list must be as well or "none of the above" never matches.
    ``compat`` tests against the unnormalised list. "-1" is left out otherwise: normalised it is the choice "1".
    """
    if compat:
        words = [F.lit(w) for w in ABSTENTIONS]
    else:
        words = [normalize_answer(F.lit(w)) for w in ABSTENTIONS if w != "-1"]
    return normalize_answer(answer).isin(*words)


def formula_value(correct: Column, withheld: Column) -> Column:
    """0 for a withheld answer, else +1 when right and -1 when wrong."""
    return F.when(withheld, 0).when(correct == 0, -1).otherwise(correct).cast("int")


def confidence_text(zero: Column, one: Column) -> Column:
    """Both class confidences as one text with four decimals."""
    return F.format_string("0: %.4f, 1: %.4f", zero, one)


def label_text(label: Column) -> Column:
    return label.cast("string")
