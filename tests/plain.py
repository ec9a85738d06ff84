"""Small statements of rules of our own, on words or sets, for comparison with the column expressions."""

import collections
import re


def f1(answer, golds):
    """Best overlap of an answer's words with each gold's words; all given as lists."""
    best = 0.0
    for gold in golds:
        if not answer or not gold:
            best = max(best, float(answer == gold))
            continue
        same = sum((collections.Counter(answer) & collections.Counter(gold)).values())
        best = max(best, 2 * same / (len(answer) + len(gold)))
    return best


def overlap(a, b, how):
    """Shared word weight of two texts."""
    x, y = (collections.Counter(re.findall(r"\w\w+", t.lower())) for t in (a, b))
    return sum((x[w] & y[w]) if how == "bitand" else min(x[w], y[w]) for w in x.keys() & y.keys())


def redundant(texts, threshold, how="bitand"):
    """Of texts in turn order (None allowed): how many some later one overlaps."""
    held = [t for t in texts if t is not None]
    return sum(
        any(overlap(held[i], held[j], how) >= threshold for j in range(i + 1, len(held))) for i in range(len(held))
    )
