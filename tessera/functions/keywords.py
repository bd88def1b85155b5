"""Keyword scores of a query by position, context, similarity and gapped patterns; structural counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that raise a keyword's weight when before or after it.
ASKING = ["哪个", "什么", "如何", "为什么"]
PROPERTIES = ["的", "值", "属性", "能力", "技能", "武器", "关键字"]
# Word groups of the structural counts.
STRUCTURE = {
    "questions": ["什么", "如何", "为什么", "哪个", "怎么", "哪些"],
    "quantities": ["哪些", "多少个", "多少种", "几个", "多少"],
    "comparisons": ["哪个", "相比", "比较", "更", "最高", "最低", "最远", "最近"],
}


def _sum(parts: list[Column]) -> Column:
    return F.round(reduce(lambda a, b: a + b, parts, F.lit(0.0)), 6)


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def _around(query: Column, word: str, width: int) -> tuple[Column, Column, Column]:
    """1-based place of the word (0 without), and up to ``width`` characters before and after it."""
    at = F.instr(query, word)
    first = F.greatest(at - width, F.lit(1))
    return at, F.substring(query, first, at - first), F.substring(query, at + len(word), F.lit(width))


def position_score(query: Column, words: list[str], helpers: list[str] | None = None, helped: float = 0.9) -> Column:
    """Sum over the words in the query: first fifth .8, last fifth .9, between 1.2; ``helped`` after a helper phrase."""
    parts = []
    for w in words:
        at, before, _ = _around(query, w, 8)
        n, pos = F.length(query), at - 1
        place = F.when(pos < n * 0.2, 0.8).when(pos > n * 0.8, 0.9).otherwise(1.2)
        parts.append(F.when(at > 0, F.when(_any(before, helpers or []), helped).otherwise(place)).otherwise(0.0))
    return _sum(parts)


def context_score(query: Column, words: list[str], asking: list[str] = ASKING, properties: list[str] = PROPERTIES) -> Column:
    """Sum over the words in the query: 1, times 1.3 after a question word, times 1.2 before a property word (4 characters)."""
    parts = []
    for w in words:
        at, before, after = _around(query, w, 4)
        weight = F.when(_any(before, asking), 1.3).otherwise(1.0) * F.when(_any(after, properties), 1.2).otherwise(1.0)
        parts.append(F.when(at > 0, weight).otherwise(0.0))
    return _sum(parts)


def gapped_score(query: Column, patterns: list[str]) -> Column:
    """The best ``a...b`` pattern whose parts follow each other: letters of both parts by the pattern's length."""
    best = F.lit(0.0)
    for p in patterns:
        if p.count("...") != 1:
            continue
        a, b = p.split("...")
        at = F.instr(query, a) if a else F.lit(1)
        fits = (at > 0) & (F.locate(b, query, 1) > 0) & F.substring(query, at + len(a), F.length(query)).contains(b)
        best = F.greatest(best, F.when(fits, min((len(a) + len(b)) / len(p), 1.0)).otherwise(0.0))
    return F.round(best, 6)


def fuzzy_score(words: list[str], least: float = 0.8) -> Callable[[Column], Column]:
    """Sum over the words of the best similarity of a window of the word's length, where above ``least``.

    The similarity is a matching-blocks ratio, which no column function has; a text is scored in Arrow batches, and
    windows without enough letters in common are passed over, which loses none above the threshold.
    """

    def best(text: str, word: str) -> float:
        if word in text:
            return 1.0
        n, letters, top = len(word), set(word), 0.0
        match = SequenceMatcher(None)
        match.set_seq2(word)
        for window in {text[i : i + n] for i in range(len(text) - n + 1)}:
            if sum(c in letters for c in window) > least * n:
                match.set_seq1(window)
                top = max(top, match.ratio())
        return top

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: round(sum(s for s in (best(t or "", w) for w in words) if s > least), 6))

    return score


def structural_counts(query: Column, damping: Column | None = None) -> dict[str, Column]:
    """Words of each group in the query, its length and full-width punctuation; ``damping`` multiplies each row's own."""
    k = F.lit(1.0) if damping is None else damping
    out = {name: _sum([query.contains(w).cast("double") for w in ws]) * k for name, ws in STRUCTURE.items()}
    return out | {"chars": F.length(query) * k, "marks": F.length(F.regexp_replace(query, "[^，。！？；：（）【】]", "")) * k}


def damping(query: Column, phrases: list[str], factor: float = 1e-4) -> Column:
    """``factor`` where a row holds one of the negative phrases, else 1."""
    return F.when(_any(query, phrases), factor).otherwise(1.0)


def keyword_vector(query: Column, primary: dict[str, list[str]], secondary: dict[str, list[str]], negative: dict[str, list[str]]) -> dict[str, Column]:
    """For each intent its primary words by position, secondary by context, negative by similarity, and primary as gapped patterns: four groups of columns."""
    out = {f"primary_{n}": position_score(query, ws) for n, ws in primary.items()}
    out |= {f"secondary_{n}": context_score(query, ws) for n, ws in secondary.items()}
    out |= {f"negative_{n}": fuzzy_score(ws)(query) for n, ws in negative.items()}
    return out | {f"gapped_{n}": gapped_score(query, ws) for n, ws in primary.items()}
