"""Dictionary words in running text: most probable segmentation, and masking of phrases with its inverse."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class LetterModel:
    """A hidden Markov model of letters that begin (B), go on with (M) or end (E) a word or are one (S), for words that no dictionary has.

    It is estimated from a weighted dictionary: letters by their place in its words, transitions within and between them, with
    ``smooth`` added to every count. A letter that no word has fits every place alike.
    """

    STATES = "BMES"

    def __init__(self, weights: dict[str, float], smooth: float = 0.1) -> None:
        emit: dict[str, dict[str, float]] = {x: {} for x in self.STATES}
        inner = {"BM": 0.0, "BE": 0.0, "MM": 0.0, "ME": 0.0}
        alone = longer = 0.0
        for word, weight in weights.items():
            w = max(weight, 1.0)
            places = "S" if len(word) == 1 else "B" + "M" * (len(word) - 2) + "E"
            for letter, place in zip(word, places, strict=True):
                emit[place][letter] = emit[place].get(letter, 0.0) + w
            for pair in zip(places, places[1:], strict=False):
                inner["".join(pair)] += w
            alone, longer = alone + w * (len(word) == 1), longer + w * (len(word) > 1)
        letters = len({x for e in emit.values() for x in e}) + 1
        self.emit = {p: ({x: math.log((n + smooth) / (sum(e.values()) + smooth * letters)) for x, n in e.items()}, math.log(smooth / (sum(e.values()) + smooth * letters))) for p, e in emit.items()}
        share = lambda part, whole, ways: math.log((part + smooth) / (whole + smooth * ways))
        begins, single = share(longer, alone + longer, 2), share(alone, alone + longer, 2)
        self.start = {"B": begins, "S": single}
        self.step = {p: {"B": begins, "S": single} for p in "ES"} | {p: {q: share(inner[p + q], inner[p + "M"] + inner[p + "E"], 2) for q in "ME"} for p in "BM"}

    def cut(self, run: str) -> list[str]:
        """The words of the most probable states (Viterbi); the last letter ends a word."""
        if len(run) < 2:
            return [run] if run else []
        # letters outside the model are as likely in every place
        known = lambda x: any(x in table for table, _ in self.emit.values())
        score = lambda p, x: self.emit[p][0].get(x, self.emit[p][1]) if known(x) else 0.0
        best = {p: self.start[p] + score(p, run[0]) if p in self.start else -math.inf for p in self.STATES}
        back: list[dict[str, str]] = []
        for x in run[1:]:
            came = {q: max((best[p] + self.step[p][q], p) for p in self.STATES if q in self.step[p]) for q in self.STATES}
            best = {q: v + score(q, x) for q, (v, _) in came.items()}
            back.append({q: p for q, (_, p) in came.items()})
        state = max("ES", key=lambda p: best[p])
        places = [state]
        for came_from in reversed(back):
            places.append(state := came_from[state])
        out, start = [], 0
        for i, p in enumerate(reversed(places)):
            if p in "ES":
                out.append(run[start : i + 1])
                start = i + 1
        return out


def segmenter(weights: dict[str, float], blanks: bool = False, unknown: bool = False) -> Callable[[str], list[str]]:
    """Cut CJK runs into the words of the greatest product of weights; other letters and digits stay whole runs.

    A letter that no word covers is a word of weight 1. Equal products take the longer first word. With ``unknown``, letters
    that stand alone side by side in the best cut are cut again by a ``LetterModel`` of the dictionary, which finds words that it lacks.
    """
    logs = {w: math.log(max(x, 1.0)) for w, x in weights.items() if w}
    longest, total = max(map(len, logs), default=1), math.log(max(sum(weights.values()), 2.0))
    runs = re.compile(r"[一-鿿]+|[^\W_一-鿿]+|\s+|.", re.S)
    model = LetterModel({w: x for w, x in weights.items() if w}) if unknown else None

    def guessed(words: list[str]) -> list[str]:
        out: list[str] = []
        alone = ""
        for w in [*words, ""]:
            if len(w) == 1:
                alone += w
                continue
            out += model.cut(alone) if len(alone) > 1 else list(alone)
            alone = ""
            out += [w] if w else []
        return out

    def cut(text: str) -> list[str]:
        out: list[str] = []
        for run in runs.findall(text or ""):
            if run.isspace():
                out += [run] * blanks
            elif not "一" <= run[0] <= "鿿":
                out.append(run)
            else:
                n = len(run)
                best: list[tuple[float, int]] = [(0.0, 0)] * n + [(0.0, n)]
                for i in range(n - 1, -1, -1):
                    ends = [j for j in range(i + 1, min(i + longest, n) + 1) if j == i + 1 or run[i:j] in logs]
                    best[i] = max((logs.get(run[i:j], 0.0) - total + best[j][0], j) for j in ends)
                i, words = 0, []
                while i < n:
                    words.append(run[i : best[i][1]])
                    i = best[i][1]
                out += guessed(words) if model else words
        return out

    return cut


def segment(weights: dict[str, float], blanks: bool = False, unknown: bool = False) -> Callable[[Column], Column]:
    """``segmenter`` as a column function over Arrow batches; the dictionary goes to each worker once."""

    @F.pandas_udf("array<string>")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = segmenter(weights, blanks, unknown)
        for texts in batches:
            yield texts.map(cut)

    return words


def _spots(phrases: list[str]) -> Callable[[str], list[tuple[int, int]]]:
    """(start, phrase number) from the left, the longest first where several begin, none overlapping."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        if p:
            machine.add_word(p, i)
    if len(machine):
        machine.make_automaton()

    def find(text: str) -> list[tuple[int, int]]:
        out, after = [], 0
        hits = [(end - len(phrases[i]) + 1, -len(phrases[i]), i) for end, i in machine.iter(text)] if len(machine) else []
        for start, _, i in sorted(hits):
            if start >= after:
                out.append((start, i))
                after = start + len(phrases[i])
        return out

    return find


def mask(phrases: list[str]) -> Callable[[Column], Column]:
    """Replace phrases by ``__PHRASE_n_phrase__``; null stays null."""

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _spots(phrases)

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            out, at = [], 0
            for start, i in find(text):
                out += [text[at:start], f"__PHRASE_{i}_{phrases[i]}__"]
                at = start + len(phrases[i])
            return "".join(out) + text[at:]

        for texts in batches:
            yield texts.map(one)

    return masked


def unmask(text: Column) -> Column:
    """The inverse of ``mask``, for texts that hold no such marks themselves."""
    return F.regexp_replace(text, r"__PHRASE_\d+_(.*?)__", "$1")
