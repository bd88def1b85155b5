"""Streaming counterparts: incremental term index, query-log windows, list answers from pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lexical import term_counts

#: The heading of a list answer and the mark that ends an item.
_HEADING, _SOURCE = re.compile(r"共\d+个"), re.compile(r"\[来源[0-9,，]+\]")


def index_documents(stream: DataFrame, postings: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's postings to a folder of its own, so that a batch that is run again replaces itself.

    A document without tokens has one row without a term, so that ``current_postings`` can forget its older ones.
    """

    def save(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates(["doc_id"])
        rows = once.select("doc_id").join(term_counts(once), "doc_id", "left")
        rows.write.mode("overwrite").parquet(f"{postings}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_postings(spark: SparkSession, postings: str) -> DataFrame:
    """The postings of each document in the last batch that held it, so that one that comes again counts once."""
    rows = spark.read.parquet(postings)
    last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"], "left_semi").where("term is not null").drop("batch")


def query_log(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, event_type, n, mean) of a log (ts, event_type, value)."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def list_lines(text: str, headed: bool) -> tuple[list[str], str, bool]:
    """The whole lines at the start of a list answer's text, the rest without blanks before it, and whether its heading has been given.

    A line is the heading, once, where it starts what is left, or an item with a tab before it up to its source mark.
    """
    lines, at, text = [], 0, text.lstrip()
    while found := (None if headed else _HEADING.match(text, at)) or _SOURCE.search(text, at):
        heading = found.re is _HEADING
        headed = headed or heading
        lines.append(found.group() if heading else "\t" + text[at : found.end()].strip())
        at = len(text) - len(text[found.end() :].lstrip())
    return lines, text[at:], headed


def _answer(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    text, headed, given = state.get if state.exists else ("", False, 0)
    rows = pd.concat(list(parts)).sort_values("seq")
    lines, text, headed = list_lines(text + "".join(x for x in rows["piece"] if x), headed)
    if rows["last"].fillna(False).astype(bool).any():
        lines += [text] if text.strip() else []
        if state.exists:
            state.remove()
    else:
        state.update((text, headed, given + len(lines)))
    yield pd.DataFrame({"answer_id": [key[0]] * len(lines), "n": range(given, given + len(lines)), "line": lines})


def parse_lists(pieces: DataFrame) -> DataFrame:
    """(answer_id, n, line) from a stream of (answer_id, seq, piece, last): what waits is given out, and forgotten, with the last piece."""
    g = pieces.select("answer_id", "seq", "piece", "last").groupBy("answer_id")
    return g.applyInPandasWithState(_answer, "answer_id long, n long, line string", "held string, headed boolean, given long", "append", GroupStateTimeout.NoTimeout)


class _TimedAnswers:
    """State of an answer: its waiting text, whether its heading was given, lines given, and the time from which it is silent.

    Event-time timers end what stays silent, so that an answer whose last piece is lost doesn't wait for ever, and keep a client's connection
    alive before.
    """

    def __init__(self, idle_ms: int, alive_ms: int) -> None:
        self.idle, self.alive = idle_ms, alive_ms

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "text string, headed boolean, given long, seen long")

    def _timers(self, seen: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.alive:
            self.handle.registerTimer(seen + self.alive)
        self.handle.registerTimer(seen + self.idle)

    @staticmethod
    def _rows(key: tuple, lines: list[str], given: int, kind: str) -> pd.DataFrame:
        return pd.DataFrame({"answer_id": [key[0]] * len(lines), "n": range(given, given + len(lines)), "kind": pd.Series([kind] * len(lines), dtype=object), "line": pd.Series(lines, dtype=object)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, headed, given, seen = self.held.get() if self.held.exists() else ("", False, 0, 0)
        parts = pd.concat(list(rows)).sort_values("seq")
        lines, text, headed = list_lines(text + "".join(x for x in parts["piece"] if x), headed)
        seen = max(seen, int(parts["ts"].max().timestamp() * 1000))
        if parts["last"].fillna(False).astype(bool).any():
            lines += [text] if text.strip() else []
            self._forget()
        else:
            self.held.update((text, headed, given + len(lines), seen))
            self._timers(seen)
        yield self._rows(key, lines, given, "line")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        text, headed, given, seen = self.held.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= seen + self.idle:
            yield self._rows(key, [text] if text.strip() else [], given, "ended")
            self._forget()
        elif self.alive:
            self.handle.registerTimer(min(expiredTimerInfo.getExpiryTimeInMs() + self.alive, seen + self.idle))
            yield self._rows(key, [": keep-alive"], given, "alive")

    def _forget(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.held.clear()

    def close(self) -> None:
        pass


def parse_lists_timed(pieces: DataFrame, idle: int = 60, alive: int = 15, late: str = "10 seconds") -> DataFrame:
    """(answer_id, n, kind, line) from a stream of (answer_id, ts, seq, piece, last), as ``parse_lists``, with timers by event time.

    An answer that is silent for ``idle`` seconds of the stream's time gives what waits, as of kind ``ended``, and is forgotten; after each ``alive``
    seconds of silence before, a comment row of kind ``alive`` keeps its connection open (0: none). The session's state store must be RocksDB.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Answers(_TimedAnswers, StatefulProcessor):
        pass

    g = pieces.select("answer_id", "ts", "seq", "piece", "last").withWatermark("ts", late).groupBy("answer_id")
    return g.transformWithStateInPandas(Answers(idle * 1000, alive * 1000), "answer_id long, n long, kind string, line string", "append", "eventTime")


def full_text(pieces: DataFrame) -> DataFrame:
    """(answer_id, text): the pieces (answer_id, seq, piece) of each answer in their order, as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("piece", F.lit("")).alias("piece"))))
    return pieces.groupBy("answer_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"))
