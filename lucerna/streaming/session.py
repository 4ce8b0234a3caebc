"""Paused conversations as keyed streaming state."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lucerna.functions.text import choose
from lucerna.operators.flow import PENDING, Walk, compiled

MOST_QUESTIONS = 20
MISSING = "informacion_faltante"


def advance(program: tuple, answers: dict[str, str], asked: int, pending: str | None, said: list[str | None]) -> tuple[dict, int, str | None, str, list[str]]:
    """Takes the replies in turn; a reply that cannot be read uses up a question and stores nothing. The walk is replayed from the answers."""
    walked = lambda answers: Walk(*program, answers).result()
    got = walked(answers)
    for reply in said:
        if pending is not None and got["status"] == PENDING and got["stopped_at"] == pending:
            option = choose(reply, got["options"])
            if option is not None:
                answers = {**answers, pending: option}
                got = walked(answers)
        if got["status"] != PENDING:
            return answers, asked, None, got["status"], []
        if asked >= MOST_QUESTIONS:
            return answers, asked, None, MISSING, []
        asked, pending = asked + 1, got["stopped_at"]
    if got["status"] != PENDING:
        return answers, asked, None, got["status"], []
    return answers, asked, pending, PENDING, got["options"]


OUTPUT = "thread_id string, status string, node_id string, options array<string>, asked int, answers string"
STATE = "answers string, asked int, pending string"
EXPIRED = "caducado"
#: How long an open thread waits for a reply.
WAIT_MS = 24 * 60 * 60 * 1000


class Conversation(StatefulProcessor):
    """The state of a thread: its answers, questions asked, and open question.

    A thread that ends leaves the store at once; one that gets no reply for
    `wait_ms` leaves it with a last row of status EXPIRED. A reply to a thread
    that is not in the store opens it anew.
    """

    def __init__(self, program: tuple, wait_ms: int) -> None:
        self.program, self.wait_ms = program, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.thread = handle.getValueState("thread", STATE)

    def _row(self, key, status: str, pending: str | None, options: list[str], asked: int, answers: dict[str, str]) -> pd.DataFrame:
        return pd.DataFrame({"thread_id": [key[0]], "status": [status], "node_id": [pending], "options": [options], "asked": [asked], "answers": [json.dumps(answers, sort_keys=True)]})

    def _quiet(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values("turn")
        held, asked, pending = self.thread.get() if self.thread.exists() else ("{}", 0, None)
        answers, asked, pending, status, options = advance(self.program, json.loads(held), int(asked), pending, frame["reply"].tolist())
        self._quiet()
        if status == PENDING:
            self.thread.update((json.dumps(answers, sort_keys=True), asked, pending))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        else:
            self.thread.clear()
        yield self._row(key, status, pending, options, asked, answers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.thread.exists():
            held, asked, pending = self.thread.get()
            self.thread.clear()
            yield self._row(key, EXPIRED, pending, [], int(asked), json.loads(held))

    def close(self) -> None:
        pass


def conversations(events: DataFrame, nodes: list[dict], edges: list[dict], wait_ms: int = WAIT_MS) -> DataFrame:
    """A stream (thread_id, turn, reply) as the state of each thread after its new turns; the first turn opens the thread.

    The state lives in the state store, so a restart from the checkpoint goes on
    where threads stood; only open threads are there. The store must be RocksDB
    (`state_store`). Timers run with each batch; a stream that is to end when its
    input does needs `spark.sql.streaming.noDataMicroBatches.enabled` off.
    """
    return events.groupBy("thread_id").transformWithStateInPandas(Conversation(compiled(nodes, edges), wait_ms), OUTPUT, "Update", "ProcessingTime")


def state_store(spark) -> None:
    """Sets the store that threads with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
