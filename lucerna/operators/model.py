"""Calls of outside models for the rows of a table (O3, O7, and the generator, judge, translator and classifier of 2.16).

A client is any picklable function from a prompt to a reply. It runs on the
executors, a partition at a time; a call that is late, or that fails for good,
becomes the row's error, and the query goes on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUT_S, PAUSE_S = 120.0, 2.0
TECHNICAL = "error_tecnico"


class Refused(Exception):
    """A client's reply with an HTTP status."""

    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status

    def __reduce__(self):
        return Refused, (self.status,)


def with_retry(client: Callable[[str], str], pause: float = PAUSE_S) -> Callable[[str], str]:
    """One more try after a status from 500 on, none after any other."""

    def call(prompt: str) -> str:
        try:
            return client(prompt)
        except Refused as e:
            if e.status < 500:
                raise
        time.sleep(pause)
        return client(prompt)

    return call


def timed(client: Callable[[str], str], prompts: Iterator[str | None], timeout: float) -> Iterator[tuple[str | None, str | None]]:
    """O3: (reply, error) of each prompt; a reply that comes after the timeout is never used, and its worker is left behind."""
    pool = ThreadPoolExecutor(1)
    try:
        for prompt in prompts:
            if prompt is None:
                yield None, None
                continue
            try:
                yield pool.submit(client, prompt).result(timeout), None
            except Late:
                pool.shutdown(wait=False, cancel_futures=True)
                pool = ThreadPoolExecutor(1)
                yield None, f"{TECHNICAL}: no reply in {timeout:g} s"
            except Exception as e:  # noqa: BLE001  any failure of a client is its row's error
                yield None, f"{TECHNICAL}: {e}"
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def asked(rows: DataFrame, client: Callable[[str], str], prompt: str = "prompt", timeout: float = TIMEOUT_S, pause: float = PAUSE_S) -> DataFrame:
    """The rows with `reply` and `error`, one of them null; both for a null prompt. Other columns stay as they are."""
    call = with_retry(client, pause)
    whole = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(f"`{prompt}`").cast("string").alias("prompt"))

    def run(batches):
        for batch in batches:
            got = list(timed(call, iter(batch.column("prompt").to_pylist()), timeout))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([r for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], ["row", "reply", "error"])

    out = whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, reply string, error string")
    return out.select("row.*", "reply", "error")


def verdicts(replies: DataFrame, reply: str = "reply", field: str = "ok") -> DataFrame:
    """The rows with `verdict`: the boolean `field` of a JSON reply, null if it cannot be read (the callers' fail rules decide)."""
    return replies.withColumn("verdict", F.get_json_object(F.col(f"`{reply}`"), f"$.{field}").try_cast("boolean"))
