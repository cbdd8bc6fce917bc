"""External models as table functions: requests by key, answered from a table of responses, the rest asked in batches.

A client is any object that can be pickled and has answer(list[str]) -> list[str | None]; None is a failure and is not
kept. Without a client only the kept responses answer."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Client(Protocol):
    def answer(self, payloads: list[str]) -> list[str | None]: ...


# How often each kind of failure is borne in one request; each kind has a budget of its own.
BUDGETS = {"bad response": 4, "connection": 12, "timeout": 3}
LONGEST_WAIT = 60.0  # seconds


class BadResponse(Exception):
    """A reply that can't be used."""


def parsed(reply: str) -> Any:
    """The JSON of a reply, without a code fence around it; BadResponse if it holds none."""
    body = reply.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        return json.loads(body)
    except ValueError as e:
        raise BadResponse(str(e)) from e


def ask(call: Callable[[str], str], payload: str, budgets: dict[str, int] | None = None, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The parsed reply to one request. A failure is tried again after 1, 2, 4 ... seconds while the budget of its kind
    lasts; then it is raised. Other errors are raised at once."""
    left = dict(BUDGETS if budgets is None else budgets)
    tries = 0
    while True:
        try:
            return parsed(call(payload))
        except (BadResponse, ConnectionError, TimeoutError) as e:
            kind = "bad response" if isinstance(e, BadResponse) else "timeout" if isinstance(e, TimeoutError) else "connection"
            left[kind] -= 1
            if left[kind] <= 0:
                raise
            sleep(min(LONGEST_WAIT, 2.0**tries))
            tries += 1


class RetryingClient:
    """A client around one call for one payload; replies are JSON texts, requests whose budget is used up have none."""

    def __init__(self, call: Callable[[str], str], budgets: dict[str, int] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.call, self.budgets, self.sleep = call, budgets, sleep

    def answer(self, payloads: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in payloads:
            try:
                out.append(json.dumps(ask(self.call, p, self.budgets, self.sleep), ensure_ascii=False))
            except (BadResponse, ConnectionError, TimeoutError):
                out.append(None)
        return out


def with_keys(requests: DataFrame, payload: str = "payload") -> DataFrame:
    return requests.withColumn("request_id", F.sha2(F.col(payload), 256))


def answered(requests: DataFrame, responses: DataFrame, client: Client | None = None, in_flight: int = 8, tries: int = 3) -> DataFrame:
    """request_id, response for the requests (request_id, payload): kept responses first; open ones are asked, each
    distinct request once, in no more than `in_flight` tasks at a time."""
    kept = requests.join(responses, "request_id", "left_semi").select("request_id").join(responses, "request_id").select("request_id", "response")
    if client is None:
        return kept
    todo = requests.join(responses.select("request_id"), "request_id", "left_anti").select("request_id", "payload").dropDuplicates(["request_id"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            left, got = f, []
            for _ in range(tries):
                if not len(left):
                    break
                answers = pd.Series(client.answer(left["payload"].tolist()), index=left.index, dtype=object)
                done = answers.notna()
                got.append(pd.DataFrame({"request_id": left["request_id"][done], "response": answers[done].astype(str)}))
                left = left[~done]
            yield pd.concat(got) if got else pd.DataFrame({"request_id": [], "response": []})

    return kept.unionByName(todo.coalesce(in_flight).mapInPandas(run, "request_id string, response string"))
