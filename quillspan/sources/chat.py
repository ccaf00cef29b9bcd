"""Model answers from a chat server, for a table of prompts.

One request a row, made inside tasks; a client is made once a task. A failed request gives
a row with its error, so that one failure never fails the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = (
    "content string, done boolean, total_duration_s double, load_duration_s double, prompt_eval_duration_s double, "
    "eval_duration_s double, prompt_tokens bigint, completion_tokens bigint, error string"
)
NAMES = [c.split(" ")[0] for c in COLUMNS.split(", ")]


class Client(Protocol):
    def ask(self, prompt: str) -> dict: ...


def host_of(text: str) -> str:
    """A server address with its scheme and without a slash at the end."""
    text = text.strip().rstrip("/")
    return text if text.startswith(("http://", "https://")) else f"http://{text}"


def seconds(nanoseconds: float | None) -> float | None:
    return None if nanoseconds is None else nanoseconds / 1e9


@dataclass
class HttpClient:
    """Chat by JSON over HTTP: ``messages`` in, a message and usage counts out."""

    host: str
    model: str
    openai: bool = True
    timeout: float = 300.0
    schema: dict | None = None

    def ask(self, prompt: str) -> dict:
        body: dict = {"model": self.model, "stream": False, "messages": [{"role": "user", "content": prompt}]}
        if self.openai:
            body |= {"temperature": 0}
            if self.schema:
                body["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "schema": self.schema}}
        elif self.schema:
            body["format"] = self.schema
        path = "/v1/chat/completions" if self.openai else "/api/chat"
        request = Request(host_of(self.host) + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urlopen(request, timeout=self.timeout) as answer:
            return self.read(json.load(answer))

    def read(self, got: dict) -> dict:
        if self.openai:
            choice, usage = got["choices"][0], got.get("usage") or {}
            return {
                "content": choice["message"]["content"], "done": choice.get("finish_reason") == "stop",
                "prompt_tokens": usage.get("prompt_tokens"), "completion_tokens": usage.get("completion_tokens"),
            }
        return {
            "content": got["message"]["content"], "done": got.get("done"),
            **{f"{k}_s": seconds(got.get(k)) for k in ("total_duration", "load_duration", "prompt_eval_duration", "eval_duration")},
            "prompt_tokens": got.get("prompt_eval_count"), "completion_tokens": got.get("eval_count"),
        }


def generated(prompts: DataFrame, key: str, prompt: str, factory: Callable[[], Client]) -> DataFrame:
    """``key``, answer, timings, token counts and error of each prompt; null prompts are errors."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for batch in batches:
            rows = []
            for k, text in batch.itertuples(index=False):
                try:
                    rows.append({"_k": k, **client.ask(text)})
                except Exception as e:
                    rows.append({"_k": k, "error": f"{type(e).__name__}: {e}"})
            every = [[r.get(c) for c in ("_k", *NAMES)] for r in rows]
            yield pd.DataFrame(every, columns=["_k", *NAMES], dtype=object)

    rows = prompts.selectExpr(f"`{key}` as _k", f"`{prompt}` as _p")
    return rows.mapInPandas(run, f"_k {kind}, {COLUMNS}").withColumnRenamed("_k", key)
