"""Connectors to external models: an HTTP parser, chat models by name, message formats, rate limits and retries.

Everything that leaves the machine goes through an injected ``post`` or client, so
that tests and offline runs use stubs. Connectors are made on the executors, one per task.
"""

from __future__ import annotations

import asyncio
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Awaitable, Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Providers by model name, the parser's model, and limits of requests (number, seconds).
PROVIDERS = {
    "gpt-3.5-turbo": "openai", "gpt-4o": "openai", "gpt-4o-mini": "openai", "gpt-4": "openai", "sabia-3": "openai", "deepseek-chat": "deepseek",
    "deepseek-reasoner": "deepseek", "gemini-2.5-pro": "gemini", "gemini-2.5-flash": "gemini", "gemini-2.0-flash": "gemini", "gemini-1.5-flash": "gemini",
    "gemini-2.0": "gemini", "gemini-1.5": "gemini",
}
PARSER_MODEL = "portuguese-bosque-ud-2.12-230717"
LIMITS = {"gemini": (150, 60.0)}

Post = Callable[[str, dict[str, str], float], tuple[int, str]]
AsyncClient = Callable[[dict[str, Any], list[dict[str, str]]], Awaitable[str]]


class RequestFailed(RuntimeError):
    """A request failed for good; ``kind`` is timeout, request or generic."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def http_post(url: str, form: dict[str, str], timeout: float) -> tuple[int, str]:
    """Status and body of a form sent by POST."""
    try:
        with urllib.request.urlopen(url, urllib.parse.urlencode(form).encode(), timeout=timeout) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def kind_of(error: Exception) -> str:
    if isinstance(error, TimeoutError | asyncio.TimeoutError):
        return "timeout"
    return "request" if isinstance(error, OSError) else "generic"


def retried(work: Callable[[], Any], attempts: int = 3, delay: float = 5.0, pause: Callable[[float], None] = time.sleep) -> Any:
    """What ``work`` returns, tried several times; the last error is raised with its kind."""
    for attempt in range(1, attempts + 1):
        try:
            return work()
        except Exception as e:  # an external service may fail in any way
            if attempt == attempts:
                raise RequestFailed(kind_of(e), f"{kind_of(e)} after {attempts} attempts: {e}") from e
            pause(delay)
    raise ValueError("at least one attempt is needed")


def parser(url: str, model: str = PARSER_MODEL, post: Post = http_post, attempts: int = 3, delay: float = 5.0, timeout: float = 30.0) -> Callable[[], Callable[[str], str]]:
    """A connector to an HTTP service that tokenises, tags and parses a text into CoNLL-U."""

    def connect() -> Callable[[str], str]:
        def once(text: str) -> str:
            status, body = post(url, {"tokenizer": "", "tagger": "", "parser": "", "model": model, "data": text}, timeout)
            if status != 200:
                raise RuntimeError(f"HTTP status {status}: {body[:200]}")
            found = json.loads(body)
            if "result" not in found:
                raise RuntimeError("the answer has no result")
            return found["result"]

        return lambda text: retried(lambda: once(text), attempts, delay)

    return connect


def _content(x: Any) -> str:
    """The text of a message's content: a string, or a list whose first part has a text."""
    if isinstance(x, str):
        return x
    if isinstance(x, list | tuple) and x:
        first = x[0]
        return str(first.get("text", first) if isinstance(first, dict) else getattr(first, "text", first))
    return str(x)


def normalised(messages: Any) -> list[dict[str, str]]:
    """Messages of any accepted form (list, object, dict, text) as a list of role and content."""
    if isinstance(messages, list | tuple):
        return [one for m in messages for one in normalised(m)] if messages else []
    if isinstance(messages, dict):
        return [{"role": str(messages.get("role", "user")), "content": _content(messages.get("content", ""))}]
    if hasattr(messages, "content"):
        return [{"role": str(getattr(messages, "role", "user")), "content": _content(messages.content)}]
    return [{"role": "user", "content": str(messages)}]


class Registry:
    """Clients by model name; each provider's client is made once, from its first key."""

    def __init__(self, makers: dict[str, Callable[[str], AsyncClient]], keys: dict[str, list[str]], providers: dict[str, str] = PROVIDERS):
        self.makers, self.keys, self.providers, self.made = makers, keys, providers, {}

    def client(self, model: str) -> AsyncClient:
        provider = self.providers.get(model)
        if provider is None or provider not in self.makers:
            raise ValueError(f"no provider for model {model}")
        if provider not in self.made:
            if not self.keys.get(provider):
                raise ValueError(f"no key for {provider}")
            self.made[provider] = self.makers[provider](self.keys[provider][0])
        return self.made[provider]


class Limiter:
    """At most ``number`` requests in any ``seconds``, for all coroutines of a task."""

    def __init__(self, number: int, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.number, self.seconds, self.clock, self.starts = number, seconds, clock, []

    async def __aenter__(self) -> None:
        while True:
            now = self.clock()
            self.starts = [t for t in self.starts if now - t < self.seconds]
            if len(self.starts) < self.number:
                self.starts.append(now)
                return
            await asyncio.sleep(self.starts[0] + self.seconds - now)

    async def __aexit__(self, *_: object) -> None:
        return None


def share(number: int, tasks: int, part: int) -> int:
    """The requests of a limit that fall to one of ``tasks`` parts; together they are ``number``."""
    return number // tasks + (part < number % tasks)


def asked(items: DataFrame, message: str, model: str, connect: Callable[[], Registry], config: tuple[str, ...] = (), times: str | None = None, concurrency: int = 6, tasks: int = 1, limits: dict[str, tuple[int, float]] = LIMITS, into: str = "response") -> DataFrame:
    """Chat models' responses: a row per item and response, and one with an error for an item without any.

    Each task has at most ``concurrency`` items in flight; an item asks ``times``
    responses (a column; one if absent) at once. Failed ones are dropped, and an
    item whose responses all fail becomes a row with the last error. Finished batches
    are committed with their task, so that a stopped run resumes by ``enrich.pending``.

    One rate limit for all tasks: items are dealt to ``tasks`` partitions, fewer if a
    limit allows fewer requests than that, however they were dealt before, and each
    partition has its own share of every limit. There is one task per share, so together
    they keep the limit wherever they run. A task that is tried again first lets a
    window pass, as the attempt before may have used its share.
    """
    tasks = max(1, min([tasks, *(number for number, _ in limits.values())]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        registry, shared, part = connect(), {}, context.partitionId()
        if context.attemptNumber() and limits:
            time.sleep(max(seconds for _, seconds in limits.values()))

        async def one(slot: asyncio.Semaphore, row: dict[str, Any]) -> list[tuple[str | None, str | None]]:
            async with slot:
                try:
                    client = registry.client(row[model])
                except ValueError as e:
                    return [(None, str(e))]
                provider = registry.providers[row[model]]
                number, seconds = limits.get(provider, (10**9, 1.0))
                limiter = shared.setdefault(provider, Limiter(share(number, tasks, part), seconds))

                async def once() -> str:
                    async with limiter:
                        return await client({"model": row[model]} | {c: row[c] for c in config}, normalised(row[message]))

                n = int(row[times]) if times else 1
                found = await asyncio.gather(*[once() for _ in range(n)], return_exceptions=True)
                good = [(x, None) for x in found if isinstance(x, str)]
                bad = [f"{type(x).__name__}: {x}" for x in found if isinstance(x, BaseException)]
                return good or ([(None, bad[-1] if bad else "no response")] if n > 0 else [])

        async def all_of(rows: list[dict[str, Any]]) -> list[list[tuple[str | None, str | None]]]:
            slot = asyncio.Semaphore(concurrency)
            return await asyncio.gather(*[one(slot, r) for r in rows])

        for pdf in batches:
            answers = asyncio.run(all_of(pdf.to_dict("records")))
            at = [i for i, a in enumerate(answers) for _ in a]
            flat = [x for a in answers for x in a]
            yield pdf.iloc[at].assign(**{into: [x for x, _ in flat], "error": [e for _, e in flat]})

    return items.repartition(tasks).mapInPandas(run, f"{fields}, `{into}` string, error string")


def counters(called: DataFrame) -> DataFrame:
    """How many rows succeeded and failed."""
    from pyspark.sql import functions as F

    return called.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))
