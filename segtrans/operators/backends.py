"""Translation backends: the one place where opaque code meets the segments.

A backend either is a column expression (``as_column``), and then never leaves
the JVM, or takes batches of texts inside Python workers (``translate_batch``).
"""

from __future__ import annotations

import http.client
import json
import os
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_translatable
from .filters import share

OK = "ok"
FAILED = "failed"
API_ERROR = "api_error"

TASKS_PER_CORE = 4  # where calls run in threads
CALLS_PER_TASK = 10_000  # there, so many are repeated if a task is lost
OUTCOMES = 64  # calls whose results leave a task together
RESULT_SCHEMA = "translation string, status string, attempts int, error string"


@dataclass(frozen=True)
class Result:
    translation: str | None
    status: str = OK
    attempts: int = 1
    error: str | None = None


class Backend:
    """Extension point; ``name`` is part of the memory key."""

    name = "backend"
    texts_per_call = 1  # where calls run in threads or at a rate

    def translate_batch(self, texts: list[str], src: str, tgt: str) -> list[Result]:
        raise NotImplementedError

    def as_column(self, text: Column, src: Column, tgt: Column) -> Column | None:
        """The translation as an expression, for backends that have one."""
        return None


class MockBackend(Backend):
    """``[MOCK:<target>] <text>``; blank text is returned as it is."""

    name = "mock"

    def as_column(self, text: Column, src: Column, tgt: Column) -> Column:
        marked = F.concat(F.lit("[MOCK:"), tgt, F.lit("] "), text)
        return F.when(is_translatable(text), marked).otherwise(text)

    def translate_batch(self, texts, src, tgt):
        return [Result(f"[MOCK:{tgt}] {t}" if t.strip() else t) for t in texts]


# --------------------------------------------------------------------- retry


class Retryable(Exception):
    """A failure another attempt may cure."""


class ApiError(Exception):
    """The service answered, and its answer is a refusal: never retried."""


@dataclass(frozen=True)
class RetryPolicy:
    attempts: int = 3
    delay: float = 2.0
    growth: str = "linear"  # or "exponential"

    def wait(self, attempt: int) -> float:
        return self.delay * (attempt if self.growth == "linear" else 2 ** (attempt - 1))


def with_retry(call: Callable[[], str], policy: RetryPolicy = RetryPolicy(),
               sleep: Callable[[float], None] = time.sleep) -> Result:
    """Run one call under the policy; the outcome is a value, never a raise."""
    error = None
    for attempt in range(1, policy.attempts + 1):
        try:
            return Result(call(), OK, attempt)
        except ApiError as exc:
            return Result(None, API_ERROR, attempt, str(exc))
        except Retryable as exc:
            error = str(exc)
            sleep(policy.wait(attempt))
    return Result(None, FAILED, policy.attempts, error)


# ---------------------------------------------------------------------- http


@dataclass(frozen=True)
class HttpReply:
    status: int
    body: str


class TransportTimeout(Exception):
    pass


class TransportError(Exception):
    pass


def urllib_transport(url: str, payload: dict, headers: dict, timeout: float) -> HttpReply:
    """POST with the standard library."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return HttpReply(reply.status, reply.read().decode())
    except urllib.error.HTTPError as exc:
        return HttpReply(exc.code, exc.read().decode(errors="replace"))
    except TimeoutError as exc:
        raise TransportTimeout(str(exc)) from exc
    except (http.client.HTTPException, UnicodeDecodeError) as exc:
        raise TransportError(f"broken reply: {exc!r}") from exc
    except OSError as exc:
        if isinstance(getattr(exc, "reason", None), TimeoutError):
            raise TransportTimeout(str(exc)) from exc
        raise TransportError(str(exc)) from exc


class KeptConnections:
    """A transport that keeps one connection per thread and address, and opens another when it breaks.

    A request that finds its kept connection closed is sent once more on a new one.
    """

    def __init__(self):
        self._own: threading.local | None = None

    def __getstate__(self) -> dict:
        return {"_own": None}  # connections do not travel

    def _connections(self) -> dict:
        if self._own is None:
            self._own = threading.local()
        return self._own.__dict__

    def __call__(self, url: str, payload: dict, headers: dict, timeout: float) -> HttpReply:
        parts = urlsplit(url)
        kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        kept, key = self._connections(), f"{parts.scheme}://{parts.netloc}"
        for again in (key in kept, False):
            connection = kept.setdefault(key, None) or kind(parts.netloc, timeout=timeout)
            kept[key] = connection
            try:
                connection.request("POST", path, json.dumps(payload).encode(), headers)
                reply = connection.getresponse()
                return HttpReply(reply.status, reply.read().decode(errors="strict" if reply.status < 400 else "replace"))
            except (OSError, http.client.HTTPException, UnicodeDecodeError) as exc:
                connection.close()
                del kept[key]
                if again and isinstance(exc, (http.client.RemoteDisconnected, BrokenPipeError, ConnectionResetError)):
                    continue
                if isinstance(exc, TimeoutError):
                    raise TransportTimeout(str(exc)) from exc
                raise TransportError(f"broken reply: {exc!r}") from exc
        raise AssertionError("not reached")


# Statuses always worth another attempt, marker of a good reply.
RETRY_STATUSES = (429, 503)
SUCCESS = "SUCCESS"
NOT_TEXT = "refused: the output is not text"
REPLY_SCHEMA = "message_type string, output string, message string"


def parse_reply(body: str) -> str:
    data = json.loads(body)
    if data.get("message_type") != SUCCESS:
        raise ApiError(f"refused: {data.get('message') or 'no reason given'}")
    if not isinstance(data["output"], str):
        raise ApiError(NOT_TEXT)
    return data["output"]


def parse_response(body: Column) -> Column:
    """Logged reply bodies to ``(translation, status, error)``, as a column."""
    reply = F.from_json(body, REPLY_SCHEMA)
    success = F.coalesce(reply["message_type"] == SUCCESS, F.lit(False))
    # A number is read as its digits; only a quoted value is text.
    is_text = F.coalesce(body.rlike(r'"output"\s*:\s*"'), F.lit(False))
    good = success & is_text
    message = F.coalesce(reply["message"], F.lit("no reason given"))
    return F.struct(
        F.when(good, reply["output"]).alias("translation"),
        F.when(good, F.lit(OK)).otherwise(F.lit(API_ERROR)).alias("status"),
        F.when(success & ~is_text, F.lit(NOT_TEXT))
        .when(~success, F.concat(F.lit("refused: "), message)).alias("error"),
    )


class HttpBackend(Backend):
    """JSON over POST with a bearer token.

    Only the *name* of the token's environment variable travels in the plan;
    the token is read in the worker (or ``auth`` called there). ``transport`` and
    ``sleep`` are injected, so tests need neither a network nor patience.
    """

    def __init__(self, url: str, *, token_env: str = "TRANSLATION_API_TOKEN", name: str = "http",
                 timeout: float = 10.0, policy: RetryPolicy = RetryPolicy(),
                 retry_client_errors: bool = True, transport=urllib_transport, sleep=time.sleep,
                 auth: Callable[[], dict] | None = None):
        self.url, self.token_env, self.name = url, token_env, name
        self.timeout, self.policy = timeout, policy
        self.retry_client_errors = retry_client_errors
        self.transport, self.sleep, self.auth = transport, sleep, auth

    def _headers(self) -> dict:
        if self.auth is not None:
            return self.auth()
        token = os.environ.get(self.token_env)
        if not token:
            raise RuntimeError(f"environment variable {self.token_env} is not set on the worker")
        return {"Authorization": f"Bearer {token}", "Content-Type": "application/json"}

    def _call(self, text: str, src: str, tgt: str, headers: dict) -> str:
        payload = {"text": text, "src_lang": src, "tgt_lang": tgt}
        try:
            reply = self.transport(self.url, payload, headers, self.timeout)
        except TransportTimeout as exc:
            raise Retryable("request timed out") from exc
        except TransportError as exc:
            raise Retryable("connection error") from exc
        if reply.status in RETRY_STATUSES or reply.status >= 500:
            raise Retryable(f"HTTP {reply.status}")
        if reply.status >= 400:
            if self.retry_client_errors:
                raise Retryable(f"HTTP {reply.status}")
            raise ApiError(f"HTTP {reply.status}")
        try:
            return parse_reply(reply.body)
        except json.JSONDecodeError as exc:
            raise Retryable("reply is not JSON") from exc
        except (KeyError, AttributeError) as exc:
            raise ApiError(f"malformed reply: {exc!r}") from exc

    def translate_batch(self, texts, src, tgt):
        headers = self._headers()
        return [
            Result(t) if not t.strip()
            else with_retry(lambda t=t: self._call(t, src, tgt, headers), self.policy, self.sleep)
            for t in texts
        ]


def make_backend(backend: str | Backend = "mock") -> Backend:
    if isinstance(backend, Backend):
        return backend
    if backend == "mock":
        return MockBackend()
    raise ValueError(f"unknown backend {backend!r}: pass 'mock' or a Backend instance")


# ------------------------------------------------------------------ execution


def run_backend(segments: DataFrame, backend: Backend, parallel_calls: int | None = None,
                batch_size: int = 256, *, texts: int | None = None,
                calls_per_second: float | None = None) -> DataFrame:
    """Translate each row of ``(src_lang, tgt_lang, segment, ...)`` once.

    A column backend stays in the JVM. For any other, ``parallel_calls`` is the
    ceiling on concurrent calls (by default the cores of the cluster). Beyond the
    cores each task keeps a window of calls going in threads: as one ends the next
    begins, so a slow text holds up no other. ``texts``, where known, sets the
    number of tasks, so that a lost task repeats ``CALLS_PER_TASK`` calls at most.
    Up to the cores, the number of partitions is the ceiling. A partition is a
    range of the hash of its texts, hence the same after a retry, and even because
    texts are distinct. ``calls_per_second`` is shared out among the tasks that
    can run at once.
    """
    text, src, tgt = F.col("segment"), F.col("src_lang"), F.col("tgt_lang")
    expr = backend.as_column(text, src, tgt)
    if expr is not None:
        return segments.select(
            "*",
            expr.alias("translation"), F.lit(OK).alias("status"), F.lit(1).alias("attempts"),
            F.lit(None).cast("string").alias("error"),
        )

    cores = segments.sparkSession.sparkContext.defaultParallelism
    ceiling = parallel_calls or cores
    threads = max(1, ceiling // cores)
    tasks = ceiling if ceiling <= cores else max(cores * TASKS_PER_CORE, -(-(texts or 0) // CALLS_PER_TASK))
    segments = segments.repartitionById(tasks, share(tasks))
    pause = min(tasks, cores) / calls_per_second if calls_per_second else 0.0
    size = batch_size if threads == 1 and not pause else backend.texts_per_call

    def translate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            def begin(rows: pd.DataFrame) -> Future:
                src, tgt = rows["src_lang"].iloc[0], rows["tgt_lang"].iloc[0]
                return pool.submit(backend.translate_batch, rows["segment"].tolist(), src, tgt)

            for done in windowed(calls_of(batches, size), begin, threads, pause):
                yield pd.concat([_with_results(rows, results) for rows, results in done], ignore_index=True)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields)
    return segments.mapInPandas(translate, f"{columns}, {RESULT_SCHEMA}")


def calls_of(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The rows of one call each: up to ``size``, of one direction."""
    for batch in batches:
        for _, rows in batch.groupby(["src_lang", "tgt_lang"], sort=False):
            for at in range(0, len(rows), size):
                yield rows.iloc[at:at + size]


def windowed(calls: Iterator, begin: Callable[..., Future], most: int, pause: float = 0.0,
             clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[list]:
    """Lists of ``(call, result)`` as they end; never more than ``most`` under way, ``pause`` seconds between two beginnings."""
    under_way: dict[Future, Any] = {}
    due, out = clock(), []
    for call in calls:
        if pause:
            sleep(max(0.0, due - clock()))
            due = max(due, clock()) + pause
        if len(under_way) >= most:
            ended, _ = wait(under_way, return_when=FIRST_COMPLETED)
            out += [(under_way.pop(f), f.result()) for f in ended]
        under_way[begin(call)] = call
        if len(out) >= OUTCOMES:
            yield out
            out = []
    out += [(call, f.result()) for f, call in under_way.items()]
    if out:
        yield out


def _with_results(rows: pd.DataFrame, results: list[Result]) -> pd.DataFrame:
    if len(results) != len(rows):
        raise RuntimeError("backend returned another number of results than texts")
    return rows.assign(
        translation=[r.translation for r in results], status=[r.status for r in results],
        attempts=[r.attempts for r in results], error=[r.error for r in results])
