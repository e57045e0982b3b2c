"""Retry, replies and the policies on failure."""

import http.client
import json
import sys

import pytest
from pyspark.sql import functions as F

from segtrans.operators import backends as b
from segtrans.operators.memory import TranslationFailed, TranslationMemory
from segtrans.plans.tables import translate_table
from segtrans.session import ship_by_value
from workload.service import no_wait, rule_backend


def backend(replies, **options):
    """An HTTP backend whose service gives these replies one after the other."""
    left, waits = list(replies), []

    def transport(url, payload, headers, timeout):
        reply = left.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    made = b.HttpBackend("https://translation.invalid/", transport=transport, sleep=waits.append,
                         auth=dict, **options)
    return made, left, waits


def good(output="नमस्ते"):
    return b.HttpReply(200, json.dumps({"message_type": "SUCCESS", "output": output}))


@pytest.mark.parametrize("text,src,tgt,want", [
    ("Hello", "en", "ne", "[MOCK:ne] Hello"), ("नमस्ते", "ne", "en", "[MOCK:en] नमस्ते"),
    ("Hello", "en", "tmg", "[MOCK:tmg] Hello"), ("   ", "en", "ne", "   "),
])
def test_mock_in_python_and_as_column(spark, text, src, tgt, want):
    mock = b.MockBackend()
    assert mock.translate_batch([text], src, tgt)[0].translation == want
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(mock.as_column(F.col("t"), F.lit(src), F.lit(tgt)).alias("x")).first().x == want


@pytest.mark.parametrize("first", [
    b.HttpReply(429, ""), b.HttpReply(503, ""), b.HttpReply(500, ""), b.HttpReply(404, ""),
    b.HttpReply(200, "<html>"), b.TransportTimeout(), b.TransportError(),
])
def test_second_attempt_after(first):
    made, left, waits = backend([first, good()])
    assert made.translate_batch(["Hello"], "en", "ne") == [b.Result("नमस्ते", b.OK, 2)]
    assert waits == [2.0] and not left


def test_three_attempts_then_failed():
    made, left, waits = backend([b.HttpReply(503, "")] * 3)
    result = made.translate_batch(["Hello"], "en", "ne")[0]
    assert (result.status, result.attempts, result.translation) == (b.FAILED, 3, None)
    assert waits == [2.0, 4.0, 6.0] and "503" in result.error


def test_exponential_wait():
    policy = b.RetryPolicy(attempts=4, delay=1.0, growth="exponential")
    assert [policy.wait(n) for n in (1, 2, 3, 4)] == [1, 2, 4, 8]


def test_refusal_is_not_retried():
    refused = b.HttpReply(200, json.dumps({"message_type": "ERROR", "message": "no"}))
    made, left, waits = backend([refused, good()])
    result = made.translate_batch(["Hello"], "en", "ne")[0]
    assert (result.status, result.attempts) == (b.API_ERROR, 1) and "no" in result.error
    assert len(left) == 1 and waits == []


def test_client_error_can_fail_at_once():
    made, left, _ = backend([b.HttpReply(400, ""), good()], retry_client_errors=False)
    assert made.translate_batch(["Hello"], "en", "ne")[0].status == b.API_ERROR and len(left) == 1


def test_blank_text_makes_no_call():
    made, left, _ = backend([])
    assert made.translate_batch(["  "], "en", "ne")[0].translation == "  "


def test_token_is_read_in_the_worker(monkeypatch):
    seen = {}

    def transport(url, payload, headers, timeout):
        seen.update(headers=headers, payload=payload, timeout=timeout)
        return good()

    made = b.HttpBackend("https://translation.invalid/", token_env="SOME_TOKEN", transport=transport)
    with pytest.raises(RuntimeError):
        made.translate_batch(["Hello"], "en", "ne")
    monkeypatch.setenv("SOME_TOKEN", "secret")
    made.translate_batch(["Hello"], "en", "ne")
    assert seen["headers"]["Authorization"] == "Bearer secret" and seen["timeout"] == 10
    assert seen["payload"] == {"text": "Hello", "src_lang": "en", "tgt_lang": "ne"}
    assert "secret" not in str(made.__dict__)


def test_make_backend():
    assert isinstance(b.make_backend(), b.MockBackend)
    made = rule_backend()
    assert b.make_backend(made) is made
    with pytest.raises(ValueError):
        b.make_backend("real")


TEXTS = ["abcde", "abcdef", "abcdefg", "abcdefgh", "abcdefghi"]


def test_fail_policy_keeps_the_good_rows(spark, strings, tmp_path):
    memory = TranslationMemory(spark, str(tmp_path / "memory"))
    with pytest.raises(TranslationFailed, match="2 segments failed"):
        translate_table(strings(TEXTS), "en", "ne", backend=rule_backend(), memory=memory)
    assert {r.segment for r in memory.read("rule").collect()} == set(TEXTS[:3])
    assert {r.status for r in memory.failures().collect()} == {"failed", "api_error"}
    # A later run asks only for what is missing, and can get by without it.
    out = translate_table(strings(TEXTS), "en", "ne", backend=rule_backend(), memory=memory,
                          on_error="source")
    assert [r.v for r in out.collect()] == ["[ne] abcde", "[ne] abcdef", "[ne] abcdefg", *TEXTS[3:]]


def test_fail_policy_without_memory(strings):
    with pytest.raises(TranslationFailed):
        translate_table(strings(TEXTS), "en", "ne", backend=rule_backend())


def test_no_wait_is_silent():
    assert no_wait(1.0) is None


@pytest.mark.parametrize("output", [None, 5, ["x"]])
def test_only_text_is_a_translation(spark, output):
    body = json.dumps({"message_type": "SUCCESS", "output": output})
    made, _, _ = backend([b.HttpReply(200, body)])
    [result] = made.translate_batch(["Hello"], "en", "ne")
    assert (result.translation, result.status, result.attempts) == (None, b.API_ERROR, 1)
    row = spark.createDataFrame([(body,)], "body string").select(b.parse_response(F.col("body")).alias("r")).first().r
    assert (row.translation, row.status, row.error) == (None, b.API_ERROR, b.NOT_TEXT)


@pytest.mark.parametrize("error", [http.client.IncompleteRead(b"x"), UnicodeDecodeError("utf-8", b"x", 0, 1, "bad"),
                                   http.client.BadStatusLine("x"), ConnectionResetError()])
def test_every_transport_error_is_tried_again(monkeypatch, error):
    def broken(*args, **options):
        raise error

    monkeypatch.setattr(b.urllib.request, "urlopen", broken)
    made = b.HttpBackend("https://translation.invalid/", sleep=no_wait, auth=dict)
    [result] = made.translate_batch(["Hello"], "en", "ne")
    assert (result.status, result.attempts) == (b.FAILED, 3)


class Slow(b.Backend):
    """Notes how many calls of its process are under way at once."""

    name = "slow"

    def translate_batch(self, texts, src, tgt):
        import threading
        import time

        state = threading.__dict__.setdefault("_slow_calls", {"now": 0, "lock": threading.Lock()})
        out = []
        for text in texts:
            with state["lock"]:
                state["now"] += 1
                most = state["now"]
            time.sleep(0.05)
            with state["lock"]:
                state["now"] -= 1
            out.append(b.Result(f"{most}"))
        return out


def test_several_calls_to_a_task_and_never_beyond_the_ceiling(spark, strings):
    ship_by_value(sys.modules[__name__])
    cores = spark.sparkContext.defaultParallelism
    segments = strings([f"text {i}" for i in range(400)], "segment").selectExpr(
        "'en' src_lang", "'ne' tgt_lang", "segment", "1L uses")
    for ceiling, most in ((cores * 4, 4), (2, 1)):
        done = b.run_backend(segments, Slow(), ceiling)
        assert done.rdd.getNumPartitions() == (cores * b.TASKS_PER_CORE if most > 1 else 2)
        at_once = {int(r.translation) for r in done.collect()}
        assert max(at_once) == most


class Uneven(b.Backend):
    """One text takes long; each tells when it was done."""

    name = "uneven"

    def translate_batch(self, texts, src, tgt):
        import time

        time.sleep(3 if texts == ["slow"] else 0.02)
        return [b.Result(str(time.time())) for _ in texts]


def test_a_slow_text_delays_no_other(spark, strings):
    ship_by_value(sys.modules[__name__])
    cores = spark.sparkContext.defaultParallelism
    texts = strings(["slow", *(f"text {i}" for i in range(300))], "segment").coalesce(1).selectExpr(
        "'en' src_lang", "'ne' tgt_lang", "segment", "1L uses")
    done = {r.segment: float(r.translation) for r in b.run_backend(texts, Uneven(), 2 * cores).collect()}
    late = done.pop("slow")
    assert len(done) == 300 and all(t < late - 1 for t in done.values())


def test_as_many_tasks_as_texts_need(spark, strings):
    cores = spark.sparkContext.defaultParallelism
    texts = strings(["a"], "segment").selectExpr("'en' src_lang", "'ne' tgt_lang", "segment")
    many = b.run_backend(texts, Uneven(), 2 * cores, texts=10**6)
    assert many.rdd.getNumPartitions() == 10**6 // b.CALLS_PER_TASK


def test_window_and_rate():
    from concurrent.futures import Future

    under_way, most, began, now = [], [], [], [0.0]

    def begin(call):
        future = Future()
        under_way.append(future)
        most.append(sum(not f.done() for f in under_way))
        began.append(now[0])
        if len(under_way) % 3 == 0:  # every third call ends those before it
            for f in under_way:
                if not f.done():
                    f.set_result(call)
        return future

    got = [c for part in b.windowed(iter(range(9)), begin, 3, 0.5, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s)) for c, _ in part]
    assert sorted(got) == list(range(9)) and max(most) == 3
    assert began == [0.5 * i for i in range(9)]


def test_connections_are_kept_and_opened_anew(monkeypatch):
    import pickle

    opened, script = [], []

    class Reply:
        def __init__(self, status, body):
            self.status, self.body = status, body

        def read(self):
            return self.body

    class Connection:
        def __init__(self, address, timeout):
            opened.append(address)

        def request(self, method, path, body, headers):
            assert method == "POST" and path == "/v1?x=1"

        def getresponse(self):
            step = script.pop(0)
            if isinstance(step, Exception):
                raise step
            return Reply(*step)

        def close(self):
            pass

    monkeypatch.setattr(b.http.client, "HTTPSConnection", Connection)
    transport = pickle.loads(pickle.dumps(b.KeptConnections()))

    def send():
        return transport("https://service.invalid/v1?x=1", {"text": "a"}, {}, 5)

    script[:] = [(200, b"one"), (429, b"\xff"), (200, b"two")]
    assert [send().body for _ in range(3)] == ["one", "\ufffd", "two"] and len(opened) == 1
    script[:] = [http.client.RemoteDisconnected("idle"), (200, b"three")]
    assert send().body == "three" and len(opened) == 2  # a kept connection had been closed
    for error, kind in ((TimeoutError("t"), b.TransportTimeout), (ConnectionRefusedError(), b.TransportError),
                        (http.client.BadStatusLine("x"), b.TransportError)):
        script[:] = [error]
        with pytest.raises(kind):
            send()
    script[:] = [http.client.RemoteDisconnected("new one, too")]
    with pytest.raises(b.TransportError):
        send()
